"""A table with one row a key in buckets of files, changed a few buckets at a time."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rulemill.operators.ingest import last_per_key
from rulemill.sources import paths

BUCKETS, SEGMENTS = 64, 8


class KeyedStore:
    """Files are in `path`/data/seg=<number>/bucket=<number>; which of them count, a manifest says:
    `path`/manifests/<version>.json with the segments of each bucket, old ones first. Of several manifests
    that with the highest version holds. A writer first writes its files and then publishes the next
    manifest by a rename, so a reader sees all of a change or nothing of it, and a writer that dies
    in between leaves files that no manifest names. One writer at a time; its manifest is
    refused if another's has come before. The manifest has at most `segments` entries a bucket, whatever the number of
    changes.

    `schema` has the column `key`; `order` are the columns by which the last of several rows of a key is told.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, order: tuple[str, ...] = (), buckets: int = BUCKETS, segments: int = SEGMENTS):
        self.spark, self.path, self.key, self.order, self.segments = spark, path.rstrip("/"), key, order, segments
        self.schema = spark.createDataFrame([], schema).schema
        known = self.manifest()
        self.buckets = known["count"] if known["version"] else buckets

    def manifest(self) -> dict:
        """version, count (of buckets), and the segments of each bucket as [segment, epoch]."""
        found = [n for n in paths.names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        if not found:
            return {"version": 0, "count": 0, "buckets": {}}
        return json.loads(paths.read_text(self.spark, f"{self.path}/manifests/{found[-1]}"))

    def _publish(self, known: dict, buckets: dict) -> None:
        version = known["version"] + 1
        paths.publish(self.spark, f"{self.path}/manifests/{version:012d}.json", json.dumps({"version": version, "count": self.buckets, "buckets": buckets}))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _files(self, known: dict, buckets: Iterable[int], before: int | None = None) -> list[str]:
        return [f"{self.path}/data/seg={seg}/bucket={b}" for b in buckets for seg, epoch in known["buckets"].get(str(b), []) if before is None or epoch < before]

    def _rows(self, files: list[str]) -> DataFrame:
        """The rows of files with seg and bucket."""
        schema = StructType([*self.schema.fields]).add("seg", "long").add("bucket", "integer")
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*files)

    def _last(self, rows: DataFrame) -> DataFrame:
        """A row per key and bucket: that of the last segment, and in it the last in order."""
        names = [c for c in self.schema.names if c != self.key]
        return rows.groupBy(self.key, "bucket").agg(F.max_by(F.struct(*names), F.struct("seg", *self.order)).alias("_row")).select(self.key, "_row.*", "bucket")

    def read(self, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The store's rows or, with `keys` (a table with the key), theirs, for which only the buckets that
        they are in are opened. With `before`, what was so before that epoch."""
        known = self.manifest()
        wanted = range(self.buckets)
        if keys is not None:
            wanted = [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # at most as many as buckets
        rows = self._rows(self._files(known, sorted(wanted), before))
        if keys is not None:
            rows = rows.join(keys.select(self.key).distinct(), self.key, "left_semi")
        # A segment has a row a key, so only several of one bucket need a look at which came last.
        several = any(sum(before is None or epoch < before for _, epoch in known["buckets"].get(str(b), [])) > 1 for b in wanted)
        return (self._last(rows) if several else rows).select(*self.schema.names)

    def _write(self, rows: DataFrame, seg: int, dealt: bool = False) -> list[int]:
        """Rows (with bucket) as a segment; the buckets that it has. A bucket is written by one task; rows may have been
        dealt to tasks by bucket before."""
        place = f"{self.path}/data/seg={seg}"
        paths.remove(self.spark, place)  # of a writer that has died
        (rows if dealt else rows.repartition(self.buckets, "bucket")).write.partitionBy("bucket").parquet(place)
        return sorted(int(n.removeprefix("bucket=")) for n in paths.names(self.spark, place) if n.startswith("bucket="))

    def _shaped(self, new: DataFrame) -> DataFrame:
        there = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        return last_per_key(new.select(*there), self.key, self.order).withColumn("bucket", self.bucket())

    def append(self, new: DataFrame, epoch: int) -> None:
        """Adds rows that replace those of their keys, as a segment of an epoch; it may come again and then replaces what
        it wrote. Buckets with more segments than allowed are merged, of earlier epochs only."""
        known = self.manifest()
        seg = 2 * (known["version"] + 1)
        buckets = {b: [x for x in segs if x[1] != epoch] for b, segs in known["buckets"].items()}
        full = [int(b) for b, segs in buckets.items() if len(segs) >= self.segments]
        if full:
            old = self._last(self._rows([f"{self.path}/data/seg={s}/bucket={b}" for b in full for s, _ in buckets[str(b)]]))
            for b in self._write(old, seg - 1):
                buckets[str(b)] = [[seg - 1, max(e for _, e in buckets[str(b)])]]
        for b in self._write(self._shaped(new), seg):
            buckets.setdefault(str(b), []).append([seg, epoch])
        self._publish(known, buckets)

    def upsert(self, new: DataFrame) -> int:
        """Replaces and adds whole rows by key; returns the number of rows written. `new` is computed once;
        only buckets that it has keys of are written again, all others keep their files."""
        known = self.manifest()
        seg = 2 * (known["version"] + 1)
        touched = self._write(self._shaped(new), seg - 1)  # aside: no manifest names it
        if not touched:
            return 0
        fresh = self._rows([f"{self.path}/data/seg={seg - 1}/bucket={b}" for b in touched])
        written = fresh.count()
        files = self._files(known, touched)
        if not files:
            self._publish(known, known["buckets"] | {str(b): [[seg - 1, 0]] for b in touched})
            return written
        # Old and new rows are moved once, by bucket; what is last of a key is told where they are written.
        both = self._rows([*files, *(f"{self.path}/data/seg={seg - 1}/bucket={b}" for b in touched)]).repartition(self.buckets, "bucket")
        self._write(self._last(both), seg, dealt=True)
        self._publish(known, known["buckets"] | {str(b): [[seg, 0]] for b in touched})
        paths.remove(self.spark, f"{self.path}/data/seg={seg - 1}")
        return written

    def vacuum(self, keep: int = 2) -> None:
        """Deletes files that none of the last `keep` manifests names, and older manifests."""
        found = [n for n in paths.names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        live = set()
        for n in found[-keep:]:
            for b, segs in json.loads(paths.read_text(self.spark, f"{self.path}/manifests/{n}"))["buckets"].items():
                live |= {(seg, int(b)) for seg, _ in segs}
        for n in found[:-keep]:
            paths.remove(self.spark, f"{self.path}/manifests/{n}")
        for folder in paths.names(self.spark, f"{self.path}/data"):
            seg = int(folder.removeprefix("seg="))
            for part in paths.names(self.spark, f"{self.path}/data/{folder}"):
                if part.startswith("bucket=") and (seg, int(part.removeprefix("bucket="))) not in live:
                    paths.remove(self.spark, f"{self.path}/data/{folder}/{part}")
