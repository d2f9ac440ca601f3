"""Document fingerprints: mergeable bottom-k sketches of word shingles."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

#: Words in a shingle and hashes in a sketch.
WIDTH, SIZE = 5, 128
#: Hashes have this many bytes.
BYTES = 6
_SPACE = float(1 << (8 * BYTES))
#: Word hashes that a Python worker keeps.
CACHE = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words, so that the smallest are a random sample."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, split at space and U+0009 to U+000D."""
    words = text.encode().lower().split()
    return np.fromiter((_hashes[w] for w in words), np.uint64, len(words))


def bottom_k(hashes: np.ndarray, width: int = WIDTH, size: int = SIZE) -> np.ndarray:
    """The `size` smallest distinct shingle hashes, sorted; fewer words than `width` are one
    shingle and no words are none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    n, total = min(width, len(hashes)), np.zeros(max(1, len(hashes) - width + 1), np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + _mix(hashes[i : i + len(total)] + np.uint64(1))
    values = _mix(total) >> np.uint64(64 - 8 * BYTES)
    if len(values) > 4 * size:  # the smallest, some more for repeats
        part = np.partition(values, 3 * size)[: 3 * size + 1]
        least = np.unique(part)
        if len(least) > size:
            return least[:size]
    return np.unique(values)[:size]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BYTES :] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of the union, exactly as if it were made at once."""
    return np.union1d(a, b)[:size]


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact below `size`."""
    return float(len(a)) if len(a) < size else (size - 1) * _SPACE / float(a[size - 1])


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard resemblance, 0 to 1; two texts without words are alike."""
    both = merge(a, b, size)
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of the shingles of `a` that `b` has."""
    union, own = distinct(merge(a, b, size), size), distinct(a, size)
    return min(1.0, resemblance(a, b, size) * union / own) if own else 1.0


def sketch_column(text: Column, width: int = WIDTH, size: int = SIZE) -> Column:
    """The encoded sketch of a text without nulls; an empty string for one without words."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(bottom_k(word_hashes(x), width, size)) for x in texts], dtype=object)

    return of(text)


def pair_column(a: Column, b: Column, measure=resemblance) -> Column:
    """`measure` (resemblance or containment) of two sketch columns."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([measure(decode(x), decode(y)) for x, y in zip(a, b)], dtype=float)

    return of(a, b)


def distinct_column(sketch: Column) -> Column:
    @F.pandas_udf("double")
    def of(sketches: pd.Series) -> pd.Series:
        return pd.Series([distinct(decode(x)) for x in sketches], dtype=float)

    return of(sketch)


def merged(df: DataFrame, by: list[str], sketch: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """One sketch per group, merged in parts before it is shuffled. A part has at most `size`
    hashes a group, so no task holds more than those of its groups. Null keys are a group of
    their own; sketches of empty texts add nothing; repeated rows change nothing; an empty table
    has no groups."""
    parts = df.select(*by, F.spark_partition_id().alias("part"), sketch)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.empty(0, np.uint64)
        for x in pdf[sketch]:
            out = merge(out, decode(x), size)
        return pdf[by].head(1).assign(**{sketch: encode(out)})

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*by, sketch).dtypes)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for *key, x in pdf[[*by, sketch]].itertuples(index=False):
                held[tuple(key)] = merge(held.get(tuple(key), np.empty(0, np.uint64)), decode(x), size)
            if len(held) > 50_000:
                yield pd.DataFrame([[*k, encode(v)] for k, v in held.items()], columns=[*by, sketch])
                held.clear()
        yield pd.DataFrame([[*k, encode(v)] for k, v in held.items()], columns=[*by, sketch])

    return parts.select(*by, sketch).mapInPandas(local, kinds).groupBy(*by).applyInPandas(join, kinds)


def with_next(docs: DataFrame, fn, schema: str, parts: int | None = None) -> DataFrame:
    """Runs fn(doc_id, text, next text) -> row over all rows, the next row being that of the
    next smaller doc_id (equal ids by text, nulls last), after the last the first.

    doc_id, a number, is cut into ranges at its quantiles, so the texts move once. The first
    row of each range is also sent, marked, to the end of the range before it: nothing else
    crosses a border. Rows of one doc_id are in one range: a doc_id repeated in a large share of
    the rows makes one task as large. Null texts count as empty; null ids come last; a single row
    is its own next; an empty table has no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / (3 * parts) for i in range(1, 3 * parts)], 10_000)).first()[0] or []), reverse=True)
    # Range 0 has the largest ids; the last one has nulls.
    edges = np.array(sorted(cuts), np.int64)

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        """How many cuts are at or above each id; one more than all for a null. Ids stay whole numbers."""
        at = len(edges) - np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(edges) + 1, at), pa.int32())

    bucket = place("doc_id")
    ranged = docs.withColumn("bucket", bucket)
    tops = ranged.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    tops = tops.withColumn("to", F.coalesce(F.lag("bucket").over(W.orderBy("bucket")), F.max("bucket").over(W.partitionBy()))).orderBy("bucket").collect()  # a row for each range
    if not tops:
        return spark.createDataFrame([], schema)
    to = F.element_at(F.create_map(*[F.lit(x) for r in tops for x in (r.bucket, r.to)]), F.col("bucket"))
    heads = docs.where(F.col("doc_id").isin([r.top for r in tops if r.top is not None]) | (F.col("doc_id").isNull() if any(r.top is None for r in tops) else F.lit(False)))
    heads = heads.groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("bucket", bucket)
    rows = ranged.withColumn("head", F.lit(False)).unionByName(heads.withColumn("bucket", to).withColumn("head", F.lit(True)))
    rows = rows.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "head", F.col("doc_id").desc_nulls_last(), "text")

    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits = None
        for batch in batches:
            out = []
            for doc_id, text, head in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "head"))):
                if waits is not None:
                    out.append(fn(*waits, text))
                waits = None if head else (doc_id, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, schema)


def compare_with_next(docs: DataFrame, width: int = WIDTH, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next of every row: its text, its text with the last half replaced by the first half
    of the next row's, and the next row's text. Null texts count as empty; a single row is
    its own next row; repeated rows each get a row."""
    import hashlib

    def of(doc_id, text: str, after: str):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (bottom_k(word_hashes(x), width, size) for x in (text, edited, after))
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), encode(a), encode(b), resemblance(a, b, size), resemblance(a, c, size)

    return with_next(docs, of, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
