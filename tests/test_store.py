"""The keyed store and the row log."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from rulemill.sources import files, paths, rowlog
from rulemill.sources.store import KeyedStore

SCHEMA = "k string, text string, at int"


def files_of(store):
    return {b: [f"seg={s}" for s, _ in segs] for b, segs in store.manifest()["buckets"].items()}


def rows_of(df):
    return sorted((r.k, r.text) for r in df.collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, "k", ("at",), buckets=8)
    first = spark.createDataFrame([(f"k{i}", "old", 1) for i in range(40)], SCHEMA)
    assert store.upsert(first) == 40
    before = files_of(store)
    assert store.upsert(spark.createDataFrame([("k3", "a", 1), ("k3", "b", 2), ("new", "x", 1)], SCHEMA)) == 2
    after = files_of(store)
    assert 0 < sum(before[b] != after[b] for b in before) <= 2
    assert dict(rows_of(store.read())) == {f"k{i}": "old" for i in range(40)} | {"k3": "b", "new": "x"}
    assert store.upsert(first.limit(0)) == 0 and files_of(store) == after
    store.vacuum(keep=1)
    assert len(paths.names(spark, f"{store.path}/manifests")) == 1 and store.read().count() == 41


def test_reads_do_not_grow_with_batches(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, "k", ("at",), buckets=2, segments=3)
    want = {}
    for epoch in range(9):
        new = [(f"k{i}", f"{epoch}", epoch) for i in range(epoch, epoch + 4)]
        want |= {k: t for k, t, _ in new}
        store.append(spark.createDataFrame(new, SCHEMA), epoch)
        assert all(len(segs) <= 3 + 1 for segs in store.manifest()["buckets"].values())
    assert dict(rows_of(store.read())) == want
    assert rows_of(store.read(spark.createDataFrame([("k8",), ("none",)], "k string"))) == [("k8", "8")]


def test_a_batch_that_comes_again_reads_and_writes_the_same(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, "k", ("at",), buckets=2, segments=2)
    for epoch in range(4):
        for _ in range(2):
            assert ("k", f"{epoch}") not in rows_of(store.read(before=epoch))
            assert rows_of(store.read(before=epoch)) == ([("k", f"{epoch - 1}")] if epoch else [])
            store.append(spark.createDataFrame([("k", f"{epoch}", epoch)], SCHEMA), epoch)


@pytest.mark.parametrize("way", ["append", "upsert"])
def test_a_writer_that_dies_leaves_no_trace(spark, tmp_path, monkeypatch, way):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, "k", ("at",), buckets=2)
    write = (lambda rows: store.append(rows, 5)) if way == "append" else store.upsert
    write(spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], SCHEMA))
    new = spark.createDataFrame([("a", "2", 2), ("c", "2", 2)], SCHEMA)

    def dies(*args):
        raise InterruptedError

    with monkeypatch.context() as patch:
        patch.setattr(paths, "publish", dies)
        with pytest.raises(InterruptedError):
            write(new)
    assert rows_of(store.read()) == [("a", "1"), ("b", "1")]
    write(new)
    assert rows_of(store.read()) == ([("a", "2"), ("c", "2")] if way == "append" else [("a", "2"), ("b", "1"), ("c", "2")])
    with pytest.raises(FileExistsError):
        paths.publish(spark, f"{store.path}/manifests/{store.manifest()['version']:012d}.json", "{}")


def test_log_in_bounded_batches_and_again(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    spark.range(0, 95, 1, 3).withColumn("ts", F.timestamp_micros(F.col("id") * 1_000_001)).write.parquet(folder)

    def run(until=None):
        sizes = []
        out = rowlog.read_log(spark, folder, "id long, ts timestamp", f"file://{tmp_path}/cursor", rows=20, task_rows=7)
        query = out.writeStream.foreachBatch(lambda df, n: sizes.append(df.count()) or df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={n}")).option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
        return sizes

    assert run() == [20, 20, 20, 20, 15]
    spark.range(95, 130, 1, 1).withColumn("ts", F.timestamp_micros(F.col("id") * 1_000_001)).write.parquet(f"{tmp_path}/more")
    (part,) = [n for n in (tmp_path / "more").iterdir() if n.name.endswith(".parquet")]
    part.rename(tmp_path / "in" / "part-99999-later.parquet")
    assert run() == [20, 15]
    rows = spark.read.schema("id long, ts timestamp").parquet(f"{tmp_path}/out").collect()
    assert sorted(r.id for r in rows) == list(range(130))
    assert spark.read.parquet(f"{tmp_path}/out").where(F.unix_micros("ts") != F.col("id") * 1_000_001).count() == 0


def test_one_manifest_or_the_old_one(spark, tmp_path):
    file = f"file://{tmp_path}/manifest.json"
    rows = spark.range(300).selectExpr("id AS pos", "'t\n\"' || id AS title", "'u' || id AS url")
    files.write_manifest(rows.repartition(5), file)
    assert sorted(r["pos"] for r in json.loads((tmp_path / "manifest.json").read_text())) == list(range(300))
    assert {(r.pos, r.title) for r in files.read_manifest(spark, file).collect()} == {(i, f't\n"{i}') for i in range(300)}
    failing = rows.withColumn("title", F.when(F.col("pos") == 150, F.raise_error(F.lit("no"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="no"):
        files.write_manifest(failing, file)
    assert len(json.loads((tmp_path / "manifest.json").read_text())) == 300 and len(list(tmp_path.iterdir())) == 1
    files.write_manifest(rows.limit(0), file)
    assert json.loads((tmp_path / "manifest.json").read_text()) == []


def test_digests_are_streamed(spark, tmp_path, monkeypatch):
    for i in range(1, 7):
        (tmp_path / f"f{i}.bin").write_bytes(bytes([i]) * (i * 5_000_000))
    manifest = spark.createDataFrame([("f1.bin", "known"), ("f2.bin", None)], "relative_path string, sha256 string")
    found = files.file_digests(spark, str(tmp_path), manifest, root=f"{tmp_path.name}/")
    schemas = re.findall("ReadSchema: (.*)", found._jdf.queryExecution().executedPlan().toString())
    assert schemas and not any("content" in x for x in schemas)
    want = {f"f{i}.bin": hashlib.sha256(bytes([i]) * (i * 5_000_000)).hexdigest() for i in range(1, 7)} | {"f1.bin": "known"}
    assert {r.relative_path: r.sha256 for r in found.collect()} == want


def test_old_and_new_rows_are_moved_once(spark, tmp_path):
    from rulemill.sources.store import KeyedStore

    store = KeyedStore(spark, f"file://{tmp_path}/s", "k string, v long", "k", ("v",), 4)
    store.upsert(spark.range(40).selectExpr("CAST(id AS STRING) AS k", "id AS v"))
    assert "Exchange" not in store.read()._jdf.queryExecution().executedPlan().toString()
    plans, usual = [], store._write
    store._write = lambda rows, seg, **k: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), usual(rows, seg, **k))[1]
    assert store.upsert(spark.range(0, 60, 2).selectExpr("CAST(id AS STRING) AS k", "-id AS v")) == 30
    assert plans[-1].count("Exchange hash") == 1
    assert {(r.k, r.v) for r in store.read().collect()} == {(str(i), -i if i % 2 == 0 else i) for i in range(60) if i % 2 == 0 or i < 40}
