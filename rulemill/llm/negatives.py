"""Hard negatives by a search over candidates in buckets of like norm."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, saved, shared_dir

#: Positives of an anchor and negatives of a positive; the window of a negative's score, in
#: hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: What a component is multiplied with before its fraction is cut off.
SCALE = 256
#: Candidates in a bucket.
BUCKET_ROWS = 16_384
#: Bytes of anchors' vectors that are broadcast at once; more anchors are searched for block by block.
ANCHOR_BYTES = 32 << 20
#: Scores that a task holds at once.
SCORES = 1 << 20
#: Shares of the buckets, the longest vectors first, after which the kth scores are told to all tasks.
WAVES = (1 / 64, 1 / 8, 1.0)
_LAST = (1 << 63) - 1


def quantised(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, vec (floor(scale * x) of each component), norm2 (the sum of their squares) of the
    rows with a label and a vector whose components are all there and finite."""
    x = F.col(vector)
    usable = F.col(label).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | F.abs(v.cast("double")).eqNullSafe(F.lit(float("inf"))))
    vec = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    kept = rows.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), vec.alias("vec"))
    return kept.withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double")))


def _matrix(vectors: pa.ListArray, width: int, kind: type) -> np.ndarray:
    """Vectors as rows of `width` numbers; shorter ones end in zeros, which add nothing to a score."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(vectors), width).astype(kind)
    out = np.zeros((len(vectors), width), kind)
    ends = np.cumsum(lengths)
    for i, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist())):
        out[i, : min(n, width)] = flat[end - n : end - n + min(n, width)]
    return out


def _search(held, k: int, same: bool):
    """Candidates -> the k best of each target that this task has. A batch is passed over by all targets
    whose anchor's norm times its largest norm (no inner product is above that) is below the window
    or below the target's kth score so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        vectors, norm, label, row, anchor = (known[c] for c in ("vectors", "norm", "label", "row", "anchor"))
        kind, low, high = vectors.dtype.type, known["low"], known["high"]
        none = -np.inf if kind is np.float64 else -(1 << 62)
        score, ids, rows = np.full((len(anchor), k), none, kind), np.full((len(anchor), k), _LAST), np.full((len(anchor), k), _LAST)
        score[:, -1] = known["kth"]  # nothing below it is needed; it is no hit itself
        for batch in batches:
            if not batch.num_rows or not len(anchor):
                continue
            own_ids = batch.column("vec_id").fill_null(_LAST).to_numpy()
            by_id = np.lexsort((batch.column("row").to_numpy(), own_ids))  # the first of equal scores is the one to take
            own_ids, own_rows, own_label = own_ids[by_id], batch.column("row").to_numpy()[by_id], batch.column("label").to_numpy()[by_id]
            theirs = _matrix(batch.column("vec"), vectors.shape[1], kind)[by_id]
            longest = float(np.sqrt(batch.column("norm2").to_numpy().max()))
            open_ = np.flatnonzero(norm[anchor] * longest * (1 + 1e-9) >= np.maximum(low, score[:, -1]))
            step = max(1, SCORES // len(own_ids))
            for at in range(0, len(open_), step):
                t = open_[at : at + step]
                a = anchor[t]
                s = vectors[a] @ theirs.T
                s[(s < low[t, None]) | (s > high[t, None]) | (s < score[t, -1:]) | ((label[a, None] == own_label) != same) | (row[a, None] == own_rows)] = none
                hit = np.flatnonzero((s > none).any(axis=1))
                if not len(hit):
                    continue
                s, t, line = s[hit], t[hit], np.arange(len(hit))
                new = []
                for _ in range(min(k, s.shape[1])):
                    best = s.argmax(axis=1)
                    new.append((s[line, best], np.where(s[line, best] > none, own_ids[best], _LAST), np.where(s[line, best] > none, own_rows[best], _LAST)))
                    s[line, best] = none
                all_s, all_i, all_r = (np.concatenate([old[t], np.column_stack([n[i] for n in new])], axis=1) for i, old in enumerate((score, ids, rows)))
                order = np.lexsort((all_r, all_i, -all_s), axis=1)[:, :k]
                score[t], ids[t], rows[t] = (np.take_along_axis(x, order, 1) for x in (all_s, all_i, all_r))
        hits = rows != _LAST
        target = np.broadcast_to(np.arange(len(anchor))[:, None], hits.shape)[hits]
        yield pa.RecordBatch.from_arrays([pa.array(target), pa.array(score[hits].astype(np.int64)), pa.array(ids[hits], mask=ids[hits] == _LAST), pa.array(rows[hits])], ["target", "score", "vec_id", "row"])

    return run


def _best(candidates: DataFrame, known: dict, k: int, same: bool, waves: int) -> DataFrame:
    """target, score, vec_id, row, rank (from 1): the k best of each target."""
    spark = candidates.sparkSession
    rank = F.row_number().over(W.partitionBy("target").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    before, kth = None, known["low"].copy()
    for wave in range(waves):
        held = spark.sparkContext.broadcast(known | {"kth": kth})
        found = candidates.where(F.col("wave") == wave).select("vec_id", "label", "row", "norm2", "vec").mapInArrow(_search(held, k, same), "target long, score long, vec_id long, row long")
        found = found if before is None else found.unionByName(before.drop("rank"))
        best = saved(found.withColumn("rank", rank).where(F.col("rank") <= k), "nearest", tidy=True)
        held.destroy()
        forget(before)
        before = best
        if wave + 1 < waves:
            full = best.where(F.col("rank") == k).select("target", "score").toArrow()  # at most a row for each target of the block
            kth = known["low"].copy()
            at = full.column("target").to_numpy()
            kth[at] = np.maximum(kth[at], full.column("score").to_numpy().astype(kth.dtype))
    return before


def mine(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, anchor_block: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    Anchors are the rows for which the column `anchors` (over vec_id) is true. The score of a row is its
    integer inner product with the anchor after `quantised`; higher ones come first, then smaller
    ids. An anchor's positives are its best `positives` other rows of its label; a positive's negatives the best
    `negatives` rows of other labels with low * positive <= 100 * negative <= high * positive.

    Candidates are sorted by norm, longest first, and cut into buckets of about `bucket_rows`. Tasks
    pass over what a norm rules out; after each wave of buckets the kth scores are told to all. Anchors
    are broadcast a block at a time (`anchor_block`, or as many as `ANCHOR_BYTES` hold), so neither the
    driver nor a task holds more than one block's; each block scans the candidates.

    Rows with a null label or vector, or a null or non-finite component, take no part; rows with a null id can
    be found but are no anchors, and come last of equal scores. Shorter vectors end in zeros.
    Rows with one id are different rows. Scores of 2^63 and more are refused. Other columns aren't
    read; an empty table, or one without anchors, has no rows.
    """
    spark = rows.sparkSession
    own = saved(quantised(rows, vec_id, label, vector, scale), "vectors", tidy=True)
    n, longest, width = own.agg(F.count(F.lit(1)), F.max("norm2"), F.max(F.size("vec"))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], out)
    if longest * 100 >= float(1 << 63):
        raise ValueError("the components are too large for scores of 64 bits")
    buckets = max(1, -(-n // bucket_rows))
    sorted_ = own.repartitionByRange(buckets, F.desc("norm2"), F.col("vec_id"), F.xxhash64("vec")).sortWithinPartitions(F.desc("norm2"))
    bucket = F.spark_partition_id()
    wave = F.coalesce(*[F.when(bucket < max(i + 1, int(share * buckets)), F.lit(i)) for i, share in enumerate(WAVES[:-1])], F.lit(len(WAVES) - 1))
    table = saved(sorted_.select("vec_id", "label", "vec", "norm2", wave.alias("wave"), F.monotonically_increasing_id().alias("row")), "by-norm", tidy=True)
    forget(own)
    asks = table.withColumnRenamed("vec_id", vec_id).where(anchors).withColumnRenamed(vec_id, "vec_id")
    asked = asks.count()
    blocks = -(-asked // (anchor_block or max(1, ANCHOR_BYTES // (8 * max(1, width)))))
    if not blocks:
        return spark.createDataFrame([], out)
    dealt = saved(asks.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "anchors")
    folder = f"{shared_dir(spark)}/tables/negatives-{uuid.uuid4().hex}"
    kind = np.float64 if longest * 100 < float(1 << 53) else np.int64
    for b in range(blocks):
        block = dealt.where(F.col("block") == b).select("vec_id", "label", "vec", "norm2", "row").toArrow().combine_chunks()
        if block.num_rows:
            found = _of_block(table, block, width, kind, positives, negatives, low, high)
            found.write.parquet(f"{folder}/block={b}")
            forget(*found._rm_read)
    forget(dealt)
    return spark.read.schema(out).parquet(f"{folder}/block=*")


def _of_block(table: DataFrame, block: pa.Table, width: int, kind: type, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = table.sparkSession
    vectors = block.column("vec").combine_chunks() if block.column("vec").num_chunks != 1 else block.column("vec").chunk(0)
    count = block.num_rows
    known = {"vectors": _matrix(vectors, width, kind), "norm": np.sqrt(block.column("norm2").to_numpy()), "label": block.column("label").to_numpy(), "row": block.column("row").to_numpy(), "anchor": np.arange(count)}
    least, most = (-np.inf, np.inf) if kind is np.float64 else (-(1 << 61), 1 << 61)
    first = _best(table, known | {"low": np.full(count, least, kind), "high": np.full(count, most, kind)}, positives, True, len(WAVES))
    # A target is an anchor's positive: at most `positives` for each anchor of the block.
    pairs = first.select("target", "rank", "score", "vec_id").toArrow()
    score = pairs.column("score").to_numpy()
    bottom, top = -((-low * score) // 100), (high * score) // 100
    open_ = bottom <= top
    targets = pairs.filter(pa.array(open_))
    last = _best(table, known | {"anchor": targets.column("target").to_numpy(), "low": bottom[open_].astype(kind), "high": top[open_].astype(kind)}, negatives, False, len(WAVES))
    ids = block.column("vec_id").to_numpy()
    names = pa.table({"target": np.arange(targets.num_rows), "anchor_id": ids[targets.column("target").to_numpy()], "positive_id": targets.column("vec_id"), "positive_score": targets.column("score")})
    told = spark.createDataFrame(names) if names.num_rows else spark.createDataFrame([], "target long, anchor_id long, positive_id long, positive_score long")
    out = last.join(F.broadcast(told), "target").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out._rm_read = (first, last)
    return out
