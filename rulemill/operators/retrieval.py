"""Exact cosine retrieval and the context made of its hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulemill.functions.text import clip, present, strip
from rulemill.sources.folders import new_folder

TOP_K = 8
#: Bytes of query vectors that are broadcast at once; a longer log is searched block by block.
QUERY_BYTES = 64 << 20
#: Bytes of the corpus's vectors that a task holds while blocks of queries pass by.
CORPUS_BYTES = 64 << 20
#: Distances that a task holds at once.
DISTANCES = 1 << 19
#: Digits of a distance that count, so that equal vectors tie wherever they are computed.
DIGITS = 9


def _unit(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of what is neither null nor zero nor has a null inside."""
    usable = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(usable), -1) if len(usable) else np.zeros((0, 1))
    norm = np.linalg.norm(rows, axis=1)
    return usable[norm > 0], rows[norm > 0] / norm[norm > 0, None]


def top_k(queries: DataFrame, chunks: DataFrame, k: int | None = TOP_K, exclude_self: bool = False, query_block: int | None = None) -> DataFrame:
    """queries (query_id, embedding) against chunks (id, embedding), chunks' ids long -> query_id,
    id, distance, rank: the k nearest by cosine distance, equal ones by id. Null and zero vectors
    are never found and find nothing; all others have one length; k of 0 or None means 8.

    Each task keeps k hits a query, so the shuffle moves k rows for each query and task, whatever
    the corpus. Queries of one block are broadcast. Those of more (blocks of `query_block`, or of as many as
    `QUERY_BYTES` hold) are dealt to files in the shared folder; the corpus is scanned once, and each task
    takes its part of it against one block of queries after the other. Neither the driver nor a task holds more
    than a block of queries, a part of the corpus and their hits.
    """
    k = k or TOP_K
    spark = queries.sparkSession
    own = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    n, width = own.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], f"query_id {_kind(own)}, id long, distance double, rank int")
    blocks = -(-n // (query_block or max(1, QUERY_BYTES // (8 * max(1, width)))))
    kinds = f"query_id {_kind(own)}, id long, distance double"
    if blocks == 1:
        table = own.toArrow()
        held = spark.sparkContext.broadcast(_queries(table))
        found = chunks.select("id", "embedding").mapInArrow(_against_one(held, k, exclude_self), kinds)
    else:
        folder = new_folder(spark, "queries")
        dealt = own.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        dealt.repartition(blocks, "block").write.partitionBy("block").parquet(folder)
        found = chunks.select("id", "embedding").mapInArrow(_against_blocks(folder, blocks, k, exclude_self), kinds)
    return _best(found, k)


def _kind(queries: DataFrame) -> str:
    return queries.schema["query_id"].dataType.simpleString()


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _queries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of what can be searched for."""
    keep, unit = _unit(table.column("embedding").combine_chunks())
    return table.column("query_id").to_numpy()[keep], unit


class _Nearest:
    """The k nearest of each query among what was added, equal ones by id."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.unit, self.k, self.exclude_self = ids, unit, k, exclude_self
        self.d, self.i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, own: np.ndarray, rows: np.ndarray) -> None:
        # A block of rows against a block of queries, so that one holds at most DISTANCES however many there are of either.
        step = max(1, min(len(own), 1_024, DISTANCES))
        for at in range(0, len(own), step):
            part, these = own[at : at + step], rows[at : at + step].T
            for q in range(0, len(self.ids), max(1, DISTANCES // step)):
                self._add(slice(q, q + max(1, DISTANCES // step)), part, these)

    def _add(self, q: slice, part: np.ndarray, rows: np.ndarray) -> None:
        d = np.round(1 - self.unit[q] @ rows, DIGITS)
        if self.exclude_self:
            d[self.ids[q, None] == part[None]] = np.inf
        near = np.flatnonzero(d.min(axis=1) <= self.d[q, -1])  # only these rows can change
        both_d, both_i = np.concatenate([self.d[q][near], d[near]], axis=1), np.concatenate([self.i[q][near], np.broadcast_to(part, (len(near), len(part)))], axis=1)
        order = np.lexsort((both_i, both_d), axis=1)[:, : self.k]
        self.d[q][near], self.i[q][near] = np.take_along_axis(both_d, order, 1), np.take_along_axis(both_i, order, 1)

    def hits(self) -> pa.RecordBatch:
        hit = np.isfinite(self.d)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(self.ids[:, None], hit.shape)[hit]), pa.array(self.i[hit]), pa.array(self.d[hit])], ["query_id", "id", "distance"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        keep, rows = _unit(batch.column("embedding"))
        if len(keep):
            yield batch.column("id").to_numpy(zero_copy_only=False)[keep], rows


def _against_one(held, k: int, exclude_self: bool):
    """A block of queries that was broadcast against all that a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = _Nearest(*held.value, k, exclude_self)
        for own, rows in _vectors(batches):
            nearest.add(own, rows)
        yield nearest.hits()

    return run


def _against_blocks(folder: str, blocks: int, k: int, exclude_self: bool):
    """Parts of the corpus that a task can hold, each against all blocks of queries from their files."""

    def against(part: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        own, rows = (np.concatenate(x) for x in zip(*part))
        store, root = pafs.FileSystem.from_uri(folder)
        for b in range(blocks):
            found = store.get_file_info(pafs.FileSelector(f"{root}/block={b}", allow_not_found=True))
            for file in (f.path for f in found if f.path.endswith(".parquet")):
                with store.open_input_file(file) as stream:
                    nearest = _Nearest(*_queries(pq.read_table(stream)), k, exclude_self)
                nearest.add(own, rows)
                yield nearest.hits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for own, rows in _vectors(batches):
            part.append((own, rows))
            size += rows.nbytes
            if size > CORPUS_BYTES:
                yield from against(part)
                part, size = [], 0
        if part:
            yield from against(part)

    return run


def project_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks' columns; empty strings count as missing, the text as empty."""
    named = chunks.select(
        "id", F.coalesce("text", F.lit("")).alias("text"), "page", F.coalesce(present(F.col("section_hint")), present(F.col("parent_section"))).alias("section_hint"),
        present(F.col("source")).alias("source"), present(F.col("rule_number")).alias("rule_number"), present(F.col("figure_description")).alias("figure_description"),
    )
    return hits.join(named, "id")


def context_block(rank: Column, text: Column, page: Column, section_hint: Column, source: Column, rule_number: Column, figure: Column) -> Column:
    """One hit as it stands in a prompt: a citation, the text, and what a diagram shows."""
    where = F.when(present(rule_number).isNotNull(), F.concat(F.lit("Rule "), rule_number)).otherwise(present(section_hint))
    cited = F.coalesce(present(F.concat_ws(" | ", where, F.concat(F.lit("page "), page), present(source))), F.concat(F.lit("chunk "), rank))
    diagram = F.when(present(figure).isNotNull(), F.concat(F.lit("\n\n**Diagram on this page:** "), strip(figure))).otherwise(F.lit(""))
    return F.concat(F.lit("### Context "), rank, F.lit(" ("), cited, F.lit(")\n"), strip(text), diagram)


def format_context(hits: DataFrame) -> DataFrame:
    """query_id, context: a query's blocks in the order of their rank, k at most."""
    block = context_block(*[F.col(c) for c in ("rank", "text", "page", "section_hint", "source", "rule_number", "figure_description")])
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b")).select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


def response_context(hits: DataFrame, width: int = 180) -> DataFrame:
    """query_id, context_chunks: what an answer shows of its hits, in the order of rank."""
    shown = F.struct("rank", "page", "section_hint", "rule_number", "source", present(F.col("figure_description")).isNotNull().alias("has_figure"), clip(F.translate(strip(F.col("text")), "\n", " "), width, "...").alias("preview"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("context_chunks"))
