"""Overlapping chunks of page text."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulemill.functions.pieces import in_pieces
from rulemill.functions.text import lines, strip

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SIZE, OVERLAP = 1200, 200
#: A line of capitals, with or without a number before it.
SECTION = r"^(?:\d+\.\s+)?[A-Z][A-Z0-9 \-/']{2,60}\z"


def _ends(text: str, separator: str) -> list[int]:
    """Where the pieces of a text end: behind every separator, and at the end of the text."""
    ends = [m.end() for m in re.finditer(re.escape(separator), text)] if separator else list(range(1, len(text) + 1))
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of about `size` characters, each a stretch of the text that begins `overlap`
    before the end of the one before and ends with the last piece that fits, or with the next
    one if none does: so a chunk may exceed the size. Pieces at the very start that are too
    long are cut by the later separators, and the stretch behind them has no overlap."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    ends = _ends(text, next((s for s in separators if s in text), separators[-1]))
    chunks, start = [], 0
    while start < len(text) and (end := ends[bisect_right(ends, start)]) - start > size:
        chunks += split_text(text[start:end], size, overlap, separators[1:]) if separators[1:] else [text[start:end]]
        start = end
    end = start
    while end < len(text):
        fits, following = bisect_right(ends, start + size), bisect_right(ends, end)
        end = ends[max(fits - 1, following)]
        chunks.append(text[start:end].strip())
        start = max(start, end - overlap)
    return [c for c in chunks if c]


def recursive_split(text: Column, chunk_size: int = SIZE, chunk_overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Column:
    return in_pieces(lambda x: split_text(x or "", chunk_size, chunk_overlap, separators), "array<string>", text)


def section_hint(text: Column) -> Column:
    """The first line that looks like a section header, or null."""
    return F.get(F.filter(F.transform(lines(text), strip), lambda x: x.rlike(SECTION)), F.lit(0))


def chunk_pages(pages: DataFrame, chunk_size: int = SIZE, chunk_overlap: int = OVERLAP) -> DataFrame:
    """pages (doc_id, page, text) -> doc_id, page, chunk_index, text, section_hint. Blank pages
    have no chunks; the index runs across a document's pages. Pages are numbered before they
    are cut, so only a page's number of chunks is summed along a document."""
    cut = pages.select("doc_id", "page", section_hint(F.col("text")).alias("section_hint"), recursive_split(F.col("text"), chunk_size, chunk_overlap).alias("chunks"))
    before = F.coalesce(F.sum(F.size("chunks")).over(W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("before", before).select("doc_id", "page", "section_hint", "before", F.posexplode("chunks").alias("pos", "text")).select("doc_id", "page", (F.col("before") + F.col("pos")).cast("int").alias("chunk_index"), "text", "section_hint")


def preview(chunks: DataFrame, offset: int = 0, limit: int = 20, width: int = 600) -> DataFrame:
    """A page of chunks of each document: a header line and a clipped body."""
    body = F.when(F.length("text") > width, F.concat(F.left("text", F.lit(width)), F.lit("…"))).otherwise(F.col("text"))
    head = F.concat_ws(" ", F.concat(F.lit("#"), "chunk_index"), F.concat(F.lit("page "), "page"), "section_hint")
    return chunks.where((F.col("chunk_index") >= offset) & (F.col("chunk_index") < offset + limit)).select("doc_id", "chunk_index", head.alias("header"), body.alias("body"))


def preview_stats(chunks: DataFrame, label: str = "section_hint") -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.min_by(label, "chunk_index").alias("first_label"), F.max_by(label, "chunk_index").alias("last_label"))
