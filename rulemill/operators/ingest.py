"""From pages to keyed, embedded chunks in a store."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from rulemill.functions.text import present, short_hash
from rulemill.operators.chunking import OVERLAP, SIZE, chunk_pages
from rulemill.operators.rules import parse_rules

# Source categories by parser profile.
CATEGORIES = {"core_rules": "core_rules", "event_companions": "event_companions", "faction_packs": "faction_packs", "miscellaneous": "miscellaneous", "reference": "reference", "updates_and_faq": "updates_and_faq"}
OTHER_CATEGORY = "miscellaneous"
COLUMNS = "doc_id text page chunk_index parser_profile chunk_type source source_category rule_number parent_section section_hint has_figure figure_description".split()


def category_of(profile: Column) -> Column:
    pairs = [F.lit(x) for item in CATEGORIES.items() for x in item]
    return F.coalesce(F.get(F.array(F.element_at(F.create_map(*pairs), profile)), F.lit(0)), F.lit(OTHER_CATEGORY))


def build_chunks(pages: DataFrame, documents: DataFrame, captions: DataFrame | None = None, chunk_size: int = SIZE, chunk_overlap: int = OVERLAP, min_chunk_chars: int = 50) -> DataFrame:
    """pages (doc_id, page, text) of documents (doc_id, parser_profile, source) -> chunks.
    Core rules become a chunk per numbered rule, all others overlapping chunks; captions
    (doc_id, page, caption) go to the chunks of core rules."""
    about = documents.select("doc_id", "parser_profile", "source")
    core = pages.join(about.where("parser_profile = 'core_rules'").select("doc_id"), "doc_id", "left_semi")
    other = pages.join(about.where("parser_profile != 'core_rules'").select("doc_id"), "doc_id", "left_semi")
    rules = parse_rules(core, min_chunk_chars).withColumnRenamed("title", "parent_section")
    parts = chunk_pages(other, chunk_size, chunk_overlap).withColumn("chunk_type", F.lit("miscellaneous"))
    chunks = rules.unionByName(parts, allowMissingColumns=True).join(about, "doc_id").withColumn("source_category", category_of(F.col("parser_profile")))
    chunks = chunks.withColumn("has_figure", F.lit(False)).withColumn("figure_description", F.lit(None).cast("string"))
    if captions is not None:
        told = apply_captions(chunks.where("parser_profile = 'core_rules'"), captions)
        chunks = chunks.where("parser_profile != 'core_rules'").unionByName(told)
    return chunks.select(*COLUMNS)


def apply_captions(chunks: DataFrame, captions: DataFrame) -> DataFrame:
    """has_figure and figure_description of chunks whose page has a caption."""
    told = captions.groupBy("doc_id", "page").agg(F.first("caption").alias("caption"))
    df = chunks.drop("has_figure", "figure_description").join(told, ["doc_id", "page"], "left")
    return df.withColumn("has_figure", F.col("caption").isNotNull()).withColumnRenamed("caption", "figure_description")


def doc_key(source: Column, rule_number: Column, page: Column, chunk_index: Column) -> Column:
    """The key of a chunk: by its rule number if it has one, else by its place."""
    return F.when(present(rule_number).isNotNull(), short_hash(source, rule_number)).otherwise(short_hash(source, page, chunk_index))


def with_key(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("doc_key", doc_key(F.col("source"), F.col("rule_number"), F.col("page"), F.col("chunk_index")))


def payload(chunks: DataFrame) -> DataFrame:
    """doc_key and the stored JSON; what is null, and an empty figure description, is left out."""
    names = [c for c in COLUMNS if c not in ("doc_id", "figure_description")]
    body = F.struct(*names, present(F.col("figure_description")).alias("figure_description"))
    return chunks.select("doc_key", F.to_json(body).alias("payload"))


def summarise(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of chunks, figures and characters; the mean is rounded half to even."""
    figure = F.col("has_figure")
    total = F.sum(F.length("text"))
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(figure).alias("figure_chunks"), F.countDistinct(F.when(figure, F.struct("doc_id", "page"))).alias("figure_pages"),
        F.coalesce(total, F.lit(0)).alias("text_chars"), F.coalesce(F.sum(F.when(figure, F.length(F.coalesce("figure_description", F.lit(""))))), F.lit(0)).alias("caption_chars"),
        F.coalesce(F.bround(total / F.count(F.lit(1))), F.lit(0)).cast("long").alias("avg_text_chars"),
    )


#: Words whose places a worker keeps, of at most 32 characters: some 20 MB.
WORDS = 100_000


def hashing_encoder(dim: int = 64, task: str = "document") -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, of
    length one. Documents and queries are tasks of their own, as for a real model."""

    places: dict[str, int] = {}

    def place(word: str) -> int:
        """Where a word counts: among the first `dim` for, behind them against. Words repeat, so some are kept."""
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
        found = h % dim + (0 if h >> 63 else dim)
        if len(places) < WORDS and len(word) <= 32:
            places[word] = found
        return found

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        known = places.get
        for i, text in enumerate(texts):
            at = [place(word) if (p := known(word)) is None else p for word in text.lower().split()]
            counts = np.bincount(at, minlength=2 * dim) if at else np.zeros(2 * dim)
            out[i] = counts[:dim] - counts[dim:]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    encode.task = task
    return encode


def zero_encoder(dim: int = 768) -> Callable[[list[str]], np.ndarray]:
    """For dry runs."""
    return lambda texts: np.zeros((len(texts), dim), np.float32)


def embed(df: DataFrame, encode_fn: Callable[[list[str]], np.ndarray], text: str = "text", batch_size: int = 16) -> DataFrame:
    """Adds embedding: `encode_fn` turns lists of at most `batch_size` texts into as many
    vectors; it is built once per task."""
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "embedding array<float>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list = []
            texts = pdf[text].fillna("").tolist()
            for i in range(0, len(texts), batch_size):
                got = encode_fn(texts[i : i + batch_size])
                if len(got) != len(texts[i : i + batch_size]):
                    raise ValueError("the encoder must return a vector per text")
                vectors += [np.asarray(v, np.float32) for v in got]
            yield pdf.assign(embedding=vectors)

    return df.mapInPandas(run, kinds)


def last_per_key(new: DataFrame, key: str = "doc_key", order: tuple[str, ...] = ("page", "chunk_index")) -> DataFrame:
    """A row per key: that which was written last, in the order of those columns of `order` that
    there are. Of rows of equal place the largest by its other columns counts."""
    names = [c for c in new.columns if c != key]
    last = [c for c in order if c in names]
    plain = [c for c in names if not isinstance(new.schema[c].dataType, MapType)]
    return new.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*last, *plain)).alias("_row")).select(key, "_row.*").select(*new.columns)


def upsert(existing: DataFrame, new: DataFrame, key: str = "doc_key", order: tuple[str, ...] = ("page", "chunk_index")) -> DataFrame:
    """The store (a row a key) after whole-row replacement by key; rows that are no longer made stay. Of new
    rows with one key the last in `order` replaces. One aggregation over both, so that new rows, which may
    be dear to make, are made once."""
    names = [*existing.columns, *(c for c in new.columns if c not in existing.columns)]
    both = existing.withColumn("_rm_new", F.lit(0)).unionByName(new.withColumn("_rm_new", F.lit(1)), allowMissingColumns=True)
    values = [c for c in names if c != key]
    plain = [c for c in values if not isinstance(both.schema[c].dataType, MapType)]
    last = F.struct("_rm_new", *[c for c in order if c in plain], *plain)
    return both.groupBy(key).agg(F.max_by(F.struct(*values), last).alias("_row")).select(key, "_row.*").select(*names)


def changed_only(existing: DataFrame, new: DataFrame, key: str = "doc_key") -> DataFrame:
    """Rows of `new` whose key or text the store lacks: only these need embedding."""
    return new.join(existing.select(key, F.sha2("text", 256).alias("h")), (new[key] == existing[key]) & (F.sha2(new["text"], 256) == F.col("h")), "left_anti")
