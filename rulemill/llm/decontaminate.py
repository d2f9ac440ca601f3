"""Benchmark decontamination by a hash set of normalised n-grams."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, text_of

#: Words in a window; an item of fewer is one window.
WINDOW = 13
#: Characters of all items together up to which their windows are broadcast: the index of so many
#: takes some 200 MB of a Python worker.
MAX_CHARS = 4_000_000

#: After lower-casing A-Z, words are runs of digits, a-z and everything beyond ASCII.
_SPLIT = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    return text.encode().lower().translate(_SPLIT).split()


def _windows(found: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    n = min(width, len(found))
    return [tuple(found[i : i + n]) for i in range(len(found) - n + 1)] if n else []


class Index:
    """The windows of a benchmark: word ids, and for each length the items of every window."""

    def __init__(self, items: list[tuple[str | None, str]], width: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            for window in _windows(words(text), width):
                key = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in window], np.int32).tobytes()
                owners = self.windows.setdefault(len(window), {}).setdefault(key, set())
                if item is not None:
                    owners.add(item)

    def scan(self, text: str) -> tuple[int, int, list[str], list[dict[str, int]]]:
        """Words, words hit, items (sorted), and merged spans of words hit (end exclusive)."""
        found = words(text)
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in found), np.int32, len(found))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        steps, items = np.zeros(len(ids) + 1, np.int64), set()
        for n, windows in self.windows.items():
            # Only where all words are words of the benchmark can a window be one of its own.
            for i in np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else ():
                owners = windows.get(ids[i : i + n].tobytes())
                if owners is not None:
                    items |= owners
                    steps[i] += 1
                    steps[i + n] -= 1
        hit = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        spans = [{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
        return len(found), int(hit.sum()), sorted(items), spans


_SCAN_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])
_SCAN = "struct<n_words long, n_hit long, items array<string>, spans array<struct<first: int, end: int>>>"


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """Adds n_words, n_hit, items (sorted ids of the items with a window in the text), spans
    (first and end of runs of hit words) and contaminated (at least one word in 20 is hit).

    Null and empty texts have no words and aren't contaminated; items without words have no
    windows; windows of an item with a null item_id hit, but name no item; repeated items count
    once; other columns stay, those named as a result are replaced; an empty table has no rows, an empty benchmark no windows. Texts are
    looked at whole, one at a time. Up to `max_chars` characters of items are broadcast as a hash set; a larger
    benchmark becomes a table of windows that is joined to the windows of the documents.
    """
    out = _found(docs, benchmark, width, max_chars)
    out = out.withColumns({k: F.col(f"_rm_hit.{k}") for k in ("n_words", "n_hit", "items", "spans")})
    return out.withColumn("contaminated", _contaminated()).drop("_rm_hit")


def _contaminated() -> Column:
    return (F.col("_rm_hit.n_hit") > 0) & (20 * F.col("_rm_hit.n_hit") >= F.col("_rm_hit.n_words"))


def _found(docs: DataFrame, benchmark: DataFrame, width: int, max_chars: int) -> DataFrame:
    """`docs` with a struct of what was found, under a name of its own."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_of(benchmark).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > max_chars:
        return _joined(docs, items, width)
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], width))

    names = ("n_words", "n_hit", "items", "spans")
    look = by_text(lambda texts: [dict(zip(names, index.value.scan(x))) for x in texts], _SCAN, _SCAN_ARROW)
    return docs.withColumn("_rm_hit", look(text_of(docs)))


def _joined(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """The same by a join of windows, for a benchmark that may not be broadcast."""

    def cut(lengths: list[int]) -> Column:
        @F.pandas_udf("array<struct<first: int, n: int, window: string>>")
        def of(texts: pd.Series) -> pd.Series:
            out = []
            for text in texts:
                found = words(text)
                own = lengths or [min(width, len(found))]
                out.append([{"first": i, "n": n, "window": b" ".join(found[i : i + n]).decode()} for n in own if n for i in range(len(found) - n + 1)])
            return pd.Series(out, dtype=object)

        return of

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words(x)) for x in texts], dtype="int64")

    windows = items.select("item_id", F.explode(cut([])("text")).alias("w")).groupBy("w.window").agg(F.first("w.n").alias("n"), F.collect_set("item_id").alias("owners"))
    lengths = [r.n for r in windows.select("n").distinct().collect()]  # `width` at most
    # Rows of equal doc_id and text have equal results, so these two are the key.
    keyed = docs.withColumn("_rm_text", text_of(docs)).withColumn("_rm_hash", F.xxhash64("_rm_text"))
    once = keyed.select(F.col("doc_id").alias("k_id"), F.col("_rm_hash").alias("k_hash"), F.col("_rm_text").alias("k_text")).dropDuplicates(["k_id", "k_hash"])
    met = once.select("k_id", "k_hash", F.explode(cut(lengths)("k_text")).alias("w")).select("k_id", "k_hash", "w.*").join(windows.drop("n"), "window")
    at = met.select("k_id", "k_hash", F.explode(F.expr("sequence(first, first + n - 1)")).alias("i")).distinct()
    edge = at.alias("a").groupBy("k_id", "k_hash").agg(F.array_sort(F.collect_list("i")).alias("i"))
    # Sorted and distinct: a run begins where the place before isn't one less.
    starts = F.filter("i", lambda x, k: ~F.get("i", k - 1).eqNullSafe(x - 1))
    ends = F.filter("i", lambda x, k: ~F.get("i", k + 1).eqNullSafe(x + 1))
    spans = edge.select("k_id", "k_hash", F.size("i").cast("long").alias("n_hit"), F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b + 1).alias("end"))).alias("spans"))
    owners = met.select("k_id", "k_hash", F.explode("owners").alias("o")).groupBy("k_id", "k_hash").agg(F.array_sort(F.collect_set("o")).alias("items"))
    joined = spans.join(owners, [spans.k_id.eqNullSafe(owners.k_id), spans.k_hash == owners.k_hash], "left").select(spans.k_id, spans.k_hash, "n_hit", "spans", "items")
    out = keyed.join(joined.withColumnsRenamed({c: f"_rm_j_{c}" for c in joined.columns}), F.col("doc_id").eqNullSafe(F.col("_rm_j_k_id")) & (F.col("_rm_hash") == F.col("_rm_j_k_hash")), "left")
    none = F.expr("cast(array() as array<string>)")
    hit = F.struct(size("_rm_text").alias("n_words"), F.coalesce("_rm_j_n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("_rm_j_items", none).alias("items"), F.coalesce("_rm_j_spans", F.expr("cast(array() as array<struct<first: int, end: int>>)")).alias("spans"))
    return out.withColumn("_rm_hit", hit).select(*docs.columns, "_rm_hit")


def remove(docs: DataFrame, benchmark: DataFrame, spans: bool = False, width: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """`docs` without its contaminated documents or, with `spans`, with all documents and
    without the hit passages of their texts (from the first hit word to the last). Null and empty
    texts stay as they are; repeated rows are judged each; an empty table or benchmark changes
    nothing; all columns stay."""
    found = _found(docs, benchmark, width, max_chars)
    if not spans:
        return found.where(~_contaminated()).select(*docs.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            if text is not None and len(own):
                at = [m.span() for m in _WORD.finditer(text)]
                for s in reversed(list(own)):
                    text = text[: at[s["first"]][0]] + text[at[s["end"] - 1][1] :]
            out.append(text)
        return pd.Series(out, dtype=object)

    return found.withColumn("text", cut("text", "_rm_hit.spans")).select(*docs.columns)
