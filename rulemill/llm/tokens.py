"""Token counts: pieces are counted once per distinct pre-token, never as lists of ids."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of

#: Pre-tokens whose counts are broadcast, the most frequent first; all others are joined.
HEAD = 200_000
#: Characters of a pre-token that may be broadcast, which bounds the table's bytes; longer ones are
#: always joined.
SHORT = 64
#: Distinct pre-tokens, and their characters, that a task gathers before it passes them on.
FLUSH, FLUSH_CHARS = 400_000, 32 << 20

#: Where no piece of a model has a space mark after another character, and none a line break,
#: merges never cross the borders between these.
PRE_TOKEN = re.compile("\n|▁*[^▁\n]+|▁+")
_PIECE = re.compile("▁*[^▁\n]*")
#: A text that a model which rewrites or trims characters would change.
_PROBE = " a  b\tc \ufb01\n \u212b x "


def splits(model: str) -> bool:
    """Whether the pre-tokens of a text can be counted each for itself: the model must leave the
    characters alone, put a space mark ahead of the text, and have only pieces that lie within
    a pre-token."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = library.normalize(_PROBE) == "▁" + _PROBE.replace(" ", "▁")
    return plain and all(_PIECE.fullmatch(library.id_to_piece(i)) for i in range(library.get_piece_size()))


def _by_text(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, whole texts given to the library."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        return pd.Series([len(library.encode(x)) for x in texts], dtype="int64")

    text = text_of(docs)
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))


def pre_tokens(text: str) -> list[str]:
    """A text's pre-tokens; the library puts a space mark before any text that isn't empty."""
    return PRE_TOKEN.findall("▁" + text.replace(" ", "▁")) if text else []


def _lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            seen.update(pre_tokens(text))
            held += len(text)
            if len(seen) > FLUSH or held > FLUSH_CHARS and sum(map(len, seen)) > FLUSH_CHARS:
                yield out()
                seen.clear()
            held = held if held <= FLUSH_CHARS else 0
    if seen:
        yield out()


def lexicon(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """piece, n (occurrences in the corpus), n_pieces: each distinct pre-token is given to the
    library once. `model` is the path of a sentencepiece model that every executor has. Null and
    empty texts have no pre-tokens; repeated rows count each; no rows, no pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            # After a line break the library adds no space mark; the mark before the break and the break are two pieces.
            counts = [len(x) - 2 for x in library.encode(["\n" + x for x in batch.column(0).to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["piece", "n", "n_pieces"])

    found = docs.select(text_of(docs, text).alias("text")).mapInArrow(_lexicon, "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(count, "piece string, n long, n_pieces long")


def _frequent(words: DataFrame, head: int) -> dict[str, int]:
    """piece -> n_pieces of the most frequent pre-tokens of at most `SHORT` characters, at most `head`
    of them: all from the lowest step of frequency on that leaves no more."""
    words = words.where(F.length("piece") <= SHORT)
    step = F.floor(4 * F.log2("n"))
    least, total = None, 0
    for row in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 4 rows a doubling
        total += row["count"]
        if total > head:
            break
        least = row.step
    if least is None:
        return {}
    return dict(words.where(step >= least).select("piece", "n_pieces").toPandas().itertuples(index=False))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row: null and empty texts have no
    tokens, repeated rows are counted each for itself, an empty table has no rows, other columns are left
    out. A text is cut in memory, one at a time; what a task gathers of texts is bounded by characters.

    The counts of at most `head` pre-tokens of at most 64 characters, the most frequent, are broadcast; a document's other
    pre-tokens are joined to the lexicon, so no part grows with the number of distinct ones. A
    model whose pieces cross pre-tokens (`splits` looks) is given whole texts instead.
    """
    spark = docs.sparkSession
    if not splits(model):
        return _by_text(docs, model).withColumn("over_limit", F.col("n_tokens") > limit)
    words = saved(lexicon(docs, model), "lexicon")
    frequent = spark.sparkContext.broadcast(_frequent(words, head))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        names = ["row", "doc_id", "piece", "times", "done", "size"]
        for batch in batches:
            rows, pieces, times, done, size, held = [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("doc_id").take(at), pa.array(pieces, pa.string()), pa.array(times, pa.int64()), pa.array(done, pa.int64()), pa.array(size, pa.int64())], names)

            for i, text in enumerate(batch.column("text")):
                text, total = text.as_py(), 0
                rest: list[tuple[str, int]] = []
                for piece, n in Counter(pre_tokens(text)).items():
                    k = known.get(piece)
                    if k is None:
                        rest.append((piece, n))
                    else:
                        total += k * n
                # A row of its own carries what is known, under a key that no pre-token equals.
                rows += [i] * (len(rest) + 1)
                pieces += [f"\n{i}.{total}.{len(text)}", *(p for p, _ in rest)]
                times += [0, *(n for _, n in rest)]
                done += [total, *[0] * len(rest)]
                size += [len(text.encode()), *[0] * len(rest)]
                held += sum(len(p) for p, _ in rest)
                if held > FLUSH_CHARS:
                    yield out()
                    rows, pieces, times, done, size, held = [], [], [], [], [], 0
            if rows:
                yield out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of(docs).alias("text")).mapInArrow(scan, f"row long, doc_id {kind}, piece string, times long, done long, size long")
    sums = parts.join(words.select("piece", "n_pieces"), "piece", "left").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sum("size").alias("n_bytes"), F.sum(F.col("done") + F.col("times") * F.coalesce("n_pieces", F.lit(0))).alias("n_tokens")
    )
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
