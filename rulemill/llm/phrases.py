"""Collocations: phrases counted in compressed position bitmaps of words, shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, saved, text_of

#: Words of the longest phrase, occurrences a phrase needs, and phrases that a language gets.
LONGEST, LEAST, TOP = 3, 10, 2000
#: A phrase goes if a longer one around it has at least this share, in hundredths, of its occurrences.
SHARE = 50
#: Words of a shard.
SHARD = 500_000
#: Words whose phrases a task extends at once, before it takes the next ones.
STARTS = 8_000
#: Parts of a language that are ranked apart before all of it is.
PARTS = 16
#: Positions in a word of a bitmap; only words with a bit set are kept.
BITS = 16
#: Bits of the filter that shards get of the frequent phrases of a length: 16 for each, up to this many.
FILTER_BITS = 1 << 28
UNKNOWN = "und"

#: What a byte is: of a word (0), blank (1) or the end of a piece (2).
_KIND = bytes(2 if b in b".,;:!?\n\x0b\x0c\r" else 1 if b in b" \t" else 0 for b in range(256))
#: Bytes of texts whose words are looked for at once; a word is never cut.
WINDOW = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: An entry of a bitmap.
_ENTRY = np.dtype([("block", "<u4"), ("bits", "<u2")])


def _windows(texts: pa.Array) -> Iterator[tuple[bytes, bytes, np.ndarray, np.ndarray]]:
    """Texts (without nulls), some rows at a time and then cut between words: their bytes, A-Z lower-cased, the kinds of
    these, and the texts that begin in the window: where, and their places in the array."""
    starts = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(starts, starts[row] + WINDOW, side="right")) - 1)
        begin = starts[row:upto] - starts[row]
        # Without bytes in all there is no buffer.
        text = texts.buffers()[2].slice(int(starts[row]), int(starts[upto] - starts[row])).to_pybytes().lower() if starts[upto] > starts[row] else b""
        kinds, low = text.translate(_KIND), 0
        while low < len(text):
            high = len(text)
            if high - low > WINDOW:
                high = max(kinds.rfind(b"\1", low, low + WINDOW), kinds.rfind(b"\2", low, low + WINDOW)) + 1
                if not high:  # one long word
                    high = min((x + 1 for x in (kinds.find(b"\1", low), kinds.find(b"\2", low)) if x >= 0), default=len(text))
            own = slice(*np.searchsorted(begin, [low, high]))
            yield text[low:high], kinds[low:high], begin[own] - low, np.arange(row, upto)[own]
            low = high
        row = upto


def _words(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The words of texts in their order, a window at a time; of each the place of its text, and whether it begins a piece."""
    current, fresh = 0, True
    for text, kinds, begin, rows in _windows(texts):
        kind = np.frombuffer(kinds, np.uint8)
        inside = np.zeros(len(kind) + 2, bool)
        inside[1:-1] = kind == 0
        edge = inside[1:] != inside[:-1]
        first, behind = edge & inside[1:], edge & inside[:-1]
        # A text ends the word before it, also where nothing is between them.
        met = begin[inside[begin] & inside[begin + 1]]
        first[met] = behind[met] = True
        at, ends = np.flatnonzero(first), np.flatnonzero(behind)
        offsets = np.concatenate([[0], np.cumsum(ends - at)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(text, np.uint8)[inside[1:-1]])])
        # A word begins a piece if one has ended, or a text begun, since the word before.
        opens = np.zeros(len(at) + 1, bool)
        opens[np.searchsorted(at, np.flatnonzero(kind == 2))] = True
        places = np.searchsorted(at, begin)
        opens[places] = True
        opens[0] |= fresh
        fresh = bool(opens[-1])
        of = np.repeat(np.concatenate([[current], rows]), np.diff(np.concatenate([[0], places, [len(at)]])))
        current = int(rows[-1]) if len(rows) else current
        yield words, of, opens[:-1]


def _order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by keys (not negative), the last of which counts most: sixteen bits at a time, which takes linear time."""
    order = None
    for key in keys:
        for shift in range(0, max(1, int(key.max(initial=0)).bit_length()), 16):
            part = (key >> shift).astype(np.uint16)
            order = np.argsort(part, kind="stable") if order is None else order[np.argsort(part[order], kind="stable")]
    return order


def bitmaps(words: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, block, bits of the compressed bitmaps of all words, in this order, from the words at
    ascending positions."""
    order = _order(words)
    word, block = words[order], positions[order] // BITS
    bit = np.uint16(1) << (positions[order] % BITS).astype(np.uint16)
    head = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])]))
    return word[head], block[head], np.bitwise_or.reduceat(bit, head)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> a row per word of a shard: its occurrences and its bitmap. A position is left
    empty between pieces, so no phrase crosses one."""
    number, held = 0, 0
    found: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    langs: dict[str, int] = {}
    task = TaskContext.get().partitionId() << 32

    def out() -> pa.RecordBatch:
        encoded = pa.chunked_array([w for w, _, _ in found]).combine_chunks().dictionary_encode()
        known = len(encoded.dictionary)
        words = np.concatenate([x for _, x, _ in found]) * known + encoded.indices.to_numpy()
        positions = np.arange(len(words)) + np.cumsum(np.concatenate([x for _, _, x in found]))
        word, block, bits = bitmaps(words, positions)
        edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
        data = np.zeros(len(word), _ENTRY)
        data["block"], data["bits"] = block, bits
        blob = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * data.itemsize).astype(np.int32)), pa.py_buffer(data.tobytes())])
        n = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), edges[:-1])
        own = word[edges[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), task + number)), pa.array([*langs]).take(pa.array(own // known)), encoded.dictionary.take(pa.array(own % known)).cast(pa.string()), pa.array(n), blob], ["shard", "lang", "word", "n", "bitmap"])

    for batch in batches:
        numbers = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], np.int64)
        for words, of, opens in _words(batch.column(1)):
            while held + len(words) >= SHARD:
                # A shard ends where a piece begins.
                least = max(0, SHARD - held)
                after = np.flatnonzero(opens[least:])
                cut = least + int(after[0]) if len(after) else len(words)
                found.append((words.slice(0, cut), numbers[of[:cut]], opens[:cut]))
                held += cut
                words, of, opens = words.slice(cut), of[cut:], opens[cut:]
                if not len(after):
                    break
                yield out()
                number, held, found = number + 1, 0, []
            else:
                found.append((words, numbers[of], opens))
                held += len(words)
    if held:
        yield out()


def vertical(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """shard, lang, word, n (occurrences in the shard) and bitmap (blocks of positions and their bits)."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of(docs, text).alias("text"))
    return rows.mapInArrow(_shards, "shard long, lang string, word string, n long, bitmap binary")


def _hash(ids: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases, by the numbers of their words."""
    total = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        total = (total ^ x.astype(np.uint64)) * _STEP
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def _may_be(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter has hashes: never false of those that were put in."""
    mask = np.uint64(len(bits) * 8 - 1)
    out = np.ones(len(hashes), bool)
    for shift in (0, 32):
        at = (hashes >> np.uint64(shift)) * np.uint64(1 + shift) & mask
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _extended(shard: pa.Table, length: int, filters: list[np.ndarray | None]) -> pa.Table:
    """Phrases of `length` words of a shard (id, bitmap) and their occurrences: the bitmap of a phrase
    is shifted on by one position and met with those of all words; what is left has a bit for each
    occurrence of the longer phrase. The phrases of some first words are extended to their full
    length before those of the next; of the shorter ones only those go on that may be frequent."""
    ids = shard.column("id").to_numpy()
    blob = shard.column("bitmap").combine_chunks()
    blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
    offsets = np.frombuffer(blob.buffers()[1], np.int32, len(blob) + 1, blob.offset * 4)
    data = np.frombuffer(blob.buffers()[2], _ENTRY, offsets[-1] // _ENTRY.itemsize)[offsets[0] // _ENTRY.itemsize :]
    word = np.repeat(np.arange(len(ids)), np.diff(offsets) // _ENTRY.itemsize)
    block, bits = data["block"].astype(np.int64), data["bits"]
    by_block = _order(block)
    in_word, in_bits = word[by_block], bits[by_block]
    begin = np.searchsorted(block[by_block], np.arange(int(block.max()) + 3))
    counted: list[list[np.ndarray]] = [[] for _ in range(length + 1)]
    for first in range(0, len(ids), STARTS):
        take = (word >= first) & (word < first + STARTS)
        phrase, at, now = [word[take]], block[take], bits[take]
        for size in range(2, length + 1):
            # One position on; the last bit of a block becomes the first of the next.
            on = (now << np.uint16(1)).astype(np.uint16)
            over = np.flatnonzero(now >> np.uint16(BITS - 1))
            phrase = [np.concatenate([p, p[over]]) for p in phrase]
            at, now = np.concatenate([at, at[over] + 1]), np.concatenate([on, np.ones(len(over), np.uint16)])
            n = begin[at + 1] - begin[at]
            line = np.repeat(np.arange(len(at), dtype=np.int32), n)
            other = np.arange(len(line)) + np.repeat(begin[at] - (np.cumsum(n) - n), n)
            met = now[line] & in_bits[other]
            left = np.flatnonzero(met)
            line, other, now = line[left], other[left], met[left]
            phrase, at = [*(p[line] for p in phrase), in_word[other]], at[line]
            # A phrase that goes on is frequent itself; of one that is done the last words are.
            asked = (size, phrase) if size < length else (size - 1, phrase[1:])
            if filters[asked[0]] is not None:
                keep = _may_be(filters[asked[0]], _hash([ids[p] for p in asked[1]]))
                phrase, at, now = [p[keep] for p in phrase], at[keep], now[keep]
        order = _order(*phrase[::-1])
        phrase, now = [p[order] for p in phrase], now[order]
        if len(order):
            head = np.flatnonzero(np.concatenate([[True], np.any([p[1:] != p[:-1] for p in phrase], axis=0)]))
            for column, p in zip(counted, phrase):
                column.append(ids[p[head]])
            counted[length].append(np.add.reduceat(np.bitwise_count(now).astype(np.int64), head))
    names = [*(f"w{i + 1}" for i in range(length)), "n"]
    return pa.table({name: np.concatenate(x) if x else np.empty(0, np.int64) for name, x in zip(names, counted)})


def _in_shards(length: int, held):
    return lambda shard: _extended(shard, length, held.value)


def _filter(phrases: DataFrame, length: int, count: int) -> np.ndarray:
    """A Bloom filter of phrases, made in parts by the executors: 16 bits a phrase up to
    `FILTER_BITS`. Past that it lets more through, which costs time and changes no result."""
    size = 1 << max(13, min(FILTER_BITS.bit_length() - 1, (16 * max(1, count) - 1).bit_length()))
    part = 1 << 20 if size >= 1 << 20 else size
    names = [f"w{i + 1}" for i in range(length)]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _hash([batch.column(c).to_numpy() for c in names])
            at = np.unique(np.concatenate([(hashes >> np.uint64(s)) * np.uint64(1 + s) & np.uint64(size - 1) for s in (0, 32)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // part), pa.array(at % part)], ["part", "at"])

    def joined(table: pa.Table) -> pa.Table:
        own = np.zeros(part, bool)
        own[table.column("at").to_numpy()] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    rows = phrases.select(*names).mapInArrow(places, "part long, at long").groupBy("part").applyInArrow(joined, "part long, bits binary")
    for row in rows.toLocalIterator():
        out[row.part * part // 8 : (row.part + 1) * part // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """lang, total (words) and tables of the phrases of 1 to `longest` words with at least `least`
    occurrences: the first has id, lang, word, n; the others w1, w2, ... (ids) and n."""
    spark = docs.sparkSession
    shards = saved(vertical(docs, text, lang), "bitmaps", tidy=True)
    totals = saved(shards.groupBy("lang").agg(F.sum("n").alias("total")), "totals", tidy=True)
    words = shards.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = [saved(words.select(F.monotonically_increasing_id().alias("id"), "lang", "word", "n"), "words", tidy=True)]
    own = saved(shards.join(out[0].select("id", "lang", "word"), ["lang", "word"]).select("shard", "id", "bitmap"), "shards", tidy=True)
    forget(shards)
    filters: list[np.ndarray | None] = [None, None]
    for length in range(2, longest + 1):
        held = spark.sparkContext.broadcast(filters)
        names = [f"w{i + 1}" for i in range(length)]

        found = own.groupBy("shard").applyInArrow(_in_shards(length, held), ", ".join(f"{c} long" for c in names) + ", n long")
        out.append(saved(found.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least), f"phrases{length}", tidy=True))
        held.destroy()
        if length < longest:
            filters.append(_filter(out[-1], length, out[-1].count()))
    forget(own)
    return totals, out


def _scored(phrases: DataFrame, tables: list[DataFrame], length: int) -> DataFrame:
    """Adds lang, phrase, a, l, r and score: of all cuts of a phrase that with the lowest score, then
    the first. Every part of a frequent phrase is frequent, so it is in its table."""
    df = phrases.withColumnRenamed("n", "a")
    for i in range(length):
        word = tables[0].select(F.col("id").alias(f"w{i + 1}"), F.col("word").alias(f"word{i}"), F.col("n").alias(f"n{i}_1"), *([F.col("lang")] if i == 0 else []))
        df = df.join(word, f"w{i + 1}")
    for size in range(2, length):
        for i in (0, length - size):
            part = tables[size - 1].select(*[F.col(f"w{j + 1}").alias(f"w{i + j + 1}") for j in range(size)], F.col("n").alias(f"n{i}_{size}"))
            df = df.join(part, [f"w{i + j + 1}" for j in range(size)])
    cuts = []
    for k in range(1, length):
        left, right = F.col(f"n0_{k}"), F.col(f"n{k}_{length - k}")
        score = F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(n0_{k} as decimal(19,0)) * cast(n{k}_{length - k} as decimal(19,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    df = df.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
    return df.select(*phrases.columns[:-1], "lang", F.concat_ws(" ", *[f"word{i}" for i in range(length)]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SHARE, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first `top` phrases.

    Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at spaces and tabs
    into words; a null language is `und`, null texts count as empty. a is the number of occurrences of
    a phrase of 2 to `longest` words within pieces, overlapping ones included, at least `least`; n that of all words of
    the language. A phrase has the score of its worst cut, floor(1000000 a a / (l r)), where l and r are the
    occurrences of the two parts. Phrases inside a longer candidate that has `share` hundredths of
    their occurrences go. The order is by score, a (both descending) and the bytes of the phrase.

    Each shard of some hundred thousand words has its own bitmaps; counts of shards are summed.
    Words, and then phrases of each length, that aren't frequent in all shards together go no further. Numbers are
    exact for a up to 10^15 (decimals of 38 digits). Repeated rows count each; an empty table has
    no phrases; other columns aren't read.
    """
    totals, tables = counts(docs, longest, least, text, lang)
    rows = None
    for length in range(2, longest + 1):
        one = _scored(tables[length - 1], tables, length)
        names = [f"w{i + 1}" for i in range(length)]
        for more in range(length + 1, longest + 1):
            for i in range(more - length + 1):
                around = tables[more - 1].groupBy(*[F.col(f"w{i + j + 1}").alias(names[j]) for j in range(length)]).agg(F.max("n").alias("around"))
                one = one.join(around, names, "left").where(F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(share) * F.col("a"))).drop("around")
        one = one.select("lang", "phrase", "a", "l", "r", "score")
        rows = one if rows is None else rows.unionByName(one)
    # The first rows of each part of a language, then the first of those: no task gets more than `PARTS` times `top`.
    order = (F.desc("score"), F.desc("a"), "phrase")
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    parts = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    best = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
