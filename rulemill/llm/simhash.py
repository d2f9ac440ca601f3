"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, saved, small, text_of
from .components import components

#: Rows of a cell that one task compares; a fuller cell is split into pairs of blocks. Full cells
#: that may be broadcast (12 bytes each): beyond it there are twenty thousand million rows in them.
CELL_ROWS, FULL_CELLS = 20_000, 1_000_000
#: For removing duplicates: words in a shingle, words of the longer fingerprint, and the bits in
#: which candidates may differ (39 expected at a resemblance of 0.8, 48 for four shingles against five).
WIDTH, CHECKS, CHECK_BITS = 5, 4, 70
#: Texts and shingles of a group that one task compares; a larger group is split into pairs of blocks.
GROUP_ROWS, GROUP_SHINGLES = 4_000, 500_000
#: Candidates have all minima of one of `BANDS` bands in common. Two sets have a minimum in common
#: as often as they resemble each other, so a pair at 0.8 is missed in 0.0002 of cases.
BANDS, BAND_MINIMA = 16, 4
#: Sets of up to `SHORT` shingles have minima of as many permutations, sets of `LONG` or more those
#: of the parts of one permutation; between the two both. A pair at 0.8 is on one side together.
LONG, SHORT = 256, 320
#: Bits in which the first words of candidates may differ (9.7 expected at 0.8).
NEAR_BITS = 26
_EVEN = 0x5555555555555555


def _hashes(text: str, width: int, repeats: bool, seed: int) -> np.ndarray:
    """XXH64 of the shingles of a text. Only A-Z are lower-cased; words are split at space and
    U+0009 to U+000D; fewer words than `width` are one shingle, no words are none."""
    words = text.encode().lower().split()
    joined, ends, digest = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist(), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, seed)] if words else []
    elif width == 1:
        hashes = [digest(w, seed) for w in (words if repeats else set(words))]
    else:
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[width - 1 :])]
    return np.array(hashes if repeats else list(set(hashes)), np.uint64)


def _majority(hashes: np.ndarray) -> np.uint64:
    """The word whose bits are 1 where over half of the hashes have them."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # very long texts in slices
        part = hashes[i : i + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: str, width: int = 3, repeats: bool = True, seed: int = 42) -> int:
    """The 64-bit fingerprint, 0 for a text without words. With `repeats` a shingle counts as
    often as it occurs, else once."""
    return int(_majority(_hashes(text, width, repeats, seed)))


def _majorities(hashes: np.ndarray) -> np.ndarray:
    """`_majority` of every row of a table of hashes."""
    counts, ones = np.zeros((len(hashes), 64), np.int64), np.uint64(0x0101010101010101)
    for i in range(0, hashes.shape[1], 255):  # a byte counts up to 255
        part = hashes[:, i : i + 255]
        for k in range(8):
            sums = ((part >> np.uint64(k)) & ones).sum(axis=1, dtype=np.uint64)
            counts[:, k::8] += sums.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.packbits(2 * counts > hashes.shape[1], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(text: str, width: int = WIDTH, words: int = CHECKS, seed: int = 42) -> np.ndarray:
    """A fingerprint of `words` times 64 bits of distinct shingles, as signed words: further
    hashes come from mixing the first."""
    return _fingerprints(_hashes(text, width, False, seed), words)


def _fingerprints(hashes: np.ndarray, words: int) -> np.ndarray:
    table = np.empty((words, len(hashes)), np.uint64)
    for k in range(words):
        table[k] = hashes
        hashes = _mix(hashes)
    return _majorities(table).view(np.int64)


def fingerprint_column(text: Column, width: int = 3, repeats: bool = True, seed: int = 42) -> Column:
    """Fingerprints as signed 64-bit integers."""

    return by_text(lambda texts: np.array([fingerprint(x, width, repeats, seed) for x in texts], np.uint64).view(np.int64), "long", pa.int64())(text)


def embed(x: np.ndarray) -> np.ndarray:
    """The embedding: the bit counts of 32 segments of two bits, as two-bit fields of a word.
    The Manhattan distance of two embeddings is at most the Hamming distance of the words."""
    return (x & np.uint64(_EVEN)) + ((x >> np.uint64(1)) & np.uint64(_EVEN))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of embeddings: each field differs by 0, 1 or 2, and by 2 only as 00 against 10."""
    x = a ^ b
    odd, high = x & np.uint64(_EVEN), (x >> np.uint64(1)) & np.uint64(_EVEN)
    # Fields: equal 0; 0-1 or 1-2 differ in the low bit (1); 0-2 differ in the high bit only (2).
    return np.bitwise_count(odd) + 2 * np.bitwise_count(high & ~odd)


def cells(prints: np.ndarray, distance: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, cell): the grid cells in which a fingerprint meets all within `distance`.

    The segments fall into groups; words within `distance` are within distance // groups in
    the embedding of one group at least. A cell is one point of a group's grid. For radius 1
    the points next to it are needed as well, but only from fingerprints of even bit count:
    neighbours at distance 1 differ in parity.
    """
    e, bits = embed(prints), 64 // groups
    at, keys = [], []
    everyone = np.arange(len(prints))
    for g in range(groups):
        shift = np.uint64(g * bits)
        part = (e >> shift) & np.uint64((1 << bits) - 1)
        at.append(everyone)
        keys.append(part)
        if distance // groups == 1:
            low, high = part & np.uint64(_EVEN), (part >> np.uint64(1)) & np.uint64(_EVEN)
            near = everyone[(np.bitwise_count(low) + 2 * np.bitwise_count(high)) % 2 == 0]
            for s in range(0, bits, 2):
                field = (part[near] >> np.uint64(s)) & np.uint64(3)
                for ok, step in ((field < 2, 1), (field > 0, -1)):
                    at.append(near[ok])
                    keys.append(part[near[ok]] + np.uint64(step << s) if step > 0 else part[near[ok]] - np.uint64(1 << s))
        first = len(keys) - 1 if distance // groups == 0 else next(i for i in range(len(keys)) if keys[i] is part)
        for i in range(first, len(keys)):  # the group's number goes on top of the point
            keys[i] = keys[i] | np.uint64(g << 59)
    return np.concatenate(at), np.concatenate(keys)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


_N = BANDS * BAND_MINIMA
_FACTORS = _mix(np.arange(1, _N + 1, dtype=np.uint64)) | np.uint64(1)
_STARTS = (np.arange(_N, dtype=np.uint64) << np.uint64(48)) // np.uint64(_N) << np.uint64(16)


def _joined(minima: np.ndarray, kind: int) -> np.ndarray:
    """A cell for each band of minima."""
    keys = _mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1 + kind * BANDS))
    for column in minima.reshape(BANDS, BAND_MINIMA).T:
        keys = _mix(keys ^ column) + np.uint64(kind)
    return keys


def band_cells(hashes: np.ndarray) -> np.ndarray:
    """The cells in which a set of shingles (sorted hashes) meets those it may resemble, as
    signed words; none for an empty set. A part of the permutation without a shingle counts as
    a minimum of its own, which sets share more often than they resemble each other."""
    cells = [np.empty(0, np.uint64)]
    if 0 < len(hashes) <= SHORT:
        cells.append(_joined((hashes[None] * _FACTORS[:, None]).min(axis=1), 0))
    if len(hashes) >= LONG:
        at = np.searchsorted(hashes, _STARTS)
        first = hashes[np.minimum(at, len(hashes) - 1)]
        there = np.diff(np.r_[at, len(hashes)]) > 0
        cells.append(_joined(np.where(there, first, np.uint64(0)), 1))
    return np.concatenate(cells).view(np.int64)


def _near(prints: np.ndarray, check: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int, bits: int) -> np.ndarray:
    """Which of the pairs i, j are links: first by the lower bound, then exactly, then by the
    words that check what the fingerprints found."""
    near = manhattan(embed(prints[i]), embed(prints[j])) <= distance
    near[near] = np.bitwise_count(prints[i[near]] ^ prints[j[near]]) <= distance
    if check.shape[1]:
        near[near] = np.bitwise_count(check[i[near]] ^ check[j[near]]).sum(axis=1) <= bits
    return near


def _forest(prints: np.ndarray, check: np.ndarray, distance: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near in one cell, as few as join it: each row is linked to the
    first of its component. Rows left over shrink with each step."""
    left = np.arange(len(prints))
    if len(prints) > 16:  # leave out what is alone
        near = np.zeros(len(prints), bool)
        for i in range(0, len(prints), 128):
            x, y = np.nonzero(np.bitwise_count(prints[i : i + 128, None] ^ prints[None]) <= distance)
            x, y = x[x + i != y] + i, y[x + i != y]
            if check.shape[1]:
                x = x[np.bitwise_count(check[x] ^ check[y]).sum(axis=1) <= bits]
            near[x] = True
        left = left[near]
    roots, members = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            hit = _near(prints, check, np.full(len(left), front.pop()), left, distance, bits)
            if hit.any():
                found = left[hit]
                roots.append(np.full(len(found), root))
                members.append(found)
                front += list(found)
                left = left[~hit]
    return np.concatenate(roots), np.concatenate(members)


def _links(distance: int, bits: int):
    """Over rows (cell, fp, node, check words) sorted by cell and fp: links (a, b) of nodes."""

    def one(rows: np.ndarray) -> pa.RecordBatch:
        cell, node = rows[:, 0], rows[:, 2]
        prints, check = (np.ascontiguousarray(rows[:, c]).view(np.uint64) for c in (1, slice(3, None)))
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[start, len(cell)])
        few = 16 if check.shape[1] else 8
        small = np.repeat(sizes <= few, sizes)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in range(1, few):  # small cells: all pairs at once
            i = np.flatnonzero(small[:-d] & (cell[d:] == cell[:-d])) if d < len(cell) else ()
            if not len(i):
                break
            i = i[_near(prints, check, i, i + d, distance, bits)]
            a.append(node[i]), b.append(node[i + d])
        for s, n in zip(start[sizes > few], sizes[sizes > few]):
            x, y = _forest(prints[s : s + n], check[s : s + n], distance, bits)
            a.append(node[s + x]), b.append(node[s + y])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]):
        kept: list[np.ndarray] = []  # of the cell that is still open
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            cut = np.searchsorted(rows[:, 0], rows[-1, 0])
            if cut or kept and kept[0][0, 0] != rows[-1, 0]:
                yield one(np.concatenate([*kept, rows[:cut]]))
                kept = []
            kept.append(rows[cut:])
        if kept:
            yield one(np.concatenate(kept))

    return run


def links(prints: DataFrame, distance: int = 3, groups: int = 2, cell_rows: int = CELL_ROWS, bits: int = 0) -> DataFrame:
    """fp, node and check words v0, v1, ... -> links (a, b) of nodes that join all whose
    fingerprints are within `distance` and whose check words are within `bits` in all: each
    chain of links joins just what a chain of such pairs joins. With a column `cells` rows meet
    in these cells, not in the grid. Repeated rows of a node link nothing new; no rows, no links.

    Cells are counted first, in buckets. One with more than `cell_rows` rows is dealt out as pairs of
    blocks, each a cell of its own, so that no task gets a whole one.
    """
    banded = "cells" in prints.columns
    if not banded and (64 % (2 * groups) or not 0 <= distance < 2 * groups):
        raise ValueError("groups must divide 32 and distance be less than 2 * groups")
    names = ["fp", "node", *(c for c in prints.columns if c.startswith("v"))]

    def spread(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at, keys = cells(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), distance, groups)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.select(names).take(pa.array(at)).columns], ["cell", *names])

    def met(rows: DataFrame) -> DataFrame:
        return rows.select("cell", *names).repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_links(distance, bits), "a long, b long")

    rows = prints.select(F.explode("cells").alias("cell"), *names) if banded else prints.select(*names).mapInArrow(spread, ", ".join(f"{c} long" for c in ["cell", *names]))
    # Most cells have a row or two: buckets of many cells are counted first, then the cells of full buckets.
    buckets = F.lit(max(1, prints.count() * (BANDS if banded else 12 * groups) * 10 // cell_rows))
    bucket = F.pmod(F.xxhash64("cell"), buckets)
    crowded = saved(rows.groupBy(bucket.alias("bucket")).count().where(F.col("count") > cell_rows).select("bucket"), "crowded")
    if crowded.isEmpty():
        return saved(met(rows), "met")
    counts = rows.withColumn("bucket", bucket).join(small(crowded, FULL_CELLS), "bucket", "left_semi").groupBy("cell").count()
    full = saved(counts.where(F.col("count") > cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("n")), "full")
    tagged = rows.join(small(full, FULL_CELLS), "cell", "left")
    blocks = tagged.where("n IS NOT NULL").withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")))
    pairs = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    split = pairs.withColumn("cell", F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")))
    return saved(met(tagged.where("n IS NULL")).union(met(split)), "met")


def _roots(prints: DataFrame, distance: int) -> DataFrame:
    """node, root of distinct fingerprints and nodes."""
    groups = 2 if distance < 4 else 4 if distance < 8 else 8
    roots = components(links(prints, distance, groups))
    return saved(prints.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, repeats: bool = True) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row.

    Documents link when their fingerprints differ in at most `distance` bits; component_id is
    the smallest doc_id reached. Null and empty texts have fingerprint 0 and link like all
    others; repeated rows share a component; null doc_ids never name a component unless it
    has no other. Texts are hashed whole, whatever their length; an empty table has no rows; other columns are left out.
    """
    prints = saved(docs.select("doc_id", fingerprint_column(text_of(docs), width, repeats).alias("fp")), "prints")
    roots = _roots(prints.select("fp", F.col("fp").alias("node")).distinct(), distance).withColumnRenamed("node", "fp")
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, "fp")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _print_column(text: Column) -> Column:
    """node, a digest of the set of shingles, its fingerprint of 1 + CHECKS words and its cells."""

    def of(texts: list[str]) -> list[dict]:
        rows = []
        for x in texts:
            hashes = np.sort(_hashes(x, WIDTH, False, 42))
            node = np.array([xxhash.xxh64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0]
            rows.append({"node": int(node), "words": _fingerprints(hashes, 1 + CHECKS), "cells": band_cells(hashes)})
        return rows

    return by_text(of, "struct<node long, words array<long>, cells array<long>>", pa.struct([("node", pa.int64()), ("words", pa.list_(pa.int64())), ("cells", pa.list_(pa.int64()))]))(text)


def _set_column(text: Column) -> Column:
    """The hashes of a text's distinct shingles, 8 bytes each."""

    return by_text(lambda texts: [_hashes(x, WIDTH, False, 42).tobytes() for x in texts], "binary", pa.binary())(text)


def resembling(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a chain of pairs of a resemblance (Jaccard) of 0.8 or more joins,
    as few as join it; sets aren't empty. Shared elements are counted exactly."""
    lengths = np.array([len(x) for x in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel() if sets else np.empty(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    mark = np.zeros(flat.max(initial=-1) + 1, np.uint8)
    roots, members = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left = np.arange(len(sets))
    rest = flat  # the elements of what is left, in its order
    while len(left) > 1:
        root, front = left[0], [left[0]]
        rest, left = rest[lengths[root] :], left[1:]
        while front and len(left):
            x = front.pop()
            own = flat[starts[x] : starts[x] + lengths[x]]
            mark[own] = 1
            n = lengths[left]
            both = np.add.reduceat(mark[rest], np.cumsum(n) - n, dtype=np.int64)
            mark[own] = 0
            hit = 5 * both >= 4 * (n + lengths[x] - both)
            if hit.any():
                roots.append(np.full(hit.sum(), root))
                members.append(left[hit])
                front += list(left[hit])
                rest, left = rest[np.repeat(~hit, n)], left[~hit]
    return np.concatenate(roots), np.concatenate(members)


def _compared(batches: Iterator[pa.RecordBatch]):
    """Rows (cell, node, shingles) sorted by cell and node -> links of nodes."""

    def one(nodes: list[int], sets: list[bytes]) -> pa.RecordBatch:
        x, y = resembling([np.frombuffer(s, np.uint64) for s in sets])
        at = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at[x]), pa.array(at[y])], ["a", "b"])

    cell, nodes, sets = None, [], []
    for batch in batches:
        for c, n, s in zip(*(column.to_pylist() for column in batch.columns)):
            if c != cell:
                if len(nodes) > 1:
                    yield one(nodes, sets)
                cell, nodes, sets = c, [], []
            if not nodes or nodes[-1] != n:  # rows that are repeated as a whole
                nodes.append(n)
                sets.append(s)
    if len(nodes) > 1:
        yield one(nodes, sets)


def verified(docs: DataFrame, prints: DataFrame, near: DataFrame, rows: int = GROUP_ROWS, shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Links of nodes whose sets of shingles have a resemblance of 0.8 or more, among all pairs
    of a group of `near` (node, root). `prints` (doc_id, h, node) says whose text a node is."""
    first = prints.join(small(near), "node").groupBy("node", "root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("k"))
    first = small(saved(first.select("node", "root", F.col("k.doc_id").alias("_rm_id"), F.col("k.h").alias("_rm_k")), "first"))
    keyed = docs.select("doc_id", text_of(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    found = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("_rm_id")) & (F.col("h") == F.col("_rm_k"))).select("root", "node", _set_column(F.col("text")).alias("shingles"))
    sets = saved(found.where(F.length("shingles") > 0), "sets")
    sizes = sets.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum(F.length("shingles")) / (8 * shingles))).cast("int").alias("n"))
    blocks = sets.join(small(saved(sizes, "sizes")), "root").withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")))
    pairs = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = pairs.select(F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "node", "shingles")
    return saved(met.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_compared, "a long, b long"), "same")


def deduplicate(docs: DataFrame, distance: int = NEAR_BITS, bits: int = CHECK_BITS) -> DataFrame:
    """`docs` with one row of each group of near duplicates: that of the smallest doc_id
    (null is the largest), of equal ids that of the smallest hash of the text.

    Two texts are linked if their sets of five-word shingles have a resemblance (Jaccard) of
    0.8 or more, which is counted over the sets themselves. Pairs to compare are those of a
    group of candidates: candidates meet in a cell of minima of their shingles, and their
    fingerprints are within `distance` in the first word and within `bits` in the next 256.
    Groups are what links join. Texts without words have one set, the empty one, and form one
    group, as do all others of equal sets. Of rows of equal doc_id and text that of the largest
    hash of all its columns stays, in whatever order they are read; an empty table
    stays one; very long texts cost in proportion to their length. All columns stay.
    """
    text = text_of(docs)
    checks = [f"v{k}" for k in range(CHECKS)]
    parts = [F.get("words", F.lit(k)).alias(c) for k, c in enumerate(["fp", *checks])]
    one = docs.select("doc_id", F.xxhash64(text).alias("h"), _print_column(text).alias("p")).select("doc_id", "h", "p.*")
    prints = saved(one.select("doc_id", "h", "node", "cells", *parts), "prints")
    near = components(links(prints.select("fp", "node", *checks, "cells").dropDuplicates(["node"]), distance, bits=bits))
    roots = small(components(verified(docs, prints.select("doc_id", "h", "node"), near)))
    named = prints.select("doc_id", "h", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("k"), F.count(F.lit(1)).alias("n"))
    ranked = named.join(small(saved(groups.where("n > 1").drop("n"), "groups")), "root").where(~(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("h") == F.col("k.h"))))
    drop = small(saved(ranked.select(F.col("doc_id").alias("_rm_id"), F.col("h").alias("_rm_drop")).distinct(), "drop"))
    keyed = docs.withColumn("_rm_h", F.xxhash64(text))
    out = keyed.join(drop, F.col("doc_id").eqNullSafe(F.col("_rm_id")) & (F.col("_rm_h") == F.col("_rm_drop")), "left_anti")
    if not prints.groupBy("doc_id", "h").count().where("count > 1").isEmpty():  # rows that are repeated as a whole
        told = F.max_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_rm_row")
        out = out.groupBy(F.col("doc_id").alias("_rm_id"), "_rm_h").agg(told).select("_rm_row.*")
    return out.select(*docs.columns)
