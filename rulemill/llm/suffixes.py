"""Removal of long byte strings that stood earlier in a corpus, by Burrows-Wheeler transforms.

A string of `least` bytes has one anchor: of the grams of `GRAM` bytes in it, the leftmost with the
smallest hash. Equal strings have equal anchors, so all strings of one anchor can be judged
without any other. Neighbouring strings with the same anchor are a stretch of text. Of equal
stretches the first alone is looked at further: those behind it are gone from end to end.
Different stretches of one anchor that also share half of what a string has besides, on its left or
on its right, meet in a bucket, whose text is transformed; extending its backward, all of a length before any longer one, gives the common prefixes of its suffixes by
increasing value, and ends at `least`.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, saved, text_of

#: Bytes of a string that counts, and of an anchor.
LEAST, GRAM = 100, 24
#: Bytes of text that a task turns into arrays at once, of one text or several, which a CPU's cache
#: holds; a longer text is walked piece by piece.
PIECE = 1 << 18
#: Bytes of stretches in a bucket, on average.
BUCKET = 1 << 19
#: Stretches of one anchor beyond which each of their strings goes to a bucket of its own hash, so
#: that a line in a large share of all texts doesn't make a bucket as large.
HOT = 10_000
#: Stretches of one anchor up to which they are asked whether others share more than the anchor.
WIDE = 1_000
#: Stretches that a task gathers, to tell repeats among them.
KEPT = 200_000
#: Of a place: a start and the number of starts from there on, below this.
PLACES = 1 << 8

_STEP, _SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_LOW = np.uint64((1 << 26) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the `size` bytes at each place of an array of bytes, made of hashes of twice as many
    bytes at a time."""
    power, width = _BYTES[data], 1
    total, have = None, 0
    while True:
        if size & width:
            if total is None:
                total, have = power, width
            else:
                n = len(data) - have - width + 1
                total = total[:n] * np.uint64(pow(_STEP, width, 1 << 64)) + power[have : have + n]
                have += width
        if have == size:
            return _mix(total)
        n = len(power) - width
        power = power[:n] * np.uint64(pow(_STEP, width, 1 << 64)) + power[width : width + n]
        width *= 2


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - width + size], values[width - size :]) if size < width else values


def stretches(hashes: np.ndarray, sizes: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first start, number of starts and anchor's place of the stretches of texts of `sizes` bytes
    (`least` at least, less than 64 MB in all), put together, by the hashes of their grams."""
    at = _window_least((hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64), least - gram + 1) & _LOW
    # A string that crosses an end is of no text.
    inside = np.repeat(np.tile([True, False], len(sizes)), np.column_stack([sizes - least + 1, np.full(len(sizes), least - 1)]).ravel())
    starts = np.flatnonzero(inside[: len(at)])
    at = at[starts].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return starts[new], np.diff(np.append(new, len(at))), at[new]


@functools.cache
def _powers(step: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, step, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _sequence_hashes(hashes: np.ndarray, step: int):
    """A function of the hashes of the sequences from some places to others: each hash counts with
    a power of `step`, so a sum of all up to a place gives those of any two places."""
    bits = len(hashes).bit_length()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(step, bits)[: len(hashes)])])
    back = _powers(pow(step, -1, 1 << 64), bits)
    return lambda begin, end: _mix((sums[end] - sums[begin]) * back[begin])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of an array of numbers below 255 in the order of their suffixes. Eight numbers are
    compared at once, then as many again as were before, of suffixes that are still equal."""
    n = len(text)
    key = np.zeros(n + 8, np.uint64)
    key[:n] = text + np.uint8(1)  # what is behind the end is smaller than any number
    for width in (1, 2, 4):
        key[: n + 8 - width] = (key[: n + 8 - width] << np.uint64(8 * width)) | key[width:]
    key = key[:n]
    order = np.argsort(key)
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    done = 8
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_):
        own = order[open_]
        behind = own + done
        key = rank[own] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[open_], key = own[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[open_]] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        open_ = open_[~(new & np.append(new[1:], True))]
        done *= 2
    return order


def first_differences(transform: np.ndarray, text_first: np.ndarray, least: int) -> np.ndarray:
    """Of a Burrows-Wheeler transform and the sorted first letters of its suffixes: whether each
    suffix has less than `least` letters in common with the one above. Zeros end a string and
    equal nothing.

    The suffixes that begin with a string w are an interval. All intervals of one length are
    extended backward at once: the suffix c w is the image of w by the order-preserving map from
    letters of the transform to their places in sorted order, so two neighbours that begin with c
    have one letter more in common than the least common prefix between their images. Only
    borders that the last length brought can bring any for the next, so the common prefixes come
    out by increasing value, and the walk ends at `least` or when a length brings none. Where the
    two images are neighbours themselves, as in most of a repeat, the border between them is the only
    one that counts, and leads back to them; other pairs are looked through at every length.
    """
    n = len(transform)
    image = np.argsort(transform, kind="stable").astype(np.int32)  # where the suffix without its first letter is
    border = np.concatenate([[True], text_first[1:] != text_first[:-1]]) | (text_first == 0)
    open_ = np.flatnonzero(~border)
    low, high = image[open_ - 1], image[open_]
    beside, origin = high == low + 1, np.empty(n, np.int32)
    origin[image] = np.arange(n, dtype=np.int32)
    led = np.zeros(n, bool)
    led[open_[beside]] = True
    open_, low, high = open_[~beside], low[~beside], high[~beside]
    fresh, sorted_high, closed = np.flatnonzero(border), None, 0
    for _ in range(1, least):
        if not len(fresh):
            break
        back = origin[fresh]
        back = back[led[back]]  # each border is fresh once
        if not len(open_):
            fresh = back
            border[fresh] = True
            continue
        if sorted_high is None:
            # The images of neighbours with one first letter ascend.
            letter = text_first[open_]
            letters = np.unique(letter).astype(np.int64)
            sorted_high = np.searchsorted(letters, letter) * (n + 1) + high
        if len(fresh) * len(letters) * 4 < len(open_):
            # Few new borders: for each, the pair of images around it of every letter.
            between = np.tile(fresh, len(letters))
            at = np.searchsorted(sorted_high, np.repeat(np.arange(len(letters)) * (n + 1), len(fresh)) + between)
            inside = np.minimum(at, len(open_) - 1)
            met = np.unique(inside[(at < len(open_)) & (low[inside] < between) & (high[inside] >= between)])
        else:
            flags = np.zeros(n, np.int32)
            flags[fresh] = 1
            sums = np.cumsum(flags, dtype=np.int32)
            met = np.flatnonzero(sums[low] != sums[high])
        found = open_[met]
        found = found[~border[found]]
        fresh = np.concatenate([back, found])
        border[fresh] = True
        closed += len(found)
        if closed * 4 > len(open_):
            keep = ~border[open_]
            open_, low, high, sorted_high, closed = open_[keep], low[keep], high[keep], None, 0
    return border


def repeats(parts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """part, first start, number of starts of the strings of `least` bytes in `parts` (in the order of
    the corpus) that an earlier part has too. No part may have a string twice."""
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    ends = np.cumsum(sizes)
    # Bytes of UTF-8 are below 255, which leaves a zero to end a part.
    text = text + np.uint8(1)
    text[ends - 1] = 0
    order = suffix_array(text)
    border = first_differences(text[order - 1], text[order], least)
    at = np.flatnonzero(border)
    whole = np.diff(np.append(at, len(order))) > 1
    begins, until = at[whole], np.append(at, len(order))[1:][whole]
    if not len(begins):
        return (np.empty(0, np.int64),) * 3
    picked = np.repeat(begins - np.concatenate([[0], np.cumsum(until - begins)[:-1]]), until - begins) + np.arange(int((until - begins).sum()))
    places = order[picked]
    part = np.searchsorted(ends, places, "right")
    heads = np.concatenate([[0], np.cumsum(until - begins)[:-1]])
    first = np.repeat(np.minimum.reduceat(part, heads), until - begins)
    gone = np.sort(places[part > first])
    if not len(gone):
        return (np.empty(0, np.int64),) * 3
    runs = np.flatnonzero(np.concatenate([[True], np.diff(gone) != 1]))
    begin = gone[runs]
    part = np.searchsorted(ends, begin, "right")
    return part, begin - (ends[part] - sizes[part]), np.diff(np.append(runs, len(gone)))


def _keyed(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    text = text_of(docs)
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("tie"), F.col(doc_id).isNull().alias("no_id"), text.alias("text"))


def _walked(data: bytes, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text (place, bytes) that have each string of `least` bytes in one of them."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole) - least + 1, PIECE):
        yield at, whole[at : at + PIECE + least - 1]


_FIELDS = ("anchor", "c1", "c2", "near", "doc", "tie", "place")


def _described(pieces: list[tuple], least: int, gram: int) -> list[np.ndarray]:
    """(doc, tie, place, bytes) of pieces -> of each stretch its anchor's hash, a digest in two
    halves, what is next to its anchor, and where it is. Digests and what is next to an anchor are
    hashes of the hashes of grams. The latter has 32 bits for half of what a string has besides the
    anchor on its left, and 32 on its right: equal strings have one of them in common. A stretch that
    doesn't reach so far has bits of its digest there."""
    sizes = np.fromiter((len(x[3]) for x in pieces), np.int64, len(pieces))
    hashes = gram_hashes(np.concatenate([x[3] for x in pieces]), gram)
    first, n, at = stretches(hashes, sizes, least, gram)
    end, half = first + n + least - gram, (least - gram + 1) // 2
    one, two = _sequence_hashes(hashes, _STEP), _sequence_hashes((hashes >> np.uint64(32)) | (hashes << np.uint64(32)), _SECOND)
    c1, c2 = one(first, end), two(first, end)
    low = np.uint64(32)
    left = np.where(at - half >= first, one(np.maximum(at - half, 0), at + 1) >> low, c1 >> low)
    right = np.where(at + half < end, one(at, np.minimum(at + half + 1, len(hashes))) >> low, c2 >> low)
    ends = np.cumsum(sizes)
    own = np.searchsorted(ends, first, "right")
    doc, tie, begin = (np.fromiter((x[i] for x in pieces), np.int64, len(pieces)) for i in range(3))
    place = (first - (ends - sizes)[own] + begin[own]) * PLACES + n
    return [x.view(np.int64) for x in (hashes[at], c1, c2, (left << low) | right, doc[own], tie[own], place)]


def _marked(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Rows of stretches in the order of the corpus, the repeats of earlier ones marked."""
    anchor, c1, c2, near, doc, tie, place = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, tie, doc))
    by = order[np.argsort(c1[order], kind="stable")]
    head = np.concatenate([[True], c1[by[1:]] != c1[by[:-1]]])
    least = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
    again = by[~head & (c2[by] == c2[least])]
    place[again] *= -1
    anchor[again] = c1[again] ^ place[again]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, c1, c2, near, doc, tie, place)], list(_FIELDS))


def _anchors(least: int, gram: int):
    """Texts -> a row per stretch, as `_described`. Of equal ones that a task gathers at once all but
    the first in the corpus are marked (the place is negative) and have no part in their anchor's group,
    so a group has few rows of a task's copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size, found, rows = [], 0, [], 0
        for batch in batches:
            for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                for at, piece in _walked(text.as_py(), least):
                    pieces.append((doc, tie, at, piece))
                    size += len(piece)
                    if size >= PIECE:
                        found.append(_described(pieces, least, gram))
                        rows += len(found[-1][0])
                        pieces, size = [], 0
                        if rows >= KEPT:
                            yield _marked(found)
                            found, rows = [], 0
        if pieces:
            found.append(_described(pieces, least, gram))
        if found:
            yield _marked(found)

    return run


def _contents(least: int, buckets: int):
    """Texts with the places of their stretches (negative: of a hot anchor) -> bucket, doc, tie,
    start, content. A hot anchor's stretches are taken apart into their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row in range(batch.num_rows):
                doc, tie, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].as_py().encode()
                for place, anchor in zip(*(batch.column(3)[row].values.field(i).to_numpy() for i in (0, 1))):
                    start, n = divmod(abs(int(place)), PLACES)
                    cut = [(start, text[start : start + n + least - 1])] if place > 0 else [(s, text[s : s + least]) for s in range(start, start + n)]
                    for s, part in cut:
                        out[0].append((int(anchor) if place > 0 else xxhash.xxh3_64_intdigest(part)) % buckets)
                        for column, value in zip(out[1:], (doc, tie, s, part)):
                            column.append(value)
                if len(out[0]) > 10_000:
                    yield _content_batch(out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _content_batch(out)

    return run


def _content_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["bucket", "doc", "tie", "start", "content"])


def _judged(least: int):
    """A bucket's stretches -> doc, tie, place of the strings that stand in an earlier one."""

    def run(table: pa.Table) -> pa.Table:
        doc, tie, start = (table.column(c).to_numpy() for c in ("doc", "tie", "start"))
        order = np.lexsort((start, tie, doc))
        part, first, n = repeats(table.column("content").take(pa.array(order)).to_pylist(), least)
        row = order[part]
        return pa.table({"doc": doc[row], "tie": tie[row], "place": (start[row] + first) * PLACES + n})

    return run


def repeated_places(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs (doc, tie, text, one row for each pair) -> doc, tie, places: start * 256 + number of
    starts of strings of `least` bytes that stand earlier in the corpus, by (doc, tie, start)."""
    rows = docs.select("doc", "tie", "text").mapInArrow(_anchors(least, gram), ", ".join(f"{x} long" for x in _FIELDS)).repartition("anchor")
    place = F.struct("doc", "tie", "place")
    equal, same = W.partitionBy("anchor", "c1", "c2"), W.partitionBy("anchor")
    told = rows.withColumn("first", F.row_number().over(equal.orderBy("doc", "tie", "place")) == 1).withColumn("kinds", F.sum(F.col("first").cast("int")).over(same))
    kind = F.when((F.col("place") < 0) | ~F.col("first"), "copy").when(F.col("kinds") > hot, "hot").when(F.col("kinds") > WIDE, "wide").otherwise("cut")
    told = saved(told.where("NOT first OR place < 0 OR kinds > 1").select("doc", "tie", kind.alias("kind"), F.abs("place").alias("place"), "anchor", "near"), "stretches", tidy=True)
    halves = told.where("kind = 'cut'").withColumns({"left": F.shiftright("near", 32), "right": F.shiftright(F.shiftleft("near", 32), 32)})
    shared = halves.withColumns({f"n_{side}": F.count(F.lit(1)).over(W.partitionBy("anchor", side)) for side in ("left", "right")}).where("n_left > 1 OR n_right > 1")
    cut = saved(shared.unionByName(told.where("kind IN ('hot', 'wide')"), allowMissingColumns=True).select("doc", "tie", "kind", "place", "anchor"), "cut", tidy=True)
    size = cut.agg(F.sum(F.when(F.col("kind") == "hot", F.col("place") % PLACES * least).otherwise(F.col("place") % PLACES + least))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    wanted = cut.groupBy("doc", "tie").agg(F.collect_list(F.struct(F.when(F.col("kind") == "hot", -F.col("place")).otherwise(F.col("place")).alias("place"), "anchor")).alias("places"))
    contents = docs.select("doc", "tie", "text").join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "places").mapInArrow(_contents(least, buckets), "bucket long, doc long, tie long, start long, content binary")
    judged = saved(contents.groupBy("bucket").applyInArrow(_judged(least), "doc long, tie long, place long"), "repeats", tidy=True)
    out = saved(told.where("kind = 'copy'").select("doc", "tie", "place").unionByName(judged).groupBy("doc", "tie").agg(F.collect_list("place").alias("places")), "places", tidy=True)
    forget(told, cut, judged)
    return out


def runs_of(places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """begin and end of the maximal runs of bytes that the strings at `places` cover."""
    start = np.sort(places)
    begin, end = start // PLACES, start // PLACES + start % PLACES + least - 1
    end = np.maximum.accumulate(end)
    head = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[head], end[np.append(np.flatnonzero(head)[1:] - 1, len(end) - 1)]


def _removed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, kept, digest = [], [], [], [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                data = text.as_py().encode()
                begin, end = runs_of(places.values.to_numpy(), least) if places.is_valid and len(places.values) else (np.empty(0, np.int64),) * 2
                bounds = np.concatenate([[0], np.column_stack([begin, end]).ravel(), [len(data)]]).astype(np.int64).tolist()
                rest = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                size.append(len(data))
                gone.append(len(data) - len(rest))
                spans.append([{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())])
                kept.append(rest)
                digest.append(hashlib.sha256(rest).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), batch.column("no_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(digest)], ["doc", "tie", "no_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    return run


_OUT = "doc long, tie long, no_id boolean, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string"


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (the maximal removed runs of bytes, ends exclusive), kept
    (the other bytes of the text's UTF-8) and kept_sha256 of every row of docs (doc_id, text).

    A byte is removed if it is in a string of `least` bytes that also starts earlier: in a smaller
    doc_id, or in the same text at an earlier place. Strings are judged on the input, overlapping
    ones count, and none crosses texts. Null and empty texts and those of less than `least` bytes
    lose nothing. Null ids come last. Texts of one doc_id are ordered by a hash of theirs; of repeated rows
    the first stays as it is and all others lose everything. An empty table has no rows; other columns
    aren't read. `kept` may begin or end inside a character.
    """
    keyed = _keyed(docs)
    again = saved(keyed.groupBy("doc", "tie", "no_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("n_bytes")).where("n > 1"), "again")
    repeated = bool(again.limit(1).count())
    if repeated:
        keyed = keyed.groupBy("doc", "tie", "no_id").agg(F.max("text").alias("text"))
    places = repeated_places(keyed, least, gram, hot)
    out = keyed.join(places, ["doc", "tie"], "left").select("doc", "tie", "no_id", "text", "places").mapInArrow(_removed(least), _OUT)
    if repeated:
        gone = F.col("n_bytes") >= least
        spans = F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.array().cast("array<struct<start: long, end: long>>"))
        # Short texts stay whole, so all rows of a pair say the same.
        short = out.where(F.col("n_bytes") < least).join(again.select("doc", "tie", "no_id", F.explode(F.sequence(F.lit(2).cast("long"), "n"))), ["doc", "tie", "no_id"]).select(*out.columns)
        whole = again.where(gone).select("doc", "tie", "no_id", "n_bytes", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select("doc", "tie", "no_id", "n_bytes", F.col("n_bytes").alias("n_removed"), spans.alias("spans"), F.unhex(F.lit("")).alias("kept"), F.sha2(F.unhex(F.lit("")), 256).alias("kept_sha256"))
        out = out.unionByName(short).unionByName(whole)
    return out.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept", "kept_sha256")


def span_count(spans: Column) -> Column:
    return F.size(spans).cast("long")
