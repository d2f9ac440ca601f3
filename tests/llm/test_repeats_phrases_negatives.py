"""Removal of repeats, collocations and hard negatives against loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulemill.llm import negatives, phrases, suffixes
from rulemill.llm.queries import QUERIES


def removed(rows, least):
    """(id, text) in the order of the corpus -> id, bytes, removed, spans, digest of the rest."""
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data) + 1)
        for s in range(len(data) - least + 1):
            if data[s : s + least] in seen:
                gone[s : s + least] = b"\1" * least
            else:
                seen.add(data[s : s + least])
        spans = sum(gone[i] and not gone[i - 1] for i in range(len(data)))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", suffixes.span_count(F.col("spans")), "kept_sha256").collect()), key=str)


def test_repeats_equal_a_loop(spark, sf):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    own = sorted((tuple(r) for r in QUERIES["op11_suffix_array"](spark, sf).collect()), key=str)
    assert own == removed(rows, 100)
    assert sum(r[2] for r in own) > 0


@pytest.mark.parametrize("hot", [2, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_in_small_alphabets(spark, monkeypatch, seed, hot):
    """Runs of one letter, periods, shared passages with other surroundings, copies."""
    monkeypatch.setattr(suffixes, "PIECE", 64)
    monkeypatch.setattr(suffixes, "BUCKET", 400)
    r = random.Random(seed)
    some = lambda n, letters="ab": "".join(r.choice(letters) for _ in range(n))
    passage = some(40, "abcdé")
    rows = [(i, r.choice([some(90), "a" * r.randint(0, 90), "abc" * r.randint(0, 30), some(r.randint(0, 30)) + passage + some(r.randint(0, 30)), some(9) + passage[3:25] + some(9), "", None])) for i in range(60)]
    rows = sorted(dict(rows + [(100 + i, rows[i][1]) for i in range(0, 60, 3)]).items())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(suffixes.remove_repeats(df, 12, 4, hot)) == removed(rows, 12)


def test_repeats_of_odd_rows(spark):
    long = " ".join(f"w{i * 7919 % 10_007}" for i in range(60_000))
    rows = [(5, long), (5, long), (None, long[1000:1300]), (7, "ü" * 200), (8, "short"), (8, "short"), (9, None), (9, None), (6, ""), ((1 << 60) + 1, "x" + long[50_000:51_000]), (1 << 60, "y" + long[50_000:51_000])]
    df = spark.createDataFrame([(*x, "own", 1) for x in rows], "doc_id long, text string, places string, tie int")
    order = sorted(rows, key=lambda x: (x[0] is None, x[0]))
    assert found(suffixes.remove_repeats(df)) == removed(order, 100)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
    spans = {r.doc_id: r.spans for r in suffixes.remove_repeats(df).where("doc_id > 10").collect()}
    assert [(s.start, s.end) for s in spans[1 << 60]] == [(1, 1001)] and [(s.start, s.end) for s in spans[(1 << 60) + 1]] == [(1, 1001)]


def test_common_prefixes_by_increasing_value():
    r = np.random.default_rng(3)
    for least in (1, 2, 5, 9):
        text = np.concatenate([np.append(r.integers(1, 4, 40), 0) for _ in range(6)]).astype(np.uint8)
        order = suffixes.suffix_array(text)
        data = bytes(text)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        border = suffixes.first_differences(text[order - 1], text[order], least)
        for i in range(1, len(order)):
            a, b = data[order[i - 1] :][:least], data[order[i] :][:least]
            assert border[i] == (a != b or 0 in a or len(a) < least)


def collocated(rows, longest, least, top, share):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in own.items():
            if any(100 * b >= share * a for q, b in own.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("longest, shard, starts", [(3, 60, 3), (3, 500_000, 20_000), (4, 200, 5)])
def test_phrases_equal_a_loop(spark, monkeypatch, longest, shard, starts):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "STARTS", starts)
    r = random.Random(longest)
    words = ["the", "The", "of", "größe", "ÉTÉ", "a b", "x", "y", "new york city", "new york city hall"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b"]) for _ in range(r.randint(0, 60)))
    rows = [(r.choice(["en", "de", None, "und"]), r.choice([text(), text(), "", None, "x " * r.randint(0, 40)])) for _ in range(80)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "lang string, text string, id int").repartition(3)
    own = phrases.collocations(df, longest, 5, 20, 50)
    assert sorted(tuple(x) for x in own.collect()) == collocated(rows, longest, 5, 20, 50)
    assert phrases.collocations(df.limit(0), longest).count() == 0


@pytest.mark.parametrize("window", [1, 3, 7, 50, 1 << 20])
def test_words_of_texts_by_windows(monkeypatch, window):
    monkeypatch.setattr(phrases, "WINDOW", window)
    r = random.Random(window)
    text = lambda: "".join(r.choice(["The", "größe", "É", "x" * 9, " ", " ", "\t", ".", ",", "\n", "\x0b", "\x1c"]) for _ in range(r.randint(0, 12)))
    texts = [text() for _ in range(200)] + ["", "", "ab", "cd", "", " ", "."]
    want = []
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            want += [(w.encode(), i, j == 0) for j, w in enumerate(w for w in piece.replace("\t", " ").split(" ") if w)]
    own = [x for words, of, opens in phrases._words(pa.array(["skipped", *texts]).slice(1)) for x in zip(words.to_pylist(), of.tolist(), opens.tolist())]
    assert own == want
    assert list(phrases._words(pa.array([], pa.string()))) == []


def test_order_by_sixteen_bits_at_a_time():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 1 << 40, 3000) // (1 << 36) * 70_001, r.integers(0, 5, 3000)
    assert phrases._order(a, b).tolist() == np.lexsort((a, b)).tolist()
    assert phrases._order(np.empty(0, np.int64)).tolist() == []


def test_filter_has_all_that_was_put_in(spark):
    rows = spark.range(50_000).selectExpr("id AS w1", "id * 7919 AS w2", "1L AS n")
    bits = phrases._filter(rows, 2, 50_000)
    ids = np.arange(50_000)
    assert phrases._may_be(bits, phrases._hash([ids, ids * 7919])).all()
    assert phrases._may_be(bits, phrases._hash([ids, ids * 7919 + 1])).mean() < 0.1


def mined(rows, is_anchor, positives, negatives_, low, high):
    usable = []
    for i, (vec_id, label, vec) in enumerate(rows):
        if label is not None and vec is not None and all(x is not None and np.isfinite(x) for x in vec):
            usable.append((i, vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in vec]))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    key = lambda x: (-x[0], x[1] is None, x[1])
    for i, a_id, a_label, a in usable:
        if a_id is None or not is_anchor(a_id):
            continue
        best = sorted(((score(a, v), v_id) for j, v_id, label, v in usable if j != i and label == a_label), key=key)[:positives]
        for s, p_id in best:
            hits = sorted(((t, v_id) for t, v_id in ((score(a, v), v_id) for j, v_id, label, v in usable if label != a_label) if low * s <= 100 * t <= high * s), key=key)[:negatives_]
            out += [(a_id, p_id, rank, v_id, s, t) for rank, (t, v_id) in enumerate(hits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, bucket, scale", [(None, 16_384, 1), (7, 10, 1), (3, 25, 1e4)])
def test_negatives_equal_a_loop(spark, block, bucket, scale):
    r = np.random.default_rng(4)
    vector = lambda: [float(x) for x in (r.normal(size=6) * r.choice([0.1, 1, 1, 5]) * scale).astype(np.float32)]
    rows = [(i, int(r.integers(0, 3)), vector()) for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)]  # the same vectors
    rows += [(5, 1, vector()), (None, 0, vector()), (300, None, vector()), (301, 1, None), (302, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, 1, [float("nan")] * 6), (304, 2, [float("-inf")] * 6), (305, 2, [0.0] * 6), (310, 0, [1.5, 2.0]), (315, 1, [])]
    df = spark.createDataFrame([(*x, "row", 2.0) for x in rows], "vec_id long, label int, embedding array<float>, row string, norm2 double").repartition(4)
    own = negatives.mine(df, F.col("vec_id") % 5 == 0, anchor_block=block, bucket_rows=bucket)
    want = mined(rows, lambda i: i % 5 == 0, 5, 3, 50, 95)
    assert sorted((tuple(x) for x in own.collect()), key=str) == want and len(want) > 50
    assert own.schema["rank"].dataType.simpleString() == "int"


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (2, 2, None)], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(df, F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(df, F.col("vec_id") == 1).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine(spark.createDataFrame([(1, 1, [1e30])], "vec_id long, label int, embedding array<float>"), F.col("vec_id") == 1)
