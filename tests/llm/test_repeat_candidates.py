"""Removal of repeats: which stretches meet in buckets, and several texts in one array."""

import random

import numpy as np
import pytest
from test_repeats_phrases_negatives import found, removed

from rulemill.llm import suffixes


@pytest.fixture
def tables(monkeypatch):
    rows, saved = {}, suffixes.saved

    def counted(df, name, **more):
        out = saved(df, name, **more)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(suffixes, "saved", counted)
    return rows


def test_an_anchor_alone_leads_to_no_bucket(spark, tables):
    r = random.Random(6)
    some = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    shared, longer = some(60), some(130)
    rows = [(i, some(100) + shared + some(100)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(suffixes.remove_repeats(df)) == removed(rows, 100)
    assert tables["stretches"] > 0 and tables["cut"] == 0
    rows += [(100 + i, some(50) + longer + some(50)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    own = found(suffixes.remove_repeats(df))
    assert own == removed(rows, 100) and sum(x[2] for x in own) >= 3 * 130
    assert 0 < tables["cut"] < tables["stretches"]


@pytest.mark.parametrize("wide", [0, 3])
def test_wide_anchors_skip_the_question(spark, monkeypatch, tables, wide):
    monkeypatch.setattr(suffixes, "WIDE", wide)
    monkeypatch.setattr(suffixes, "PIECE", 90)
    r = random.Random(7)
    some = lambda n, letters="ab": "".join(r.choice(letters) for _ in range(n))
    passage = some(30, "abcdé")
    rows = [(i, r.choice([some(60), "ab" * r.randint(0, 40), some(9) + passage + some(9), some(5) + passage[:20] + some(12), "a" * 50])) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least, gram in ((12, 4), (13, 4), (9, 8)):
        assert found(suffixes.remove_repeats(df, least, gram)) == removed(rows, least)
    assert tables["cut"] > 0


def test_texts_in_one_array_are_as_alone():
    r = np.random.default_rng(4)
    texts = [r.integers(97, 100, int(r.integers(12, 90))).astype(np.uint8) for _ in range(30)]
    pieces = [(i, 7, 0, t) for i, t in enumerate(texts)]
    together = suffixes._described(pieces, 12, 4)
    alone = [np.concatenate(x) for x in zip(*(suffixes._described([p], 12, 4) for p in pieces))]
    assert all((a == b).all() for a, b in zip(together, alone))
    anchor, c1, c2, near, doc, _, place = (x.tolist() for x in together)
    content = [bytes(texts[d][p // 256 : p // 256 + p % 256 + 11]) for d, p in zip(doc, place)]
    assert len({*zip(content, c1, c2)}) == len({*content}) == len({*zip(c1, c2)})
    assert sum(p % 256 for p in place) == sum(len(t) - 11 for t in texts)
