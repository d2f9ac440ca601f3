"""The near-duplicate stage against the resemblance of five-word shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.llm import simhash
from rulemill.llm.components import components


def words(r, n, letters):
    return ["".join(r.choices(letters, k=3)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["appended", "inserted", "deleted", "scattered"])
def test_copies_with_other_words_are_found(spark, kind):
    """Words repeat, so a passage changes the set of words more than that of shingles."""
    r, rows = random.Random(3), []
    for i in range(40):
        text = r.choices(words(r, 40, "abcdefghij"), k=300)
        at = r.randrange(270)
        rows.append((i, " ".join(text)))
        if kind == "deleted":
            text = text[:at] + text[at + 25 :]
        elif kind == "scattered":
            for j in r.sample(range(300), 4):
                text[j] = "new"
        else:
            at = 300 if kind == "appended" else at
            text = text[:at] + words(r, 25, "klmnopqrst") + text[at:]
        rows.append((1000 + i, " ".join(text)))
    kept = {x.doc_id for x in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(40))


@pytest.mark.parametrize("sizes", [(4, 5, 4), (9, 9, 8), (12, 15, 12), (90, 90, 80), (200, 250, 200), (255, 260, 229), (256, 320, 256), (250, 300, 245), (900, 900, 800), (5000, 6000, 4900)])
def test_cells_find_resemblance_of_four_fifths(sizes):
    """0.99 of pairs of sets with a resemblance of 0.8 (sizes of the two and of what they share) meet."""
    r, (n, m, both), met = np.random.default_rng(4), sizes, 0
    for _ in range(600):
        hashes = r.integers(0, 2**64, n + m - both, np.uint64)
        pair = [np.sort(x) for x in (hashes[:n], hashes[n - both :])]
        prints = np.stack([simhash._fingerprints(x, 1 + simhash.CHECKS) for x in pair]).view(np.uint64)
        near = np.bitwise_count(prints[0] ^ prints[1])
        met += len(np.intersect1d(*map(simhash.band_cells, pair))) > 0 and near[0] <= simhash.NEAR_BITS and near[1:].sum() <= simhash.CHECK_BITS
    assert met >= 594


def test_cells_keep_others_apart():
    """Sets of a resemblance of 0.2 seldom meet, and sets that share nothing never."""
    r, met = np.random.default_rng(8), 0
    for _ in range(300):
        hashes = r.integers(0, 2**64, 500, np.uint64)
        met += len(np.intersect1d(simhash.band_cells(np.sort(hashes[:300])), simhash.band_cells(np.sort(hashes[200:])))) > 0
        assert not len(np.intersect1d(simhash.band_cells(np.sort(hashes[:250])), simhash.band_cells(np.sort(hashes[250:]))))
    assert met < 30
    assert not len(simhash.band_cells(np.empty(0, np.uint64)))


def test_majorities():
    hashes = np.random.default_rng(5).integers(0, 2**64, (3, 1000), np.uint64)
    for n in (0, 1, 2, 255, 256, 1000):
        assert list(simhash._majorities(hashes[:, :n])) == [simhash._majority(h) for h in hashes[:, :n]]


def resemblance(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.encode().lower().split(), b.encode().lower().split()))
    return len(a & b) / len(a | b) if a | b else 1


def brute(texts):
    """Groups by all pairs of texts."""
    of = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and resemblance(texts[i], texts[j]) >= 0.8:
                of = {k: min(of[i], of[j]) if v in (of[i], of[j]) else v for k, v in of.items()}
    return set(of.values())


def test_stage_against_brute_force(spark):
    """Copies on both sides of 0.8, chains, exact copies and texts of a few words."""
    r, texts = random.Random(6), {}
    for i in range(40):
        n = r.choice([7, 9, 12, 30, 100, 300])
        text = words(r, n, "abcdefghij")
        texts[10 * i] = " ".join(text)
        for k in range(1, r.randint(2, 6)):
            extra = r.randint(0, max(1, int(n * 0.45)))
            texts[10 * i + k] = " ".join(text + words(r, extra, "klmnopqrst"))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in simhash.deduplicate(docs).collect()}
    assert kept == brute(texts)


def test_full_cells_are_split(spark):
    """Cells of more rows than one task takes give the same groups."""
    r = np.random.default_rng(9)
    base = r.integers(0, 2**63, 5)
    rows = [(int(x ^ (1 << int(b))), i * 64 + int(b)) for i, x in enumerate(base) for b in range(0, 60, 2)]
    prints = spark.createDataFrame(rows, "fp long, node long").withColumn("cells", F.array(F.lit(1), F.col("node") % 3))
    for bound in (20_000, 7):
        of = {n: n for _, n in rows}
        for a, b in simhash.links(prints, 4, cell_rows=bound).collect():
            old, new = sorted((of[a], of[b]), reverse=True)
            of = {k: new if v == old else v for k, v in of.items()}
        assert {frozenset(k for k in of if of[k] == v) for v in of.values()} == {frozenset(i * 64 + b for b in range(0, 60, 2)) for i in range(5)}


@pytest.mark.parametrize("heavy, limit", [(10_000, 100_000), (3, 0)])
def test_components_of_heavy_nodes(spark, heavy, limit):
    """Stars of a largest and of a smallest node, a chain, repeated links, links to oneself."""
    links = [(1000, i) for i in range(900, 930)] + [(1, i) for i in range(10, 40)] + [(50 + i, 51 + i) for i in range(20)] + [(1, 10), (7, 7)]
    rows = {(x.node, x.root) for x in components(spark.createDataFrame(links, "a long, b long"), heavy, limit).collect()}
    expected = {(i, 900) for i in [1000, *range(900, 930)]} | {(i, 1) for i in [1, *range(10, 40)]} | {(i, 50) for i in range(50, 71)}
    assert rows == expected
    assert components(spark.createDataFrame([], "a long, b long"), heavy, limit).count() == 0


def test_groups_split_into_blocks(spark):
    r, texts = random.Random(7), {}
    base = words(r, 60, "abcdefghij")
    for i in range(60):
        texts[i] = " ".join(base + words(r, r.choice([0, 4, 12, 13, 20, 40]), "klmnopqrst"))
    docs = spark.createDataFrame([*texts.items(), (None, ""), (None, "")], "doc_id long, text string")
    prints = docs.select("doc_id", F.xxhash64("text").alias("h"), simhash._print_column(F.col("text")).alias("p")).select("doc_id", "h", "p.node")
    near = prints.select("node", F.lit(1).cast("long").alias("root")).distinct()
    ids = {x.node: x.doc_id for x in prints.where("doc_id IS NOT NULL").orderBy(F.desc("doc_id")).collect()}
    for limits in ((4000, 10**6), (7, 10**6), (4000, 500)):
        of = {i: i for i in ids.values()}
        for x in simhash.verified(docs, prints, near, *limits).collect():
            a, b = of[ids[x.a]], of[ids[x.b]]
            of = {k: min(a, b) if v in (a, b) else v for k, v in of.items()}
        assert set(of.values()) == brute(texts)
