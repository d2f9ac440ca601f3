"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rulemill.llm import common, decontaminate, mixing, pii, quality, secrets, simhash, sketch, tokens, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their results.
CLASHING = ["hit", "key", "fp", "bucket", "score", "size", "row", "spans", "n_words", "base_spans", "k_h", "rule", "host"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "word " * 60_000, "en", None, 300_000), (4, "same text of some words here", None, "b", 1), (4, "same text of some words here", None, "b", 1), (None, "no id for this one", "en", "b", 1), (5, "same text of some words here", "en", "a", 1), (6, "x" * 200_000, "en", "c", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    return docs


def keeps(before, after, but=()):
    """Every column of the input is there once and, but for results, as it was."""
    for c in before.columns:
        assert after.columns.count(c) == 1
        if c in CLASHING and c not in but:
            assert {r[0] for r in after.select(c).distinct().collect()} == {f"own {c}"}


def test_simhash(spark, docs, clashing):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[2] == {("0" * 16, 1)} and {c for _, c in by[4]} == {c for _, c in by[5]} == {4}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    out = simhash.deduplicate(clashing)
    keeps(clashing, out)
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 1), (False, 3), (False, 4), (False, 6), (True, None)]
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_sketch(docs):
    rows = sketch.compare_with_next(docs).collect()
    assert len(rows) == 8 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sketch.compare_with_next(docs.limit(0)).count() == 0


def test_mixing(docs, clashing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 8 and all(0 <= r.taken <= 2 * r.size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    keeps(clashing, mixing.mixture(clashing), but=("size",))


def test_tokens(docs):
    import public_tokenizers

    rows = tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == 8 and {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}
    assert tokens.count_tokens(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_decontamination(spark, docs, clashing):
    items = spark.createDataFrame([(1, "same text of some words here"), (1, "same text of some words here"), (None, "no id"), (2, None), (3, " .")], "item_id long, text string")
    rows = decontaminate.scan(docs.select("doc_id", "text"), items).collect()
    joined = decontaminate.scan(docs.select("doc_id", "text"), items, max_chars=0).collect()
    assert sorted(map(str, rows)) == sorted(map(str, joined))
    assert {(r.doc_id, tuple(r["items"]), r.n_hit) for r in rows if r.n_hit} == {(4, ("1",), 6), (5, ("1",), 6), (None, (), 2)}
    assert not any(r.contaminated for r in rows if r.doc_id in (1, 2, 3, 6))
    keeps(clashing, decontaminate.remove(clashing, items))
    cut = decontaminate.remove(clashing, items, spans=True)
    keeps(clashing, cut)
    assert {r.text for r in cut.where("doc_id = 5").collect()} == {""}
    assert decontaminate.scan(docs, items.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.scan(docs.limit(0), items).count() == 0


def test_quality(spark, docs, clashing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 7)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    keeps(clashing, quality.accepted(clashing, none))


def test_secrets(docs, clashing):
    assert secrets.scan(docs).where("size(all_spans) > 0").count() == 0
    assert secrets.scan(docs.limit(0)).count() == 0
    out = secrets.redact(clashing)
    keeps(clashing, out)
    assert out.count() == 8


def test_pii(docs):
    rows = pii.summary(pii.scan(docs)).collect()
    assert len(rows) == 8 and {r.spans for r in rows} == {""} and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.scan(docs.limit(0)).count() == 0


def test_urls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme.com/"), (4, "http://A.com"), (5, "http://a.com/x"), (5, "http://a.com/x"), (6, "http://" + "a." * 20_000 + "com/" + "b/" * 20_000)], "page_id long, url string").withColumn("hit", F.lit("own"))
    out = urls.judge(df, [urls.Rule("block", "com", "/")])
    assert sorted((r.page_id, r.rule, r.verdict) for r in out.collect() if r.page_id in (1, 2, 3, 4)) == [(1, None, "allow"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow")]
    assert {r.rule for r in out.collect() if r.page_id > 4} == {"com/"} and {r.hit for r in out.collect()} == {"own"}
    assert urls.judge(df.limit(0), []).count() == 0


def test_warc(spark):
    df = spark.createDataFrame([(1, None, None), (2, "http://a", ""), (None, "u", "x"), (3, "a\r\nb", "é" * 300_000), (3, "c", "é" * 300_000)], "page_id long, url string, html string").withColumn("sha1", F.lit("own"))
    folder = warc.archive_folder(spark)
    found = warc.read_archives(warc.write_archives(warc.chunk_table(df, chunk=1000), folder), folder, chunk=4096)
    rows = warc.records(found).collect()
    assert sorted((r.page_id or "", r.payload_bytes, r.record_type, r.refers_to) for r in rows) == [("", 1, "response", None), ("1", 0, "response", None), ("2", 0, "revisit", "1"), ("3", 600_000, "response", None), ("3", 600_000, "response", None)]
    assert warc.records(warc.read_archives(warc.write_archives(warc.chunk_table(df.limit(0)), folder), folder)).count() == 0


def test_next_documents_of_large_and_null_ids(spark):
    ids = [*((1 << 60) + 3 * i for i in range(150)), *(-(1 << 61) + i for i in range(150)), *((1 << 53) + i for i in range(99)), None]
    rows = [(i, f"{i} " + " ".join(str((n * 31 + j) % 97) for j in range(n % 40))) for n, i in enumerate(ids)]
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        want[i] = hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    own = sketch.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert {r.doc_id: r.edited_sha256 for r in own.collect()} == want


def test_filters_have_no_false_negatives(spark):
    keys = spark.range(0, 60_000, 3).select(F.xxhash64("id").alias("h"))
    rows = common.may_be_in(spark.range(60_000).withColumn("h", F.xxhash64("id")), F.col("h"), keys, F.col("h"), "may")
    told = {r.id: r.may for r in rows.select("id", "may").collect()}
    assert len(told) == 60_000 and all(told[i] for i in range(0, 60_000, 3))
    assert sum(told.values()) < 20_100
    assert not any(r.may for r in common.may_be_in(spark.range(50), F.xxhash64("id"), keys.limit(0), F.col("h"), "may").collect())


def test_secrets_and_payloads_beyond_the_broadcast(spark):
    rows = [(i % 50, f"text {i} " + ("password: hunter2hunter2 " if i % 3 else "") + "x" * (i % 7)) for i in range(200)] + [(None, "api_key = abcdefgh"), (7, None)] + [(5, "token: abcdefghij")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = (sorted(map(str, secrets.summary(secrets.scan(df, limit=limit)).collect())) for limit in (1000, 0))
    assert few == many and len(many) == len(rows)
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i % 11}") for i in range(80)] + [(None, "n", "page 3"), (3, "u3", "page 3"), (90, None, None), (91, "e", "")], "page_id long, url string, html string")
    few, many = (sorted(map(str, warc.chunk_table(pages, limit=limit).collect())) for limit in (1000, 0))
    assert few == many and len(many) == 84


def test_long_pre_tokens_stay_off_the_driver(spark):
    import public_tokenizers
    import sentencepiece

    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdefgh") for _ in range(30_000))) for i in range(6)] + [(9, "the of the " * 50)]
    model = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {x.doc_id: x.n_tokens for x in tokens.count_tokens(df, model).collect()} == {i: len(library.encode(t)) for i, t in rows}
    words = common.saved(tokens.lexicon(df, model), "lexicon")
    assert sum(map(len, tokens._frequent(words, tokens.HEAD))) < 100 and words.count() > 6


def test_spans_of_a_joined_benchmark(spark):
    item = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"a b {item} c {item} d"), (2, item), (3, "w1 w2 w3"), (4, None)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("x", item), ("y", "w1 w2")], "item_id string, text string")
    few, many = (sorted(map(str, decontaminate.scan(df, bench, max_chars=n).collect())) for n in (1000, 0))
    assert few == many
