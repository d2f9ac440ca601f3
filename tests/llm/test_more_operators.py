"""Second forms, planted cases and plans of the operators."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rulemill.llm import common, mixing, pii, quality, secrets, sketch, tokens, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def filled(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Targets by rounds: all share by weight, who has enough stops, the rest share again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, total = {}, set(names), share * sum(sizes.values())
    while left:
        level = (total - sum(target.values())) / sum(w[s] for s in left)
        full = {s for s in left if w[s] * level > cap * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in left}
        target |= {s: cap * sizes[s] for s in full}
        left -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_rounds(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 10, 500, 100_000]) for i in range(r.randint(1, 9))} | {None: 7}
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    expected = filled(sizes)
    assert all(math.isclose(x.target, expected[x.source], rel_tol=1e-9, abs_tol=1e-9) for x in found.collect())


def test_mixing_by_a_loop(spark):
    """Repeated rows, ties, a source of decorated junk alone, and few rows in a bucket."""
    r = random.Random(1)
    rows = [(i, "a", "word " * r.randint(0, 9)) for i in range(300)] + [(i, "junk", "%%%% " * 5 + "$$" * r.randint(0, 9)) for i in range(2000)]
    rows += [(7, "b", "x y z " * 5)] * 3 + [(8, None, None), (9, "empty", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    own = mixing.mix(docs, bucket_rows=50).collect()
    sizes = Counter()
    for x in own:
        sizes[x.source] += x.size
    target = filled(sizes)
    taken = Counter()
    for x in own:
        assert 0 <= x.taken <= 2 * x.size and math.isclose(x.target, target[x.source])
        taken[x.source] += x.taken
    assert taken == {s: int(t) for s, t in target.items()} | {s: 0 for s in sizes if not sizes[s]}
    mixed = mixing.mixture(docs, bucket_rows=50).collect()
    assert Counter((x.doc_id, x.source, x.taken) for x in mixed) == Counter((x.doc_id, x.source, x.taken) for x in own if x.taken)


def test_shares_of_keys_are_even(spark):
    """Buckets of a source whose keys have two rates hold what they are meant to."""
    rows = [(i, "%% " * 9 if i % 10 else "plain words") for i in range(20_000)]
    weighed = common.saved(mixing._weighed(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")), None, 42).drop("text"), "t")
    keys, weights = (np.array([x[0] for x in weighed.select(c).collect()]) for c in ("_rm_key", "_rm_weight"))
    above = sum(np.mean(weights == w) * np.exp(-w * keys) for w in np.unique(weights))
    counts = np.bincount(np.minimum(19, (20 * (1 - above)).astype(int)), minlength=20)
    assert counts.max() < 1.3 * 1000 and counts.min() > 0.7 * 1000


def test_told_splits_hot_keys(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1), (3, 9)], "k long, v long")
    of = common.saved(spark.createDataFrame([(1, "x", 50), (2, "y", 1), (None, "z", 1)], "k long, w string, n long"), "of")
    a, b = (sorted(map(str, common.told(rows, of, "k", F.col("n") > 10, limit).collect())) for limit in (100, 0))
    assert a == b and len(a) == 52


def test_archives_are_read_by_a_task_each(spark):
    pages = spark.createDataFrame([(i, "http://a", f"page {i}") for i in range(60)], "page_id long, url string, html string").repartition(6)
    folder = warc.archive_folder(spark)
    archives = warc.write_archives(warc.chunk_table(pages), folder)
    assert archives.count() == 6
    parts = warc.read_archives(archives, folder).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 6 and sum(x["count"] for x in parts) == 60


def test_no_settings_are_left_behind(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.checkpoint.dir")
    before = [spark.conf.get(n, None) for n in names]
    common.saved(spark.range(3), "t")
    assert [spark.conf.get(n, None) for n in names] == before


def test_a_cluster_must_name_a_folder():
    class Context:
        master, applicationId = "yarn", "x"

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_hosts_of_rules_in_any_case(spark):
    pages = spark.createDataFrame([(1, "http://www.Example.com/x")], "page_id long, url string")
    for most in (10, 0):
        (row,) = urls.judge(pages, [urls.Rule("block", "EXAMPLE.com", "/")], max_trie_rules=most).collect()
        assert (row.rule, row.verdict) == ("example.com/", "block")


def test_token_models_are_looked_at(spark, monkeypatch):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    assert tokens.splits(model)
    docs = spark.createDataFrame([(1, "some text  here\n"), (2, None), (2, "")], "doc_id long, text string").withColumn("piece", F.lit("own"))
    parts = sorted(map(str, tokens.count_tokens(docs, model).collect()))
    monkeypatch.setattr(tokens, "_PIECE", re.compile("[a-z]*"))  # as for a model of pieces with marks inside
    assert not tokens.splits(model)
    assert sorted(map(str, tokens.count_tokens(docs, model).collect())) == parts


def test_statistics_by_loops(sf):
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' LIMIT 60").fetchall()] + ["", "a", "A b\n\nA b\n", "é | % ! [x] 12"]
    for text in texts:
        raw = text.encode()
        n, words, lines = max(1, len(raw)), raw.split(), raw.split(b"\n")
        w, lens = max(1, len(words)), [len(x) for x in words] or [0]
        mean = sum(lens) / len(lens)
        share = lambda chars: sum(raw.count(bytes([c])) for c in chars) / n
        expected = {
            "log_chars": math.log(1 + len(raw)), "log_words": math.log(1 + len(words)), "word_len": mean, "word_len_sd": math.sqrt(sum((x - mean) ** 2 for x in lens) / len(lens)), "longest_word": min(max(lens), 10_000),
            "upper": sum(65 <= b <= 90 for b in raw) / n, "digit": sum(48 <= b <= 57 for b in raw) / n, "space": share(b" \t\n\r"), "period": share(b"."), "comma": share(b","), "bang": share(b"!"), "mark": share(b"#$%&*@^~"),
            "bar": share(b"|"), "bracket": share(b"()[]{}<>"), "other_punct": share(b"\"'-:;?/\\_+=`"), "non_ascii": sum(b > 127 for b in raw) / n, "caps_words": sum(x.isupper() for x in words) / w, "short_words": sum(x <= 3 for x in lens) / w,
            "distinct_words": len(set(words)) / w, "top_word": max((words.count(x) for x in set(words)), default=0) / w, "log_lines": math.log(1 + len(lines)), "line_len": math.log(1 + n / len(lines)), "distinct_lines": len(set(lines)) / len(lines), "top_line": max(lines.count(x) for x in set(lines)) / len(lines),
        }
        assert np.allclose(quality.statistics(text), [expected[k] for k in quality.FEATURES]), text[:50]


def test_trees_by_a_scalar_walk():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 5))
    model = quality.fit_trees(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=12)

    def walk(row):
        total = model.base
        for feature, threshold, leaf in zip(model.feature.tolist(), model.threshold.tolist(), model.leaf.tolist()):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(model.score(x), [walk(row) for row in x.tolist()])


def scored(contexts, occurs, rounds, support, confidence, specific):
    """The bootstrap by dictionaries: contexts (instance, l1, l2, r1, r2) -> (seed, times)."""
    of = {c: [f"{k} {x}" for k, x in zip(("l1", "l2", "r1", "r2"), c[1:]) if x] for c in contexts}
    hits, met = defaultdict(list), Counter()
    for c, own in of.items():
        for p in own:
            hits[p].append(c)
            met[p] += contexts[c][1]
    telling = {p for p in hits if len(hits[p]) >= support and met[p] >= specific * occurs.get(p[3:], met[p])}
    conf = {}
    for step in range(rounds):
        score, trusted = {}, set()
        for p in telling:
            trust = [1.0 if contexts[c][0] else conf.get(c[0], 0.0) for c in hits[p]]
            weight = sum(1.0 if contexts[c][0] or step else 0.5 for c in hits[p])
            score[p] = sum(trust) / (weight + 1)
            if score[p] >= confidence and len({c[0] for c, t in zip(hits[p], trust) if t >= confidence}) >= support:
                trusted.add(p)
        per = defaultdict(list)
        for c, own in of.items():
            if not contexts[c][0] and telling & set(own):
                per[c[0]].append(max((score[p] for p in own if p in trusted), default=0.0))
        conf = {i: sum(x) / len(x) for i, x in per.items()}
    return {i: x for i, x in conf.items() if x >= confidence}


def test_scores_by_dictionaries(spark):
    r = random.Random(4)
    rows = {}
    for _ in range(1500):
        seed = r.random() < 0.4
        left, right = r.choice(["id", "no", "the", "of", ""]), r.choice(["and", "is", "", "end"])
        rows[(f"{'S' if seed else 'X'}{r.randint(0, 120)}", left, left and f"a {left}", right, right and f"{right} z")] = (seed, 1)
    rows |= {(f"S{i}", "mail", "my mail", "ok", ""): (True, 1) for i in range(30)} | {(f"N{i}", "mail", "my mail", "ok", ""): (False, 2) for i in range(30)}
    rows |= {(f"N{i}", "code", "a code", "", ""): (False, 1) for i in range(12)} | {(f"M{i}", "code", "a code", "", ""): (False, 1) for i in range(6)}
    rows |= {(f"C{i}", "chapter", "in chapter", "", ""): (False, 1) for i in range(9)}
    may = spark.createDataFrame([(*c, s) for c, (s, times) in rows.items() for _ in range(times)], "instance string, l1 string, l2 string, r1 string, r2 string, seed boolean")
    occurs = {"the": 9000, "of": 8000, "and": 7000, "is": 700, "a": 99_999, "mail": 130, "code": 30}
    table = spark.createDataFrame(list(occurs.items()), "phrase string, occurs long")
    _, found = pii.discover(may.repartition(4), lambda phrases: table.join(phrases, "phrase", "left_semi"))
    got = {x.instance: x.conf for x in found.collect()}
    expected = scored(rows, occurs, pii.ROUNDS, pii.SUPPORT, pii.CONFIDENCE, pii.SPECIFIC)
    assert got.keys() == expected.keys() and all(math.isclose(got[i], expected[i]) for i in got)
    assert {f"N{i}" for i in range(12, 30)} & got.keys() and not any(i[0] in "SC" for i in got)


def test_occurrences(spark):
    docs = spark.createDataFrame([("the end of the 12 ends",), ("The  end\nof 7",), ("",)], "text string")
    phrases = spark.createDataFrame([("the",), ("the end",), ("of 0",), ("none",)], "phrase string")
    for limit in (10, 0):
        assert {tuple(x) for x in pii.occurrences(docs, phrases, limit).collect()} == {("the", 3), ("the end", 2), ("of 0", 1)}


def planted(texts, seed=5):
    """Texts with identifiers of no base kind in contexts that also hold base ones, and with codes
    of the same shape in contexts of their own."""
    r, out, wanted, others = random.Random(seed), [], set(), set()
    for i, text in texts:
        words = text.split(" ")
        at = r.randrange(len(words) + 1)
        kind = i % 4
        lead = r.choice(["Account holder:", "customer no", "Kontakt per", "usuario registrado"])
        new = f"{r.choice('ABCDEFG')}{r.randint(10, 99)}-{r.randint(1000, 9999)}"
        if kind == 0:
            piece = f"{lead} {r.choice([f'user{i}@mail.example.com', f'+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}'])}"
        elif kind == 1:
            piece, _ = f"{lead} {new}", wanted.add((i, new))
        elif kind == 2:
            piece, _ = f"{r.choice(['chapter', 'part', 'Artikel', 'lote'])} {new}", others.add((i, new))
        else:
            piece = ""
        out.append((i, " ".join([*words[:at], piece, *words[at:]])))
    return out, wanted, others


def test_planted_identifiers_are_found(spark, sf):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf.replace('0.001', '0.01')}/documents.parquet'").fetchall()
    rows, wanted, _ = planted(texts)
    found = pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.explode(F.filter("all_spans", lambda s: s["kind"] == "id")).alias("s")).select("doc_id", "s.start", "s.end").collect()
    by = dict(rows)
    got = {(x.doc_id, by[x.doc_id][x.start : x.end]) for x in found}
    hits = len(got & wanted)
    assert hits >= 0.9 * len(wanted) and hits >= 0.9 * len(got), (hits, len(wanted), len(got))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", None, None), (2, "", "en", "a", 0), (3, "word " * 20_000, "en", "b", 1), (4, "same text of some words here", None, "b", 1), (4, "same text of some words here", None, "b", 1), (None, "no id for this one", "en", "b", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_clashing_names(spark, odd):
    names = ["row", "may", "more", "bucket", "head", "top", "piece", "times", "done", "start", "base_spans", "cells", "node", "root"]
    more = odd.withColumns({n: F.lit("own") for n in names})
    assert pii.summary(pii.scan(more)).count() == 6 and sketch.compare_with_next(more).count() == 6
    only = spark.createDataFrame([(None, "a b"), (None, "c")], "doc_id long, text string")
    assert {x.n_chars for x in sketch.compare_with_next(only).collect()} == {3, 1}
    hot = spark.createDataFrame([(1, f"text {i}") for i in range(40)] + [(2, "x")], "doc_id long, text string").repartition(4)
    rows = sketch.with_next(hot, lambda i, text, after: (i, text, after), "doc_id long, text string, after string", parts=3).collect()
    ordered = ["x", *sorted(f"text {i}" for i in range(40))]
    assert {(x.text, x.after) for x in rows} == set(zip(ordered, [*ordered[1:], "x"]))


def test_pipeline_on_odd_rows(spark, odd, sf):
    names = ["fp", "key", "size", "taken", "spans", "hit"]
    more = odd.withColumns({n: F.lit("own") for n in names})
    for rows in (more, more.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, sf)
            if i < 4:
                assert out.columns == rows.columns and (i != 3 or out.count() == rows.count())
            assert out.count() <= rows.count()


def test_secret_stage_by_a_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {x.doc_id: x for x in corpus_pipeline.STAGES[3][1](spark, docs, sf).collect()}
    rules = [(re.compile(r.pattern, re.A), r.group, r.least) for r in (*secrets.BASE, *secrets.MORE)]
    for x in docs.collect():
        gone = set()
        for pattern, group, least in rules:
            gone |= {i for m in pattern.finditer(x.text) if len(m[group]) >= least for i in range(*m.span())}
        spans, text = [m.span() for m in re.finditer("x+", "".join("x" if i in gone else "." for i in range(len(x.text))))], x.text
        for a, b in reversed(spans):
            text = text[:a] + "[SECRET]" + text[b:]
        assert (out[x.doc_id].text, out[x.doc_id].n_chars) == (text, len(text))
