"""Queries without SQL against plain loops over the same tables."""

import hashlib
import json
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulemill.jobs.registry import QUERIES
from rulemill.operators import retrieval, rules
from rulemill.operators.chunking import split_text


@pytest.fixture(scope="module")
def books(sf):
    out = {}
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY 1").fetchall():
        out.setdefault(doc_id // 16, []).append((doc_id % 16 + 1, text))
    return out


def whole(text, chunks, size=1200, overlap=200):
    """What any cut of a text has: stretches of it in its order that leave out white space alone, and
    repeat at most an overlap; a text of at most `size` characters is one."""
    text = text.strip()
    if len(text) <= size:
        assert chunks == [text] * bool(text)
        return
    covered = {0}  # up to where the chunks so far may reach: short ones may stand in several places
    for chunk in chunks:
        assert chunk and chunk == chunk.strip()
        reached = set()
        for c in covered:
            bare = c + len(text[c:]) - len(text[c:].lstrip())
            place = text.find(chunk, max(0, c - overlap - 1), bare + len(chunk))
            while place >= 0:
                if place + len(chunk) > c:  # each brings something new
                    reached.add(place + len(chunk))
                place = text.find(chunk, place + 1, bare + len(chunk))
        covered = reached
    assert any(not text[c:].strip() for c in covered)


def test_chunks(spark, sf, books):
    expected = set()
    for book, pages in books.items():
        index = 0
        for page, text in pages:
            chunks = split_text(text, 1200, 200)
            whole(text, chunks)
            for chunk in chunks:
                key = hashlib.sha256(f"book_{book}:{page}:{index}".encode()).hexdigest()[:32]
                expected.add((book, page, index, key, hashlib.sha256(chunk.encode()).hexdigest(), len(chunk)))
                index += 1
    rows = [tuple(r) for r in QUERIES["corpus_chunks"](spark, sf).collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    for r in QUERIES["corpus_chunk_summary"](spark, sf).collect():
        own = [x for x in expected if f"book_{x[0]}" == r.source]
        assert (r.chunks, r.text_chars, r.avg_text_chars) == (len(own), sum(x[5] for x in own), round(sum(x[5] for x in own) / len(own)))
    payloads = {r.doc_key: json.loads(r.payload) for r in QUERIES["stored_payloads"](spark, sf).collect()}
    assert {(k, p["page"], hashlib.sha256(p["text"].encode()).hexdigest()) for k, p in payloads.items()} == {(x[3], x[1], x[4]) for x in expected}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.\n ", max_size=400), st.integers(9, 60), st.integers(1, 8))
def test_splitter(text, size, overlap):
    chunks = split_text(text, size, overlap)
    whole(text, chunks, size, overlap)


@pytest.mark.parametrize("block", [None, 3])
def test_nearest_by_brute_force(spark, block):
    """Ties, null and zero vectors, and blocks of queries."""
    r = np.random.default_rng(1)
    rows = {i: r.integers(-2, 3, 4).astype(float).tolist() for i in range(120)} | {200: [0.0] * 4, 201: None}
    table = spark.createDataFrame(list(rows.items()), "id long, embedding array<double>").repartition(3)
    asked = [i for i in rows if i % 10 == 0 or i > 199]
    found = retrieval.top_k(table.where(F.col("id").isin(asked)).withColumnRenamed("id", "query_id"), table, 5, exclude_self=True, query_block=block)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows.items() if v and any(v)}
    expected = []
    for q in asked:
        near = sorted((round(1 - float(unit[q] @ v), 9), i) for i, v in unit.items() if i != q) if q in unit else []
        expected += [(q, i, n + 1) for n, (_, i) in enumerate(near[:5])]
    assert sorted((x.query_id, x.id, x.rank) for x in found.collect()) == sorted(expected)
    assert retrieval.top_k(table.limit(0).withColumnRenamed("id", "query_id"), table).count() == 0


@pytest.mark.parametrize("case", [
    ("drop", "43", "42.01", 42, "a", "Text"), ("drop", "20", "07.01", 3, "AB", ""), ("drop", "24", "23.01", 90, "text", "CORE RULES"), ("drop", "12", "03.01", 90, "FIGHT PHASE", "text"), ("drop", "12", "03.01", 90, "text", "This is"),
    ("drop", "5", "03.01", 5, "HEADING", "text"), ("drop", "9", "03.01", 5, "LONG HEADING", "text"), ("drop", "7", "03.01", 5, "Some caption", "text"), ("drop", "9", "03.01", 5, "", "CAPITALS"), ("drop", "9", "03.01", 5, "It ends.", "CAPITALS"),
    ("keep", "43", "43.01", 42, "text", "AB"), ("drop", "03", "03.01", 50, "text", "text"), ("drop", "30", "03.01", 90, "03", "text"), ("drop", "51", "03.01", 50, "text", ""), ("drop", "50", "03.01", 50, "closed)", "text"),
    ("keep", "6", "03.01", 50, "moves up to", "inches"), ("keep", "51", "03.01", 50, "moves up to", "inches"), ("keep", "3", "03.01", 50, "text", "text"),
])
def test_margin_numbers(case):
    """One case for each row of the table of margins, and plain numbers in running text."""
    verdict, number, rule, page, above, below = case
    assert rules.is_margin(number, rule, page, above, below) == (verdict == "drop")
