from hypothesis import given, settings
from hypothesis import strategies as st

from rulemill.operators import chunking


def test_bound():
    parts = chunking.split_text("word " * 500, 200, 20)
    assert len(parts) > 1 and max(map(len, parts)) <= 220


def test_hint_index_and_blank_pages(spark):
    pages = spark.createDataFrame([(1, 42, "MOVE UNITS\n\nA sentence."), (1, 43, "  \n"), (1, 44, "More.")], "doc_id long, page int, text string")
    rows = sorted(chunking.chunk_pages(pages, 500, 0).collect(), key=lambda r: r.chunk_index)
    assert [(r.page, r.chunk_index, r.section_hint) for r in rows] == [(42, 0, "MOVE UNITS"), (44, 1, None)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.\n ", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_no_text_is_lost(text, size, overlap):
    parts = chunking.split_text(text, size, overlap)
    letters = lambda x: sum(c in "ab." for c in x)
    assert all(p == p.strip() and p for p in parts)
    assert sum(map(letters, parts)) >= letters(text)
    assert all(p in text for p in parts)


def test_pieces_are_bounded_and_whole():
    import pyarrow as pa

    from rulemill.functions import pieces

    batch = pa.array(["x" * 10_000] * 1_000 + [None, ""])
    found = list(pieces.pieces(batch))
    assert max(p.nbytes for p in found) <= 1.1 * pieces.PIECE_BYTES and sum(map(len, found)) == len(batch)
    assert [len(p) for p in pieces.pieces(pa.array([], pa.string()))] == [0]
    assert [len(p) for p in pieces.pieces(pa.array(["x" * (3 << 20)] * 2))] == [1, 1]


def test_a_batch_is_split_in_pieces(spark):
    texts = [("word " * 3_000 if i % 3 else None if i % 2 else "", i) for i in range(600)]
    df = spark.createDataFrame(texts, "text string, i int").coalesce(1)
    got = {r.i: r.parts for r in df.select("i", chunking.recursive_split(df.text).alias("parts")).collect()}
    assert got == {i: chunking.split_text(t or "") for t, i in texts}
