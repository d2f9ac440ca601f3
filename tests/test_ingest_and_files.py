import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.operators import captions, ingest
from rulemill.sources import files
from rulemill.sources.folders import new_folder
from rulemill.streaming import chat as stream
from rulemill.streaming.state import keyed_state

CHUNK = "doc_id string, text string, page int, chunk_index int, source string, rule_number string"


def chunks(spark):
    return spark.createDataFrame([("d", "one", 10, 0, "s", "01.01"), ("d", "two", 31, 1, "s", "01.02"), ("d", "three", 31, 2, "s", None)], CHUNK)


def test_captions_keys_summary(spark):
    told = spark.createDataFrame([("d", 31, "a figure")], "doc_id string, page int, caption string")
    df = ingest.with_key(ingest.apply_captions(chunks(spark), told))
    rows = {r.chunk_index: r for r in df.collect()}
    assert [rows[i].has_figure for i in range(3)] == [False, True, True]
    assert len({r.doc_key for r in rows.values()}) == 3 and all(len(r.doc_key) == 32 for r in rows.values())
    s = ingest.summarise(df).first()
    assert (s.chunks, s.figure_chunks, s.figure_pages, s.text_chars, s.caption_chars, s.avg_text_chars) == (3, 2, 1, 11, 16, 4)


def test_build_payload_embed_upsert(spark):
    pages = spark.createDataFrame([("c", 1, "RULE A 01.01\n" + "body text " * 20), ("m", 1, "x. " * 900)], "doc_id string, page int, text string")
    about = spark.createDataFrame([("c", "core_rules", "core"), ("m", "reference", "ref")], "doc_id string, parser_profile string, source string")
    told = spark.createDataFrame([("c", 1, "fig")], "doc_id string, page int, caption string")
    df = ingest.with_key(ingest.build_chunks(pages, about, told))
    assert {(r.parser_profile, r.has_figure) for r in df.collect()} == {("core_rules", True), ("reference", False)}
    body = json.loads(ingest.payload(df.where("parser_profile = 'reference'")).first().payload)
    assert "rule_number" not in body and body["source_category"] == "reference"
    vectors = ingest.embed(df, ingest.hashing_encoder(8), batch_size=2)
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in vectors.collect())
    once = ingest.upsert(df, df)
    assert sorted(map(str, once.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert ingest.changed_only(df, df).count() == 0


def test_encoder_must_keep_lengths(spark):
    with pytest.raises(Exception, match="a vector per text"):
        ingest.embed(chunks(spark), lambda texts: []).collect()


def test_catalogue_and_caption_files(spark, tmp_path):
    (tmp_path / "hits.json").write_text(json.dumps({"hits": [{"title": "A", "id": {"file": "a.pdf"}}, {"title": "B"}]}))
    assert [r.title for r in files.read_hits(spark, str(tmp_path / "hits.json")).collect()] == ["A", "B"]
    (tmp_path / "none.json").write_text("{}")
    assert files.read_hits(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "cap.json").write_text(json.dumps({"source_pdf": "p", "sha256": "s", "pages": {"3": {"caption": " x "}, "4": {"caption": " "}}}))
    assert [tuple(r) for r in files.read_captions(spark, str(tmp_path / "cap.json")).collect()] == [("p", "s", 3, "x")]
    pages = spark.createDataFrame([(1, 5, "captioned", None, 2, 3, 0.5, "c")], "run_id int, page int, status string, skip_reason string, prompt_tokens int, output_tokens int, charged_usd double, caption string")
    out = files.caption_file(captions.summarise(pages), pages).first()
    assert out.pages_captioned == 1 and out.pages["5"].caption == "c"
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a.pdf").write_bytes(b"abc")
    assert files.file_digests(spark, str(tmp_path / "bin"), root="bin/").first().relative_path == "a.pdf"


def test_store(spark, tmp_path):
    a = ingest.with_key(chunks(spark))
    first, _ = files.upsert_store(spark, str(tmp_path / "one"), a)
    assert first.count() == 3
    again, written = files.upsert_store(spark, str(tmp_path / "one"), a.withColumn("text", F.upper("text")).limit(2))
    assert again.count() == 3 and again.where("text = upper(text)").count() == written == 2


def test_stream_equals_batch(spark, tmp_path):
    message = lambda i, **k: {"messages": [{"id": str(i), "type": "text", "chat_id": "u", "timestamp": 1000 + i, "text": {"body": "a question"}, "from": "me"} | k]}
    rows = [message(i) for i in range(4)] + [message(3), message(9, from_me=True), {"event": {"type": "statuses"}, "messages": [{"id": "x"}]}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(map(json.dumps, rows)))
    clock = message(8000, from_me=True)
    (tmp_path / "in" / "clock.txt").write_text(json.dumps(clock))
    payloads = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "payload")
    with keyed_state(spark):
        query = stream.limited(stream.gated(payloads), 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert {r.id: r.allowed for r in spark.table("limited").collect()} == {"0": True, "1": True, "2": False, "3": False}
    # Two batches: the second is answered from the first one's answers.
    texts = [(1, "a question of rules"), (2, "other things")]
    chunks = ingest.embed(spark.createDataFrame(texts, "id long, text string"), ingest.hashing_encoder(8)).selectExpr("*", "1 AS page", "'S' AS section_hint", "'' AS parent_section", "'src' AS source", "'' AS rule_number", "'' AS figure_description")
    told = {}
    options = dict(cache=str(tmp_path / "cache"), chunks=chunks, encode_fn=ingest.hashing_encoder(8), reply_to=lambda prompt: F.lit("**yes**"), k=1, buckets=2, trigger={"availableNow": True})

    def answer(folder):
        rows = stream.limited(stream.gated(spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "payload")), 2, 60)
        stream.answer_batches(rows, folder, lambda df, epoch: told.update({r.id: (r.decision, r.reason, r.route, r.reply) for r in df.collect()}), **options).awaitTermination()

    answer(str(tmp_path / "d"))
    assert told == {"0": ("ask", None, "prompted", "*yes*"), "1": ("ask", None, "cached", "*yes*"), "2": ("reply", "rate limit", None, stream.REPLIES["rate limit"]), "3": ("reply", "rate limit", None, stream.REPLIES["rate limit"])}
    (tmp_path / "in" / "b.txt").write_text("\n".join(map(json.dumps, [message(9200), message(9201, type="image", text=None), message(9202, text={"body": "xyz"}), message(89_000, from_me=True)])))
    answer(str(tmp_path / "d"))
    assert (told["9200"], told["9201"][1], told["9202"][2:]) == (("ask", None, "cached", "*yes*"), "text only", ("prompted", "*yes*"))


def test_the_last_write_of_a_key_stays(spark, tmp_path):
    old = spark.createDataFrame([("k", "old", 1, 0), ("o", "stays", 1, 0)], "doc_key string, text string, page int, chunk_index int")
    new = spark.createDataFrame([("k", "b", 2, 0), ("k", "a", 2, 1), ("k", "z", 1, 5), ("n", "x", 1, 0)], old.schema).repartition(4)
    assert sorted((r.doc_key, r.text) for r in ingest.upsert(old, new).collect()) == [("k", "a"), ("n", "x"), ("o", "stays")]
    files.upsert_store(spark, str(tmp_path / "store"), old)
    store, written = files.upsert_store(spark, str(tmp_path / "store"), new)
    assert sorted((r.doc_key, r.text) for r in store.collect()) == [("k", "a"), ("n", "x"), ("o", "stays")] and written == 2


def test_missing_manifests_are_empty_and_clusters_name_a_folder(spark, tmp_path):
    assert files.read_manifest(spark, str(tmp_path / "none.json")).count() == 0

    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master, applicationId = "spark://host", "x"

    with pytest.raises(ValueError):
        new_folder(Session, "x")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_the_encoder_counts_words_as_hashes_say():
    import hashlib

    import numpy as np

    from rulemill.operators import ingest

    encode, texts = ingest.hashing_encoder(dim=16), ["a b a", "", "b " * 40 + "é", "x" * 100 + " a"]
    encode(["a b other"])  # words that are known by now count the same
    want = np.zeros((len(texts), 16), np.float32)
    for i, text in enumerate(texts):
        for word in text.split():
            h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
            want[i, h % 16] += 1 if h >> 63 else -1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert (encode(texts) == want).all()
    places = dict(zip(encode.__code__.co_freevars, encode.__closure__))["places"].cell_contents
    assert "a" in places and "x" * 100 not in places
