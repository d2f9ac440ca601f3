import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.operators import ask, chat, retrieval


@pytest.mark.parametrize("query, legacy", [("How did this work in 9th edition?", True), ("the old rules", True), ("rules from 10th", True), ("edition 10", True), ("8th ed", True), ("How do I charge?", False), ("edition 11", False)])
def test_guard(spark, query, legacy):
    assert spark.createDataFrame([(query,)], "q string").select(ask.is_legacy(F.col("q"))).first()[0] == legacy


def test_citation_forms(spark):
    rows = [(1, 1, " body ", 3, "HINT", "src", "01.02", " fig "), (1, 2, "b", None, "HINT", None, None, None), (1, 3, "c", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "query_id int, rank int, text string, page int, section_hint string, source string, rule_number string, figure_description string")
    assert retrieval.format_context(df).first().context == "### Context 1 (Rule 01.02 | page 3 | src)\nbody\n\n**Diagram on this page:** fig\n\n### Context 2 (HINT)\nb\n\n### Context 3 (chunk 3)\nc"


def test_top_k_ties_nulls_and_blocks(spark, monkeypatch):
    r = np.random.default_rng(0)
    vectors = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)] + [(200, None), (201, [0.0] * 4)]
    chunks = spark.createDataFrame(vectors, "id long, embedding array<float>").repartition(3)
    queries = chunks.where("id < 20 OR id >= 200").withColumnRenamed("id", "query_id")
    ok = {i: np.array(v) for i, v in vectors if v and any(v)}
    expected = {(q, i, k) for q in ok if q < 20 for k, (_, i) in enumerate(sorted((round(1 - ok[q] @ ok[i] / np.linalg.norm(ok[q]) / np.linalg.norm(ok[i]), 9), i) for i in ok)[:8], 1)}
    monkeypatch.setattr(retrieval, "CORPUS_BYTES", 1000)  # some parts of the corpus in each task
    for block in (1000, 5):
        assert {(x.query_id, x.id, x["rank"]) for x in retrieval.top_k(queries, chunks, 0, query_block=block).collect()} == expected
    assert retrieval.top_k(queries, chunks.limit(3), 8).count() <= 66
    plan = retrieval.top_k(queries, chunks, 3, query_block=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan  # one scan, whatever the number of blocks


def test_log_hits_itself(spark):
    log = spark.createDataFrame([(1, 10, "What is it?", True), (2, 11, " what IS it? ", True), (3, 12, "What is it?", False), (4, 13, "no", True), (5, 1, "old rules please", True), (6, 14, "known one", True), (7, 15, "empty one", True)], "query_id int, ts long, query string, use_cache boolean")
    cache = spark.createDataFrame([("known one", "yes"), ("empty one", "")], "q string, answer string").select(F.sha2("q", 256).alias("query_hash"), "answer")
    assert {r.query_id: r.route for r in ask.routed(log, cache).collect()} == {1: "retrieve", 2: "cached", 3: "retrieve", 4: "invalid", 5: "refused", 6: "cached", 7: "retrieve"}


def test_replies(spark):
    df = spark.createDataFrame([("# Head\n**b** " + "x" * 2500, ["s", None, "a"])], "answer string, sources array<string>")
    phone, server = (chat.format_reply(df, c).first().reply for c in ("phone", "server"))
    assert phone.startswith("HEAD\n*b* xx") and len(phone) == 1600 and phone.endswith("...") and len(server) == 2000
    short = spark.createDataFrame([(" ok ", ["s", "a", "s"])], "answer string, sources array<string>")
    assert chat.format_reply(short, "server").first().reply == "ok\n\n*Source: a, s*"


def test_server_gate(spark):
    gate = chat.Gate(bot_id=7, allowed_guilds="111,222", allowed_channels="999")
    rows = [(1, False, 111, 999, [7], "<@7> hello there"), (1, False, None, 999, [7], "hello"), (1, True, 111, 999, [7], "hello there"), (7, False, 111, 999, [7], "hello"), (1, False, 111, 999, [], "@rulesbot hi"), (1, False, 111, 5, [7], "hello")]
    df = spark.createDataFrame(rows, "author_id long, author_is_bot boolean, guild_id long, channel_id long, raw_mentions array<long>, content string")
    assert [(r.decision, r.reason) for r in chat.decide_server(df, gate).collect()] == [("ask", None), ("drop", "group not allowed"), ("drop", "bot"), ("drop", "own message"), ("reply", "too short"), ("drop", "channel not allowed")]


def test_distances_held_at_once_are_bounded(monkeypatch):
    import numpy as np

    from rulemill.operators import retrieval

    r = np.random.default_rng(1)
    unit, rows = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.integers(-2, 3, (900, 8)) + 0.5, r.integers(-2, 3, (3_000, 8)) + 0.5))
    held, usual = [], np.round
    monkeypatch.setattr(retrieval, "DISTANCES", 500)
    monkeypatch.setattr(np, "round", lambda d, n: held.append(d.size) or usual(d, n))
    nearest = retrieval._Nearest(np.arange(900), unit, 5, True)
    for at in range(0, 3_000, 2_500):
        nearest.add(np.arange(3_000)[at : at + 2_500], rows[at : at + 2_500])
    monkeypatch.undo()
    assert max(held) <= 500
    d = np.round(1 - unit @ rows.T, retrieval.DIGITS)
    d[np.arange(900), np.arange(900)] = np.inf
    order = np.lexsort((np.broadcast_to(np.arange(3_000), d.shape), d), axis=1)[:, :5]
    assert (nearest.i == order).all() and (nearest.d == np.take_along_axis(d, order, 1)).all()


def test_a_batch_of_a_stream_is_made_and_answered_once(spark, tmp_path):
    from rulemill.operators import ingest
    from rulemill.sources import paths
    from rulemill.streaming import chat as stream

    kind = "key string, id string, ts timestamp, allowed boolean, decision string, reason string, query string, chat_id string"
    rows = [("u", str(i), f"2024-01-01 00:00:{i:02d}", True, "ask", None, f"question {i % 4}", "c") for i in range(8)] + [("u", "8", "2024-01-01 00:00:09", None, "reply", "too short", None, "c")]
    spark.createDataFrame(rows, kind.replace("timestamp", "string")).coalesce(1).write.json(str(tmp_path / "in"))
    texts = spark.createDataFrame([(1, "question 1 of rules"), (2, "other things")], "id long, text string")
    chunks = ingest.embed(texts, ingest.hashing_encoder(8)).selectExpr("*", "1 AS page", "'S' AS section_hint", "'' AS parent_section", "'src' AS source", "'' AS rule_number", "'' AS figure_description")
    asked, told, plans, held = spark.sparkContext.accumulator(0), {}, [], []

    @F.udf("string")
    def reply(prompt):
        asked.add(int(prompt is not None))
        return prompt and "yes"

    def sink(df, epoch):
        told.update({r.id: (r.route, r.reply) for r in df.collect()})
        plans.append(df._jdf.queryExecution().toString())
        held.extend(f.rsplit("/", 2)[0] for f in df.inputFiles() if "/batch-" in f)

    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        messages = spark.readStream.schema(kind).json(str(tmp_path / "in")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["id"])
        query = stream.answer_batches(messages, str(tmp_path / "c"), sink, str(tmp_path / "cache"), chunks, ingest.hashing_encoder(8), reply_to=reply, k=1, buckets=2, trigger={"availableNow": True})
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert told == {str(i): ("prompted" if i < 4 else "cached", "yes") for i in range(8)} | {"8": (None, stream.REPLIES["too short"])}
    assert asked.value == 4  # a model is asked once for a question
    # What is done with a batch knows nothing of the stream's plan, and has tasks by its size, not by the parts of the state.
    assert plans and not any("InMemoryRelation" in p or "Deduplicate" in p for p in plans)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(job).stageIds}
    assert 0 < sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 600
    assert held and not any(paths.exists(spark, f) for f in held)  # its files are gone behind it
