"""Personal data: patterns are tried in rows of marked words only, and phrases counted once."""

import random
import re
import time

from pyspark.sql import functions as F

from rulemill.llm import pii, spans


def test_rows_hold_what_the_whole_text_holds(spark):
    r = random.Random(8)
    some = ["a@b.c", "a@b.c,d@e.f", "+1 (234) 567 89", "+1", "(", ")-", "--", "1.2.3.4", "4111 1111", "k:'Z9'", "é", "x", "", "\t", "\n", "\U0001f600"]
    texts = ["".join(r.choice("ab@.+12 -()\n\té\U0001f600") for _ in range(r.randint(0, 40))) for _ in range(400)] + [" ".join(r.choice(some) for _ in range(r.randint(0, 20))) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = docs.select("text", pii.rows_of(F.col("text")).alias("found")).select("text", "found", spans.placed(spans.within(F.col("found"), pii.TOKEN), around=True).alias("tokens"), spans.matches(F.col("text"), pii.TOKEN, around=True).alias("whole"))
    for x in found.collect():
        pieces = [p for pair in zip(x.found.gaps, [*x.found.all, ""]) for p in pair]
        assert "".join(pieces) == x.text and not any(re.search("[0-9@]", g) for g in x.found.gaps)
        assert x.tokens == x.whole, x.text


def test_texts_without_marks_cost_little(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    docs = spark.createDataFrame([(" ".join(r.choice(words) for _ in range(20_000)) + " 7",) for _ in range(40)], "text string").repartition(4).cache()
    docs.count()

    def least(column):
        took = []
        for _ in range(4):
            began = time.time()
            docs.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    rows = docs.select(pii.rows_of(F.col("text")).alias("found")).collect()
    assert all(x.found.all == ["7"] for x in rows)
    assert least(pii.rows_of(F.col("text"))) < 0.5 * least(F.regexp_extract_all("text", F.lit(pii.TOKEN), F.lit(0)))


def test_last_words_count_once(spark):
    docs = spark.createDataFrame([("of the end",), ("the end",), ("end",)], "text string")
    phrases = spark.createDataFrame([("end",), ("the end",), ("the",)], "phrase string")
    for limit in (10, 0):
        assert {tuple(x) for x in pii.occurrences(docs, phrases, limit).collect()} == {("end", 3), ("the end", 2), ("the", 2)}
