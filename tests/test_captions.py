import pytest
from pyspark.sql import functions as F

from rulemill.operators import captions


@pytest.mark.parametrize("page, heavy", [((239, 6, 2493), True), ((12, 8, 655), True), ((5, 0, 4000), False), ((25, 0, 1500), True), ((25, 0, 1999), False)])
def test_heavy(spark, page, heavy):
    df = spark.createDataFrame([page], "drawing_count int, image_count int, text_chars int")
    assert captions.score(df).first().is_heavy == heavy


def test_cost_and_unknown_model(spark):
    usage = spark.createDataFrame([("gemini-2.5-pro", 1200, 350), ("other", 1200, 350)], "model string, prompt_tokens int, output_tokens int")
    assert {round(r.cost_usd, 9) for r in captions.with_cost(usage, captions.prices(spark)).collect()} == {0.005}


def test_budget_matches_a_loop(spark):
    import random

    r = random.Random(1)
    rows = [(run, page, r.choice([0.0, 0.5, 1.0, 2.0]), r.choice(["x", " ", None]), False) for run in range(20) for page in range(15)]
    expected = {}
    for run in range(20):
        spent = 0.0
        for _, page, cost, caption, _ in [x for x in rows if x[0] == run]:
            if spent >= 5.0:
                expected[run, page] = "budget_exceeded"
                continue
            spent += cost
            expected[run, page] = "captioned" if caption and caption.strip() else "empty_response"
    df = spark.createDataFrame(rows, "run_id int, page int, cost_usd double, caption string, dry_run boolean")
    assert {(x.run_id, x.page): x.status for x in captions.apply_budget(df).collect()} == expected


def test_billable(spark):
    df = spark.createDataFrame([((10, 5, 2, 99),), ((10, 0, None, 25),), (None,)], "u struct<prompt: int, output: int, thoughts: int, total: int>")
    a, b = captions.billable_tokens(F.col("u"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [(10, 7), (10, 15), (0, 0)]


def test_prices_without_the_default_are_refused(spark):
    usage = spark.createDataFrame([("other", 1, 1)], "model string, prompt_tokens int, output_tokens int")
    rows = [("m", 1.0, 1.0), ("m", 2.0, 1.0)]
    with pytest.raises(ValueError):
        captions.with_cost(usage, captions.prices(spark, rows))
    (row,) = captions.with_cost(usage, captions.prices(spark, rows), "m").collect()
    assert row.cost_usd == 3e-6
