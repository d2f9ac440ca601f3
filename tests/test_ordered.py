"""Running sums and as-of lookups against loops."""

import random

import pytest

from rulemill.operators import ordered, rules


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_running_sums(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 90), i, r.randint(0, 9)) for i in range(300)]
    own = ordered.running_sum(spark.createDataFrame(rows, "g string, at int, id int, v int").repartition(5), "g", "at", "v", "before", ("id",), parts)
    assert own.columns == ["g", "at", "id", "v", "before"]
    want, total = {}, {}
    for g, at, i, v in sorted(rows, key=lambda x: (x[1], x[2])):
        want[i] = total.get(g, 0)
        total[g] = want[i] + v
    assert {x.id: x.before for x in own.collect()} == want
    assert ordered.running_sum(own.limit(0).drop("before"), "g", "at", "v", "before").count() == 0


def test_a_run_is_shared_by_tasks(spark):
    plan = ordered.running_sum(spark.range(4000).selectExpr("1 AS g", "id AS at", "1 AS v"), "g", "at", "v", "before", parts=40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    try:
        parts = plan.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 4000 and max(parts) < 2500


@pytest.mark.parametrize("parts", [1, 3, 12])
def test_last_before(spark, parts):
    r = random.Random(parts)
    right = [(g, r.randint(5, 200), r.randint(0, 50)) for g in "aab" for _ in range(20)] + [("c", 100, 1)]
    left = [(r.choice("abcd"), r.randint(0, 220), i) for i in range(300)]
    own = ordered.last_before(spark.createDataFrame(left, "g string, at int, id int"), spark.createDataFrame(right, "g string, at int, v int"), "g", "at", "v", parts)
    want = {i: max(((a, v) for h, a, v in right if h == g and a <= at), default=(0, None))[1] for g, at, i in left}
    assert {x.id: x.v for x in own.collect()} == want


def test_pages_by_halving(spark):
    r = random.Random(1)
    for n in (1, 2, 3, 7, 64, 100):
        starts = sorted(r.sample(range(1000), n))
        df = spark.createDataFrame([([(s, i + 1) for i, s in enumerate(starts)], o) for o in (0, 1, 500, 999, 5000, *starts)], "starts array<struct<start: int, page: int>>, offset int")
        rows = df.select("offset", rules.page_at(df["starts"], df["offset"]).alias("page")).collect()
        assert [x.page for x in rows] == [max((i + 1 for i, s in enumerate(starts) if s <= x.offset), default=1) for x in rows]
