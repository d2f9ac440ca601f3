import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rulemill.operators import ratelimit
from rulemill.sources.rowlog import read_log
from rulemill.streaming.state import keyed_state


def loop(rows, most, seconds):
    state, out = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        start, count = state.get(key, (None, 0))
        if start is None or t - start >= seconds:
            state[key], out[i] = (t, 1), True
        elif count >= most:
            out[i] = False
        else:
            state[key], out[i] = (start, count + 1), True
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_matches_a_loop(spark, parts):
    r = random.Random(3)
    rows = [(r.choice("abc"), t, i) for i, t in enumerate(r.choices(range(0, 4000), k=600))] + [("d", 0, 1000), ("d", 60, 1001), ("d", 119, 1002)]
    df = spark.createDataFrame(rows, "key string, t long, id int").withColumn("ts", F.timestamp_seconds("t")).repartition(parts)
    for most, seconds in ((2, 60), (1, 60), (10, 600)):
        got = {x.id: x.allowed for x in ratelimit.limit(df, "key", "ts", most, seconds, order="id").collect()}
        assert got == loop(rows, most, seconds)


def test_keys(spark):
    df = spark.createDataFrame([("a/b:c@d",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(ratelimit.key_of(F.col("s"))).collect()] == ["a_b_c_d", "unknown", "unknown"]


def test_stream_in_batches_out_of_order_equals_batch(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), (1 << 60) + i, r.random() < 0.8, t) for i, t in enumerate(r.choices(range(0, 3500), k=400))]
    schema = "key string, id long, asks boolean, t long"
    arrived = sorted(rows, key=lambda x: x[3] + r.uniform(0, 290))
    arrived.append((None, None, False, 10_000))  # the clock goes on
    df = spark.createDataFrame([(n, *x) for n, x in enumerate(arrived)], f"n int, {schema}").withColumn("ts", F.timestamp_seconds("t"))
    df.repartitionByRange(8, "n").sortWithinPartitions("n").drop("n").write.parquet(f"{tmp_path}/in")
    source = read_log(spark, f"file://{tmp_path}/in", f"{schema}, ts timestamp", f"file://{tmp_path}/cursor", rows=60).withWatermark("ts", "300 seconds")
    with keyed_state(spark):
        query = ratelimit.limit_stream(source, "key", "ts", "id", 2, 60, "asks", ("t",)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert query.lastProgress["batchId"] >= 5
    told = spark.read.schema("key string, id long, ts timestamp, allowed boolean, t long").parquet(f"{tmp_path}/out").where("id IS NOT NULL").collect()
    want = loop([(k, t, i) for k, i, asks, t in rows if asks], 2, 60)
    assert {x.id: x.allowed for x in told} == {i: want.get(i) for _, i, _, _ in rows}
    assert len(told) == len(rows) and {x.id: x.t for x in told} == {i: t for _, i, _, t in rows}


class _Handle:
    """State of one key that counts what is asked of it."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, []

    def getValueState(self, name, kind):
        return self

    getMapState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 600_000


def test_slices_that_end_at_once_cost_few_calls_for_state():
    handle, limiter = _Handle(), ratelimit._Limiter(2, 60_000_000, 60_000)
    limiter.init(handle)
    # Ten slices of three requests each, the last ones first.
    times = [[(n * 60 + s) * 1_000_000 for s in (1, 2, 3)] for n in range(10)]
    rows = pd.DataFrame({"number": [t[0] // 60_000_000 for t in times], "times": times, "rows": [[str(x) for x in t] for t in times]}).iloc[::-1]
    (out,) = limiter.handleInputRows(("a",), iter([rows]), handle)
    assert out["allowed"].tolist() == [[True, True, False]] * 10 and out["rows"].tolist() == rows["rows"].tolist()[::-1]
    assert handle.calls <= 3 and handle.value == (541_000_000, 2) and handle.timers == [660_000]
