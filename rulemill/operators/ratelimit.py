"""Rate limits in windows that open with a request."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from rulemill.functions.text import present

REQUESTS, SECONDS = 10, 60


def key_of(sender: Column) -> Column:
    """The limiter's key: all without a sender share one."""
    return F.translate(F.coalesce(present(sender), F.lit("unknown")), "/:@", "___")


def sessions(df: DataFrame, key: str, micros: str, seconds: float) -> DataFrame:
    """Adds session: a pause of `seconds` or more certainly opens a window, so what lies
    between two such pauses can be judged alone. Pauses are looked for between buckets as
    long as a window, of which a busy key has few, not between its requests."""
    span = int(seconds * 1e6)
    df = df.withColumn("bucket", F.floor(F.col(micros) / span))
    edges = df.groupBy(key, "bucket").agg(F.min(micros).alias("lo"), F.max(micros).alias("hi"))
    order = W.partitionBy(key).orderBy("bucket")
    starts = edges.withColumn("opens", (F.col("lo") - F.lag("hi").over(order) >= span).cast("long"))
    numbered = starts.withColumn("session", F.coalesce(F.sum("opens").over(order), F.lit(0))).select(F.col(key).alias("s_key"), F.col("bucket").alias("s_bucket"), "session")
    return df.join(numbered, F.col(key).eqNullSafe(F.col("s_key")) & (F.col("bucket") == F.col("s_bucket"))).drop("s_key", "s_bucket", "bucket")


def allow(times: np.ndarray, start: float | None, count: int, most: int, span: int) -> tuple[np.ndarray, float | None, int]:
    """Which of a key's requests (sorted, microseconds) pass, and the state behind them: the
    first opens a window; one that comes `span` later opens the next; `most` pass in each."""
    passed, at = np.zeros(len(times), bool), 0
    while at < len(times):
        if start is None or times[at] - start >= span:
            start, count = times[at], 0
        end = int(np.searchsorted(times, start + span))
        room = max(0, most - count)
        passed[at : min(end, at + room)] = True
        count += min(end - at, room)
        at = end
    return passed, start, count


def limit(df: DataFrame, key: str, ts: str, max_requests: int = REQUESTS, window_seconds: float = SECONDS, order: str | None = None) -> DataFrame:
    """Adds allowed to requests. Refused ones neither count nor lengthen a window; equal times
    go by `order` (a column). Tasks stream over sorted sessions, so a sender that never
    pauses isn't gathered in memory."""
    span = int(window_seconds * 1e6)
    extra = [order] if order else []
    keyed = sessions(df.withColumn("t_micros", F.unix_micros(F.col(ts).cast("timestamp"))), key, "t_micros", window_seconds)
    ready = keyed.repartition(key, "session").sortWithinPartitions(key, "session", "t_micros", *extra)
    names = [*df.columns]
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "allowed boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, count = None, None, 0
        for batch in batches:
            group = list(zip(batch.column(key).to_pylist(), batch.column("session").to_pylist()))
            times = batch.column("t_micros").to_numpy(zero_copy_only=False)
            passed, at = np.zeros(len(group), bool), 0
            while at < len(group):
                end = at + 1
                while end < len(group) and group[end] == group[at]:
                    end += 1
                if group[at] != last:
                    last, start, count = group[at], None, 0
                passed[at:end], start, count = allow(times[at:end], start, count, max_requests, span)
                at = end
            if len(group):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(passed)], [*names, "allowed"])

    return ready.select(*names, "session", "t_micros").mapInArrow(run, kinds)


class _Limiter(StatefulProcessor):
    """Judges slices of a key's requests, whose times are sorted. State: the open window, until it has certainly ended."""

    def __init__(self, most: int, span: int, slice_ms: int):
        self.most, self.span, self.slice_ms = most, span, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, count long")

    def _end(self, start: int) -> int:
        """When the slice of the window's last request has passed, in milliseconds."""
        return ((start + self.span - 1) // (1000 * self.slice_ms) + 1) * self.slice_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.window.get()
        start, count = known or (None, 0)
        slices = sorted((x for pdf in rows for x in zip(pdf["number"].tolist(), pdf["times"], pdf["rows"])), key=lambda x: x[0])
        judged = []
        for _, times, _ in slices:
            times = np.asarray(times, np.int64)
            late = 0 if start is None else int(np.searchsorted(times, start))
            passed, start, count = allow(times[late:], start, count, self.most, self.span)
            judged.append([False] * late + passed.tolist())
        if self._end(int(start)) > timerValues.getCurrentWatermarkInMs():
            self.window.update((int(start), int(count)))
            if known is None or known[0] != start:
                self.handle.registerTimer(self._end(int(start)))
        elif known is not None:
            self.window.clear()
        yield pd.DataFrame({"key": [key[0]] * len(slices), "rows": [x[2] for x in slices], "allowed": judged})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.window.get()
        if known is not None and self._end(known[0]) <= timerValues.getCurrentWatermarkInMs():
            self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def limit_stream(df: DataFrame, key: str, ts: str, ids: str, max_requests: int = REQUESTS, window_seconds: float = SECONDS, counts: str | None = None, carry: tuple[str, ...] = (), slice_seconds: float | None = None) -> DataFrame:
    """The same over a stream with a watermark on `ts`: key, id, ts, allowed and the columns
    `carry`. What `limit` says of all rows together is what the stream says of them, in whatever
    batches and order they come, if none is later than the watermark allows.

    Requests are judged by event time: those of one key and slice of time (`slice_seconds`, as long as a window
    by default) are gathered by an aggregation until the watermark has passed the slice, and then judged behind the key's earlier
    ones; a task holds those slices of one key that end at once, however many a batch has. A request that is only seen when its window is over and a later one open
    is refused and counts in none. Rows whose column `counts` isn't true, or without a time, pass by at once with a null
    allowed. A window's state goes when it has certainly ended, which changes nothing: the
    next request opens a window anyway. Start the query within `streaming.state.keyed_state`.
    """
    packed = F.struct(F.col(ids).alias("id"), F.unix_micros(F.col(ts)).alias("_rm_at"), *carry)
    kind = df.select(packed.alias("row")).schema["row"].dataType
    slice_ms = max(1, int((slice_seconds or window_seconds) * 1000))
    micros = F.unix_micros(F.col(ts))
    # One look at time and `counts` together: a condition without the time would be applied before the watermark, which
    # then would not see the other rows.
    asks = F.coalesce(micros >= F.when(F.col(counts) if counts else F.lit(True), F.lit(-(1 << 63))), F.lit(False))
    # Rows go as JSON, so that no id passes through a float on its way.
    shaped = df.select(F.col(key).alias("key"), F.col(ts).alias("event_time"), micros.alias("micros"), F.col(ids).isNull().alias("no_id"), F.col(ids).alias("id"), F.to_json(packed).alias("row"), asks.alias("asks"))
    slices = shaped.where("asks").groupBy("key", F.window("event_time", f"{slice_ms} milliseconds").alias("slice")).agg(F.array_sort(F.collect_list(F.struct("micros", "no_id", "id", "row"))).alias("r"))
    slices = slices.select("key", F.window_time("slice").alias("event_time"), F.unix_micros("slice.start").alias("number"), F.col("r.micros").alias("times"), F.col("r.row").alias("rows"))
    limiter = _Limiter(max_requests, int(window_seconds * 1e6), slice_ms)
    judged = slices.groupBy("key").transformWithStateInPandas(limiter, "key string, rows array<string>, allowed array<boolean>", "Append", "EventTime")
    judged = judged.select("key", F.explode(F.arrays_zip("rows", "allowed")).alias("r")).select("key", F.col("r.rows").alias("row"), "r.allowed")
    passing = shaped.where("NOT asks").select("key", "row", F.lit(None).cast("boolean").alias("allowed"))
    told = judged.unionByName(passing).select("key", F.from_json("row", kind).alias("row"), "allowed")
    return told.select("key", "row.id", F.timestamp_micros("row._rm_at").alias("ts"), "allowed", *[F.col(f"row.`{c}`") for c in carry])
