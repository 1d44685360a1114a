"""Stateful processors for what built-in windows cannot say: sliding de-duplication, count
windows per flow, correlation sessions, template memory.

State lives in the RocksDB state store, one key per flow, alert key, group or template, and
is small per key (a timestamp, at most one window, a few sums). Rows of one key arrive
ordered inside each micro-batch here; across batches the order is the arrival order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICRO = 1_000_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _arrivals(rows: Iterator[pd.DataFrame], order: list[str]) -> Iterator[tuple]:
    """Rows of one key and batch in order; batches of a key are merged before sorting."""
    frames = [r for r in rows if len(r)]
    if not frames:
        return
    whole = pd.concat(frames).sort_values(order, kind="stable")
    yield from whole.itertuples(index=False)


def _struct(**fields: T.DataType) -> T.StructType:
    """State schema built without the JVM, which tasks cannot reach."""
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


class DedupProcessor(StatefulProcessor):
    """Emit the first alert of a run; each alert extends the run by the window."""

    def __init__(self, window_us: int, columns: list[str], order: list[str]):
        self.window_us, self.columns, self.order = window_us, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _struct(us=T.LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        fresh = []
        for row in _arrivals(rows, self.order):
            ts = row.ts_us
            if last is None or ts - last > self.window_us:
                fresh.append([getattr(row, c) for c in self.columns])
            last = ts if last is None else max(last, ts)
        if last is not None:
            self.last.update((int(last),))
            # once the watermark passes this, no alert can extend the run any more
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last + self.window_us) // 1000 + 1)
        if fresh:
            yield pd.DataFrame(fresh, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_dedup(alerts: DataFrame, window_s: int = 300, tie: str = "alert_id") -> DataFrame:
    """Sliding de-duplication of a stream with watermarked ``ts``, ``ts_us`` and ``dedup_key``."""
    keep = [c for c in alerts.columns if c != "ts"]
    schema = T.StructType([alerts.schema[c] for c in keep])
    return alerts.groupBy("dedup_key").transformWithStateInPandas(
        DedupProcessor(window_s * MICRO, keep, ["ts_us", tie]), schema, "Append", "EventTime"
    )


class CountWindowProcessor(StatefulProcessor):
    """Collect vectors of a flow; every ``length`` of them leave as one window."""

    def __init__(self, length: int, order: list[str]):
        self.length, self.order = length, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", _struct(vec=T.ArrayType(T.DoubleType())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [list(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        done = []
        for row in _arrivals(rows, self.order):
            held.append([float(x) for x in row.vec])
            if len(held) == self.length:
                done.append((key[0], float(row.timestamp), held))
                held = []
        if held:
            self.waiting.put([(v,) for v in held])
        else:
            self.waiting.clear()
        if done:
            yield pd.DataFrame(done, columns=["flow_key", "timestamp", "seq"])

    def close(self) -> None:
        pass


def stream_tumbling_sequences(df: DataFrame, length: int = 10, tie: str = "id") -> DataFrame:
    """Count windows of a stream of ``flow_key, timestamp, vec`` rows."""
    schema = "flow_key STRING, timestamp DOUBLE, seq ARRAY<ARRAY<DOUBLE>>"
    keyed = df.filter(F.octet_length("flow_key") > 0).select("flow_key", "timestamp", "vec", tie)
    return keyed.groupBy("flow_key").transformWithStateInPandas(
        CountWindowProcessor(length, ["timestamp", tie]), schema, "Append", "None"
    )


class SessionProcessor(StatefulProcessor):
    """Number each alert of a correlation group inside its session."""

    def __init__(self, idle_us: int, columns: list[str], order: list[str]):
        self.idle_us, self.columns, self.order = idle_us, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _struct(first=T.LongType(), last=T.LongType(), n=T.LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last, n = self.state.get() if self.state.exists() else (None, None, 0)
        out = []
        for row in _arrivals(rows, self.order):
            ts = row.ts_us
            if last is None or ts - last > self.idle_us:
                first, n = ts, 0
            out.append([*[getattr(row, c) for c in self.columns], first, n])
            last, n = ts if last is None else max(last, ts), n + 1
        if out:
            self.state.update((int(first), int(last), int(n)))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last + self.idle_us) // 1000 + 1)
            yield pd.DataFrame(out, columns=[*self.columns, "session_us", "group_rank"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_correlation_sessions(alerts: DataFrame, idle_s: int = 3600, tie: str = "alert_id") -> DataFrame:
    """``session_us`` and rank of each alert in its group's session (``group_id``, watermarked ``ts``)."""
    keep = [c for c in alerts.columns if c != "ts"]
    schema = T.StructType(
        [*[alerts.schema[c] for c in keep], T.StructField("session_us", T.LongType()), T.StructField("group_rank", T.LongType())]
    )
    return alerts.groupBy("group_id").transformWithStateInPandas(
        SessionProcessor(idle_s * MICRO, keep, ["ts_us", tie]), schema, "Append", "EventTime"
    )


class TemplateProcessor(StatefulProcessor):
    """Give each data row the newest template of its exporter and id seen so far."""

    def __init__(self, timeout_us: int, columns: list[str], order: list[str]):
        self.timeout_us, self.columns, self.order = timeout_us, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("template", _struct(seen=T.LongType(), spec=T.StringType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, spec = self.known.get() if self.known.exists() else (None, None)
        out = []
        for row in _arrivals(rows, self.order):
            if row.kind == 0:
                seen, spec = row.ts_us, row.spec_json
            elif seen is not None and row.ts_us - seen <= self.timeout_us:
                out.append([*[getattr(row, c) for c in self.columns], spec])
        if seen is not None:
            self.known.update((int(seen), spec))
        if out:
            yield pd.DataFrame(out, columns=[*self.columns, "spec_json"])

    def close(self) -> None:
        pass


def stream_templates(data: DataFrame, templates: DataFrame, timeout_s: int = 3600) -> DataFrame:
    """As-of template join of two streams keyed by (exporter, template_id); templates come first on ties."""
    keep = [c for c in data.columns if c != "ts"]
    spec_type = templates.schema["spec"].dataType.simpleString()
    seen = templates.select(
        "exporter", "template_id", F.col("seen_us").alias("ts_us"), F.to_json("spec").alias("spec_json"), F.lit(0).alias("kind")
    )
    both = data.select(*keep).withColumns({"spec_json": F.lit(None).cast("string"), "kind": F.lit(1)})
    both = both.unionByName(seen, allowMissingColumns=True)
    schema = T.StructType([*[data.schema[c] for c in keep], T.StructField("spec_json", T.StringType())])
    joined = both.groupBy("exporter", "template_id").transformWithStateInPandas(
        TemplateProcessor(timeout_s * MICRO, keep, ["ts_us", "kind"]), schema, "Append", "None"
    )
    return joined.withColumn("spec", F.from_json("spec_json", spec_type)).drop("spec_json")
