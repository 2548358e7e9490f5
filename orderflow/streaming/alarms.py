"""Alarms as a stream: every alarm has a ring of its last points and a timer, so a period without a datapoint changes its state as well.

Datapoints are reduced to one row per alarm and step (the greatest common divisor of the periods) in the JVM, partially before the shuffle, so a metric
that holds most points is a handful of rows when it meets its alarm. What follows is keyed by alarm: the sums of the open period, the points of the last
``evaluation_periods`` periods, the state, and one timer at the end of the open period. A timer that fires closes its period, with or
without datapoints, and sets the next. Periods close when the watermark passes their end, so the states do not depend on where micro-batches begin.

The watermark is that of all metrics, so one that falls silent is noticed while others go on; :func:`with_heartbeat` moves it when all are silent.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orderflow.operators.alarms import ALARM_SPECS, alarm_specs
from orderflow.session import keep_state_in_rocksdb

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the processor travels with the job

#: Metric of heartbeats: of no alarm, and not null, since the join's own filter on nulls is pushed below the watermark.
HEARTBEAT = ""
STATES = "alarm_name string, period_s bigint, value double, state string, from_state string, held_s bigint"


class AlarmProcessor(StatefulProcessor):
    """Closes the periods of one alarm in order. Input: ``alarm_name, period_s, n, total, low, high``, one row per step."""

    def __init__(self, specs: list[tuple]):
        self.specs = {spec[0]: spec for spec in specs}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "period_s bigint", "n bigint, total double, low double, high double")
        self.at = handle.getValueState("at", "period_s bigint, recent string, state string, since_s bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        period = self.specs[key[0]][5]
        parts: dict[int, tuple] = {}
        for row in rows:
            part = (row.n, row.total, row.low, row.high)
            parts[row.period_s] = _merged(parts[row.period_s], part) if row.period_s in parts else part
        for second, part in parts.items():
            held = self.open.getValue((second,)) if self.open.containsKey((second,)) else None
            self.open.updateValue((second,), _merged(tuple(held), part) if held else part)
        if parts and not self.at.exists():
            first = min(parts)
            self.at.update((first, "", "OK", first))
            self.handle.registerTimer((first + period) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        spec = self.specs[key[0]]
        period, now_s = spec[5], timerValues.getCurrentWatermarkInMs() // 1000
        second, recent, state, since = self.at.get()
        while second + period <= now_s:
            held = self.open.getValue((second,)) if self.open.containsKey((second,)) else None
            if held:
                self.open.removeKey((second,))
            value = _statistic(spec[2], *held) if held else None
            recent = (recent + _point(spec, value))[-spec[6] :]
            before, state = state, _state(spec, recent)
            yield Row(alarm_name=key[0], period_s=second, value=value, state=state, from_state=before, held_s=second - since)
            since = since if state == before else second
            second += period
        self.at.update((second, recent, state, since))
        self.handle.registerTimer((second + period) * 1000)


def _merged(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3])


def _statistic(name: str, n: int, total: float, low: float, high: float) -> float:
    value = {"Average": total / n, "Sum": total, "Maximum": high, "Minimum": low}[name]
    if not math.isfinite(value):
        return value
    return float(Decimal(repr(value)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def _point(spec: tuple, value: float | None) -> str:
    """``b`` breaching, ``o`` not breaching, ``?`` unknown."""
    if value is None:
        return {"breaching": "b", "notBreaching": "o"}.get(spec[8], "?")
    return "b" if (value > spec[4] if spec[3] == ">" else value < spec[4]) else "o"


def _state(spec: tuple, recent: str) -> str:
    if recent.count("b") >= spec[7]:
        return "ALARM"
    return "INSUFFICIENT_DATA" if set(recent) == {"?"} else "OK"


def with_heartbeat(metrics: DataFrame, clock: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Datapoints and the rows of a stream of times (such as the ``rate`` source), which move the watermark when no metric does."""
    beats = clock.select(F.col(ts).alias("ts"), F.lit(HEARTBEAT).alias("metric_name"), F.lit(None).cast("double").alias("value"))
    return metrics.select("ts", "metric_name", F.col("value").cast("double").alias("value")).unionByName(beats)


def evaluate_alarms_stream(metrics: DataFrame, specs: list[tuple] | None = None, lateness: str = "10 minutes") -> DataFrame:
    """The state of every alarm in every closed period since its metric's first datapoint, once, as the batch operator finds it. ``from_state`` is the state of
    the period before (OK at first) and ``held_s`` how long that had lasted.

    Datapoints later than ``lateness`` are dropped; null and NaN values count as none. Periods are whole seconds. The state of timers needs the RocksDB
    store, which is set for queries that the session starts from here on.
    """
    keep_state_in_rocksdb(metrics.sparkSession)
    rows = ALARM_SPECS if specs is None else specs
    step = math.gcd(*[r[5] for r in rows])
    table = alarm_specs(metrics.sparkSession, rows).select("alarm_name", "metric_name", "period_seconds")
    marked = metrics.withWatermark("ts", lateness).join(F.broadcast(table), "metric_name")
    # A filter on values would be pushed below the watermark, and rows without one move it too.
    value = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("double"))
    steps = (
        marked.groupBy("alarm_name", "period_seconds", F.window("ts", f"{step} seconds"))
        .agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
        .filter("n > 0")
    )
    start, period = F.unix_seconds("window.start"), F.col("period_seconds").cast("bigint")
    dealt = steps.select("alarm_name", "window", (start - F.pmod(start, period)).alias("period_s"), "n", "total", "low", "high")
    states = dealt.groupBy("alarm_name").transformWithState(AlarmProcessor(rows), STATES, "Append", "EventTime")
    known = F.broadcast(alarm_specs(metrics.sparkSession, rows).select("alarm_name", "severity", "threshold"))
    return states.join(known, "alarm_name").select(
        "alarm_name", "severity", F.timestamp_seconds("period_s").alias("period_start"), "value", "threshold", "state", "from_state", "held_s"
    )


def changes(states: DataFrame) -> DataFrame:
    """The periods in which an alarm changed its state, of a stream or a table of its states."""
    return states.filter(F.col("state") != F.col("from_state")).select(
        "alarm_name", "severity", "period_start", "from_state", F.col("state").alias("to_state"), "held_s"
    )
