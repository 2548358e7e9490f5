"""Histories kept up in nested time tiles: new rows get counts and sums of their key over past spans without a pass over that past.

Rows and their sums per minute, hour and day are stored as micro-batches bring them, rows and minutes in a folder per hour, hours and days in a folder per
day. Any span ``[t - s, t)`` is a difference of two running totals, and a total up to ``x`` is whole days, then the hours of one day, the minutes of one hour
and the rows of one minute. So a micro-batch opens, for each span, the hours and days in which its rows begin and end, and one small table per day in
between; the days' table is a row per key. Each step sums at most 60 tiles of a key, and the rows of a minute are summed by slices, so a
hot key is neither one task nor a list of pairs.

Folders that have gathered :data:`FAN` runs are merged into one, and days older than the longest span are deleted, so neither files nor bytes read grow with the age
of the stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.functions.running import running
from orderflow.functions.scalar import floor_div, join_on
from orderflow.session import child_names, delete_path, few_listing_tasks, path_exists, stage, staging_scope
from orderflow.streaming.memory import AcceptedKeys
from orderflow.streaming.sinks import batch_path

FAN = 16
MINUTE, HOUR, DAY = 60, 3600, 86400
#: Seconds of a tile and of its parent.
LEVELS = {"minute": (MINUTE, HOUR), "hour": (HOUR, DAY), "day": (DAY, None)}
FOREVER = 10**9  # seconds for which a key's last row is known
VALUE = "decimal(38,6)"


def _floor(at: Column, seconds: int) -> Column:
    return floor_div(at, seconds) * seconds


@dataclass(frozen=True)
class Run:
    first: int
    last: int

    @staticmethod
    def of(name: str) -> Run:
        return Run(*map(int, name.removeprefix("run=").split("_")))

    def inside(self, other: Run) -> bool:
        return other != self and other.first <= self.first and self.last <= other.last


class TiledHistory:
    """Rows ``_key, _us, _v`` and tiles ``_key, _at, _n, _v, _last`` below ``root``; times are whole micro-seconds and seconds. Rows and minutes have a folder
    per ``folder`` seconds: an hour suits micro-batches of minutes, a day those of days."""

    def __init__(self, spark: SparkSession, root: str, key_type: str, fan: int = FAN, folder: int = HOUR):
        if folder % HOUR or DAY % folder:
            raise ValueError("a folder is whole hours, and a day whole folders")
        self.spark, self.root, self.fan = spark, root, fan
        self.folders = {"raw": folder, "minute": folder, "hour": DAY, "day": DAY}
        self.raw = f"_key {key_type}, _us bigint, _v {VALUE}"
        self.tile = f"_key {key_type}, _at bigint, _n bigint, _v {VALUE}, _last bigint"

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """The runs of a micro-batch, which a repeated one overwrites: each level is summed from the one below."""
        second = floor_div(F.col("_us"), 1_000_000)
        self._write(rows.withColumn("unit", _floor(second, self.folders["raw"])), "raw", batch_id)
        tiles = rows.select("_key", _floor(second, MINUTE).alias("_at"), F.lit(1).cast("bigint").alias("_n"), "_v", F.col("_us").alias("_last"))
        for level, (size, _) in LEVELS.items():
            tiles = stage(_summed(tiles.withColumn("_at", _floor(F.col("_at"), size)), ["_key", "_at"]), level)
            self._write(tiles.withColumn("unit", _floor(F.col("_at"), self.folders[level])), level, batch_id)

    def _write(self, rows: DataFrame, level: str, batch_id: int) -> None:
        by_unit = rows.withColumn("run", F.lit(f"{batch_id}_{batch_id}")).repartition("unit")
        writer = by_unit.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("unit", "run").parquet(f"{self.root}/{level}")

    def _runs(self, level: str, unit: int, upto: int) -> list[Run]:
        """Runs of a folder that no other holds. A merged one counts from the moment it is complete."""
        folder = f"{self.root}/{level}/unit={unit}"
        runs = [Run.of(name) for name in child_names(self.spark, folder) if name.startswith("run=")]
        runs = [r for r in runs if r.last <= upto and (r.first == r.last or path_exists(self.spark, f"{self._path(level, unit, r)}/_SUCCESS"))]
        return [r for r in runs if not any(r.inside(other) for other in runs)]

    def _path(self, level: str, unit: int, run: Run) -> str:
        return f"{self.root}/{level}/unit={unit}/run={run.first}_{run.last}"

    def read(self, level: str, units: list[int], upto: int) -> DataFrame:
        """What the micro-batches up to ``upto`` brought to some folders of a level; only those folders are opened."""
        paths = [self._path(level, unit, run) for unit in units for run in self._runs(level, unit, upto)]
        schema = self.raw if level == "raw" else self.tile
        if not paths:
            return self.spark.createDataFrame([], schema)
        with few_listing_tasks(self.spark):
            return self.spark.read.schema(schema).parquet(*paths)

    def units(self, level: str) -> list[int]:
        return [int(n.removeprefix("unit=")) for n in child_names(self.spark, f"{self.root}/{level}") if n.startswith("unit=")]

    def units_of(self, minutes: DataFrame, level: str) -> list[int]:
        """The folders of a level in which the minutes (``_at``) lie: as many as hours or days are asked for."""
        return [r[0] for r in minutes.select(_floor(F.col("_at"), self.folders[level])).distinct().collect()]

    def newest(self, upto: int) -> int | None:
        """The newest day that the micro-batches up to ``upto`` brought."""
        return max((unit for unit in self.units("day") if self._runs("day", unit, upto)), default=None)

    def tidy(self, batch_id: int, forget_before: int | None) -> None:
        """Merge full folders of earlier micro-batches, delete what is merged and what is too old."""
        for level in ("raw", *LEVELS):
            for unit in self.units(level):
                if forget_before is not None and unit + DAY <= forget_before:
                    delete_path(self.spark, f"{self.root}/{level}/unit={unit}")
                    continue
                runs = self._runs(level, unit, batch_id - 1)
                if len(runs) >= self.fan:
                    rows = self.read(level, [unit], batch_id - 1)
                    merged = rows if level == "raw" else _summed(rows, ["_key", "_at"])
                    path = self._path(level, unit, Run(min(r.first for r in runs), max(r.last for r in runs)))
                    merged.write.mode("overwrite").parquet(path)
                    runs = self._runs(level, unit, batch_id - 1)
                for name in child_names(self.spark, f"{self.root}/{level}/unit={unit}"):
                    if name.startswith("run=") and any(Run.of(name).inside(run) for run in runs):
                        delete_path(self.spark, f"{self.root}/{level}/unit={unit}/{name}")

    def before(self, minutes: DataFrame, known: DataFrame | None, upto: int) -> DataFrame:
        """``_key, _at, _n, _v, _last``: totals of a key's rows before each asked minute (``_key, _at``), counted from a day that is the same for all; ``known`` has
        the last rows of keys from before that day."""
        first_day = minutes.agg(_floor(F.min("_at"), DAY)).first()[0]
        asked = {level: minutes.select("_key", _floor(F.col("_at"), size).alias("_at")).distinct() for level, (size, _) in LEVELS.items()}
        days = [unit for unit in self.units("day") if unit >= first_day]
        carried = None
        if known is not None:
            carried = known.filter(F.col("_last") < first_day * 1_000_000).select("_key", "_last")
            carried = carried.select("_key", F.lit(first_day - 1).alias("_at"), F.lit(0).cast("bigint").alias("_n"), F.lit(0).cast(VALUE).alias("_v"), "_last")
        for level in ("day", "hour", "minute"):
            tiles = self.read(level, days if level == "day" else self.units_of(minutes, level), upto)
            carried = _totals_before(tiles, asked[level], carried, LEVELS[level][1])
            if level != "minute":  # what was before an hour or day enters ahead of its tiles
                carried = carried.withColumn("_at", F.col("_at") - 1)
        return carried


def _summed(tiles: DataFrame, keys: list[str]) -> DataFrame:
    return tiles.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_v").cast(VALUE).alias("_v"), F.max("_last").alias("_last"))


def _totals_before(tiles: DataFrame, asked: DataFrame, carried: DataFrame | None, parent: int | None) -> DataFrame:
    """Totals of the tiles that begin before each asked one within its parent, and of what is carried into that parent (one second ahead of it)."""
    nothing = asked.select(
        "_key", "_at", F.lit(0).cast("bigint").alias("_n"), F.lit(0).cast(VALUE).alias("_v"), F.lit(None).cast("bigint").alias("_last"), F.lit(True).alias("_asked")
    )
    rows = tiles.withColumn("_asked", F.lit(False)).unionByName(nothing)
    within = F.lit(0).cast("bigint") if parent is None else _floor(F.col("_at"), parent)
    rows = rows.withColumn("_parent", within)
    if carried is not None:
        ahead = F.lit(0).cast("bigint") if parent is None else F.col("_at") + 1
        rows = rows.unionByName(carried.withColumn("_asked", F.lit(False)).withColumn("_parent", ahead))
    grouped = rows.groupBy("_key", "_parent", "_at").agg(
        F.sum("_n").alias("_n"), F.sum("_v").cast(VALUE).alias("_v"), F.max("_last").alias("_last"), F.max("_asked").alias("_asked")
    )
    earlier = Window.partitionBy("_key", "_parent").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = grouped.select(
        "_key", "_at", "_asked",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("_v").over(earlier), F.lit(0)).cast(VALUE).alias("_v"),
        F.max("_last").over(earlier).alias("_last"),
    )
    return totals.filter("_asked").drop("_asked")


def history_batches(
    root: str, key: str, ts: str, amount: str, spans: dict[str, int], fan: int = FAN, folder: int = HOUR
) -> Callable[[DataFrame, int], None]:
    """The sink of a stream of rows: each with ``orders_*`` and ``amount_*`` per span and ``recency_s``, as in the batch operator, below ``root/rows``.

    A row sees what came with its own micro-batch or an earlier one, whatever the order of arrival. ``spans`` are whole minutes. Days that ended more than
    the longest span (and a day) before the newest day of earlier micro-batches are forgotten: a row that comes later than that counts what is left, and its
    recency is that of the key's newest row, if that is older. A null key is a key like others, a null amount counts as 0, a row without a time has no history (nulls) and enters none.
    """
    if not spans or any(seconds <= 0 or seconds % MINUTE for seconds in spans.values()):
        raise ValueError("spans are whole minutes")
    marks = {"in": 0, **spans}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = TiledHistory(spark, f"{root}/tiles", batch.schema[key].dataType.simpleString(), fan, folder)
        last = AcceptedKeys(spark, f"{root}/last", FOREVER, fan)
        with staging_scope(spark):
            row = F.struct(*[F.col(f"`{c}`") for c in batch.columns]).alias("_row")
            value = F.coalesce(F.col(f"`{amount}`").cast(VALUE), F.lit(0).cast(VALUE))
            rows = stage(batch.select(F.col(f"`{key}`").alias("_key"), F.unix_micros(ts).alias("_us"), value.alias("_v"), row), "history-rows")
            timed = rows.filter("_us is not null")
            empty = [F.lit(None).cast(t).alias(f"{n}_{s}") for s in spans for n, t in (("orders", "bigint"), ("amount", VALUE))]
            timeless = rows.filter("_us is null").select("_row.*", *empty, F.lit(None).cast("bigint").alias("recency_s"))
            low = timed.agg(F.min("_us")).first()[0]
            out = timeless
            if low is not None:
                newest = store.newest(batch_id - 1)
                store.tidy(batch_id, None if newest is None else newest - max(spans.values()) - DAY)
                store.add(timed.drop("_row"), batch_id)
                out = _histories(store, last, timed, spans, marks, batch_id, low).unionByName(timeless)
            out.write.mode("overwrite").parquet(batch_path(f"{root}/rows", batch_id))

    return write


def _histories(
    store: TiledHistory, last: AcceptedKeys, rows: DataFrame, spans: dict[str, int], marks: dict[str, int], batch_id: int, low: int
) -> DataFrame:
    second = floor_div(F.col("_us"), 1_000_000)
    asking = stage(rows.select("_key", _floor(second, MINUTE).alias("_minute")).distinct(), "history-minutes")
    shifts = F.explode(F.array(*[F.lit(s).cast("bigint") for s in marks.values()]))
    minutes = stage(asking.select("_key", shifts.alias("_s"), "_minute").select("_key", (F.col("_minute") - F.col("_s")).alias("_at")).distinct(), "history-bounds")

    named = rows.select(F.to_json(F.struct("_key")).alias("_text"), "_key", "_us")
    keys = stage(named.groupBy("_text", "_key").agg(F.max("_us").alias("_clock")), "history-keys")
    last.tidy(batch_id)
    texts = keys.select(F.col("_text").alias("_key"))
    found = last.latest(texts, batch_id, low)
    known = None if found is None else keys.join(found.select(F.col("_key").alias("_text"), F.col("_known").alias("_last")), "_text").select("_key", "_last")
    if known is not None:
        known = stage(known, "history-known")
    keys.select(F.col("_text").alias("_key"), "_clock").write.mode("overwrite").parquet(last.own(batch_id))

    # Totals at the begin of a minute and the rows inside it, moved by the span: those that have left it by then.
    totals = store.before(minutes, known, batch_id).select("_key", F.col("_at").alias("_minute"), (F.col("_at") * 1_000_000 - 1).alias("_us"), "_n", "_v", "_last")
    inside = store.read("raw", store.units_of(minutes, "raw"), batch_id)
    inside = inside.select("_key", _floor(second, MINUTE).alias("_minute"), "_us", F.lit(1).cast("bigint").alias("_n"), "_v", F.col("_us").alias("_last"))
    names = F.explode(F.map_from_arrays(F.array(*map(F.lit, marks)), F.array(*[F.lit(s).cast("bigint") for s in marks.values()])))
    moved = totals.unionByName(inside).select("*", names.alias("_m", "_s"))
    moved = moved.withColumn("_minute", F.col("_minute") + F.col("_s")).withColumn("_us", F.col("_us") + F.col("_s") * 1_000_000)
    entries = join_on(moved, asking, ["_key", "_minute"])
    nothing = F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")
    entering, zero = F.col("_m") == "in", F.lit(0).cast(VALUE)
    entries = entries.select(
        "_key", "_minute", "_us", nothing, F.when(entering, F.col("_last")).alias("_last"),
        *[F.when(F.col("_m") == m, F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias(f"_n_{m}") for m in marks],
        *[F.when(F.col("_m") == m, F.col("_v")).otherwise(zero).cast(VALUE).alias(f"_v_{m}") for m in marks],
    )
    asked = rows.select(
        "_key", _floor(second, MINUTE).alias("_minute"), "_us", "_row", F.lit(None).cast("bigint").alias("_last"),
        *[F.lit(0).cast("bigint").alias(f"_n_{m}") for m in marks], *[zero.alias(f"_v_{m}") for m in marks],
    )
    outputs = {"_seen": ("max", "_last")}
    for m in marks:
        outputs[f"_rn_{m}"], outputs[f"_rv_{m}"] = ("sum", f"_n_{m}"), ("sum", f"_v_{m}")
    found = running(entries.unionByName(asked), ["_key", "_minute"], "_us", None, outputs).filter("_row is not null")
    columns = []
    for s in spans:
        columns.append((F.col("_rn_in") - F.col(f"_rn_{s}")).alias(f"orders_{s}"))
        columns.append((F.col("_rv_in") - F.col(f"_rv_{s}")).cast(VALUE).alias(f"amount_{s}"))
    return found.select("_row.*", *columns, floor_div(F.col("_us") - F.col("_seen"), 1_000_000).alias("recency_s"))


def read_histories(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows").drop("batch_id")
