"""Time-of-day heatmap of the busiest modules of one day."""

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import percent, round_half_up, round_long
from . import spans
from .stats import is_error
from .windows import latest_per_key

MINUTES = {"HOUR": 60, "HALF_HOUR": 30}
SHOWN_MODULES = 50
# Colours from the coldest to the hottest tenth, and for empty cells.
GRADIENT = (
    "#E8F5E9", "#C8E6C9", "#A5D6A7", "#81C784", "#FFF9C4",
    "#FFE082", "#FFB74D", "#FF8A65", "#E57373", "#C62828",
)
NO_DATA_COLOUR = "#F5F5F5"
HEAT_VALUES = {
    "CALL_COUNT": "call_count", "ERROR_COUNT": "error_count",
    "RESPONSE_TIME": "avg_ms", "USER_COUNT": "user_count",
}


def day_rows(logs: DataFrame, day) -> DataFrame:
    start = spans.start_of_day(day)
    return spans.within(logs, start, start + timedelta(days=1)).filter(F.col("module").isNotNull())


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("call_count"),
        F.count_if(is_error()).alias("error_count"),
        F.avg("response_time").alias("avg_ms"),
        F.count_distinct("user_id").alias("user_count"),
    ]


def module_measures(logs: DataFrame, day) -> DataFrame:
    return day_rows(logs, day).groupBy("module").agg(*_measures())


def top_modules(logs: DataFrame, day, limit: int = SHOWN_MODULES) -> DataFrame:
    return module_measures(logs, day).orderBy(F.col("call_count").desc(), "module").limit(limit)


def cells(logs: DataFrame, day, limit: int = SHOWN_MODULES, granularity: str = "HOUR") -> DataFrame:
    """One row per top module and time bucket; empty buckets are present with zeros."""
    width = MINUTES[granularity]
    bucket = F.floor((F.hour("ts") * 60 + F.minute("ts")) / width).cast("int")
    filled = day_rows(logs, day).groupBy("module", bucket.alias("time_index")).agg(*_measures())
    grid = top_modules(logs, day, limit).select(
        "module", F.explode(F.sequence(F.lit(0), F.lit(1440 // width - 1))).alias("time_index")
    )
    return (
        grid.join(filled, ["module", "time_index"], "left")
        .fillna(0, subset=["call_count", "error_count", "user_count"])
        .fillna(0.0, subset=["avg_ms"])
    )


def heat_value(heat_type: str = "CALL_COUNT") -> Column:
    column = F.col(HEAT_VALUES[heat_type])
    return round_long(column) if heat_type == "RESPONSE_TIME" else column.cast("bigint")


def with_heat(grid: DataFrame, heat_type: str = "CALL_COUNT", granularity: str = "HOUR",
              min_heat: int | None = None) -> DataFrame:
    """Heat 0-100 on a log scale and its colour."""
    width = MINUTES[granularity]
    valued = grid.withColumn("value", heat_value(heat_type))
    top = F.greatest(F.lit(1).cast("bigint"), valued.agg(F.max("value")).scalar())
    heat = F.when(F.col("value") <= 0, 0).otherwise(
        round_long(F.log1p("value") / F.log1p(top) * 100).cast("int")
    )
    if min_heat is not None:
        heat = F.when(heat < min_heat, 0).otherwise(heat)
    colours = F.array(*[F.lit(c) for c in GRADIENT])
    minute = F.col("time_index") * width
    return valued.withColumn("heat", heat).select(
        "module", "time_index",
        F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int")).alias("time_label"),
        "value", "heat",
        F.when(F.col("heat") <= 0, NO_DATA_COLOUR).otherwise(
            F.get(colours, F.least(F.floor(F.col("heat") / 10).cast("int"), F.lit(9)))
        ).alias("color"),
        "call_count", "error_count", round_half_up(F.col("avg_ms")).alias("avg_response_time"),
        "user_count", percent(F.col("error_count"), F.col("call_count")).alias("error_rate"),
    )


def module_info(logs: DataFrame, day, limit: int = SHOWN_MODULES, granularity: str = "HOUR",
                heat_type: str = "CALL_COUNT") -> DataFrame:
    """Totals, main system and peak bucket of each top module; the earliest peak wins."""
    peaks = (
        cells(logs, day, limit, granularity)
        .withColumn("value", heat_value(heat_type))
        .groupBy("module")
        .agg(
            F.max_by("time_index", F.struct("value", -F.col("time_index"))).alias("peak_index"),
            F.max("value").alias("peak_value"),
        )
    )
    owners = day_rows(logs, day).groupBy("module", "tenant_id", "system_id").count()
    main = latest_per_key(
        owners, ["module"], [F.col("count").desc(), F.col("system_id").asc(), F.col("tenant_id").asc()]
    ).drop("count")
    return (
        top_modules(logs, day, limit)
        .withColumn("avg_response_time", round_half_up(F.col("avg_ms")))
        .drop("avg_ms")
        .join(peaks, "module")
        .join(main, "module", "left")
    )


def hourly_totals(logs: DataFrame, day) -> DataFrame:
    """Calls and errors of every hour of the day, over all modules."""
    seen = day_rows(logs, day).groupBy(F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("call_count"), F.count_if(is_error()).alias("error_count")
    )
    hours = logs.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(seen, "hour", "left").fillna(0)


def summary(logs: DataFrame, day) -> DataFrame:
    """Day summary over all modules."""
    modules = module_measures(logs, day)
    hours = hourly_totals(logs, day).agg(
        F.max_by("hour", F.struct("call_count", -F.col("hour"))).alias("peak"),
        F.max("call_count").alias("peak_calls"),
        F.min_by("hour", F.when(F.col("call_count") > 0, F.struct("call_count", "hour"))).alias("valley"),
        F.min(F.when(F.col("call_count") > 0, F.col("call_count"))).alias("valley_calls"),
    )
    # ties: the module first in (calls desc, name) order
    rate = F.col("error_count") / F.col("call_count")
    totals = modules.agg(
        F.count(F.lit(1)).alias("total_modules"),
        F.sum("call_count").alias("total_calls"),
        F.sum("error_count").alias("total_errors"),
        round_half_up(F.avg(F.when(F.col("avg_ms") > 0, F.col("avg_ms")))).alias("avg_response_time"),
        F.min_by("module", F.struct(-F.col("call_count"), "module")).alias("most_active_module"),
        F.min_by("module", F.struct(-rate, -F.col("call_count"), "module")).alias("highest_error_rate_module"),
    )
    clock = lambda c: F.format_string("%02d:00", F.coalesce(F.col(c), F.lit(0)))
    # the hours are one row, read as a scalar
    return totals.withColumn("h", hours.select(F.struct("*")).scalar()).select("*", "h.*").select(
        "total_modules", F.coalesce("total_calls", F.lit(0)).alias("total_calls"),
        F.coalesce("total_errors", F.lit(0)).alias("total_errors"),
        percent(F.col("total_errors"), F.col("total_calls")).alias("error_rate"),
        F.coalesce("avg_response_time", F.lit(0.0)).alias("avg_response_time"),
        clock("peak").alias("peak_hour"), F.coalesce("peak_calls", F.lit(0)).alias("peak_calls"),
        clock("valley").alias("valley_hour"), F.coalesce("valley_calls", F.lit(0)).alias("valley_calls"),
        "most_active_module", "highest_error_rate_module",
    )
