"""Usage statistics. Every report is one scan with partial aggregation before the shuffle."""

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import growth_rate, percent, round_half_up, round_long
from ..schema import ERROR_LEVELS
from . import spans
from .windows import latest_per_key

MODULE_SORT = ("call_count", "user_count", "error_rate", "avg_response_time")
DIMENSIONS = {"MODULE": "module", "OPERATION": "operation", "USER": "user_id"}


def is_error(error_levels=ERROR_LEVELS) -> Column:
    return F.col("level").isin(*error_levels)


def distinct(column: str, approx: bool = False) -> Column:
    return F.approx_count_distinct(column) if approx else F.count_distinct(column)


def period_stats(logs: DataFrame, start=None, end=None, approx: bool = False,
                 error_levels=ERROR_LEVELS) -> DataFrame:
    return spans.within(logs, start, end, inclusive_end=True).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(is_error(error_levels)).alias("error_count"),
        distinct("user_id", approx).alias("user_count"),
        F.coalesce(round_long(F.avg("response_time")), F.lit(0)).alias("avg_response_time"),
    )


def today_vs_yesterday(logs: DataFrame, as_of, approx: bool = False) -> DataFrame:
    """Today until ``as_of`` against the same span of yesterday: one scan of two days.

    Rows of both spans are grouped by span first, so the distinct users are partially
    aggregated like everything else.
    """
    now = spans.as_datetime(as_of)
    today = spans.start_of_day(now)
    one = timedelta(days=1)
    both = spans.within(logs, today - one, now, inclusive_end=True).filter(
        (F.col("ts") >= spans.instant(today)) | (F.col("ts") <= spans.instant(now - one))
    )
    per_span = both.groupBy((F.col("ts") >= spans.instant(today)).alias("is_today")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_error()).alias("errors"),
        distinct("user_id", approx).alias("users"),
        round_long(F.avg("response_time")).alias("avg_ms"),
    )

    def pick(column: str, today: bool) -> Column:
        return F.coalesce(F.max(F.when(F.col("is_today") == today, F.col(column))), F.lit(0))

    wide = per_span.agg(
        *[
            pick(c, today).alias(f"{c}_{'today' if today else 'before'}")
            for c in ("n", "errors", "users", "avg_ms")
            for today in (True, False)
        ]
    )
    return wide.select(
        F.col("n_today").alias("total_count"),
        F.col("errors_today").alias("error_count"),
        F.col("users_today").alias("user_count"),
        F.col("avg_ms_today").alias("avg_response_time"),
        growth_rate(F.col("n_today"), F.col("n_before")).alias("total_growth"),
        growth_rate(F.col("errors_today"), F.col("errors_before")).alias("error_growth"),
        growth_rate(F.col("users_today"), F.col("users_before")).alias("user_growth"),
        (F.col("avg_ms_today") - F.col("avg_ms_before")).alias("response_time_change"),
    )


def module_stats(logs: DataFrame, start=None, end=None, sort_by: str = "call_count",
                 limit: int = 20, approx: bool = False) -> DataFrame:
    """Top modules with rank, calls, users, error rate and mean response time."""
    if sort_by not in MODULE_SORT:
        raise ValueError(f"cannot sort by {sort_by}")
    stats = (
        spans.within(logs, start, end, inclusive_end=True)
        .filter(F.col("module").isNotNull())
        .groupBy("module")
        .agg(
            F.count(F.lit(1)).alias("call_count"),
            distinct("user_id", approx).alias("user_count"),
            percent(F.count_if(is_error()), F.count(F.lit(1))).alias("error_rate"),
            round_long(F.avg("response_time")).alias("avg_response_time"),
        )
    )
    order = [F.col(sort_by).desc(), F.col("module").asc()]
    top = stats.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def module_trend(logs: DataFrame, start, end, limit: int = 20) -> DataFrame:
    """Growth of each of the top modules over the span of equal length before."""
    first, last = spans.as_datetime(start), spans.as_datetime(end)
    before = first - (last - first)
    recent = F.col("ts") >= spans.instant(first)
    return (
        spans.within(logs, before, last)
        .filter(F.col("module").isNotNull())
        .groupBy("module")
        .agg(F.count_if(recent).alias("call_count"), F.count_if(~recent).alias("previous_count"))
        .withColumn("trend", growth_rate(F.col("call_count"), F.col("previous_count")))
        .orderBy(F.col("call_count").desc(), "module")
        .limit(limit)
    )


def hotspots(logs: DataFrame, start=None, end=None, limit: int = 50, approx: bool = False) -> DataFrame:
    """Busiest operations with their main module and a score of calls and users.

    Users are counted once per (operation, user) by the planner's own two-step distinct;
    the main module comes from a second, much smaller aggregate.
    """
    df = spans.within(logs, start, end, inclusive_end=True).filter(F.col("operation").isNotNull())
    per_op = df.groupBy("operation").agg(
        F.count(F.lit(1)).alias("call_count"),
        distinct("user_id", approx).alias("user_count"),
        round_long(F.avg("response_time")).alias("avg_time"),
    )
    order = [F.col("call_count").desc(), F.col("operation").asc()]
    top = per_op.orderBy(*order).limit(limit).withColumn(
        "rank", F.row_number().over(W.orderBy(*order))
    )
    modules = df.filter(F.col("module").isNotNull()).groupBy("operation", "module").count()
    main = latest_per_key(modules, ["operation"], [F.col("count").desc(), F.col("module").asc()])
    score = F.least(F.lit(100.0), F.col("call_count") / 100.0 + F.col("user_count") / 10.0)
    return (
        top.join(main.select("operation", "module"), "operation", "left")
        .withColumn("hot_score", round_half_up(score, 1))
        .orderBy(F.col("hot_score").desc(), "rank")
    )


def level_counts(logs: DataFrame, start=None, end=None) -> DataFrame:
    return spans.within(logs, start, end).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def counts_by_dimension(logs: DataFrame, dimension: str, start=None, end=None) -> DataFrame:
    column = DIMENSIONS[dimension.upper()]
    return (
        spans.within(logs, start, end)
        .filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("dimension_value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def counts_per_window(logs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Tumbling counts by tenant, system and level; runs on batches and on streams."""
    return (
        logs.groupBy(F.window("ts", width).alias("w"), "tenant_id", "system_id", "level")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "tenant_id", "system_id", "level", "n")
    )
