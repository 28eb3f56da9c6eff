"""Exception reports."""

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from ..functions.numbers import percent, round_half_up
from . import dims, spans
from .stats import is_error


def with_exception_type(logs: DataFrame) -> DataFrame:
    return logs.withColumn("exception_type", text.exception_class(F.col("exception")))


def _of_enabled(per_system: DataFrame, systems: DataFrame) -> DataFrame:
    """Aggregates of enabled systems: the small result is joined, not the logs."""
    return per_system.join(dims.enabled(systems).select(*dims.SYSTEM_KEY), dims.SYSTEM_KEY, "left_semi")


def exception_total(logs: DataFrame, systems: DataFrame, start=None, end=None) -> DataFrame:
    """Exceptions of all enabled systems."""
    per_system = spans.within(logs, start, end).groupBy(*dims.SYSTEM_KEY).agg(F.count_if(is_error()).alias("n"))
    return _of_enabled(per_system, systems).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("exception_count"))


def exception_trend(logs: DataFrame, systems: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Per day, zero-filled: exceptions of enabled systems and the counts by severity."""
    start, end = spans.last_days(as_of, days)
    per_system = (
        spans.within(logs, start, end)
        .groupBy(*dims.SYSTEM_KEY, F.to_date("ts").alias("log_date"))
        .agg(
            F.count_if(is_error()).alias("total_count"),
            F.count_if(F.col("level") == "WARN").alias("warning_count"),
            F.count_if(F.col("level") == "INFO").alias("info_count"),
        )
    )
    counts = ["total_count", "critical_count", "warning_count", "info_count"]
    per_day = (
        _of_enabled(per_system, systems).withColumn("critical_count", F.col("total_count"))
        .groupBy("log_date").agg(*[F.sum(c).alias(c) for c in counts])
    )
    return (
        spans.calendar(logs.sparkSession, as_of, days)
        .join(per_day, "log_date", "left")
        .fillna(0, subset=counts)
        .select("log_date", F.date_format("log_date", "MM-dd").alias("label"), *counts)
    )


def exceptions_by_system(logs: DataFrame, systems: DataFrame, start=None, end=None) -> DataFrame:
    """Exceptions and their share of the system's rows, for every enabled system."""
    per_system = (
        spans.within(logs, start, end)
        .groupBy(*dims.SYSTEM_KEY)
        .agg(
            F.count(F.lit(1)).alias("log_count"),
            F.count_if(is_error()).alias("exception_count"),
        )
    )
    return (
        dims.for_every_system(systems, per_system, ["log_count", "exception_count"])
        .withColumn("exception_rate", percent(F.col("exception_count"), F.col("log_count")))
        .orderBy(F.col("exception_count").desc(), "tenant_id", "system_id")
    )


def _typed(logs: DataFrame, systems: DataFrame, start, end) -> DataFrame:
    """Exceptions per enabled system and class: count and latest time."""
    per_system = (
        with_exception_type(spans.within(logs, start, end).filter(is_error()))
        .filter(F.col("exception_type").isNotNull())
        .groupBy(*dims.SYSTEM_KEY, "exception_type")
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest_time"))
    )
    return _of_enabled(per_system, systems)


def exceptions_by_type(logs: DataFrame, systems: DataFrame, start=None, end=None, limit: int = 20) -> DataFrame:
    """Exception classes of enabled systems by count with their share of all typed exceptions."""
    counts = _typed(logs, systems, start, end).groupBy("exception_type").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.withColumn("percentage", round_half_up(F.col("n") / total * 100))
        .withColumn("type_name", text.exception_short_name(F.col("exception_type")))
        .orderBy(F.col("n").desc(), "exception_type")
        .limit(limit)
    )


def frequent_exceptions(logs: DataFrame, systems: DataFrame, limit: int = 10, start=None, end=None) -> DataFrame:
    return (
        _typed(logs, systems, start, end)
        .orderBy(F.col("n").desc(), "tenant_id", "system_id", "exception_type")
        .limit(limit)
    )


def exception_headline(logs: DataFrame, systems: DataFrame, as_of, start, end) -> DataFrame:
    """Exceptions of enabled systems in the span and today: one scan that opens the days of both only."""
    today = spans.start_of_day(as_of)
    ts, date = F.col("ts"), F.col("log_date")
    in_span = (ts >= spans.instant(start)) & (ts < spans.instant(end))
    in_day = (ts >= spans.instant(today)) & (ts < spans.instant(today + timedelta(days=1)))
    rows = logs.filter((in_span | in_day) & is_error())
    if "log_date" in logs.columns:
        rows = rows.filter(date.between(spans.day(start), spans.day(end)) | (date == spans.day(today)))
    per_system = rows.groupBy(*dims.SYSTEM_KEY).agg(F.count_if(in_span).alias("span"), F.count_if(in_day).alias("day"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return _of_enabled(per_system, systems).agg(total("span", "total_exceptions"), total("day", "today_exceptions"))
