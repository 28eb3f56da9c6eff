"""Storage tiers, migration plans and archive statistics over a partition manifest.

The manifest has one row per tenant, system and day, so it stays small next to the logs.
"""

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import percent, round_half_up
from ..schema import PARTITION_COLUMNS
from . import spans

HOT_DAYS, WARM_DAYS, COLD_DAYS = 7, 30, 90
TIERS = ("HOT", "WARM", "COLD", "DELETED")
COST_PER_GIB = {"HOT": 1.0, "WARM": 0.5, "COLD": 0.1, "DELETED": 0.0}
GIB = 1024.0**3
MIB = 1024 * 1024
JSON_ROW_BYTES, SHEET_ROW_BYTES = 2048, 1024
CHUNK_ROWS, CHUNK_BYTES, SHEET_ROWS = 500_000, 1024**3, 1_000_000


def manifest(logs: DataFrame, row_bytes: int = JSON_ROW_BYTES) -> DataFrame:
    """Rows and estimated bytes per partition, counted from the log table."""
    return logs.groupBy(*PARTITION_COLUMNS).agg(
        F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) * row_bytes).alias("bytes")
    )


def age_days(as_of) -> Column:
    return F.datediff(spans.day(as_of), F.col("log_date"))


def tier(as_of) -> Column:
    age = age_days(as_of)
    return (
        F.when(age <= HOT_DAYS, "HOT").when(age <= WARM_DAYS, "WARM").when(age <= COLD_DAYS, "COLD")
        .otherwise("DELETED")
    )


def tier_index(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), name)


def migration_plan(parts: DataFrame, as_of) -> DataFrame:
    """Partitions that must move down a tier, with target and priority."""
    age = age_days(as_of)
    priority = (
        F.when(age > COLD_DAYS + 7, 10)
        .when(age > COLD_DAYS, 8)
        .when(age > WARM_DAYS + 3, 6)
        .when(age > WARM_DAYS, 4)
        .when(age > HOT_DAYS + 1, 2)
        .otherwise(1)
    )
    return (
        parts.withColumn("target_tier", tier(as_of))
        .withColumn("priority", priority)
        .filter(tier_index(F.col("tier")) < tier_index(F.col("target_tier")))
    )


def with_monthly_cost(parts: DataFrame) -> DataFrame:
    factor = F
    for name, cost in COST_PER_GIB.items():
        factor = factor.when(F.col("tier") == name, cost)
    return parts.withColumn("monthly_cost", F.col("bytes") / GIB * factor.otherwise(0.0))


def up_to(parts: DataFrame, date) -> DataFrame:
    return parts.filter(F.col("log_date") <= spans.day(date)).orderBy(
        F.col("log_date").desc(), "tenant_id", "system_id"
    )


def between(parts: DataFrame, first, last) -> DataFrame:
    return parts.filter(F.col("log_date").between(spans.day(first), spans.day(last)))


def expired(parts: DataFrame, as_of, days: int) -> DataFrame:
    return parts.filter(F.col("log_date") < spans.day(spans.start_of_day(as_of) - timedelta(days=days)))


def not_archived(parts: DataFrame, archived: DataFrame) -> DataFrame:
    return parts.join(archived.select(*PARTITION_COLUMNS), PARTITION_COLUMNS, "left_anti")


def already_archived(parts: DataFrame, archived: DataFrame) -> DataFrame:
    return parts.join(archived.select(*PARTITION_COLUMNS), PARTITION_COLUMNS, "left_semi")


def export_estimate(parts: DataFrame) -> DataFrame:
    """Expected sizes of a JSON and of a tabular export, and whether they need splitting."""
    rows = F.col("rows")
    return parts.select(
        *PARTITION_COLUMNS, "rows",
        (rows * JSON_ROW_BYTES).alias("json_bytes"),
        (rows * SHEET_ROW_BYTES).alias("sheet_bytes"),
        ((rows > CHUNK_ROWS) | (rows * JSON_ROW_BYTES > CHUNK_BYTES)).alias("needs_chunks"),
        (rows > SHEET_ROWS).alias("needs_many_sheets"),
    )


def archive_stats(parts: DataFrame) -> DataFrame:
    """Count, bytes and mean for all, per tenant, per tenant and system, and per date."""
    t, s, d = (F.col(c) for c in PARTITION_COLUMNS)
    return parts.groupingSets([[], [t], [t, s], [d]], t, s, d).agg(
        F.grouping_id().cast("int").alias("grouping_level"),
        F.count(F.lit(1)).alias("archive_count"),
        F.sum("bytes").alias("total_bytes"),
        round_half_up(F.avg("bytes")).alias("mean_bytes"),
    )


def archive_breakdown(parts: DataFrame, first, last) -> DataFrame:
    """Tenant and tenant-system totals in a date range; the grand total has no tenant."""
    return between(parts, first, last).rollup("tenant_id", "system_id").agg(
        F.count(F.lit(1)).alias("archive_count"),
        F.sum("bytes").alias("total_bytes"),
        F.floor(F.sum("bytes") / MIB).alias("total_mb"),
    )


def tenant_ranking(parts: DataFrame, first, last, limit: int = 10) -> DataFrame:
    return (
        between(parts, first, last).groupBy("tenant_id")
        .agg(F.count(F.lit(1)).alias("archive_count"), F.sum("bytes").alias("total_bytes"))
        .orderBy(F.col("total_bytes").desc(), "tenant_id")
        .limit(limit)
    )


def daily_sizes(parts: DataFrame, as_of, days: int) -> DataFrame:
    start, end = spans.last_days(as_of, days)
    per_day = between(parts, start, end - timedelta(days=1)).groupBy("log_date").agg(F.sum("bytes").alias("bytes"))
    return spans.calendar(parts.sparkSession, as_of, days).join(per_day, "log_date", "left").fillna(0, ["bytes"])


def size_trend(parts: DataFrame, as_of, days: int) -> DataFrame:
    """Total, daily mean, largest and smallest day; ties go to the earlier day."""
    epoch = F.unix_date("log_date")
    return daily_sizes(parts, as_of, days).agg(
        F.sum("bytes").alias("total_bytes"),
        round_half_up(F.avg("bytes")).alias("mean_bytes"),
        F.max_by("log_date", F.struct("bytes", -epoch)).alias("max_date"),
        F.max("bytes").alias("max_bytes"),
        F.min_by("log_date", F.struct("bytes", epoch)).alias("min_date"),
        F.min("bytes").alias("min_bytes"),
    )


def archive_size(parts: DataFrame, tenant_id: str, system_id: str, first, last) -> DataFrame:
    mine = (F.col("tenant_id") == tenant_id) & (F.col("system_id") == system_id)
    return between(parts, first, last).filter(mine).agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes")
    )


def storage_stats(hot: DataFrame, archived: DataFrame, as_of) -> DataFrame:
    """Hot and archived totals and shares, and hot partitions of the last seven days."""
    both = hot.select("log_date", "rows", "bytes", F.lit(True).alias("hot")).unionByName(
        archived.select("log_date", "rows", "bytes", F.lit(False).alias("hot"))
    )
    today = spans.day(as_of)
    week_ago = spans.day(spans.as_datetime(as_of) - timedelta(days=7))
    is_hot = F.col("hot")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = both.agg(
        F.count_if(is_hot).alias("hot_partitions"),
        zero(F.when(is_hot, F.col("rows"))).alias("hot_rows"),
        zero(F.when(is_hot, F.col("bytes"))).alias("hot_bytes"),
        F.count_if(~is_hot).alias("archive_count"),
        zero(F.when(~is_hot, F.col("bytes"))).alias("archive_bytes"),
        F.count_if(is_hot & (F.col("log_date") > week_ago) & (F.col("log_date") <= today)).alias("partitions_last_7_days"),
    )
    total = F.col("hot_bytes") + F.col("archive_bytes")
    return sums.withColumns(
        {
            "total_bytes": total,
            "hot_percent": percent(F.col("hot_bytes"), total),
            "archive_percent": percent(F.col("archive_bytes"), total),
        }
    )
