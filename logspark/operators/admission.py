"""Fixed-minute admission at three levels in sequence: global, tenant, system."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numbers import micros
from .windows import first_n_per_bucket

GLOBAL_PER_MINUTE, TENANT_PER_MINUTE, SYSTEM_PER_MINUTE = 10_000 * 60, 1_000 * 60, 5_000
SLOTS_PER_BUCKET = 1000


def _bucketed(df: DataFrame, seconds: int) -> DataFrame:
    return df.withColumn("_minute", F.floor(micros(F.col("ts")) / (seconds * 1_000_000)))


def pass_global(df: DataFrame, limit: int = GLOBAL_PER_MINUTE, seconds: int = 60) -> DataFrame:
    """First rows of each minute over all tenants; ranks only where a minute overflows."""
    width = max(seconds * 1_000_000 // SLOTS_PER_BUCKET, 1)
    return first_n_per_bucket(
        df,
        F.floor(micros(F.col("ts")) / (seconds * 1_000_000)),
        limit,
        F.floor(micros(F.col("ts")) / width),
        [micros(F.col("ts")), F.col("id")],
        spread_by="id",
    )


def _first_per_minute(df: DataFrame, keys: list[str], limit: int, seconds: int) -> DataFrame:
    w = W.partitionBy(*keys, "_minute").orderBy(micros(F.col("ts")), "id")
    return (
        _bucketed(df, seconds)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= limit)
        .drop("_rn", "_minute")
    )


def admit(df: DataFrame, global_limit: int = GLOBAL_PER_MINUTE, tenant_limit: int = TENANT_PER_MINUTE,
          system_limit: int = SYSTEM_PER_MINUTE, seconds: int = 60) -> DataFrame:
    """Rows that pass all three limits. A row refused later has used the earlier quotas.

    After the first pass a minute holds at most ``global_limit`` rows, so the two
    narrower passes are plain windows over groups of bounded size.
    """
    passed = pass_global(df, global_limit, seconds)
    passed = _first_per_minute(passed, ["tenant_id"], tenant_limit, seconds)
    return _first_per_minute(passed, ["tenant_id", "system_id"], system_limit, seconds)


def tenant_remaining(df: DataFrame, global_limit: int = GLOBAL_PER_MINUTE,
                     tenant_limit: int = TENANT_PER_MINUTE, seconds: int = 60) -> DataFrame:
    """Quota a tenant has left in each minute it was seen in."""
    return (
        _bucketed(pass_global(df, global_limit, seconds), seconds)
        .groupBy("tenant_id", "_minute")
        .agg(F.count(F.lit(1)).alias("used"))
        .select(
            "tenant_id", F.timestamp_seconds(F.col("_minute") * seconds).alias("minute"),
            F.greatest(F.lit(0), tenant_limit - F.col("used")).alias("remaining"),
        )
    )
