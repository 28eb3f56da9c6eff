"""Joins between logs and the small catalogue tables.

No join is forced to broadcast: Spark compares the measured size of a side with its
threshold, and beyond that runs a sort-merge join whose hot keys AQE splits.
"""

from pyspark.sql import Column, DataFrame, functions as F

SYSTEM_KEY = ["tenant_id", "system_id"]
# Fixed value: shape of a well-formed API key.
KEY_PATTERN = r"^sk_[a-f0-9]{32}$"


def enabled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == 1)


def of_enabled_systems(logs: DataFrame, systems: DataFrame) -> DataFrame:
    """Logs of enabled systems with the catalogue's name; one pass instead of a query per system."""
    known = enabled(systems).select(*SYSTEM_KEY, F.col("system_name").alias("_name"))
    return (
        logs.join(known, SYSTEM_KEY)
        .withColumn("system_name", F.coalesce("_name", "system_id"))
        .drop("_name")
    )


def for_every_system(systems: DataFrame, per_system: DataFrame, zero: list[str]) -> DataFrame:
    """One row per enabled system; counts of silent systems are 0."""
    known = enabled(systems).select(*SYSTEM_KEY, "system_name")
    return known.join(per_system, SYSTEM_KEY, "left").fillna(0, subset=zero)


def with_system_name(df: DataFrame, systems: DataFrame) -> DataFrame:
    """Catalogue name of a system, or its id where the catalogue has none."""
    names = systems.select(*SYSTEM_KEY, F.col("system_name").alias("_name"))
    base = df.drop("system_name")
    return (
        base.join(names, SYSTEM_KEY, "left")
        .withColumn("system_name", F.coalesce("_name", "system_id"))
        .drop("_name")
    )


def authenticated(logs: DataFrame, systems: DataFrame, key: str = "api_key") -> DataFrame:
    """Rows whose key belongs to an enabled system of the same tenant; hashes are compared."""
    known = enabled(systems).select(*SYSTEM_KEY, F.sha2("api_key", 256).alias("_hash"))
    return (
        logs.withColumn("_hash", F.sha2(F.col(key), 256))
        .join(known, [*SYSTEM_KEY, "_hash"], "left_semi")
        .drop("_hash")
    )


def not_revoked(logs: DataFrame, revoked: DataFrame, key: str = "api_key") -> DataFrame:
    """Rows whose key hash is not on the revocation list (column ``key_hash``)."""
    return (
        logs.withColumn("key_hash", F.sha2(F.col(key), 256))
        .join(revoked.select("key_hash"), "key_hash", "left_anti")
        .drop("key_hash")
    )


def well_formed_key(key: Column, pattern: str = KEY_PATTERN) -> Column:
    return F.coalesce(key.rlike(pattern), F.lit(False))
