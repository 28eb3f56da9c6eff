"""Queries and changes on the catalogue tables: rules, systems, tenants."""

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions.masking import mask_api_key
from ..functions.numbers import round_half_up
from . import spans
from .rules import RULE_TYPES

ALERT_LEVELS = ("CRITICAL", "WARNING", "INFO")
DEFAULT_TENANT = "default"
# Tables that are shared by all tenants.
UNSCOPED_TABLES = ("sys_tenant", "sys_user", "sys_role", "sys_permission")


def enabled_rules(rules: DataFrame, tenant_id: str | None = None, system_id: str | None = None,
                  rule_type: str | None = None) -> DataFrame:
    df = rules.filter(F.col("status") == 1)
    for column, value in (("tenant_id", tenant_id), ("system_id", system_id), ("rule_type", rule_type)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy("id")


def count_rules_by_tenant(rules: DataFrame) -> DataFrame:
    return rules.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("rule_count"))


def rule_stats_by_type(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("status") == 1).groupBy("rule_type").agg(
        F.count(F.lit(1)).alias("rule_count"),
        F.sum(F.coalesce("trigger_count", F.lit(0))).alias("total_triggers"),
    )


def recently_triggered(rules: DataFrame, as_of, hours: int = 1) -> DataFrame:
    since = spans.instant(spans.as_datetime(as_of) - timedelta(hours=hours))
    return rules.filter((F.col("status") == 1) & (F.col("last_trigger_time") >= since)).select(
        "rule_name", "rule_type", "trigger_count", "last_trigger_time", "alert_level",
        "silence_period", "silence_scope",
    ).orderBy(F.col("last_trigger_time").desc(), "rule_name")


def high_frequency(rules: DataFrame, as_of, min_triggers: int = 100) -> DataFrame:
    now = spans.as_datetime(as_of)
    hours = F.timestamp_diff("HOUR", F.col("create_time"), spans.instant(now))
    old = F.col("create_time") < spans.instant(now - timedelta(hours=24))
    return (
        rules.filter((F.col("status") == 1) & (F.col("trigger_count") > min_triggers) & old)
        .select(
            "rule_name", "rule_type", "monitor_target", "trigger_count",
            round_half_up(F.col("trigger_count") / hours).alias("triggers_per_hour"),
        )
        .orderBy(F.col("triggers_per_hour").desc(), "rule_name")
    )


def monthly_reset(rules: DataFrame, as_of) -> DataFrame:
    """Counters of rules last triggered in an earlier month start anew."""
    stale = F.coalesce(
        F.date_trunc("month", "last_trigger_time") < F.date_trunc("month", spans.instant(as_of)), F.lit(False)
    )
    return rules.withColumns(
        {
            "trigger_count": F.when(stale, 0).otherwise(F.col("trigger_count")),
            "last_trigger_time": F.when(~stale, F.col("last_trigger_time")),
        }
    )


def disable_inactive(rules: DataFrame, as_of, days: int = 30) -> DataFrame:
    limit = spans.instant(spans.as_datetime(as_of) - timedelta(days=days))
    idle = (
        (F.col("status") == 1)
        & (F.col("last_trigger_time").isNull() | (F.col("last_trigger_time") < limit))
        & (F.col("create_time") < limit)
    )
    return rules.withColumn("status", F.when(F.coalesce(idle, F.lit(False)), 0).otherwise(F.col("status")))


def apply_changes(df: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """New frame with the columns of matching change rows; a null in a change keeps the old value."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(new, key, "left")
    return out.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def update_silence(rules: DataFrame, changes: DataFrame) -> DataFrame:
    columns = ["silence_period", "silence_scope", "allow_escalation", "enable_aggregation"]
    return apply_changes(rules, changes, columns)


def set_status(rules: DataFrame, changes: DataFrame) -> DataFrame:
    return apply_changes(rules, changes, ["status"])


def remove(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Deleted rules are gone from every later query."""
    return rules.join(ids.select("id"), "id", "left_anti")


def rule_page(rules: DataFrame, tenant_id: str | None = None, system_id: str | None = None,
              page: int = 1, size: int = 20) -> DataFrame:
    df = rules
    for column, value in (("tenant_id", tenant_id), ("system_id", system_id)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy(F.col("create_time").desc(), "id").offset((page - 1) * size).limit(size)


def rule_violations(rules: DataFrame) -> DataFrame:
    """One row per fault: missing fields, unknown types and levels."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    faults = F.array_compact(
        F.array(
            *[F.when(blank(c), f"{c} is required") for c in ("tenant_id", "system_id", "rule_name")],
            F.when(~known("rule_type", RULE_TYPES), "unknown rule_type"),
            F.when(~known("alert_level", ALERT_LEVELS), "unknown alert_level"),
        )
    )
    return rules.select("id", F.explode(faults).alias("problem"))


def system_counts(systems: DataFrame, as_of) -> DataFrame:
    """Enabled systems, and those created this month."""
    month = F.date_trunc("month", spans.instant(as_of))
    return systems.filter(F.col("status") == 1).agg(
        F.count(F.lit(1)).alias("enabled"), F.count_if(F.col("create_time") >= month).alias("new_this_month")
    )


def systems_of(systems: DataFrame, tenant_id: str) -> DataFrame:
    return systems.filter((F.col("tenant_id") == tenant_id) & (F.col("status") == 1)).orderBy("id")


def count_systems_by_tenant(systems: DataFrame) -> DataFrame:
    return systems.filter(F.col("status") == 1).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("system_count"))


def find_system(systems: DataFrame, system_id: str) -> DataFrame:
    """The enabled systems of that id; tenants may share an id."""
    return systems.filter((F.col("system_id") == system_id) & (F.col("status") == 1)).orderBy("id")


def system_exists(systems: DataFrame, system_id: str, tenant_id: str | None = None) -> DataFrame:
    """One row: is the id taken, by an enabled or a disabled system?"""
    taken = F.col("system_id") == system_id
    if tenant_id is not None:
        taken = taken & (F.col("tenant_id") == tenant_id)
    return systems.agg(F.coalesce(F.bool_or(taken), F.lit(False)).alias("taken"))


def system_page(systems: DataFrame, tenant_id: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    df = systems if tenant_id is None else systems.filter(F.col("tenant_id") == tenant_id)
    shown = df.withColumn("api_key", mask_api_key(F.col("api_key")))
    return shown.orderBy(F.col("create_time").desc(), "id").offset((page - 1) * size).limit(size)


def masked_keys(systems: DataFrame) -> DataFrame:
    return systems.select("id", "system_id", mask_api_key(F.col("api_key")).alias("api_key"))


def tenant_counts(tenants: DataFrame, as_of) -> DataFrame:
    month = F.date_trunc("month", spans.instant(as_of))
    return tenants.agg(
        F.count_if(F.col("status") == 1).alias("enabled"),
        F.count_if((F.col("status") == 1) & (F.col("create_time") >= month)).alias("new_this_month"),
    )


def find_tenant(tenants: DataFrame, tenant_id: str) -> DataFrame:
    return tenants.filter((F.col("tenant_id") == tenant_id) & (F.col("status") == 1)).orderBy("id")


def enabled_tenants(tenants: DataFrame) -> DataFrame:
    return tenants.filter(F.col("status") == 1).orderBy("id")


def scoped(df: DataFrame, table: str, tenant_id: str | None) -> DataFrame:
    """Rows of the caller's tenant; shared tables pass whole."""
    if any(name in table.lower() for name in UNSCOPED_TABLES):
        return df
    return df.filter(F.col("tenant_id") == (tenant_id or DEFAULT_TENANT))
