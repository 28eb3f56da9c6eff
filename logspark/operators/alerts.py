"""Alert rows, routing, digests, queries and status changes."""

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions import levels
from . import silence, spans
from .rules import alert_content


def create_alerts(hits: DataFrame) -> DataFrame:
    """Alerts of a set of hits: silencing, escalation, aggregation, text and route."""
    keyed = silence.with_silence_key(hits)
    return alert_rows(silence.fired(keyed), keyed)


def alert_rows(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """Alerts of hits that fired; ``keyed`` are all hits with their silence keys."""
    held = F.col("enable_aggregation") & (F.col("suppressed_count") > 0)
    # Fixed value: the sentence on what was held back.
    note = F.format_string(
        "\n\n【聚合信息】\n在静默期内共发生 %d 次相同告警（%s ~ %s）",
        "suppressed_count",
        F.date_format("first_occurrence", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
        F.date_format("last_occurrence", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
    )
    return rows.select(
        F.substring(F.sha2(F.concat_ws("|", "silence_key", F.coalesce("id", silence.hit_key(keyed))), 256), 1, 32).alias("id"),
        "tenant_id", "system_id", "rule_id", "alert_level",
        F.col("rule_type").alias("alert_type"),
        F.concat(alert_content(), F.when(held, note).otherwise("")).alias("alert_content"),
        F.col("ts").alias("trigger_time"),
        F.lit("PENDING").alias("status"),
        F.lit(None).cast("string").alias("handle_user"),
        F.lit(None).cast("timestamp").alias("handle_time"),
        F.lit(None).cast("string").alias("handle_remark"),
        F.col("id").alias("log_id"), "silence_key", "suppressed_count",
        "first_occurrence", "last_occurrence",
    )


def with_route(alerts: DataFrame) -> DataFrame:
    level = levels.alert_level_or_info(F.col("alert_level"))
    return alerts.withColumn("route", F.when(level == "CRITICAL", "IMMEDIATE").otherwise("DIGEST"))


def summary_by_tenant(alerts: DataFrame, *extra_keys) -> DataFrame:
    level = levels.alert_level_or_info(F.col("alert_level"))
    return alerts.groupBy("tenant_id", *extra_keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(level == "CRITICAL").alias("critical_count"),
        F.count_if(level == "WARNING").alias("warning_count"),
        F.count_if(level == "INFO").alias("info_count"),
    )


def hourly_digest(alerts: DataFrame) -> DataFrame:
    """Digest per tenant and hour over all alerts that are not sent at once."""
    queued = with_route(alerts).filter(F.col("route") == "DIGEST")
    return summary_by_tenant(queued.withColumn("hour", F.date_trunc("hour", "trigger_time")), "hour")


def pending(alerts: DataFrame, tenant_id: str) -> DataFrame:
    return alerts.filter((F.col("tenant_id") == tenant_id) & (F.col("status") == "PENDING")).orderBy(
        F.col("trigger_time").desc(), "id"
    )


def recent(alerts: DataFrame, tenant_id: str, system_id: str, as_of, hours: int, limit: int) -> DataFrame:
    since = spans.instant(spans.as_datetime(as_of) - timedelta(hours=hours))
    return (
        alerts.filter(
            (F.col("tenant_id") == tenant_id) & (F.col("system_id") == system_id) & (F.col("trigger_time") >= since)
        )
        .orderBy(F.col("trigger_time").desc(), "id")
        .limit(limit)
    )


def count_between(alerts: DataFrame, tenant_id: str, start, end) -> DataFrame:
    return alerts.filter(
        (F.col("tenant_id") == tenant_id) & F.col("trigger_time").between(spans.instant(start), spans.instant(end))
    ).agg(F.count(F.lit(1)).alias("n"))


def trigger_counts(rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Rules with their counters moved on: every hit counts, suppressed or not."""
    seen = hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
    return (
        rules.join(seen, rules["id"] == seen["rule_id"], "left")
        .withColumn("trigger_count", (F.coalesce("trigger_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("bigint"))
        .withColumn("last_trigger_time", F.coalesce("_last", "last_trigger_time"))
        .drop("rule_id", "_n", "_last")
    )


def mark_processing(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """PENDING alerts of the list become PROCESSING."""
    listed = ids.select("id").distinct().withColumn("_listed", F.lit(True))
    change = F.coalesce(F.col("_listed"), F.lit(False)) & (F.col("status") == "PENDING")
    return (
        alerts.join(listed, "id", "left")
        .withColumn("status", F.when(change, "PROCESSING").otherwise(F.col("status")))
        .drop("_listed")
    )


def resolve(alerts: DataFrame, handled: DataFrame) -> DataFrame:
    """Alerts named in ``handled`` (id, handle_user, handle_time, handle_remark) become RESOLVED."""
    marks = handled.select(
        "id", *[F.col(c).alias(f"_{c}") for c in ("handle_user", "handle_time", "handle_remark")],
        F.lit("RESOLVED").alias("_status"),
    )
    out = alerts.join(marks, "id", "left")
    for c in ("status", "handle_user", "handle_time", "handle_remark"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out
