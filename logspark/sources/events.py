"""View the ``events`` table as a log table, and derive catalogue frames from other tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

# Exception classes that error events carry, by event_id modulo 4.
EXCEPTIONS = (
    "java.lang.NullPointerException",
    "java.sql.SQLException",
    "java.net.SocketTimeoutException",
    "com.demo.order.OrderStateException",
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Log columns as expressions over ``events``, in two steps.
_STEPS = {
    "response_time": "CAST(floor(value * 20) AS BIGINT)",
    "module": "concat('mod_', event_id % 7)",
    "level": """CASE WHEN event_type = 'error' THEN 'ERROR' WHEN floor(value * 20) > 3000 THEN 'WARN'
                WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END""",
}
_COLUMNS = {
    "id": "CAST(event_id AS STRING)",
    "trace_id": "concat('tr_', CAST(floor(event_id / 10) AS STRING))",
    "span_id": "concat('sp_', event_id % 10)",
    "tenant_id": "concat('tenant_', user_id % 2)",
    "system_id": "concat('sys_', user_id % 6)",
    "system_name": "concat('System ', user_id % 6)",
    "ts": "CAST(ts AS TIMESTAMP)",
    "level": "level",
    "logger": "'AccessLog'",
    "thread": "concat('worker-', event_id % 16)",
    "class_name": "concat('com.demo.', module, '.Service')",
    "method_name": "'run'",
    "line_number": "CAST(event_id % 500 AS INT)",
    "message": "concat('user ', user_id, ' called ', module, '.', event_type, ' on item ', event_id)",
    "exception": f"""CASE WHEN level = 'ERROR' THEN concat(
        get(array({', '.join(repr(c) for c in EXCEPTIONS)}), CAST(event_id % 4 AS INT)),
        ': failed on item ', event_id, '\\n\\tat com.demo.', module, '.Service.run(Service.java:',
        event_id % 500, ')\\nCaused by: java.io.IOException: disk\\n') END""",
    "user_id": "CAST(user_id AS STRING)",
    "user_name": "concat('User', user_id)",
    "module": "module",
    "operation": "concat(module, '.', event_type)",
    "request_url": "concat('/api/', event_type, '/', event_id % 7)",
    "request_method": "if(event_id % 2 = 0, 'GET', 'POST')",
    "request_params": "CAST(NULL AS STRING)",
    "response_time": "response_time",
    "status_code": """CASE WHEN level = 'ERROR' AND event_id % 3 = 0 THEN 500
                      WHEN level = 'WARN' AND event_id % 4 = 0 THEN 404 ELSE 200 END""",
    "ip": "concat('10.0.', user_id % 256, '.', event_id % 256)",
    "user_agent": "'agent/1.0'",
    "tags": "array(event_type, lower(level))",
    "extra": "props",
    "log_date": "to_date(CAST(ts AS TIMESTAMP))",
}


def logs_from_events(events: DataFrame) -> DataFrame:
    """Log table with ``log_date``; expressions only, so pruning and pushdown reach the scan."""
    steps = events.selectExpr("*", *[f"{sql} AS {name}" for name, sql in _STEPS.items()])
    return steps.selectExpr(*[f"{sql} AS {name}" for name, sql in _COLUMNS.items()])


def load_logs(spark: SparkSession, folder: str) -> DataFrame:
    return logs_from_events(read_table(spark, folder, "events"))


def rules_from_customers(customers: DataFrame, as_of: str) -> DataFrame:
    """A rule catalogue that grows with the ``customer`` table."""
    key = F.col("c_custkey")
    now = F.lit(as_of).cast("timestamp")
    kinds = F.array(*[F.lit(k) for k in (
        "FIELD_COMPARE", "BATCH_OPERATION", "CONTINUOUS_REQUEST", "RESPONSE_TIME", "ERROR_RATE",
        "CONTINUOUS_FAILURE",
    )])
    levels = F.array(*[F.lit(v) for v in ("CRITICAL", "WARNING", "INFO", "NOTICE")])
    hours = lambda n: now - F.make_dt_interval(hours=n.cast("int"))
    return customers.select(
        key.cast("bigint").alias("id"),
        F.concat(F.lit("tenant_"), (key % 5).cast("string")).alias("tenant_id"),
        F.concat(F.lit("sys_"), (key % 10).cast("string")).alias("system_id"),
        F.col("c_name").alias("rule_name"),
        F.get(kinds, (key % 6).cast("int")).alias("rule_type"),
        F.when(key % 4 != 0, F.concat(F.lit("module:mod_"), (key % 7).cast("string"))).alias("monitor_target"),
        F.when(key % 11 != 0, F.lit("responseTime")).alias("monitor_metric"),
        F.lit(">").alias("condition_operator"),
        (key % 5000).cast("string").alias("condition_value"),
        F.lit(60).alias("time_window"),
        F.when(key % 9 != 0, (key % 400).cast("int")).alias("trigger_count"),
        F.when(key % 8 != 0, hours(key % 1500)).alias("last_trigger_time"),
        F.get(levels, (key % 4).cast("int")).alias("alert_level"),
        F.when(key % 3 == 0, 600).alias("silence_period"),
        F.when(key % 3 == 0, "TARGET").alias("silence_scope"),
        (key % 2 == 0).alias("allow_escalation"),
        (key % 5 == 0).alias("enable_aggregation"),
        F.when(key % 7 == 0, 0).otherwise(1).alias("status"),
        hours(key % 2000).alias("create_time"),
        hours(key % 100).alias("update_time"),
    )


def systems_from_suppliers(suppliers: DataFrame, as_of: str) -> DataFrame:
    """A system catalogue that grows with the ``supplier`` table."""
    key = F.col("s_suppkey")
    now = F.lit(as_of).cast("timestamp")
    created = now - F.make_dt_interval(days=(key % 90).cast("int"))
    return suppliers.select(
        key.cast("bigint").alias("id"),
        F.concat(F.lit("sys_"), key.cast("string")).alias("system_id"),
        F.concat(F.lit("tenant_"), (key % 5).cast("string")).alias("tenant_id"),
        F.col("s_name").alias("system_name"),
        F.when(key % 2 == 0, "BUSINESS").otherwise("MIDDLEWARE").alias("system_type"),
        F.concat(F.lit("sk_"), F.md5(key.cast("string"))).alias("api_key"),
        F.when(key % 4 == 0, 0).otherwise(1).alias("status"),
        created.alias("create_time"),
        created.alias("update_time"),
    )


def tenants_from_customers(customers: DataFrame, as_of: str) -> DataFrame:
    """A tenant catalogue that grows with the ``customer`` table."""
    key = F.col("c_custkey")
    created = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=(key % 120).cast("int"))
    return customers.select(
        key.cast("bigint").alias("id"),
        F.concat(F.lit("tenant_"), key.cast("string")).alias("tenant_id"),
        F.col("c_name").alias("tenant_name"),
        F.when(key % 3 == 0, 0).otherwise(1).alias("status"),
        F.lit(None).cast("timestamp").alias("expire_time"),
        F.lit(10).alias("max_systems"),
        F.lit(100).alias("max_storage_gb"),
        created.alias("create_time"),
        created.alias("update_time"),
    )
