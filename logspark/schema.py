"""Column layouts shared by every operator."""

from pyspark.sql import types as T

LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
ERROR_LEVELS = ("ERROR",)


LOG_DDL = """
    id STRING, trace_id STRING, span_id STRING, tenant_id STRING, system_id STRING,
    system_name STRING, ts TIMESTAMP, level STRING, logger STRING, thread STRING,
    class_name STRING, method_name STRING, line_number INT, message STRING,
    exception STRING, user_id STRING, user_name STRING, module STRING, operation STRING,
    request_url STRING, request_method STRING, request_params STRING,
    response_time BIGINT, status_code INT, ip STRING, user_agent STRING,
    tags ARRAY<STRING>, extra STRING
"""
RULE_DDL = """
    id BIGINT, tenant_id STRING, system_id STRING, rule_name STRING, rule_type STRING,
    monitor_target STRING, monitor_metric STRING, condition_operator STRING,
    condition_value STRING, time_window INT, trigger_count INT,
    last_trigger_time TIMESTAMP, alert_level STRING, silence_period INT,
    silence_scope STRING, allow_escalation BOOLEAN, enable_aggregation BOOLEAN,
    status INT, create_time TIMESTAMP, update_time TIMESTAMP
"""
ALERT_DDL = """
    id STRING, tenant_id STRING, system_id STRING, rule_id BIGINT, alert_level STRING,
    alert_type STRING, alert_content STRING, trigger_time TIMESTAMP, status STRING,
    handle_user STRING, handle_time TIMESTAMP, handle_remark STRING
"""
SYSTEM_DDL = """
    id BIGINT, system_id STRING, tenant_id STRING, system_name STRING, system_type STRING,
    api_key STRING, status INT, create_time TIMESTAMP, update_time TIMESTAMP
"""
TENANT_DDL = """
    id BIGINT, tenant_id STRING, tenant_name STRING, status INT, expire_time TIMESTAMP,
    max_systems INT, max_storage_gb INT, create_time TIMESTAMP, update_time TIMESTAMP
"""

_KINDS = {
    "STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(),
    "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _schema(ddl: str) -> T.StructType:
    """Schema of a flat DDL text; unlike Spark's own parser it needs no running session."""
    pairs = (field.split() for field in ddl.split(","))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


LOG_SCHEMA = _schema(LOG_DDL)
RULE_SCHEMA = _schema(RULE_DDL)
ALERT_SCHEMA = _schema(ALERT_DDL)
SYSTEM_SCHEMA = _schema(SYSTEM_DDL)
TENANT_SCHEMA = _schema(TENANT_DDL)

# JSON text must not cut times to milliseconds.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

LOG_COLUMNS = LOG_SCHEMA.fieldNames()
PARTITION_COLUMNS = ["tenant_id", "system_id", "log_date"]
