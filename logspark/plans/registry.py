"""Registered queries. Each reads the given tables; most carry SQL that must agree with it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-30 12:00:00"


def plain(df: DataFrame) -> DataFrame:
    """Result types that every SQL engine shares: wide numbers, zone-free times, joined lists."""
    out = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DecimalType)):
            column = column.cast("double")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column, ",")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that computes the same rows."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# The log view of the ``events`` table, in SQL.
LOGS = """WITH RECURSIVE base AS (
  SELECT *, CAST(floor(value * 20) AS BIGINT) AS rt FROM events
), leveled AS (
  SELECT *, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN rt > 3000 THEN 'WARN'
                 WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS lvl,
         'mod_' || CAST(event_id % 7 AS VARCHAR) AS module
  FROM base
), logs AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
    'tr_' || CAST(CAST(floor(event_id / 10) AS BIGINT) AS VARCHAR) AS trace_id,
    'sp_' || CAST(event_id % 10 AS VARCHAR) AS span_id,
    'tenant_' || CAST(user_id % 2 AS VARCHAR) AS tenant_id,
    'sys_' || CAST(user_id % 6 AS VARCHAR) AS system_id,
    'System ' || CAST(user_id % 6 AS VARCHAR) AS system_name,
    ts, lvl AS level, 'AccessLog' AS logger,
    'worker-' || CAST(event_id % 16 AS VARCHAR) AS thread,
    'com.demo.' || module || '.Service' AS class_name, 'run' AS method_name,
    event_id % 500 AS line_number,
    'user ' || CAST(user_id AS VARCHAR) || ' called ' || module || '.' || event_type
      || ' on item ' || CAST(event_id AS VARCHAR) AS message,
    CASE WHEN lvl = 'ERROR' THEN
      CASE event_id % 4 WHEN 0 THEN 'java.lang.NullPointerException' WHEN 1 THEN 'java.sql.SQLException'
                        WHEN 2 THEN 'java.net.SocketTimeoutException' ELSE 'com.demo.order.OrderStateException' END
      || ': failed on item ' || CAST(event_id AS VARCHAR) || chr(10) || chr(9) || 'at com.demo.' || module
      || '.Service.run(Service.java:' || CAST(event_id % 500 AS VARCHAR) || ')' || chr(10)
      || 'Caused by: java.io.IOException: disk' || chr(10) END AS exception,
    CAST(user_id AS VARCHAR) AS user_id, 'User' || CAST(user_id AS VARCHAR) AS user_name,
    module, module || '.' || event_type AS operation,
    '/api/' || event_type || '/' || CAST(event_id % 7 AS VARCHAR) AS request_url,
    CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS request_method,
    rt AS response_time,
    CAST(CASE WHEN lvl = 'ERROR' AND event_id % 3 = 0 THEN 500
              WHEN lvl = 'WARN' AND event_id % 4 = 0 THEN 404 ELSE 200 END AS BIGINT) AS status_code,
    '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) AS ip,
    'agent/1.0' AS user_agent, event_type || ',' || lower(lvl) AS tags, props AS extra,
    CAST(ts AS DATE) AS log_date, event_id, CAST(epoch_us(ts) AS BIGINT) AS us
  FROM leveled
)
"""
# Systems that the log view names; the last one is silent, the one before is disabled.
SYSTEM_ROWS = [
    (1, "tenant_0", "sys_0", "ERP", 1), (2, "tenant_1", "sys_1", "CRM", 1),
    (3, "tenant_0", "sys_2", "WMS", 1), (4, "tenant_1", "sys_3", "OMS", 1),
    (5, "tenant_0", "sys_4", "BI", 1), (6, "tenant_1", "sys_5", "MDM", 0),
    (7, "tenant_1", "sys_9", "Idle", 1),
]
SYSTEMS_SQL = "systems(id, tenant_id, system_id, system_name, status, create_time) AS (VALUES " + ", ".join(
    f"({i}, '{t}', '{s}', '{n}', {st}, TIMESTAMP '2024-01-{i:02d} 00:00:00')" for i, t, s, n, st in SYSTEM_ROWS
) + ")"
LOGS_AND_SYSTEMS = LOGS + ", " + SYSTEMS_SQL + "\n"


# A second view in which every system id occurs in both tenants, enabled in one and disabled in the other for some.
SHARED_SYSTEM_ROWS = [
    (1, "tenant_0", "sys_0", "ERP", 1), (2, "tenant_1", "sys_0", "ERP copy", 0), (3, "tenant_0", "sys_1", "CRM", 1),
    (4, "tenant_1", "sys_1", "CRM two", 1), (5, "tenant_0", "sys_2", "WMS", 0), (6, "tenant_1", "sys_2", "WMS two", 1),
]
SHARED_LOGS_AND_SYSTEMS = LOGS.replace(
    "'sys_' || CAST(user_id % 6 AS VARCHAR) AS system_id", "'sys_' || CAST(user_id % 3 AS VARCHAR) AS system_id"
) + ", systems(id, tenant_id, system_id, system_name, status) AS (VALUES " + ", ".join(
    f"({i}, '{t}', '{s}', '{n}', {st})" for i, t, s, n, st in SHARED_SYSTEM_ROWS
) + ")\n"


def shared_logs(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources.events import load_logs

    number = (F.col("user_id").cast("bigint") % 3).cast("string")
    return load_logs(spark, folder).withColumn("system_id", F.concat(F.lit("sys_"), number))


def shared_systems(spark: SparkSession) -> DataFrame:
    return inline(spark, SHARED_SYSTEM_ROWS, "id BIGINT, tenant_id STRING, system_id STRING, system_name STRING, status INT")


def inline(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Small literal frame as SQL VALUES; its size is known to the optimizer."""
    def text(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(value)

    fields = [f.split() for f in ddl.split(",")]
    values = ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)
    columns = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(fields))
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    return spark.sql(f"SELECT {columns} FROM VALUES {values} AS t({names})")


def systems_frame(spark: SparkSession) -> DataFrame:
    rows = [(i, t, s, n, st, f"2024-01-{i:02d} 00:00:00") for i, t, s, n, st in SYSTEM_ROWS]
    return inline(
        spark, rows,
        "id BIGINT, tenant_id STRING, system_id STRING, system_name STRING, status INT, create_time TIMESTAMP",
    )


def half_up(value: str, digits: int = 2) -> str:
    """SQL text of the shared rounding rule."""
    return f"floor(({value}) * {float(10**digits)} + 0.5) / {float(10**digits)}"


def percent_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {half_up(f'CAST({part} AS DOUBLE) / {whole} * 100')} ELSE 0.0 END"


def growth_sql(now: str, before: str) -> str:
    return (
        f"CASE WHEN coalesce({before}, 0) = 0 THEN CASE WHEN {now} > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END "
        f"ELSE {half_up(f'CAST({now} - {before} AS DOUBLE) / {before} * 100')} END"
    )
