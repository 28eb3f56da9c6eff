"""Parse, normalise, mask, fill and validate raw log lines."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import levels, masking, text, times
from ..schema import LEVELS, LOG_COLUMNS, LOG_SCHEMA

# Accepted spellings of each text field, first match wins.
TEXT_ALIASES = {
    "id": ["id"],
    "trace_id": ["traceId", "trace_id"],
    "span_id": ["spanId", "span_id"],
    "tenant_id": ["tenantId", "tenant_id"],
    "system_id": ["systemId", "system_id"],
    "system_name": ["systemName", "system_name"],
    "level": ["level"],
    "logger": ["logger"],
    "thread": ["thread"],
    "class_name": ["className", "class_name"],
    "method_name": ["methodName", "method_name"],
    "message": ["message"],
    "exception": ["exception", "stackTrace", "stack_trace"],
    "user_id": ["userId", "user_id"],
    "user_name": ["userName", "user_name"],
    "module": ["module"],
    "operation": ["operation"],
    "request_url": ["requestUrl", "request_url", "url"],
    "request_method": ["requestMethod", "request_method", "method"],
    "request_params": ["requestParams", "request_params", "params"],
    "ip": ["ip", "clientIp", "client_ip"],
    "user_agent": ["userAgent", "user_agent"],
}
# The same for number fields.
NUMBER_ALIASES = {
    "line_number": ["lineNumber", "line_number"],
    "response_time": ["responseTime", "response_time", "duration"],
    "status_code": ["statusCode", "status_code"],
}
OBJECT_FIELDS = ["timestamp", "tags", "extra", "context"]
DEFAULT_TENANT, DEFAULT_SYSTEM = "default", "unknown"
ID_PATTERN = r"^[a-zA-Z0-9_-]{1,64}$"
MAX_BATCH = 100

_CORRUPT = "_corrupt"


def _raw_ddl() -> str:
    strings = [a for names in TEXT_ALIASES.values() for a in names]
    variants = [a for names in NUMBER_ALIASES.values() for a in names] + OBJECT_FIELDS
    fields = [f"`{a}` STRING" for a in strings] + [f"`{a}` VARIANT" for a in variants]
    return ", ".join(fields + [f"`{_CORRUPT}` STRING"])


RAW_DDL = _raw_ddl()


def parse(df: DataFrame, value: str = "value") -> DataFrame:
    """Add the parsed object ``raw`` and ``is_valid``; null, ``{}`` and bad JSON are invalid."""
    parsed = F.from_json(
        F.col(value), RAW_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    # Through a generator, not a projection: a later filter on validity would otherwise be
    # pushed below it with a second copy of the whole JSON parse.
    out = df.select("*", F.inline(F.array(F.struct(parsed.alias("raw")))))
    broken = (
        F.col(value).isNull()
        | F.col(f"raw.{_CORRUPT}").isNotNull()
        | ~F.col(value).rlike(r"^\s*\{")
        | F.col(value).rlike(r"^\s*\{\s*\}\s*$")
    )
    return out.withColumn("is_valid", ~broken).withColumn(
        "reject_reason", F.when(broken, "invalid JSON or empty log")
    )


def first_text(names: list[str]) -> Column:
    return F.expr(f"coalesce({', '.join(f'trim({n})' for n in names)})")


def first_number(names: list[str], kind: str) -> Column:
    """First alias that holds a number or numeric text; fractions of numbers are cut off."""
    tries = [
        f"""CASE schema_of_variant({n})
              WHEN 'STRING' THEN try_cast(trim(try_variant_get({n}, '$', 'string')) AS {kind})
              WHEN 'BOOLEAN' THEN NULL
              ELSE try_cast(try_variant_get({n}, '$', 'bigint') AS {kind}) END"""
        for n in names
    ]
    return F.expr(f"coalesce({', '.join(tries)})")


def normalise(parsed: DataFrame, as_of=None, keep=()) -> DataFrame:
    """Typed log columns from ``raw``; ``ts_fallback`` marks rows whose time was unreadable."""
    now = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    fields = {name: first_text([f"raw.{a}" for a in al]) for name, al in TEXT_ALIASES.items()}
    for name, al in NUMBER_ALIASES.items():
        kind = LOG_SCHEMA[name].dataType.simpleString()
        fields[name] = first_number([f"raw.{a}" for a in al], kind)
    fields["level"] = levels.canonical_level(fields["level"])
    fields["tags"] = F.expr("try_variant_get(raw.tags, '$', 'array<string>')")
    fields["extra"] = F.coalesce(
        masking.redact_secrets("raw.extra"), masking.redact_secrets("raw.context")
    )
    read_ts = times.parse_variant("raw.timestamp")
    fields["ts"] = F.coalesce(read_ts, now)
    kept = [F.col(k) for k in keep]
    return parsed.select(
        *kept, *[fields[c].alias(c) for c in LOG_COLUMNS], read_ts.isNull().alias("ts_fallback")
    )


def mask(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "message": masking.mask_text(F.col("message")),
            "request_params": masking.mask_text(F.col("request_params")),
            "exception": masking.mask_text(F.col("exception")),
            "user_name": masking.mask_user_name(F.col("user_name")),
        }
    )


def fill_missing(df: DataFrame, as_of=None, fill_response_time: bool = True) -> DataFrame:
    now = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
    filled = {
        "ts": F.coalesce("ts", now),
        "level": F.coalesce("level", F.lit("INFO")),
        "tenant_id": F.coalesce("tenant_id", F.lit(DEFAULT_TENANT)),
        "system_id": F.coalesce("system_id", F.lit(DEFAULT_SYSTEM)),
    }
    if fill_response_time:
        filled["response_time"] = F.coalesce("response_time", F.lit(0).cast("bigint"))
    return df.withColumns(filled)


def validate(df: DataFrame) -> DataFrame:
    """``reject_reason`` for missing tenant or system; unknown levels become INFO."""
    reason = F.when(F.col("tenant_id").isNull(), "tenant_id is required").when(
        F.col("system_id").isNull(), "system_id is required"
    )
    level = F.when(F.col("level").isin(*LEVELS), F.col("level")).otherwise("INFO")
    return df.withColumns({"level": level, "reject_reason": reason, "is_valid": reason.isNull()})


def ingest(lines: DataFrame, as_of=None, value: str = "value", keep=(),
           fill_response_time: bool = True) -> DataFrame:
    """Whole path from raw lines to log rows, valid and rejected ones side by side."""
    parsed = parse(lines, value).withColumnRenamed(value, "raw_value")
    rows = normalise(parsed, as_of, keep=[*keep, "raw_value", "is_valid", "reject_reason"])
    rows = fill_missing(mask(rows), as_of, fill_response_time)
    return rows.withColumn("log_date", F.to_date("ts"))


def enrich(df: DataFrame, tenant: str, as_of) -> DataFrame:
    """Gateway defaults: a content hash as id (stable on retry), tenant of the caller, time."""
    plain = F.struct(*[F.col(c) for c in df.columns if c != "id"])
    content = F.sha2(F.to_json(plain, {"ignoreNullFields": "false"}), 256)
    return df.withColumns(
        {
            "id": F.coalesce("id", F.substring(content, 1, 32)),
            "tenant_id": F.coalesce("tenant_id", F.lit(tenant)),
            "ts": F.coalesce("ts", F.lit(str(as_of)).cast("timestamp")),
        }
    )


def drop_wire_defaults(df: DataFrame, as_of) -> DataFrame:
    """Empty strings and non-positive numbers of the wire format mean "not set"."""
    out = {}
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind == "string":
            out[field.name] = F.nullif(F.col(field.name), F.lit(""))
        elif field.name in ("line_number", "response_time"):
            out[field.name] = F.when(F.col(field.name) > 0, F.col(field.name))
        elif field.name == "tags":
            out[field.name] = F.when(F.size("tags") > 0, F.col("tags"))
        elif field.name == "ts_millis":
            out[field.name] = F.when(F.col("ts_millis") > 0, F.col("ts_millis")).otherwise(
                F.unix_millis(F.lit(str(as_of)).cast("timestamp"))
            )
    return df.withColumns(out)


def ingest_report(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch: total, accepted, rejected. Errors stay rows (see ``ingest_errors``)."""
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if("is_valid").alias("success_count"),
        F.count_if(~F.col("is_valid")).alias("fail_count"),
    )


def ingest_errors(df: DataFrame, batch: str = "batch_id", row: str = "row_index") -> DataFrame:
    return df.filter(~F.col("is_valid")).select(batch, row, "reject_reason")


def accept_batches(df: DataFrame, max_rows: int = MAX_BATCH, batch: str = "batch_id") -> DataFrame:
    """Drop every row of a batch that is too large; counting needs one small aggregate only."""
    oversized = df.groupBy(batch).count().filter(F.col("count") > max_rows).select(batch)
    return df.join(oversized, batch, "left_anti")


def clean_messages(df: DataFrame, column: str = "message") -> DataFrame:
    return df.withColumn(column, text.clean_message(F.col(column)))


def id_violations(df: DataFrame, column: str, what: str) -> DataFrame:
    """Rows whose identifier is missing, too long, badly formed or holds a forbidden word."""
    value = F.col(column)
    problem = (
        F.when(value.isNull() | (value == ""), "empty")
        .when(F.length(value) > 64, "too long")
        .when(~value.rlike(ID_PATTERN), "bad format")
        .when(value.rlike(text.BLACKLIST), "forbidden word")
    )
    return df.select(F.lit(what).alias("field"), value.alias("value"), problem.alias("problem")).filter(
        F.col("problem").isNotNull()
    )
