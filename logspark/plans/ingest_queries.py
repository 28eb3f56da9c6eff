"""Parsing, normalisation, masking and classification."""

from pyspark.sql import functions as F

from ..functions import access, masking, text
from ..operators import ingest
from ..sources.events import load_logs, logs_from_events, read_table
from .registry import AS_OF, LOGS, query


def raw_lines(spark, folder):
    """JSON lines in the spellings and time forms clients use; every 50th line is broken."""
    events = read_table(spark, folder, "events")
    logs = logs_from_events(events).withColumn("n", F.col("id").cast("bigint"))
    n = F.col("n")
    seconds, millis = F.unix_seconds("ts"), F.unix_millis("ts")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    stamp = (
        F.when(n % 6 == 0, seconds.cast("string"))
        .when(n % 6 == 1, millis.cast("string"))
        .when(n % 6 == 2, quoted(seconds.cast("string")))
        .when(n % 6 == 3, quoted(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .when(n % 6 == 4, quoted(F.date_format("ts", "yyyy/MM/dd HH:mm:ss")))
        .otherwise(quoted(F.lit("yesterday")))
    )
    names = F.array(*[F.lit(v) for v in ("warn", "WARNING ", "err", "Severe", "critical", "finest", "fine", "junk")])
    line = F.when(n % 50 == 49, F.lit('{"level":')).otherwise(
        F.concat(
            F.lit('{"id":"'), "id", F.lit('","'),
            F.when(n % 2 == 0, "tenantId").otherwise("tenant_id"), F.lit('":" '), "tenant_id", F.lit(' ",'),
            F.when(n % 5 != 0, F.concat(F.lit('"systemId":"'), "system_id", F.lit('",'))).otherwise(""),
            F.lit('"level":"'), F.get(names, (n % 8).cast("int")), F.lit('","'),
            F.when(n % 3 == 0, "duration").when(n % 3 == 1, "responseTime").otherwise("response_time"), F.lit('":'),
            F.when(n % 4 == 0, quoted(F.concat(F.lit(" "), F.col("response_time").cast("string"))))
            .when(n % 4 == 1, F.lit('"n/a"')).otherwise(F.col("response_time").cast("string")),
            F.lit(',"userName":"'), "user_name", F.lit('","timestamp":'), stamp,
            F.lit(',"message":"mail '), "user_name", F.lit("@example.com from "), "ip",
            F.lit('","context":{"Token":"t","k":'), (n % 9).cast("string"), F.lit("}}"),
        )
    )
    return logs.select("n", (F.floor(n / 60)).alias("batch_id"), line.alias("value"))


RAW = LOGS + """, raw AS (SELECT *, event_id AS n FROM logs), good AS (SELECT * FROM raw WHERE n % 50 <> 49)
"""
LEVEL_OF = """CASE n % 8 WHEN 0 THEN 'WARN' WHEN 1 THEN 'WARN' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'ERROR'
  WHEN 4 THEN 'FATAL' WHEN 5 THEN 'TRACE' WHEN 6 THEN 'DEBUG' ELSE 'INFO' END"""


def ingested(spark, folder):
    return ingest.ingest(raw_lines(spark, folder), AS_OF, keep=["n", "batch_id"])


@query("ingested_logs", RAW + f"""
SELECT id, tenant_id, CASE WHEN n % 5 = 0 THEN 'unknown' ELSE system_id END AS system_id, {LEVEL_OF} AS level,
  CASE WHEN n % 4 = 1 THEN 0 ELSE response_time END AS response_time, 'U**' AS user_name,
  CASE n % 6 WHEN 1 THEN date_trunc('millisecond', ts) WHEN 5 THEN TIMESTAMP '{AS_OF}' ELSE date_trunc('second', ts) END AS ts,
  n % 6 = 5 AS ts_fallback, 'mail U***@example.com from *.*.*.*' AS message,
  '{{"Token":"***","k":' || CAST(n % 9 AS VARCHAR) || '}}' AS extra FROM good""")
def _(spark, folder):
    rows = ingested(spark, folder).filter("is_valid")
    return rows.select("id", "tenant_id", "system_id", "level", "response_time", "user_name", "ts", "ts_fallback", "message", "extra")


@query("rejected_lines", RAW + "SELECT n, '{\"level\":' AS raw_value FROM raw WHERE n % 50 = 49")
def _(spark, folder):
    return ingested(spark, folder).filter("not is_valid").select("n", "raw_value")


@query("ingest_report", RAW + """
SELECT CAST(floor(n / 60) AS BIGINT) AS batch_id, count(*) AS total_count,
  count(*) FILTER (n % 50 <> 49) AS success_count, count(*) FILTER (n % 50 = 49) AS fail_count FROM raw GROUP BY 1""")
def _(spark, folder):
    return ingest.ingest_report(ingested(spark, folder))


@query("ingest_errors", RAW + """
SELECT CAST(floor(n / 60) AS BIGINT) AS batch_id, n AS row_index, 'invalid JSON or empty log' AS reject_reason
FROM raw WHERE n % 50 = 49""")
def _(spark, folder):
    return ingest.ingest_errors(ingested(spark, folder).withColumnRenamed("n", "row_index"))


@query("accepted_batches", """WITH b AS (SELECT event_id, user_id % 11 AS batch_id FROM events)
SELECT * FROM b WHERE batch_id IN (SELECT batch_id FROM b GROUP BY 1 HAVING count(*) <= (SELECT count(*) / 11 FROM b))""")
def _(spark, folder):
    events = read_table(spark, folder, "events")
    limit = events.count() // 11
    return ingest.accept_batches(events.select("event_id", (F.col("user_id") % 11).alias("batch_id")), limit)


@query("enriched_logs", """
SELECT CASE WHEN event_id % 2 = 0 THEN 'e' || CAST(event_id AS VARCHAR)
  ELSE left(sha256('{"tenant_id":' || CASE WHEN user_id % 3 > 0 THEN '"tenant_' || CAST(user_id % 3 AS VARCHAR) || '"' ELSE 'null' END
    || ',"ts":null,"message":"' || event_type || '"}'), 32) END AS id,
  CASE WHEN user_id % 3 > 0 THEN 'tenant_' || CAST(user_id % 3 AS VARCHAR) ELSE 'acme' END AS tenant_id,
  TIMESTAMP '2024-01-30 12:00:00' AS ts, event_type AS message FROM events""")
def _(spark, folder):
    rows = read_table(spark, folder, "events").select(
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("id"),
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("tenant_"), (F.col("user_id") % 3).cast("string"))).alias("tenant_id"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.col("event_type").alias("message"),
    )
    return ingest.enrich(rows, "acme", AS_OF)


@query("wire_defaults_dropped", """
SELECT event_id, nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, '') AS message,
  CASE WHEN event_id % 4 > 0 THEN event_id % 4 END AS line_number,
  CASE WHEN floor(value * 20) > 0 THEN CAST(floor(value * 20) AS BIGINT) END AS response_time,
  CASE WHEN event_id % 5 = 0 THEN epoch_ms(TIMESTAMP '2024-01-30 12:00:00') ELSE event_id % 5 END AS ts_millis FROM events""")
def _(spark, folder):
    e = F.col("event_id")
    rows = read_table(spark, folder, "events").select(
        "event_id", F.when(e % 3 == 0, "").otherwise(F.col("event_type")).alias("message"),
        (e % 4).cast("int").alias("line_number"), F.floor(F.col("value") * 20).cast("bigint").alias("response_time"),
        (e % 5).alias("ts_millis"),
    )
    return ingest.drop_wire_defaults(rows, AS_OF)


@query("filled_and_validated", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'default' ELSE 't' END AS tenant_id, 'unknown' AS system_id,
  CASE WHEN event_id % 4 = 0 THEN 'ERROR' ELSE 'INFO' END AS level, TIMESTAMP '2024-01-30 12:00:00' AS ts,
  CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id END AS response_time, CAST(NULL AS VARCHAR) AS reject_reason, true AS is_valid
FROM events""")
def _(spark, folder):
    e = F.col("event_id")
    rows = read_table(spark, folder, "events").select(
        "event_id", F.when(e % 3 != 0, "t").alias("tenant_id"), F.lit(None).cast("string").alias("system_id"),
        F.when(e % 4 == 0, "ERROR").when(e % 4 == 1, "LOUD").alias("level"),
        F.lit(None).cast("timestamp").alias("ts"), F.when(e % 2 == 1, e).alias("response_time"),
    )
    return ingest.validate(ingest.fill_missing(rows, AS_OF))


@query("rows_missing_ids", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'tenant_id is required' ELSE 'system_id is required' END AS reject_reason
FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0""")
def _(spark, folder):
    e = F.col("event_id")
    rows = read_table(spark, folder, "events").select(
        "event_id", F.when(e % 3 != 0, "t").alias("tenant_id"), F.when(e % 5 != 0, "s").alias("system_id"),
        F.lit("INFO").alias("level"),
    )
    return ingest.validate(rows).filter("not is_valid").select("event_id", "reject_reason")


@query("masked_documents", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace("text", '\b([\w.%-])[\w.%-]+(@[\w.-]+\.[A-Za-z]{2,}\b)', '\1***\2', 'g'),
  '\b(?:\d{1,3}\.){3}\d{1,3}\b', '*.*.*.*', 'g')) AS masked_md5 FROM documents""")
def _(spark, folder):
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", F.md5(masking.mask_text(F.col("text"), ("email", "ipv4"))).alias("masked_md5"))


def _masked_sql(column: str) -> str:
    """The five masks without look-behind: the neighbours are captured, and each mask runs
    twice because neighbours of adjacent matches overlap."""
    edged = [
        (r"(1[3-9]\d)\d{4}(\d{4})", r"\2****\3", 2), (r"(\d{3})\d{11}(\d{3}[\dXx])", r"\2***********\3", 2),
        None, (r"(\d{4})\d{5,11}(\d{4})", r"\2 **** **** \3", 2), None,
    ]
    plain = [None, None, (r"\b([\w.%-])[\w.%-]+(@[\w.-]+\.[A-Za-z]{2,}\b)", r"\1***\2"), None,
             (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "*.*.*.*")]
    for edge, simple in zip(edged, plain):
        if edge:
            pattern, to, times = edge
            for _ in range(times):
                column = f"regexp_replace({column}, '(^|[^0-9]){pattern}($|[^0-9])', '\\1{to}\\4', 'g')"
        else:
            column = f"regexp_replace({column}, '{simple[0]}', '{simple[1]}', 'g')"
    return column


@query("fully_masked_documents", f"""SELECT doc_id, md5({_masked_sql('"text"')}) AS masked_md5 FROM documents""")
def _(spark, folder):
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", F.md5(masking.mask_text(F.col("text"))).alias("masked_md5"))


@query("masked_user_names", "SELECT c_custkey, left(c_name, 1) || '**' AS masked FROM customer")
def _(spark, folder):
    return read_table(spark, folder, "customer").select("c_custkey", masking.mask_user_name(F.col("c_name")).alias("masked"))


@query("clean_messages", r"""
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  CASE WHEN length(html) > 10000 THEN left(html, 10000) || '...[truncated]' ELSE coalesce(html, '') END,
  '<script', '&lt;script', 'gi'), '</script>', '&lt;/script&gt;', 'gi'), 'javascript:', '', 'gi'),
  'onerror\s*=', '', 'gi'), 'onload\s*=', '', 'gi')) AS clean_md5 FROM pages""")
def _(spark, folder):
    pages = read_table(spark, folder, "pages")
    return pages.select("page_id", F.md5(text.clean_message(F.col("html"))).alias("clean_md5"))


@query("id_violations", r"""WITH v AS (SELECT p_name AS value FROM part UNION ALL SELECT replace(p_name, ' ', '_') FROM part)
SELECT 'system_id' AS field, value, CASE WHEN value IS NULL OR value = '' THEN 'empty' WHEN length(value) > 64 THEN 'too long'
  WHEN NOT regexp_full_match(value, '[a-zA-Z0-9_-]{1,64}') THEN 'bad format' ELSE 'forbidden word' END AS problem
FROM v WHERE value IS NULL OR length(value) > 64 OR NOT regexp_full_match(value, '[a-zA-Z0-9_-]{1,64}')
  OR regexp_matches(lower(value), 'union|select|insert|update|delete|drop|create|alter|exec|execute|script|javascript')""")
def _(spark, folder):
    part = read_table(spark, folder, "part").select(F.col("p_name").alias("system_id"))
    both = part.unionByName(part.select(F.replace("system_id", F.lit(" "), F.lit("_")).alias("system_id")))
    return ingest.id_violations(both, "system_id", "system_id")


@query("access_log_classes", LOGS + """
SELECT id, CASE WHEN status_code >= 500 THEN 'ERROR' WHEN status_code >= 400 THEN 'WARN' WHEN response_time > 1500 THEN 'WARN' ELSE 'INFO' END AS access_level,
  'gateway' || CASE WHEN response_time > 1500 THEN ',slow-request' ELSE '' END || CASE WHEN status_code BETWEEN 400 AND 499 THEN ',client-error' ELSE '' END
   || CASE WHEN status_code >= 500 THEN ',server-error' ELSE '' END AS access_tags,
  request_method || ' ' || request_url || ' -> ' || CAST(status_code AS VARCHAR) || ' (' || CAST(response_time AS VARCHAR) || 'ms)' AS access_message
FROM logs""")
def _(spark, folder):
    s, r = F.col("status_code"), F.col("response_time")
    return load_logs(spark, folder).select(
        "id", access.access_level(s, r, 1500).alias("access_level"), access.access_tags(s, r, 1500).alias("access_tags"),
        access.access_message(F.col("request_method"), F.col("request_url"), s, r).alias("access_message"),
    )


@query("method_call_classes", LOGS + """, c AS (SELECT *, split_part(exception, ':', 1) AS ex FROM logs)
SELECT id, CASE WHEN ex IS NOT NULL THEN 'ERROR' WHEN response_time > 1500 THEN 'WARN' ELSE 'INFO' END AS call_level,
  'service' || CASE WHEN response_time > 1500 THEN ',slow-request' ELSE '' END || CASE WHEN ex IS NOT NULL THEN ',exception' ELSE '' END AS call_tags,
  module || '.run() ' || CASE WHEN ex IS NOT NULL THEN '执行异常: ' || ex
    ELSE CASE WHEN response_time > 1500 THEN '执行缓慢' ELSE '执行完成' END || ' (' || CAST(response_time AS VARCHAR) || 'ms)' END AS call_message
FROM c""")
def _(spark, folder):
    ex, r = text.exception_class(F.col("exception")), F.col("response_time")
    return load_logs(spark, folder).select(
        "id", access.call_level(ex, r, 1500).alias("call_level"),
        access.call_tags(F.lit("SERVICE"), ex, r, 1500).alias("call_tags"),
        access.call_message(F.col("module"), F.col("method_name"), ex, r, 1500).alias("call_message"),
    )


@query("logged_paths", """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path FROM p WHERE NOT (path = '/' OR path LIKE '/en%' OR path LIKE '/health%')""")
def _(spark, folder):
    pages = read_table(spark, folder, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1).alias("path")
    )
    return pages.filter(~access.is_excluded(F.col("path"), ("/",), ("/en", "/health")))


@query("client_ips", LOGS + """
SELECT id, CASE WHEN event_id % 4 = 0 THEN ip WHEN event_id % 4 = 1 THEN '10.9.9.9' WHEN event_id % 4 = 2 THEN ip ELSE 'unknown' END AS client_ip FROM logs""")
def _(spark, folder):
    n = F.col("id").cast("bigint") % 4
    forwarded = F.when(n == 0, F.concat("ip", F.lit(" , 10.1.1.1"))).when(n == 1, "UNKNOWN").when(n == 2, "")
    real = F.when(n == 1, "10.9.9.9")
    remote = F.when(n == 2, F.col("ip"))
    return load_logs(spark, folder).select("id", access.client_ip([forwarded, real], remote).alias("client_ip"))


@query("derived_modules", LOGS + """
SELECT id, CASE WHEN module = 'mod_0' THEN 'Zero' WHEN module IN ('mod_1', 'mod_2') THEN module ELSE 'Demo' END AS module FROM logs""")
def _(spark, folder):
    exact = {"com.demo.mod_0.Service": "Zero"}
    prefixes = {"com.demo": "Demo", "com.demo.mod_1": "mod_1", "com.demo.mod_2": "mod_2"}
    return load_logs(spark, folder).select(
        "id", access.module_of(F.col("class_name"), exact, prefixes, "none").alias("module")
    )


@query("exception_causes", LOGS + """
SELECT id, split_part(exception, ':', 1) AS exception_class, 'java.io.IOException' AS causes,
  regexp_replace(regexp_extract(split_part(exception, ':', 1), '[^.]*$'), 'Exception$', '') AS short_name
FROM logs WHERE exception IS NOT NULL""")
def _(spark, folder):
    stack = F.col("exception")
    cls = text.exception_class(stack)
    return load_logs(spark, folder).filter(stack.isNotNull()).select(
        "id", cls.alias("exception_class"), text.cause_classes(stack).alias("causes"),
        text.exception_short_name(cls).alias("short_name"),
    )
