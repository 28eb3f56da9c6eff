"""Rule detection, silencing and alerts."""

from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from ..operators import alerts, rules as rule_ops, silence
from ..schema import RULE_DDL
from ..sources.events import load_logs, read_table, rules_from_customers
from .registry import AS_OF, LOGS, inline, query

# id, tenant, system, type, target, metric, operator, value, level, status
RULE_ROWS = [
    (1, 0, 0, "RESPONSE_TIME", None, None, ">", "3000", "WARNING", 1),
    (2, 1, 1, "ERROR_RATE", "module:mod_3", "errorRate", ">", "10", "CRITICAL", 1),
    (3, 0, 2, "FIELD_COMPARE", "/api/error", "level", "=", "ERROR", "INFO", 1),
    (4, 1, 3, "FIELD_COMPARE", "", "extra.k", ">=", "90", "INFO", 1),
    (5, 0, 4, "FIELD_COMPARE", "operation:view", "message", "matches", "user \\d+ called mod_[12].*", "CRITICAL", 1),
    (6, 1, 5, "FIELD_COMPARE", "mod_", "exception", "contains", "NullPointer", "WARNING", 1),
    (7, 0, 0, "CONTINUOUS_FAILURE", None, "failCount", ">", "5", "CRITICAL", 1),
    (8, 0, 0, "RESPONSE_TIME", None, "responseTime", ">", "1", "WARNING", 0),
    (9, 0, 2, "FIELD_COMPARE", None, "tags[0]", "!=", "click", "NOTICE", 1),
    (10, 0, 2, "FIELD_COMPARE", None, "message", "matches", "(broken", "INFO", 1),
    (11, 1, 1, "FIELD_COMPARE", "userId:7", "statusCode", "==", "200", "INFO", 1),
    (12, 0, 4, "FIELD_COMPARE", "ip:10.0.4.4", "requestMethod", "startsWith", "GE", "INFO", 1),
    (13, 0, 4, "RESPONSE_TIME", None, "responseTime", "<=", "many", "INFO", 1),
    (20, 0, 0, "BATCH_OPERATION", "userId:", "operationCount", ">", "2:86400", "WARNING", 1),
    (21, 1, 1, "BATCH_OPERATION", "module:mod_1", "operationCount", ">=", "3:172800", "CRITICAL", 1),
    (22, 1, 3, "BATCH_OPERATION", "field:extra.k", "operationCount", "=", "2:259200", "INFO", 1),
    (30, 0, 2, "CONTINUOUS_REQUEST", "/api/", "continuousFailure", ">", "2", "CRITICAL", 1),
    (31, 1, 1, "CONTINUOUS_REQUEST", "module:mod_", "continuousFailure", ">", "1", "WARNING", 1),
    (32, 1, 3, "CONTINUOUS_REQUEST", "userId:", "continuousSuccess", ">=", "5", "INFO", 1),
]


def rules_frame(spark) -> DataFrame:
    rows = [
        (i, f"tenant_{t}", f"sys_{s}", f"rule {i}", kind, target, metric, op, value, None, 0, None,
         level, 86_400, "TARGET", i % 2 == 0, True, status, None, None)
        for i, t, s, kind, target, metric, op, value, level, status in RULE_ROWS
    ]
    return inline(spark, rows, RULE_DDL)


STATELESS_SQL = LOGS + """, hit AS (
SELECT 1 AS rule_id, *, CAST(response_time AS VARCHAR) AS actual_value FROM logs WHERE system_id = 'sys_0' AND response_time > 3000
UNION ALL SELECT 2, *, NULL FROM logs WHERE system_id = 'sys_1' AND module = 'mod_3' AND level = 'ERROR'
UNION ALL SELECT 3, *, level FROM logs WHERE system_id = 'sys_2' AND request_url LIKE '%/api/error%' AND level = 'ERROR'
UNION ALL SELECT 4, *, json_extract_string(extra, '$.k') FROM logs WHERE system_id = 'sys_3' AND CAST(json_extract_string(extra, '$.k') AS INT) >= 90
UNION ALL SELECT 5, *, message FROM logs WHERE system_id = 'sys_4' AND operation LIKE '%view%' AND regexp_full_match(message, 'user \\d+ called mod_[12].*')
UNION ALL SELECT 6, *, exception FROM logs WHERE system_id = 'sys_5' AND exception LIKE '%NullPointer%'
UNION ALL SELECT 9, *, split_part(tags, ',', 1) FROM logs WHERE system_id = 'sys_2' AND split_part(tags, ',', 1) <> 'click'
UNION ALL SELECT 11, *, CAST(status_code AS VARCHAR) FROM logs WHERE system_id = 'sys_1' AND user_id = '7' AND status_code = 200
UNION ALL SELECT 12, *, request_method FROM logs WHERE system_id = 'sys_4' AND ip = '10.0.4.4' AND request_method LIKE 'GE%')
"""


@query("stateless_rule_hits", STATELESS_SQL + "SELECT rule_id::BIGINT AS rule_id, id, actual_value FROM hit")
def _(spark, folder):
    return rule_ops.stateless_hits(load_logs(spark, folder), rules_frame(spark)).select("rule_id", "id", "actual_value")


BATCH_SQL = LOGS + """, m AS (
SELECT 20 AS rule_id, 86400000000 AS w, user_id AS k, id, us FROM logs WHERE system_id = 'sys_0'
UNION ALL SELECT 21, 172800000000, module, id, us FROM logs WHERE system_id = 'sys_1' AND module LIKE '%mod_1%'
UNION ALL SELECT 22, 259200000000, json_extract_string(extra, '$.k'), id, us FROM logs WHERE system_id = 'sys_3'),
c AS (SELECT a.rule_id, a.id, count(*) AS n FROM m a JOIN m b ON a.rule_id = b.rule_id AND a.k = b.k
  AND b.us BETWEEN a.us - a.w AND a.us AND (b.us < a.us OR b.id <= a.id) GROUP BY 1, 2)
SELECT rule_id::BIGINT AS rule_id, id, n AS hit_count FROM c
WHERE (rule_id = 20 AND n > 2) OR (rule_id = 21 AND n >= 3) OR (rule_id = 22 AND n = 2)"""


@query("batch_operation_hits", BATCH_SQL)
def _(spark, folder):
    return rule_ops.batch_operation_hits(load_logs(spark, folder), rules_frame(spark)).select("rule_id", "id", "hit_count")


RUNS_SQL = LOGS + """, m AS (
SELECT 30 AS rule_id, request_url AS k, id, us, level = 'ERROR' OR status_code >= 500 AS e FROM logs WHERE system_id = 'sys_2'
UNION ALL SELECT 31, module, id, us, level = 'ERROR' OR status_code >= 500 FROM logs WHERE system_id = 'sys_1'
UNION ALL SELECT 32, user_id, id, us, NOT (level = 'ERROR' OR status_code >= 500) FROM logs WHERE system_id = 'sys_3'),
i AS (SELECT *, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY rule_id, k ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS isl FROM m),
r AS (SELECT *, CAST(sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id, k, isl ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM i)
SELECT rule_id::BIGINT AS rule_id, id, n AS hit_count FROM r
WHERE e AND ((rule_id = 30 AND n > 2) OR (rule_id = 31 AND n > 1) OR (rule_id = 32 AND n >= 5))"""


@query("continuous_request_hits", RUNS_SQL)
def _(spark, folder):
    return rule_ops.continuous_request_hits(load_logs(spark, folder), rules_frame(spark)).select("rule_id", "id", "hit_count")


def _select_of(sql: str) -> tuple[str, str]:
    """CTEs behind the log view, and the final SELECT, of one of the texts above."""
    body = sql[len(LOGS):]
    at = body.rindex("\nSELECT")
    return body[:at], body[at:]


_BATCH, _RUNS = _select_of(BATCH_SQL), _select_of(RUNS_SQL)
ALL_HITS_SQL = (
    STATELESS_SQL + _BATCH[0].replace("m AS (", "mb AS (").replace("FROM m a JOIN m b", "FROM mb a JOIN mb b")
    + _RUNS[0].replace("m AS (", "mr AS (").replace("FROM m)", "FROM mr)") + """
SELECT rule_id::BIGINT AS rule_id, id, 1::BIGINT AS hit_count FROM hit UNION ALL"""
    + _BATCH[1] + " UNION ALL" + _RUNS[1]
)


@query("all_rule_hits", ALL_HITS_SQL)
def _(spark, folder):
    return rule_ops.detect(load_logs(spark, folder), rules_frame(spark)).select("rule_id", "id", "hit_count")


_NAMES = {"RESPONSE_TIME": "响应时间监控", "ERROR_RATE": "错误率监控", "FIELD_COMPARE": "字段值比较", "BATCH_OPERATION": "批量操作监控",
          "CONTINUOUS_REQUEST": "连续请求监控"}
_quoted = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
_RULES_SQL = "rl(rule_id, kind, target, metric, op, want, stateless) AS (VALUES " + ", ".join(
    f"({i}, {_quoted(_NAMES.get(kind, kind))}, {_quoted(target)}, {_quoted(metric)}, {_quoted(op)}, {_quoted(value)}, {kind in rule_ops.STATELESS})"
    for i, _, _, kind, target, metric, op, value, _, _ in RULE_ROWS
) + ")"


@query("alert_texts", ALL_HITS_SQL.replace("\nSELECT rule_id::BIGINT AS rule_id, id, 1::BIGINT AS hit_count FROM hit UNION ALL", ", " + _RULES_SQL + """, al AS (
SELECT rule_id::BIGINT AS rule_id, id, 1::BIGINT AS hit_count FROM hit UNION ALL""") + """)
SELECT al.rule_id, l.id, md5('规则名称: rule ' || al.rule_id || chr(10) || '规则类型: ' || kind || chr(10)
  || '监控对象: ' || coalesce(target, 'null') || chr(10) || '监控字段: ' || coalesce(metric, 'null') || chr(10)
  || '触发条件: ' || coalesce(metric, 'null') || ' ' || op || ' ' || want || chr(10)
  || coalesce('实际值: ' || CASE WHEN stateless AND metric IS NOT NULL THEN h.actual_value END || chr(10), '') || chr(10) || '触发日志详情:' || chr(10)
  || '时间: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(CAST(floor(l.us / 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || chr(10)
  || '级别: ' || level || chr(10) || '模块: ' || module || chr(10) || '消息: ' || message || chr(10)
  || '响应时间: ' || CAST(response_time AS VARCHAR) || 'ms' || chr(10) || '用户: ' || user_name || ' (' || user_id || ')' || chr(10)) AS content_md5
FROM al JOIN rl ON rl.rule_id = al.rule_id JOIN logs l ON l.id = al.id
LEFT JOIN (SELECT rule_id, id, actual_value FROM hit) h ON h.rule_id = al.rule_id AND h.id = al.id""")
def _(spark, folder):
    """Texts of the hits of all rules."""
    hits = rule_ops.detect(load_logs(spark, folder), rules_frame(spark))
    return hits.select("rule_id", "id", F.md5(rule_ops.alert_content()).alias("content_md5"))


@query("rule_hits_after_resets", BATCH_SQL.replace("m AS (", """rs AS (SELECT DISTINCT date_trunc('day', ts) AS t FROM logs WHERE module = 'mod_0' AND level = 'WARN'),
m0 AS (""").replace("c AS (SELECT", """m AS (SELECT m0.rule_id, m0.w, m0.k || '#' || CAST(count(rs.t) FILTER (m0.rule_id = 20) AS VARCHAR) AS k, m0.id, m0.us
  FROM m0 JOIN logs l ON l.id = m0.id LEFT JOIN rs ON rs.t <= l.ts GROUP BY m0.rule_id, m0.w, m0.k, m0.id, m0.us),
c AS (SELECT"""))
def _(spark, folder):
    logs = load_logs(spark, folder)
    resets = logs.filter("module = 'mod_0' and level = 'WARN'").select(
        F.lit(20).cast("bigint").alias("rule_id"), F.date_trunc("day", "ts").alias("reset_time")
    )
    return rule_ops.batch_operation_hits(logs, rules_frame(spark), resets).select("rule_id", "id", "hit_count")


@query("nested_field_values", LOGS + """
SELECT id, json_extract_string(extra, '$.k') AS k_text, CAST(json_extract_string(extra, '$.k') AS DOUBLE) AS k_number,
  CAST(NULL AS VARCHAR) AS nothing, json_exists(extra, '$.k') AS k_exists, false AS z_exists FROM logs""")
def _(spark, folder):
    return load_logs(spark, folder).select(
        "id", paths.text_at("extra.k").alias("k_text"), paths.number_at("extra.k").alias("k_number"),
        paths.text_at("extra.k.x[0]").alias("nothing"), paths.exists_at("extra.k").alias("k_exists"),
        paths.exists_at("extra.z").alias("z_exists"),
    )


@query("error_rate_windows", LOGS + """, w AS (SELECT tenant_id, system_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
  count(*) AS total, count(*) FILTER (level = 'ERROR') AS errors FROM logs GROUP BY 1, 2, 3)
SELECT *, floor(CAST(errors AS DOUBLE) / total * 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS error_rate FROM w
WHERE floor(CAST(errors AS DOUBLE) / total * 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE > 25""")
def _(spark, folder):
    return rule_ops.error_rate_windows(load_logs(spark, folder), 6 * 3600, 25.0)


def hits_frame(spark, folder) -> DataFrame:
    """Hits of two made-up rules over the logs: rule 1 per user with escalation, rule 2 per module."""
    n = F.col("id").cast("bigint")
    one = n % 2 == 0
    levels = F.array(*[F.lit(v) for v in ("CRITICAL", "WARNING", "INFO", "INFO", "INFO")])
    return load_logs(spark, folder).filter(F.col("level") != "DEBUG").withColumns(
        {
            "rule_id": F.when(one, 1).otherwise(2).cast("bigint"),
            "rule_name": F.when(one, "r1").otherwise("r2"),
            "rule_type": F.lit("ERROR_RATE"),
            "monitor_target": F.when(one, "/api").otherwise("module:mod"),
            "monitor_metric": F.lit("errorRate"),
            "condition_operator": F.lit(">"),
            "condition_value": F.lit("10"),
            "alert_level": F.get(levels, (n % 5).cast("int")),
            "silence_period": F.when(one, 2 * 86_400),
            "silence_scope": F.when(one, "user").otherwise("TARGET"),
            "allow_escalation": one,
            "enable_aggregation": F.lit(True),
            "actual_value": F.lit(None).cast("string"),
            "metric_value": F.lit(None).cast("string"),
            "hit_count": F.lit(1).cast("bigint"),
        }
    )


SILENCE_SQL = LOGS + """, h0 AS (SELECT id, us, ts, tenant_id, event_id % 2 = 0 AS one,
    CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rank,
    CASE WHEN event_id % 2 = 0 THEN 172800000000 ELSE 300000000 END AS p,
    CASE WHEN event_id % 2 = 0 THEN '1' ELSE '2' END || ':' || tenant_id || ':' || system_id || ':' ||
    CASE WHEN event_id % 2 = 0 THEN 'user:' || user_id ELSE 'module:' || module END AS k FROM logs WHERE level <> 'DEBUG'),
h AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, id) AS o FROM h0),
f AS (SELECT k, o, us, rank FROM h WHERE o = 1
  UNION ALL
  SELECT x.k, x.o, x.us, x.rank FROM h x JOIN (
    SELECT h.k, min(h.o) AS o FROM f JOIN h ON h.k = f.k AND h.o > f.o
      AND (h.us >= f.us + h.p OR (h.one AND h.rank < f.rank)) GROUP BY h.k, f.o) y ON x.k = y.k AND x.o = y.o),
s AS (SELECT h.*, f.o IS NOT NULL AS fired, count(f.o) OVER (PARTITION BY h.k ORDER BY h.o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS no
  FROM h LEFT JOIN f ON f.k = h.k AND f.o = h.o),
seg AS (SELECT k AS silence_key, bool_or(fired) AS fired, max(id) FILTER (fired) AS hit_id, max(ts) FILTER (fired) AS fired_at,
  count(*) FILTER (NOT fired) AS suppressed_count, min(ts) FILTER (NOT fired) AS first_occurrence, max(ts) FILTER (NOT fired) AS last_occurrence
  FROM s GROUP BY k, no)
"""


@query("fired_alerts", SILENCE_SQL + """
SELECT silence_key, hit_id, fired_at, suppressed_count, first_occurrence, last_occurrence FROM seg WHERE fired""")
def _(spark, folder):
    hits = silence.with_silence_key(hits_frame(spark, folder))
    return silence.fired(hits).select(
        "silence_key", F.col("id").alias("hit_id"), F.col("ts").alias("fired_at"),
        "suppressed_count", "first_occurrence", "last_occurrence",
    )


@query("fired_alerts_without_ids", SILENCE_SQL.replace("ORDER BY us, id)", "ORDER BY us)") + """
SELECT silence_key, fired_at, suppressed_count FROM seg WHERE fired""")
def _(spark, folder):
    """Logs whose source sends no ids: none of their alerts may be lost. Times are distinct within a key here."""
    hits = silence.with_silence_key(hits_frame(spark, folder).withColumn("id", F.lit(None).cast("string")))
    return silence.fired(hits).select("silence_key", F.col("ts").alias("fired_at"), "suppressed_count")


@query("fired_alerts_of_repeated_logs", SILENCE_SQL.replace("FROM logs WHERE level <> 'DEBUG'",
       "FROM (SELECT * FROM logs UNION ALL SELECT * FROM logs) logs WHERE level <> 'DEBUG'").replace(
       "f AS (SELECT k, o,", "f AS (SELECT k, o,") + """
SELECT silence_key, hit_id, fired_at, suppressed_count FROM seg WHERE fired""")
def _(spark, folder):
    """Logs delivered twice: each alert fires once, and the copy counts as held back."""
    hits = hits_frame(spark, folder)
    return silence.fired(silence.with_silence_key(hits.unionByName(hits))).select(
        "silence_key", F.col("id").alias("hit_id"), F.col("ts").alias("fired_at"), "suppressed_count"
    )


@query("silence_statistics", SILENCE_SQL + f""", k AS (SELECT silence_key, max(fired_at) AS last_alert,
  coalesce(sum(suppressed_count) FILTER (NOT fired), 0) AS open FROM seg GROUP BY 1)
SELECT count(*) AS active_silences, count(*) FILTER (open > 0) AS pending_aggregations, CAST(coalesce(sum(open), 0) AS BIGINT) AS total_suppressed
FROM k WHERE last_alert >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR""")
def _(spark, folder):
    hits = silence.with_silence_key(hits_frame(spark, folder))
    return silence.silence_stats(silence.segments(hits), AS_OF, expire_hours=72)


RESETS_SQL = SILENCE_SQL.replace(", h0 AS (", """, rs AS (SELECT DISTINCT date_trunc('day', ts) AS t FROM logs WHERE module = 'mod_0' AND level = 'WARN'),
eps AS (SELECT l.id, count(rs.t) AS ep FROM logs l LEFT JOIN rs ON rs.t <= l.ts AND l.event_id % 2 = 0 GROUP BY 1),
h0 AS (""").replace(" AS k FROM logs WHERE", " || CASE WHEN ep > 0 THEN '#' || CAST(ep AS VARCHAR) ELSE '' END AS k FROM logs JOIN eps USING (id) WHERE")


@query("silence_after_resets", RESETS_SQL + "SELECT silence_key, hit_id AS id, suppressed_count FROM seg WHERE fired")
def _(spark, folder):
    hits = silence.with_silence_key(hits_frame(spark, folder))
    resets = load_logs(spark, folder).filter("module = 'mod_0' and level = 'WARN'").select(
        F.lit(1).cast("bigint").alias("rule_id"), F.date_trunc("day", "ts").alias("reset_time")
    ).distinct()
    return silence.fired(silence.apply_resets(hits, resets)).select("silence_key", "id", "suppressed_count")


ALERTS_SQL = SILENCE_SQL + """, al AS (SELECT s.id AS log_id, s.tenant_id, split_part(s.k, ':', 3) AS system_id, CASE WHEN one THEN 1 ELSE 2 END AS rule_id,
  CASE rank WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'INFO' END AS alert_level, ts AS trigger_time,
  s.k AS silence_key, left(sha256(s.k || '|' || s.id), 32) AS id FROM s WHERE fired)
"""


def alert_frame(spark, folder) -> DataFrame:
    return alerts.create_alerts(hits_frame(spark, folder))


@query("alert_rows", ALERTS_SQL + """
SELECT id, log_id, tenant_id, system_id, rule_id::BIGINT AS rule_id, alert_level, 'ERROR_RATE' AS alert_type, trigger_time, 'PENDING' AS status,
  CASE WHEN alert_level = 'CRITICAL' THEN 'IMMEDIATE' ELSE 'DIGEST' END AS route FROM al""")
def _(spark, folder):
    return alerts.with_route(alert_frame(spark, folder)).select(
        "id", "log_id", "tenant_id", "system_id", "rule_id", "alert_level", "alert_type", "trigger_time", "status", "route"
    )


@query("alert_summary_by_tenant", ALERTS_SQL + """
SELECT tenant_id, count(*) AS total, count(*) FILTER (alert_level = 'CRITICAL') AS critical_count,
  count(*) FILTER (alert_level = 'WARNING') AS warning_count, count(*) FILTER (alert_level = 'INFO') AS info_count FROM al GROUP BY 1""")
def _(spark, folder):
    return alerts.summary_by_tenant(alert_frame(spark, folder))


@query("hourly_digest", ALERTS_SQL + """, q AS (SELECT *, date_trunc('hour', trigger_time) AS hour FROM al WHERE alert_level <> 'CRITICAL')
SELECT tenant_id, hour, count(*) AS total, count(*) FILTER (alert_level = 'CRITICAL') AS critical_count,
  count(*) FILTER (alert_level = 'WARNING') AS warning_count, count(*) FILTER (alert_level = 'INFO') AS info_count FROM q GROUP BY 1, 2""")
def _(spark, folder):
    return alerts.hourly_digest(alert_frame(spark, folder))


@query("pending_alerts", ALERTS_SQL + "SELECT id, trigger_time FROM al WHERE tenant_id = 'tenant_1'")
def _(spark, folder):
    return alerts.pending(alert_frame(spark, folder), "tenant_1").select("id", "trigger_time")


@query("recent_alerts", ALERTS_SQL + f"""
SELECT id, trigger_time FROM al WHERE tenant_id = 'tenant_0' AND system_id = 'sys_2'
  AND trigger_time >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR ORDER BY trigger_time DESC, id LIMIT 20""")
def _(spark, folder):
    return alerts.recent(alert_frame(spark, folder), "tenant_0", "sys_2", AS_OF, 72, 20).select("id", "trigger_time")


@query("alert_count", ALERTS_SQL + """
SELECT count(*) AS n FROM al WHERE tenant_id = 'tenant_0' AND trigger_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""")
def _(spark, folder):
    return alerts.count_between(alert_frame(spark, folder), "tenant_0", "2024-01-10", "2024-01-20")


@query("alert_status_changes", ALERTS_SQL + """
SELECT id, CASE WHEN CAST(log_id AS BIGINT) % 3 = 1 THEN 'RESOLVED' WHEN CAST(log_id AS BIGINT) % 3 = 0 THEN 'PROCESSING' ELSE 'PENDING' END AS status,
  CASE WHEN CAST(log_id AS BIGINT) % 3 = 1 THEN 'ann' END AS handle_user FROM al""")
def _(spark, folder):
    frame = alert_frame(spark, folder)
    log = F.col("log_id").cast("bigint") % 3
    handled = frame.filter(log == 1).select(
        "id", F.lit("ann").alias("handle_user"), F.lit(AS_OF).cast("timestamp").alias("handle_time"),
        F.lit("done").alias("handle_remark"),
    )
    resolved = alerts.resolve(frame, handled)
    return alerts.mark_processing(resolved, frame.filter(log != 2)).select("id", "status", "handle_user")


@query("rule_trigger_counts", LOGS + f""", h AS (SELECT 1 + CAST(user_id AS BIGINT) AS rule_id, count(*) AS n, max(ts) AS t FROM logs WHERE level = 'ERROR' GROUP BY 1)
SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 400 END, 0) + coalesce(n, 0) AS trigger_count,
  coalesce(t, CASE WHEN c_custkey % 8 <> 0 THEN TIMESTAMP '{AS_OF}' - to_hours(c_custkey % 1500) END) AS last_trigger_time
FROM customer LEFT JOIN h ON h.rule_id = c_custkey""")
def _(spark, folder):
    hits = load_logs(spark, folder).filter("level = 'ERROR'").withColumn("rule_id", 1 + F.col("user_id").cast("bigint"))
    rules = rules_from_customers(read_table(spark, folder, "customer"), AS_OF)
    return alerts.trigger_counts(rules, hits).select("id", "trigger_count", "last_trigger_time")
