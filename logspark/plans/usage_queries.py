"""Statistics, exceptions, health and heatmap."""

from pyspark.sql import functions as F

from ..operators import exceptions, health, heatmap, rollups, spans, stats
from ..sources.events import load_logs
from .registry import (
    AS_OF, LOGS, LOGS_AND_SYSTEMS, SHARED_LOGS_AND_SYSTEMS, growth_sql, half_up, percent_sql, query, shared_logs,
    shared_systems, systems_frame,
)

SPAN = ("2024-01-05 00:00:00", "2024-01-25 00:00:00")
IN_SPAN = f"ts >= TIMESTAMP '{SPAN[0]}' AND ts <= TIMESTAMP '{SPAN[1]}'"
IN_HALF_SPAN = f"ts >= TIMESTAMP '{SPAN[0]}' AND ts < TIMESTAMP '{SPAN[1]}'"
DAY = "2024-01-15"
IN_DAY = f"log_date = DATE '{DAY}'"
LONG = "CAST(floor(avg(response_time) + 0.5) AS BIGINT)"


@query("period_stats", LOGS + f"""
SELECT count(*) AS total_count, count(*) FILTER (level = 'ERROR') AS error_count,
  count(DISTINCT user_id) AS user_count, {LONG} AS avg_response_time
FROM logs WHERE {IN_SPAN}""")
def _(spark, folder):
    return stats.period_stats(load_logs(spark, folder), *SPAN)


DAYS = "log_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-24'"


def _rollup(spark, folder):
    """Rollups of some days of the logs; the sketches are held against exact figures in the tests."""
    days = F.col("log_date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-24").cast("date"))
    return rollups.daily_rollup(load_logs(spark, folder)).filter(days)


@query("period_stats_from_rollup", LOGS + f"""
SELECT count(*) AS total_count, count(*) FILTER (level = 'ERROR') AS error_count, {LONG} AS avg_response_time FROM logs WHERE {DAYS}""")
def _(spark, folder):
    return rollups.period_stats(_rollup(spark, folder)).drop("user_count")


@query("module_stats_from_rollup", LOGS + f""", m AS (SELECT module, count(*) AS call_count,
  {percent_sql("count(*) FILTER (level = 'ERROR')", "count(*)")} AS error_rate, {LONG} AS avg_response_time FROM logs WHERE {DAYS} GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY call_count DESC, module) AS rank FROM m""")
def _(spark, folder):
    return rollups.module_stats(_rollup(spark, folder)).drop("user_count")


@query("health_metrics_from_rollup", LOGS + f"""
SELECT tenant_id, system_id, count(*) AS total, count(*) FILTER (level = 'ERROR') AS errors,
  count(*) FILTER (level = 'ERROR' OR status_code >= 500) AS failed FROM logs WHERE {DAYS} GROUP BY 1, 2""")
def _(spark, folder):
    return rollups.health_metrics(_rollup(spark, folder), ["tenant_id", "system_id"]).select("tenant_id", "system_id", "total", "errors", "failed")


@query("today_vs_yesterday", LOGS + f""", s AS (
  SELECT ts >= TIMESTAMP '2024-01-30' AS today, count(*) AS n, count(*) FILTER (level = 'ERROR') AS e,
    count(DISTINCT user_id) AS u, {LONG} AS r
  FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '{AS_OF}'
     OR ts BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1
), w AS (
  SELECT coalesce(max(n) FILTER (today), 0) AS n1, coalesce(max(n) FILTER (NOT today), 0) AS n0,
    coalesce(max(e) FILTER (today), 0) AS e1, coalesce(max(e) FILTER (NOT today), 0) AS e0,
    coalesce(max(u) FILTER (today), 0) AS u1, coalesce(max(u) FILTER (NOT today), 0) AS u0,
    coalesce(max(r) FILTER (today), 0) AS r1, coalesce(max(r) FILTER (NOT today), 0) AS r0 FROM s)
SELECT n1 AS total_count, e1 AS error_count, u1 AS user_count, r1 AS avg_response_time,
  {growth_sql('n1', 'n0')} AS total_growth, {growth_sql('e1', 'e0')} AS error_growth,
  {growth_sql('u1', 'u0')} AS user_growth, r1 - r0 AS response_time_change FROM w""")
def _(spark, folder):
    return stats.today_vs_yesterday(load_logs(spark, folder), AS_OF)


MODULE_AGG = f"""SELECT module, count(*) AS call_count, count(DISTINCT user_id) AS user_count,
  {percent_sql("count(*) FILTER (level = 'ERROR')", "count(*)")} AS error_rate, {LONG} AS avg_response_time
FROM logs WHERE {IN_SPAN} GROUP BY module"""


@query("module_stats", LOGS + f", m AS ({MODULE_AGG})" + """
SELECT *, row_number() OVER (ORDER BY call_count DESC, module) AS rank FROM m
ORDER BY call_count DESC, module LIMIT 20""")
def module_stats(spark, folder):
    return stats.module_stats(load_logs(spark, folder), *SPAN)


@query("module_stats_by_error_rate", LOGS + f", m AS ({MODULE_AGG})" + """
SELECT *, row_number() OVER (ORDER BY error_rate DESC, module) AS rank FROM m
ORDER BY error_rate DESC, module LIMIT 5""")
def _(spark, folder):
    return stats.module_stats(load_logs(spark, folder), *SPAN, sort_by="error_rate", limit=5)


@query("module_trend", LOGS + f""", m AS (SELECT module,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS call_count,
    count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS previous_count
  FROM logs WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-23' GROUP BY module)
SELECT module, call_count, previous_count, {growth_sql('call_count', 'previous_count')} AS trend FROM m""")
def _(spark, folder):
    return stats.module_trend(load_logs(spark, folder), "2024-01-16", "2024-01-23")


@query("hotspots", LOGS + f""", o AS (SELECT operation, count(*) AS call_count, count(DISTINCT user_id) AS user_count,
    {LONG} AS avg_time FROM logs WHERE {IN_SPAN} GROUP BY operation
  ORDER BY call_count DESC, operation LIMIT 50),
m AS (SELECT operation, module, row_number() OVER (PARTITION BY operation ORDER BY count(*) DESC, module) AS rn
  FROM logs WHERE {IN_SPAN} GROUP BY operation, module)
SELECT o.operation, call_count, user_count, avg_time,
  row_number() OVER (ORDER BY call_count DESC, o.operation) AS rank, module,
  {half_up('least(100.0::DOUBLE, CAST(call_count AS DOUBLE) / 100.0 + CAST(user_count AS DOUBLE) / 10.0)', 1)} AS hot_score
FROM o JOIN m ON o.operation = m.operation AND rn = 1""")
def _(spark, folder):
    return stats.hotspots(load_logs(spark, folder), *SPAN)


@query("level_counts", LOGS + f"SELECT level, count(*) AS n FROM logs WHERE {IN_HALF_SPAN} GROUP BY level")
def _(spark, folder):
    return stats.level_counts(load_logs(spark, folder), *SPAN)


for _dim, _col in stats.DIMENSIONS.items():
    query(f"counts_by_{_dim.lower()}", LOGS + f"""
SELECT {_col} AS dimension_value, count(*) AS n FROM logs WHERE {IN_HALF_SPAN} GROUP BY 1""")(
        lambda spark, folder, _dim=_dim: stats.counts_by_dimension(load_logs(spark, folder), _dim, *SPAN)
    )


@query("counts_per_hour", LOGS + """
SELECT date_trunc('hour', ts) AS window_start, tenant_id, system_id, level, count(*) AS n
FROM logs GROUP BY 1, 2, 3, 4""")
def _(spark, folder):
    return stats.counts_per_window(load_logs(spark, folder), "1 hour")


# Fleet reports look at enabled systems only.
ENABLED_LOGS = """, el AS (SELECT l.* FROM logs l SEMI JOIN (SELECT * FROM systems WHERE status = 1) s
  ON l.tenant_id = s.tenant_id AND l.system_id = s.system_id)"""


@query("exception_total", LOGS_AND_SYSTEMS + ENABLED_LOGS + f"""
SELECT count(*) FILTER (level = 'ERROR') AS exception_count FROM el WHERE {IN_HALF_SPAN}""")
def _(spark, folder):
    return exceptions.exception_total(load_logs(spark, folder), systems_frame(spark), *SPAN)


@query("exception_total_of_shared_ids", SHARED_LOGS_AND_SYSTEMS + ENABLED_LOGS + f"""
SELECT count(*) FILTER (level = 'ERROR') AS exception_count FROM el WHERE {IN_HALF_SPAN}""")
def _(spark, folder):
    return exceptions.exception_total(shared_logs(spark, folder), shared_systems(spark), *SPAN)


@query("exception_trend", LOGS_AND_SYSTEMS + ENABLED_LOGS + """, days AS (
  SELECT CAST(d AS DATE) AS log_date FROM generate_series(TIMESTAMP '2024-01-26', TIMESTAMP '2024-02-01', INTERVAL 1 DAY) t(d)
), p AS (SELECT log_date, count(*) FILTER (level = 'ERROR') AS e, count(*) FILTER (level = 'WARN') AS w,
    count(*) FILTER (level = 'INFO') AS i FROM el GROUP BY log_date)
SELECT days.log_date, strftime(days.log_date, '%m-%d') AS label, coalesce(e, 0) AS total_count,
  coalesce(e, 0) AS critical_count, coalesce(w, 0) AS warning_count, coalesce(i, 0) AS info_count
FROM days LEFT JOIN p ON days.log_date = p.log_date""")
def _(spark, folder):
    return exceptions.exception_trend(load_logs(spark, folder), systems_frame(spark), "2024-02-01 09:00:00", 7)


@query("exceptions_by_system", LOGS_AND_SYSTEMS + f""", a AS (SELECT tenant_id, system_id, count(*) AS n,
    count(*) FILTER (level = 'ERROR') AS e FROM logs WHERE {IN_HALF_SPAN} GROUP BY 1, 2)
SELECT s.tenant_id, s.system_id, s.system_name, coalesce(n, 0) AS log_count, coalesce(e, 0) AS exception_count,
  {percent_sql('coalesce(e, 0)', 'coalesce(n, 0)')} AS exception_rate
FROM systems s LEFT JOIN a ON a.tenant_id = s.tenant_id AND a.system_id = s.system_id WHERE s.status = 1""")
def _(spark, folder):
    return exceptions.exceptions_by_system(load_logs(spark, folder), systems_frame(spark), *SPAN)


@query("exceptions_by_type", LOGS_AND_SYSTEMS + ENABLED_LOGS + f""", t AS (SELECT split_part(exception, ':', 1) AS exception_type, count(*) AS n
  FROM el WHERE level = 'ERROR' AND {IN_HALF_SPAN} GROUP BY 1)
SELECT exception_type, n, {half_up('CAST(n AS DOUBLE) / (SELECT sum(n) FROM t) * 100')} AS percentage,
  regexp_replace(regexp_extract(exception_type, '[^.]*$'), 'Exception$', '') AS type_name
FROM t ORDER BY n DESC, exception_type LIMIT 20""")
def _(spark, folder):
    return exceptions.exceptions_by_type(load_logs(spark, folder), systems_frame(spark), *SPAN)


@query("frequent_exceptions", LOGS_AND_SYSTEMS + ENABLED_LOGS + f"""
SELECT tenant_id, system_id, split_part(exception, ':', 1) AS exception_type, count(*) AS n, max(ts) AS latest_time
FROM el WHERE level = 'ERROR' AND {IN_HALF_SPAN} GROUP BY 1, 2, 3
ORDER BY n DESC, tenant_id, system_id, exception_type LIMIT 10""")
def _(spark, folder):
    return exceptions.frequent_exceptions(load_logs(spark, folder), systems_frame(spark), 10, *SPAN)


@query("exception_headline", LOGS_AND_SYSTEMS + ENABLED_LOGS + f"""
SELECT count(*) FILTER ({IN_HALF_SPAN}) AS total_exceptions,
  count(*) FILTER (log_date = DATE '2024-01-30') AS today_exceptions FROM el WHERE level = 'ERROR'""")
def _(spark, folder):
    return exceptions.exception_headline(load_logs(spark, folder), systems_frame(spark), AS_OF, *SPAN)


FAILED = "(level = 'ERROR' OR status_code >= 500)"


@query("health_metrics", LOGS + f"""
SELECT tenant_id, system_id, count(*) AS total, count(*) FILTER (level = 'ERROR') AS errors,
  count(*) FILTER {FAILED} AS failed, {half_up('avg(response_time)')} AS avg_ms,
  {half_up('quantile_cont(CAST(response_time AS DOUBLE), 0.99)')} AS p99_ms
FROM logs WHERE {IN_HALF_SPAN} GROUP BY 1, 2""")
def _(spark, folder):
    from ..functions.numbers import round_half_up

    rows = health.metrics(spans.within(load_logs(spark, folder), *SPAN), ["tenant_id", "system_id"])
    return rows.withColumns({c: round_half_up(F.col(c)) for c in ("avg_ms", "p99_ms")})


def _score_ctes(where: str, grid: str = "systems WHERE status = 1", day: str = "") -> str:
    keys = "tenant_id, system_id" + (", log_date AS day" if day else "")
    on = "a.tenant_id = s.tenant_id AND a.system_id = s.system_id" + (" AND a.day = s.day" if day else "")
    group = "1, 2, 3" if day else "1, 2"
    return f""", a AS (SELECT {keys}, count(*) AS n, count(*) FILTER (level = 'ERROR') AS e,
    count(*) FILTER {FAILED} AS f, avg(response_time) AS r,
    quantile_cont(CAST(response_time AS DOUBLE), 0.99) AS p FROM logs WHERE {where} GROUP BY {group}),
g AS (SELECT * FROM {grid}),
j AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(e, 0) AS e, coalesce(f, 0) AS f, r, p FROM g s LEFT JOIN a ON {on}),
sc AS (SELECT *, CASE WHEN n = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, CAST(n - f AS DOUBLE) / n * 100.0)) END AS av,
    CASE WHEN r IS NULL OR r <= 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, (1.0::DOUBLE - r / 5000.0::DOUBLE) * 100.0::DOUBLE)) END AS pe,
    CASE WHEN n = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, (1.0::DOUBLE - CAST(e AS DOUBLE) / n) * 100.0::DOUBLE)) END AS ex FROM j),
sh AS (SELECT *, av * 0.4::DOUBLE + pe * 0.3::DOUBLE + ex * 0.2::DOUBLE + 10.0::DOUBLE AS ov FROM sc)
"""


LEVEL = """CASE WHEN ov >= 95 THEN '优秀' WHEN ov >= 85 THEN '良好' WHEN ov >= 75 THEN '一般'
  WHEN ov >= 60 THEN '较差' ELSE '危险' END"""
RECENT = "ts BETWEEN TIMESTAMP '2024-01-29 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00'"
HEALTH = LOGS_AND_SYSTEMS + _score_ctes(RECENT)
ROUNDED = f"""hs AS (SELECT tenant_id, system_id, system_name, {half_up('av')} AS av, {half_up('pe')} AS pe,
  {half_up('ex')} AS ex, {half_up('ov')} AS ov FROM sh)"""


@query("system_health", HEALTH + f"""
SELECT tenant_id, system_id, system_name, n AS total, e AS errors, f AS failed,
  {half_up('coalesce(r, 0)')} AS avg_ms, {half_up('coalesce(p, 0)')} AS p99_ms,
  {half_up('av')} AS availability_score, {half_up('pe')} AS performance_score, {half_up('ex')} AS exception_score,
  100.0::DOUBLE AS resource_score, {half_up('ov')} AS health_score, {LEVEL} AS health_level FROM sh""")
def _(spark, folder):
    return health.recent_health(load_logs(spark, folder), systems_frame(spark), AS_OF)


@query("health_trend", LOGS_AND_SYSTEMS + _score_ctes(
    "log_date BETWEEN DATE '2024-01-26' AND DATE '2024-02-01'",
    "(SELECT tenant_id, system_id, CAST(d AS DATE) AS day FROM systems, generate_series(TIMESTAMP '2024-01-26', "
    "TIMESTAMP '2024-02-01', INTERVAL 1 DAY) t(d) WHERE status = 1)", "day") + f"""
SELECT tenant_id, system_id, day, strftime(day, '%m-%d') AS label, {half_up('ov')} AS health_score,
  n AS log_count, e AS exception_count FROM sh""")
def _(spark, folder):
    return health.health_trend(load_logs(spark, folder), systems_frame(spark), "2024-02-01 10:00:00", 7)


@query("fleet_summary", HEALTH + f""", {ROUNDED}, c AS (SELECT coalesce({half_up('avg(ov)')}, 0) AS overall_health,
  count(*) FILTER (ov >= 95) AS excellent, count(*) FILTER (ov >= 85 AND ov < 95) AS good,
  count(*) FILTER (ov >= 75 AND ov < 85) AS fair, count(*) FILTER (ov >= 60 AND ov < 75) AS poor,
  count(*) FILTER (ov < 60) AS critical FROM hs)
SELECT *, excellent + good AS healthy_systems, fair AS warning_systems, poor + critical AS critical_systems FROM c""")
def _(spark, folder):
    return health.fleet_summary(health.recent_health(load_logs(spark, folder), systems_frame(spark), AS_OF))


@query("fleet_factors", HEALTH + f""", {ROUNDED}, m AS (SELECT avg(av) AS av, avg(pe) AS pe, avg(ex) AS ex FROM hs)
SELECT '可用性' AS factor, 'HIGH' AS impact, '失败请求较多，建议检查系统接口稳定性和错误处理机制' AS suggestion FROM m WHERE av < 90
UNION ALL SELECT '性能', 'MEDIUM', '响应时间过长，建议优化数据库查询、添加缓存或增加服务器资源' FROM m WHERE pe < 80
UNION ALL SELECT '异常率', 'HIGH', '异常日志较多，建议排查错误原因并修复相关问题' FROM m WHERE ex < 90""")
def _(spark, folder):
    return health.fleet_factors(health.recent_health(load_logs(spark, folder), systems_frame(spark), AS_OF))


@query("system_factors", HEALTH + f""", {ROUNDED}
SELECT tenant_id, system_id, '可用性 (' || CAST(av AS VARCHAR) || '分)' AS factor,
  CASE WHEN av < 80 THEN 'HIGH' ELSE 'MEDIUM' END AS impact, '系统请求成功率偏低，建议检查接口稳定性' AS suggestion FROM hs WHERE av < 95
UNION ALL SELECT tenant_id, system_id, '性能 (' || CAST(pe AS VARCHAR) || '分)',
  CASE WHEN pe < 70 THEN 'HIGH' ELSE 'MEDIUM' END, '响应时间偏高，建议优化性能瓶颈' FROM hs WHERE pe < 95
UNION ALL SELECT tenant_id, system_id, '异常率 (' || CAST(ex AS VARCHAR) || '分)',
  CASE WHEN ex < 80 THEN 'HIGH' ELSE 'MEDIUM' END, '错误日志占比较高，建议排查异常原因' FROM hs WHERE ex < 95
UNION ALL SELECT tenant_id, system_id, '系统运行良好', 'LOW', '所有指标均正常，继续保持' FROM hs
  WHERE av >= 95 AND pe >= 95 AND ex >= 95""")
def _(spark, folder):
    return health.system_factors(health.recent_health(load_logs(spark, folder), systems_frame(spark), AS_OF))


STATUS = HEALTH + f""", {ROUNDED}, d AS (SELECT tenant_id, system_id, count(*) AS n, count(*) FILTER (level = 'ERROR') AS e
  FROM logs WHERE log_date = DATE '2024-01-30' GROUP BY 1, 2),
st AS (SELECT sh.tenant_id, sh.system_id, sh.system_name, {half_up('ov')} AS health_score, {LEVEL} AS health_level,
  coalesce(d.n, 0) AS today_log_count, {percent_sql('coalesce(d.e, 0)', 'coalesce(d.n, 0)')} AS exception_rate
  FROM sh LEFT JOIN d ON d.tenant_id = sh.tenant_id AND d.system_id = sh.system_id)
"""


@query("system_status", STATUS + "SELECT * FROM st")
def _(spark, folder):
    return health.system_status(load_logs(spark, folder), systems_frame(spark), AS_OF)


@query("system_list", STATUS + """SELECT * FROM st WHERE system_name LIKE '%M%' OR system_id LIKE '%M%'
ORDER BY health_score DESC, system_id LIMIT 2 OFFSET 1""")
def _(spark, folder):
    from ..operators.search import system_list

    status = health.system_status(load_logs(spark, folder), systems_frame(spark), AS_OF)
    # page 2 of size 1 and page 3 of size 1 are rows 2 and 3 of the list
    return system_list(status, "M", page=2, size=1).unionByName(system_list(status, "M", page=3, size=1))


@query("monitor_overview", LOGS_AND_SYSTEMS + _score_ctes(RECENT) + _score_ctes(
    "ts BETWEEN TIMESTAMP '2024-01-28 12:00:00' AND TIMESTAMP '2024-01-29 12:00:00'"
).replace("a AS (", "a2 AS (").replace("g AS (", "g2 AS (").replace("j AS (", "j2 AS (").replace("sc AS (", "sc2 AS (")
 .replace("sh AS (", "sh2 AS (").replace("FROM g s LEFT JOIN a ON a.tenant_id = s.tenant_id AND a.system_id",
 "FROM g2 s LEFT JOIN a2 a ON a.tenant_id = s.tenant_id AND a.system_id").replace("FROM j)", "FROM j2)")
 .replace("FROM sc)", "FROM sc2)") + f""", k AS (SELECT count(*) FILTER (log_date = DATE '2024-01-30') AS t,
  count(*) FILTER (log_date = DATE '2024-01-29') AS y FROM logs SEMI JOIN (SELECT * FROM systems WHERE status = 1) s
  ON logs.tenant_id = s.tenant_id AND logs.system_id = s.system_id),
h AS (SELECT count(*) AS c, count(*) FILTER ({half_up('ov')} < 60) AS ab, {half_up(f"avg({half_up('ov')})", 1)} AS m FROM sh),
h2 AS (SELECT {half_up(f"avg({half_up('ov')})", 1)} AS m2 FROM sh2)
SELECT c AS total_systems, (SELECT count(*) FROM systems WHERE status = 1 AND create_time >= TIMESTAMP '2024-01-01') AS new_systems_this_month,
  t AS today_log_count, {growth_sql('t', 'y')} AS log_count_growth, ab AS abnormal_system_count, m AS avg_health_score,
  {half_up('m - m2', 1)} AS health_score_change FROM k, h, h2""")
def _(spark, folder):
    return health.overview(load_logs(spark, folder), systems_frame(spark), AS_OF)


def _heat_ctes(width: int, limit: int) -> str:
    buckets = 1440 // width
    return f""", d AS (SELECT *, CAST(floor((hour(ts) * 60 + minute(ts)) / {width}) AS BIGINT) AS b FROM logs WHERE {IN_DAY}),
top AS (SELECT module, count(*) AS call_count, count(*) FILTER (level = 'ERROR') AS error_count,
    avg(response_time) AS avg_ms, count(DISTINCT user_id) AS user_count FROM d GROUP BY module
  ORDER BY call_count DESC, module LIMIT {limit}),
cell AS (SELECT module, b, count(*) AS c, count(*) FILTER (level = 'ERROR') AS e, avg(response_time) AS r,
    count(DISTINCT user_id) AS u FROM d GROUP BY 1, 2),
grid AS (SELECT t.module, g.i AS time_index, coalesce(c, 0) AS call_count, coalesce(e, 0) AS error_count,
    coalesce(r, 0) AS avg_ms, coalesce(u, 0) AS user_count
  FROM top t CROSS JOIN generate_series(0, {buckets - 1}) g(i) LEFT JOIN cell ON cell.module = t.module AND cell.b = g.i)
"""


GRADIENT_SQL = "[" + ", ".join(f"'{c}'" for c in heatmap.GRADIENT) + "]"


def _heat_sql(width: int, limit: int, value: str, low: int | None) -> str:
    cut = f"CASE WHEN h < {low} THEN 0 ELSE h END" if low is not None else "h"
    return LOGS + _heat_ctes(width, limit) + f""", v AS (SELECT *, {value} AS value FROM grid),
w AS (SELECT *, CASE WHEN value <= 0 THEN 0 ELSE CAST(floor(ln(1.0::DOUBLE + value) / ln(1.0::DOUBLE +
    (SELECT greatest(1, max(value)) FROM v)) * 100 + 0.5) AS BIGINT) END AS h FROM v),
x AS (SELECT *, {cut} AS heat FROM w)
SELECT module, time_index, lpad(CAST(CAST(floor(time_index * {width} / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(time_index * {width} % 60 AS VARCHAR), 2, '0') AS time_label, value, heat,
  CASE WHEN heat <= 0 THEN '#F5F5F5' ELSE ({GRADIENT_SQL})[least(CAST(floor(heat / 10) AS BIGINT), 9) + 1] END AS color,
  call_count, error_count, {half_up('avg_ms')} AS avg_response_time, user_count,
  {percent_sql('error_count', 'call_count')} AS error_rate FROM x"""


@query("heatmap_calls_by_hour", _heat_sql(60, 50, "call_count", None))
def _(spark, folder):
    return heatmap.with_heat(heatmap.cells(load_logs(spark, folder), DAY))


@query("heatmap_errors_by_hour", _heat_sql(60, 5, "error_count", 60))
def _(spark, folder):
    return heatmap.with_heat(heatmap.cells(load_logs(spark, folder), DAY, 5), "ERROR_COUNT", min_heat=60)


@query("heatmap_response_by_half_hour", _heat_sql(30, 50, "CAST(floor(avg_ms + 0.5) AS BIGINT)", None))
def _(spark, folder):
    return heatmap.with_heat(
        heatmap.cells(load_logs(spark, folder), DAY, granularity="HALF_HOUR"), "RESPONSE_TIME", "HALF_HOUR"
    )


@query("heatmap_modules", LOGS + _heat_ctes(60, 50) + f""", pk AS (SELECT module, time_index, call_count,
    row_number() OVER (PARTITION BY module ORDER BY call_count DESC, time_index) AS rn FROM grid),
own AS (SELECT module, tenant_id, system_id, row_number() OVER (PARTITION BY module ORDER BY count(*) DESC, system_id, tenant_id) AS rn
  FROM d GROUP BY 1, 2, 3)
SELECT top.module, top.call_count, top.error_count, top.user_count, {half_up('top.avg_ms')} AS avg_response_time,
  pk.time_index AS peak_index, pk.call_count AS peak_value, own.tenant_id, own.system_id
FROM top JOIN pk ON pk.module = top.module AND pk.rn = 1 JOIN own ON own.module = top.module AND own.rn = 1""")
def _(spark, folder):
    return heatmap.module_info(load_logs(spark, folder), DAY)


_SUMMARY_SQL = LOGS + _heat_ctes(60, 1_000_000) + f""", hr AS (SELECT time_index AS h, sum(call_count) AS c FROM grid GROUP BY 1),
pk AS (SELECT h, c FROM hr ORDER BY c DESC, h LIMIT 1), vl AS (SELECT h, c FROM hr WHERE c > 0 ORDER BY c, h LIMIT 1)
SELECT (SELECT count(*) FROM top) AS total_modules, CAST((SELECT sum(call_count) FROM top) AS BIGINT) AS total_calls,
  CAST((SELECT sum(error_count) FROM top) AS BIGINT) AS total_errors,
  (SELECT {percent_sql('sum(error_count)', 'sum(call_count)')} FROM top) AS error_rate,
  (SELECT {half_up('avg(avg_ms) FILTER (avg_ms > 0)')} FROM top) AS avg_response_time,
  lpad(CAST(pk.h AS VARCHAR), 2, '0') || ':00' AS peak_hour, CAST(pk.c AS BIGINT) AS peak_calls,
  lpad(CAST(vl.h AS VARCHAR), 2, '0') || ':00' AS valley_hour, CAST(vl.c AS BIGINT) AS valley_calls,
  (SELECT module FROM top ORDER BY call_count DESC, module LIMIT 1) AS most_active_module,
  (SELECT module FROM top ORDER BY CAST(error_count AS DOUBLE) / call_count DESC, call_count DESC, module LIMIT 1) AS highest_error_rate_module
FROM pk, vl"""


@query("heatmap_summary", _SUMMARY_SQL)
def _(spark, folder):
    """Totals take in every module, however few the grid shows."""
    return heatmap.summary(load_logs(spark, folder), DAY)
