"""Retention, archives, exports and catalogue tables."""

from pyspark.sql import functions as F

from ..operators import catalog, retention as ret
from ..schema import PARTITION_COLUMNS
from ..sources import logs as store
from ..sources.events import (
    load_logs, read_table, rules_from_customers, systems_from_suppliers, tenants_from_customers,
)
from ..sources.logs import sheet
from .registry import AS_OF, LOGS, half_up, percent_sql, query

MANIFEST = LOGS + """, parts AS (SELECT tenant_id, system_id, log_date, count(*) AS rows, count(*) * 2048 AS bytes FROM logs GROUP BY 1, 2, 3),
archived AS (SELECT * FROM parts WHERE log_date < DATE '2024-01-12')
"""
LATER = "2024-02-20"


def manifest(spark, folder):
    return ret.manifest(load_logs(spark, folder))


def archived(spark, folder):
    return manifest(spark, folder).filter(F.col("log_date") < F.lit("2024-01-12").cast("date"))


@query("partition_manifest", MANIFEST + "SELECT * FROM parts")
def _(spark, folder):
    return manifest(spark, folder)


@query("manifest_of_paths", LOGS + """, f AS (
  SELECT replace(tenant_id, '_', ':') AS tenant_id, replace(system_id, '_', ' ') AS system_id,
    CASE WHEN module = 'mod_6' THEN NULL ELSE log_date END AS log_date, event_id % 3 AS file, sum(strlen(message)) AS length
  FROM logs GROUP BY ALL)
SELECT tenant_id, system_id, log_date, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM f GROUP BY 1, 2, 3""")
def _(spark, folder):
    """Partitions as the names of files say, escaped characters and a missing date included."""
    day = F.when(F.col("module") == "mod_6", store.NULL_PARTITION).otherwise(F.col("log_date").cast("string"))
    path = F.concat(
        F.lit("/data/logs/tenant_id="), F.replace("tenant_id", F.lit("_"), F.lit("%3A")), F.lit("/system_id="),
        F.replace("system_id", F.lit("_"), F.lit("%20")), F.lit("/log_date="), day, F.lit("/part-"), (F.col("id").cast("bigint") % 3).cast("string"),
    )
    files = load_logs(spark, folder).groupBy(path.alias("path")).agg(F.sum(F.octet_length("message")).alias("length"))
    return store.manifest_rows(files).groupBy(*PARTITION_COLUMNS).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


AGE = f"(DATE '{LATER}' - log_date)"
TIER = f"CASE WHEN {AGE} <= 7 THEN 'HOT' WHEN {AGE} <= 30 THEN 'WARM' WHEN {AGE} <= 90 THEN 'COLD' ELSE 'DELETED' END"


@query("storage_tiers", MANIFEST + f"""
SELECT tenant_id, system_id, log_date, {TIER} AS tier, bytes / 1073741824.0::DOUBLE * CASE {TIER} WHEN 'HOT' THEN 1.0::DOUBLE
  WHEN 'WARM' THEN 0.5::DOUBLE WHEN 'COLD' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS monthly_cost FROM parts""")
def _(spark, folder):
    parts = manifest(spark, folder).withColumn("tier", ret.tier(LATER))
    return ret.with_monthly_cost(parts).drop("rows", "bytes")


@query("migration_plan", MANIFEST + f"""
SELECT tenant_id, system_id, log_date, 'WARM' AS tier, {TIER} AS target_tier, CASE WHEN {AGE} > 97 THEN 10 WHEN {AGE} > 90 THEN 8
  WHEN {AGE} > 33 THEN 6 WHEN {AGE} > 30 THEN 4 WHEN {AGE} > 8 THEN 2 ELSE 1 END::BIGINT AS priority
FROM parts WHERE {AGE} > 30""")
def _(spark, folder):
    parts = manifest(spark, folder).withColumn("tier", F.lit("WARM")).drop("rows", "bytes")
    return ret.migration_plan(parts, LATER)


@query("partitions_up_to", MANIFEST + "SELECT * FROM parts WHERE log_date <= DATE '2024-01-10'")
def _(spark, folder):
    return ret.up_to(manifest(spark, folder), "2024-01-10")


@query("partitions_between", MANIFEST + "SELECT * FROM parts WHERE log_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def _(spark, folder):
    return ret.between(manifest(spark, folder), "2024-01-10", "2024-01-12")


@query("expired_partitions", MANIFEST + "SELECT * FROM parts WHERE log_date < DATE '2024-01-21'")
def _(spark, folder):
    return ret.expired(manifest(spark, folder), LATER, 30)


@query("partitions_not_archived", MANIFEST + "SELECT * FROM parts WHERE log_date >= DATE '2024-01-12'")
def _(spark, folder):
    return ret.not_archived(manifest(spark, folder), archived(spark, folder))


@query("partitions_archived", MANIFEST + "SELECT * FROM archived")
def _(spark, folder):
    return ret.already_archived(manifest(spark, folder), archived(spark, folder))


@query("lifecycle_plan", MANIFEST + """, j AS (SELECT coalesce(p.tenant_id, a.tenant_id) AS tenant_id, coalesce(p.system_id, a.system_id) AS system_id,
  coalesce(p.log_date, a.log_date) AS log_date, p.rows IS NOT NULL AS hot, a.rows IS NOT NULL AS archived
  FROM (SELECT * FROM parts WHERE log_date >= DATE '2024-01-08') p FULL JOIN archived a
  ON p.tenant_id = a.tenant_id AND p.system_id = a.system_id AND p.log_date = a.log_date)
SELECT *, CASE WHEN log_date < DATE '2024-01-05' THEN 'EXPIRE' WHEN hot AND log_date <= DATE '2024-01-28' AND archived THEN 'DROP_HOT'
  WHEN hot AND log_date <= DATE '2024-01-28' THEN 'ARCHIVE' ELSE 'KEEP' END AS action FROM j""")
def _(spark, folder):
    from .lifecycle import lifecycle_plan

    hot = manifest(spark, folder).filter("log_date >= date'2024-01-08'")
    return lifecycle_plan(hot, archived(spark, folder), "2024-02-04", cold_days=30)


@query("export_estimates", MANIFEST + """
SELECT tenant_id, system_id, log_date, rows, rows * 2048 AS json_bytes, rows * 1024 AS sheet_bytes,
  rows > 500000 OR rows * 2048 > 1073741824 AS needs_chunks, rows > 1000000 AS needs_many_sheets FROM parts""")
def _(spark, folder):
    return ret.export_estimate(manifest(spark, folder))


@query("archive_stats", MANIFEST + f"""
SELECT tenant_id, system_id, log_date, GROUPING(tenant_id, system_id, log_date)::BIGINT AS grouping_level, count(*) AS archive_count,
  sum(bytes)::BIGINT AS total_bytes, {half_up('avg(bytes)')} AS mean_bytes
FROM archived GROUP BY GROUPING SETS ((), (tenant_id), (tenant_id, system_id), (log_date))""")
def _(spark, folder):
    return ret.archive_stats(archived(spark, folder))


@query("archive_breakdown", MANIFEST + """
SELECT tenant_id, system_id, count(*) AS archive_count, sum(bytes)::BIGINT AS total_bytes, floor(sum(bytes) / 1048576.0)::BIGINT AS total_mb
FROM archived WHERE log_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' GROUP BY ROLLUP (tenant_id, system_id)""")
def _(spark, folder):
    return ret.archive_breakdown(archived(spark, folder), "2024-01-03", "2024-01-09")


@query("archive_tenant_ranking", MANIFEST + """
SELECT tenant_id, count(*) AS archive_count, sum(bytes)::BIGINT AS total_bytes FROM archived
WHERE log_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""")
def _(spark, folder):
    return ret.tenant_ranking(archived(spark, folder), "2024-01-03", "2024-01-09")


DAILY = MANIFEST + """, d AS (SELECT CAST(x AS DATE) AS log_date FROM generate_series(TIMESTAMP '2024-01-06', TIMESTAMP '2024-01-15', INTERVAL 1 DAY) t(x)),
z AS (SELECT d.log_date, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM d LEFT JOIN archived a ON a.log_date = d.log_date GROUP BY 1)
"""


@query("archive_daily_sizes", DAILY + "SELECT * FROM z")
def _(spark, folder):
    return ret.daily_sizes(archived(spark, folder), "2024-01-15", 10)


@query("archive_size_trend", DAILY + f"""
SELECT sum(bytes)::BIGINT AS total_bytes, {half_up('avg(bytes)')} AS mean_bytes,
  (SELECT log_date FROM z ORDER BY bytes DESC, log_date LIMIT 1) AS max_date, max(bytes) AS max_bytes,
  (SELECT log_date FROM z ORDER BY bytes, log_date LIMIT 1) AS min_date, min(bytes) AS min_bytes FROM z""")
def _(spark, folder):
    return ret.size_trend(archived(spark, folder), "2024-01-15", 10)


@query("archive_size", MANIFEST + """
SELECT coalesce(sum(bytes), 0)::BIGINT AS total_bytes FROM archived
WHERE tenant_id = 'tenant_0' AND system_id = 'sys_2' AND log_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-09'""")
def _(spark, folder):
    return ret.archive_size(archived(spark, folder), "tenant_0", "sys_2", "2024-01-03", "2024-01-09")


@query("storage_stats", MANIFEST + f""", s AS (SELECT (SELECT count(*) FROM parts) AS hot_partitions, (SELECT sum(rows)::BIGINT FROM parts) AS hot_rows,
  (SELECT sum(bytes)::BIGINT FROM parts) AS hot_bytes, (SELECT count(*) FROM archived) AS archive_count,
  (SELECT sum(bytes)::BIGINT FROM archived) AS archive_bytes,
  (SELECT count(*) FROM parts WHERE log_date > DATE '2024-01-23' AND log_date <= DATE '2024-01-30') AS partitions_last_7_days)
SELECT *, hot_bytes + archive_bytes AS total_bytes, {percent_sql('hot_bytes', '(hot_bytes + archive_bytes)')} AS hot_percent,
  {percent_sql('archive_bytes', '(hot_bytes + archive_bytes)')} AS archive_percent FROM s""")
def _(spark, folder):
    return ret.storage_stats(manifest(spark, folder), archived(spark, folder), AS_OF)


@query("sheet_rows", LOGS + """
SELECT id, trace_id, tenant_id, system_id, ts, level, module, operation, class_name, method_name, line_number, message,
  exception, user_id, user_name, request_url, request_method, response_time, ip, thread, replace(tags, ',', ', ') AS tags FROM logs""")
def _(spark, folder):
    return sheet(load_logs(spark, folder))


@query("sheet_texts", """
SELECT doc_id, md5(CASE WHEN length("text") > 500 THEN left("text", 500) || '...' ELSE "text" END) AS cut_md5 FROM documents""")
def _(spark, folder):
    from ..functions.text import abbreviate

    return read_table(spark, folder, "documents").select("doc_id", F.md5(abbreviate(F.col("text"))).alias("cut_md5"))


# The catalogue frames of sources/events.py, in SQL.
HOURS_AGO = f"TIMESTAMP '{AS_OF}' - to_hours"
RULES = f"""WITH rules AS (SELECT c_custkey AS id, 'tenant_' || CAST(c_custkey % 5 AS VARCHAR) AS tenant_id,
  'sys_' || CAST(c_custkey % 10 AS VARCHAR) AS system_id, c_name AS rule_name,
  ['FIELD_COMPARE', 'BATCH_OPERATION', 'CONTINUOUS_REQUEST', 'RESPONSE_TIME', 'ERROR_RATE', 'CONTINUOUS_FAILURE'][c_custkey % 6 + 1] AS rule_type,
  CASE WHEN c_custkey % 4 <> 0 THEN 'module:mod_' || CAST(c_custkey % 7 AS VARCHAR) END AS monitor_target,
  CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 400 END AS trigger_count,
  CASE WHEN c_custkey % 8 <> 0 THEN {HOURS_AGO}(c_custkey % 1500) END AS last_trigger_time,
  ['CRITICAL', 'WARNING', 'INFO', 'NOTICE'][c_custkey % 4 + 1] AS alert_level,
  CASE WHEN c_custkey % 3 = 0 THEN 600 END AS silence_period, CASE WHEN c_custkey % 3 = 0 THEN 'TARGET' END AS silence_scope,
  CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS status, {HOURS_AGO}(c_custkey % 2000) AS create_time FROM customer)
"""


def rules(spark, folder):
    return rules_from_customers(read_table(spark, folder, "customer"), AS_OF)


@query("enabled_rules", RULES + "SELECT id, rule_name, rule_type FROM rules WHERE status = 1")
def _(spark, folder):
    return catalog.enabled_rules(rules(spark, folder)).select("id", "rule_name", "rule_type")


@query("enabled_rules_of_system", RULES + """
SELECT id, rule_name FROM rules WHERE status = 1 AND tenant_id = 'tenant_2' AND system_id = 'sys_7' AND rule_type = 'RESPONSE_TIME'""")
def _(spark, folder):
    return catalog.enabled_rules(rules(spark, folder), "tenant_2", "sys_7", "RESPONSE_TIME").select("id", "rule_name")


@query("rule_count_by_tenant", RULES + "SELECT tenant_id, count(*) AS rule_count FROM rules GROUP BY 1")
def _(spark, folder):
    return catalog.count_rules_by_tenant(rules(spark, folder))


@query("rule_stats_by_type", RULES + """
SELECT rule_type, count(*) AS rule_count, sum(coalesce(trigger_count, 0))::BIGINT AS total_triggers FROM rules WHERE status = 1 GROUP BY 1""")
def _(spark, folder):
    return catalog.rule_stats_by_type(rules(spark, folder))


@query("recently_triggered_rules", RULES + f"""
SELECT rule_name, rule_type, trigger_count, last_trigger_time, alert_level, silence_period::BIGINT AS silence_period, silence_scope FROM rules
WHERE status = 1 AND last_trigger_time >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR""")
def _(spark, folder):
    return catalog.recently_triggered(rules(spark, folder), AS_OF)


@query("high_frequency_rules", RULES + f"""
SELECT rule_name, rule_type, monitor_target, trigger_count,
  {half_up(f"CAST(trigger_count AS DOUBLE) / (epoch(TIMESTAMP '{AS_OF}' - create_time) / 3600)")} AS triggers_per_hour
FROM rules WHERE status = 1 AND trigger_count > 100 AND create_time < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR""")
def _(spark, folder):
    return catalog.high_frequency(rules(spark, folder), AS_OF)


@query("rules_after_monthly_reset", RULES + """
SELECT id, CASE WHEN last_trigger_time < TIMESTAMP '2024-01-01' THEN 0 ELSE trigger_count END AS trigger_count,
  CASE WHEN last_trigger_time >= TIMESTAMP '2024-01-01' THEN last_trigger_time END AS last_trigger_time FROM rules""")
def _(spark, folder):
    return catalog.monthly_reset(rules(spark, folder), AS_OF).select("id", "trigger_count", "last_trigger_time")


@query("rules_after_idle_shutdown", RULES + f"""
SELECT id, CASE WHEN status = 1 AND (last_trigger_time IS NULL OR last_trigger_time < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)
  AND create_time < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 0 ELSE status END::BIGINT AS status FROM rules""")
def _(spark, folder):
    return catalog.disable_inactive(rules(spark, folder), AS_OF).select("id", "status")


@query("rules_after_silence_update", RULES + """
SELECT id, CASE WHEN id % 10 = 1 THEN 900 ELSE silence_period END::BIGINT AS silence_period,
  CASE WHEN id % 10 = 1 THEN 'USER' ELSE silence_scope END AS silence_scope FROM rules""")
def _(spark, folder):
    frame = rules(spark, folder)
    changes = frame.filter("id % 10 = 1").select(
        "id", F.lit(900).alias("silence_period"), F.lit("USER").alias("silence_scope"),
        F.lit(None).cast("boolean").alias("allow_escalation"), F.lit(None).cast("boolean").alias("enable_aggregation"),
    )
    return catalog.update_silence(frame, changes).select("id", "silence_period", "silence_scope")


@query("rules_after_switch_and_removal", RULES + """
SELECT id, CASE WHEN id % 10 = 2 THEN 0 ELSE status END::BIGINT AS status FROM rules WHERE id % 10 <> 3""")
def _(spark, folder):
    frame = rules(spark, folder)
    off = frame.filter("id % 10 = 2").select("id", F.lit(0).alias("status"))
    return catalog.remove(catalog.set_status(frame, off), frame.filter("id % 10 = 3")).select("id", "status")


@query("rule_page", RULES + "SELECT id, rule_name, create_time FROM rules WHERE tenant_id = 'tenant_3' ORDER BY create_time DESC, id LIMIT 15 OFFSET 15")
def _(spark, folder):
    return catalog.rule_page(rules(spark, folder), "tenant_3", page=2, size=15).select("id", "rule_name", "create_time")


@query("rule_violations", RULES + """
SELECT id, 'unknown rule_type' AS problem FROM rules WHERE rule_type = 'CONTINUOUS_FAILURE'
UNION ALL SELECT id, 'unknown alert_level' FROM rules WHERE alert_level = 'NOTICE'""")
def _(spark, folder):
    return catalog.rule_violations(rules(spark, folder))


@query("tenant_scoped_rules", RULES + "SELECT id FROM rules WHERE tenant_id = 'tenant_4'")
def _(spark, folder):
    return catalog.scoped(rules(spark, folder), "log_exception_rule", "tenant_4").select("id")


SYSTEMS = f"""WITH systems AS (SELECT s_suppkey AS id, 'sys_' || CAST(s_suppkey AS VARCHAR) AS system_id,
  'tenant_' || CAST(s_suppkey % 5 AS VARCHAR) AS tenant_id, s_name AS system_name, 'sk_' || md5(CAST(s_suppkey AS VARCHAR)) AS api_key,
  CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END AS status, TIMESTAMP '{AS_OF}' - to_days((s_suppkey % 90)::INT) AS create_time FROM supplier)
"""


def systems(spark, folder):
    return systems_from_suppliers(read_table(spark, folder, "supplier"), AS_OF)


@query("system_counts", SYSTEMS + """
SELECT count(*) AS enabled, count(*) FILTER (create_time >= TIMESTAMP '2024-01-01') AS new_this_month FROM systems WHERE status = 1""")
def _(spark, folder):
    return catalog.system_counts(systems(spark, folder), AS_OF)


@query("systems_of_tenant", SYSTEMS + "SELECT id, system_id, system_name FROM systems WHERE status = 1 AND tenant_id = 'tenant_1'")
def _(spark, folder):
    return catalog.systems_of(systems(spark, folder), "tenant_1").select("id", "system_id", "system_name")


@query("system_count_by_tenant", SYSTEMS + "SELECT tenant_id, count(*) AS system_count FROM systems WHERE status = 1 GROUP BY 1")
def _(spark, folder):
    return catalog.count_systems_by_tenant(systems(spark, folder))


@query("system_by_id", SYSTEMS + "SELECT id, tenant_id, system_name FROM systems WHERE system_id = 'sys_3' AND status = 1")
def _(spark, folder):
    return catalog.find_system(systems(spark, folder), "sys_3").select("id", "tenant_id", "system_name")


@query("disabled_system_by_id", SYSTEMS + "SELECT id FROM systems WHERE system_id = 'sys_4' AND status = 1")
def _(spark, folder):
    return catalog.find_system(systems(spark, folder), "sys_4").select("id")


@query("system_id_taken", SYSTEMS + "SELECT count(*) FILTER (system_id = 'sys_4') > 0 AS taken FROM systems")
def _(spark, folder):
    return catalog.system_exists(systems(spark, folder), "sys_4")


@query("system_page", SYSTEMS + "SELECT id, 'sk_****' || right(md5(api_key), 8) AS api_key FROM systems ORDER BY create_time DESC, id LIMIT 5")
def _(spark, folder):
    return catalog.system_page(systems(spark, folder), size=5).select("id", "api_key")


@query("masked_api_keys", SYSTEMS + "SELECT id, system_id, 'sk_****' || right(md5(api_key), 8) AS api_key FROM systems")
def _(spark, folder):
    return catalog.masked_keys(systems(spark, folder))


TENANTS = f"""WITH tenants AS (SELECT c_custkey AS id, 'tenant_' || CAST(c_custkey AS VARCHAR) AS tenant_id, c_name AS tenant_name,
  CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS status, TIMESTAMP '{AS_OF}' - to_days((c_custkey % 120)::INT) AS create_time FROM customer)
"""


def tenants(spark, folder):
    return tenants_from_customers(read_table(spark, folder, "customer"), AS_OF)


@query("tenant_counts", TENANTS + """
SELECT count(*) FILTER (status = 1) AS enabled, count(*) FILTER (status = 1 AND create_time >= TIMESTAMP '2024-01-01') AS new_this_month FROM tenants""")
def _(spark, folder):
    return catalog.tenant_counts(tenants(spark, folder), AS_OF)


@query("tenant_by_id", TENANTS + "SELECT id, tenant_name FROM tenants WHERE tenant_id = 'tenant_77' AND status = 1")
def _(spark, folder):
    return catalog.find_tenant(tenants(spark, folder), "tenant_77").select("id", "tenant_name")


@query("enabled_tenants", TENANTS + "SELECT id, tenant_name FROM tenants WHERE status = 1")
def _(spark, folder):
    return catalog.enabled_tenants(tenants(spark, folder)).select("id", "tenant_name")
