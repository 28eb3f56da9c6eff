"""Search, paging, joins with the catalogue, admission and ordered windows."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import admission, dims, search, windows
from ..operators.search import LogQuery
from ..session import cut_lineage
from ..sources import lookups
from ..sources.events import load_logs, read_table, systems_from_suppliers
from .registry import (
    AS_OF, LOGS, LOGS_AND_SYSTEMS, SHARED_LOGS_AND_SYSTEMS, query, shared_logs, shared_systems, systems_frame,
)

RANGE = dict(start="2024-01-05 00:00:00", end="2024-01-25 00:00:00")
IN_RANGE = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'"
SHORT = ["id", "ts", "tenant_id", "system_id", "level", "module", "operation", "user_id", "response_time"]
COLS = ", ".join(SHORT)


@query("log_search", LOGS + f"""
SELECT {COLS} FROM logs WHERE {IN_RANGE} AND tenant_id = 'tenant_1' AND system_id IN ('sys_1', 'sys_3')
  AND level = 'ERROR' AND module = 'mod_3' AND response_time BETWEEN 100 AND 5000""")
def _(spark, folder):
    q = LogQuery(tenant_id="tenant_1", system_ids=("sys_1", "sys_3"), level="ERROR", module="mod_3",
                 min_response_time=100, max_response_time=5000, **RANGE)
    return search.search(load_logs(spark, folder), q).select(*SHORT)


@query("log_search_by_request", LOGS + f"""
SELECT {COLS}, request_url, request_method, tags FROM logs
WHERE request_url = '/api/click/3' AND request_method = 'POST' AND list_has_any(string_split(tags, ','), ['warn', 'info'])""")
def _(spark, folder):
    q = LogQuery(request_url="/api/click/3", request_method="POST", tags=("warn", "info"))
    return search.search(load_logs(spark, folder), q).select(*SHORT, "request_url", "request_method", "tags")


FUZZY_SQL = LOGS + """
SELECT id, message FROM logs WHERE len(list_filter(regexp_split_to_array(lower(message), '[^\\p{L}\\p{N}_]+'),
  lambda t: levenshtein(t, 'purchese') <= 2 OR levenshtein(t, 'uzer7') <= 1 OR t = '77')) > 0"""
FUZZY_KEYWORD = '"purchese" uzer7 (77)'


@query("keyword_search_fuzzy", FUZZY_SQL)
def _(spark, folder):
    return search.search(load_logs(spark, folder), LogQuery(keyword=FUZZY_KEYWORD)).select("id", "message")


@query("keyword_search_by_dictionary", FUZZY_SQL)
def _(spark, folder):
    """The same search through a dictionary of the words of all logs: each word is compared once."""
    logs = load_logs(spark, folder)
    places = cut_lineage(lookups.word_rows(logs))
    near = places.select("word").distinct().withColumn("deletion", F.explode(text.deletions_of(F.col("word"))))
    words = cut_lineage(lookups.near_words(near, search.keyword_terms(FUZZY_KEYWORD)))
    found = lookups.with_words(lookups.in_partitions(logs, places.join(words, "word", "left_semi")), words)
    return found.select("id", "message")


@query("keyword_search_exact", """
SELECT conv_id, turn, role, md5("text") AS text_md5 FROM conversations
WHERE list_has_any(regexp_split_to_array(lower("text"), '[^\\p{L}\\p{N}_]+'), ['the', 'la'])""")
def _(spark, folder):
    rows = read_table(spark, folder, "conversations")
    hit = text.matches_any(F.col("text"), search.keyword_terms("The  la?"))
    return rows.filter(hit).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("user_name_search", LOGS + "SELECT id, user_name FROM logs WHERE lower(user_name) IN ('user7', 'user12')")
def _(spark, folder):
    q = LogQuery(user_name="User7 USER12")
    return search.search(load_logs(spark, folder), q).select("id", "user_name")


@query("keyword_cleaning", """
SELECT doc_id, md5(regexp_replace(trim(regexp_replace("text", '[-+=&|><!(){}\\[\\]^"~*?:\\\\/]', ' ', 'g')), '\\s+', ' ', 'g')) AS cleaned_md5
FROM documents""")
def _(spark, folder):
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", F.md5(text.clean_keyword(F.col("text"))).alias("cleaned_md5"))


@query("log_page", LOGS + f"""
SELECT {COLS} FROM logs WHERE {IN_RANGE} AND level = 'WARN' ORDER BY response_time DESC, id LIMIT 50 OFFSET 100""")
def _(spark, folder):
    q = LogQuery(level="WARN", sort_field="responseTime", page=3, size=50, **RANGE)
    return search.search_page(load_logs(spark, folder), q).select(*SHORT)


@query("log_page_total", LOGS + f"SELECT count(*) AS total FROM logs WHERE {IN_RANGE} AND level = 'WARN'")
def _(spark, folder):
    return search.search_total(load_logs(spark, folder), LogQuery(level="WARN", **RANGE))


@query("trace_lookup", LOGS + f"SELECT {COLS}, span_id FROM logs WHERE trace_id = 'tr_42' ORDER BY ts, id")
def _(spark, folder):
    return search.trace(load_logs(spark, folder), "tr_42").select(*SHORT, "span_id")


CROSS = LogQuery(system_ids=("sys_0", "sys_1", "sys_5"), keyword="click error", size=40, page=2)
CROSS_SQL = """, m AS (SELECT l.id, l.ts, l.tenant_id, l.system_id, l.level, s.system_name
  FROM logs l JOIN systems s ON l.tenant_id = s.tenant_id AND l.system_id = s.system_id AND s.status = 1
  WHERE l.system_id IN ('sys_0', 'sys_1', 'sys_5')
    AND list_has_any(regexp_split_to_array(lower(l.message), '[^\\p{L}\\p{N}_]+'), ['click', 'error'])),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY tenant_id, system_id ORDER BY ts DESC, id) <= 40)
"""
CROSS_PAGE = "SELECT * FROM k ORDER BY ts DESC, id, tenant_id, system_id LIMIT 40 OFFSET 40"
CROSS_STATS = """SELECT tenant_id, system_id, count(*) AS total_count, count(*) FILTER (level = 'ERROR') AS error_count,
  count(*) FILTER (level = 'WARN') AS warn_count FROM m GROUP BY 1, 2"""


@query("cross_system_page", LOGS_AND_SYSTEMS + CROSS_SQL + CROSS_PAGE)
def _(spark, folder):
    page = search.cross_system_page(load_logs(spark, folder), systems_frame(spark), CROSS)
    return page.select("id", "ts", "tenant_id", "system_id", "system_name", "level")


@query("cross_system_page_of_shared_ids", SHARED_LOGS_AND_SYSTEMS + CROSS_SQL + CROSS_PAGE)
def _(spark, folder):
    page = search.cross_system_page(shared_logs(spark, folder), shared_systems(spark), CROSS)
    return page.select("id", "ts", "tenant_id", "system_id", "system_name", "level")


@query("cross_system_stats", LOGS_AND_SYSTEMS + CROSS_SQL + CROSS_STATS)
def _(spark, folder):
    return search.cross_system_stats(load_logs(spark, folder), systems_frame(spark), CROSS)


@query("cross_system_stats_of_shared_ids", SHARED_LOGS_AND_SYSTEMS + CROSS_SQL + CROSS_STATS)
def _(spark, folder):
    return search.cross_system_stats(shared_logs(spark, folder), shared_systems(spark), CROSS)


@query("top_rows_per_system", LOGS + """, r AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY response_time DESC, id) AS rn FROM logs)
SELECT system_id, id, response_time FROM r WHERE rn <= 10""")
def _(spark, folder):
    top = windows.top_n_per_group(
        load_logs(spark, folder), ["system_id"], [F.col("response_time").desc(), F.col("id").asc()], 10, "id"
    )
    return top.select("system_id", "id", "response_time")


@query("logs_of_enabled_systems", LOGS_AND_SYSTEMS + """
SELECT l.tenant_id, l.system_id, s.system_name, count(*) AS n, CAST(sum(l.response_time) AS BIGINT) AS total_ms
FROM logs l JOIN systems s ON l.tenant_id = s.tenant_id AND l.system_id = s.system_id AND s.status = 1 GROUP BY 1, 2, 3""")
def _(spark, folder):
    rows = dims.of_enabled_systems(load_logs(spark, folder), systems_frame(spark))
    return rows.groupBy("tenant_id", "system_id", "system_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("response_time").alias("total_ms")
    )


@query("log_count_of_every_system", LOGS_AND_SYSTEMS + """
SELECT s.tenant_id, s.system_id, s.system_name, count(l.id) AS n FROM systems s
LEFT JOIN logs l ON l.tenant_id = s.tenant_id AND l.system_id = s.system_id WHERE s.status = 1 GROUP BY 1, 2, 3""")
def _(spark, folder):
    counts = load_logs(spark, folder).groupBy("tenant_id", "system_id").agg(F.count(F.lit(1)).alias("n"))
    return dims.for_every_system(systems_frame(spark), counts, ["n"])


@query("system_name_or_id", LOGS_AND_SYSTEMS + """
SELECT l.id, l.system_id, coalesce(s.system_name, l.system_id) AS system_name
FROM logs l LEFT JOIN (SELECT * FROM systems WHERE id <= 3) s ON l.tenant_id = s.tenant_id AND l.system_id = s.system_id""")
def _(spark, folder):
    named = dims.with_system_name(load_logs(spark, folder), systems_frame(spark).filter("id <= 3"))
    return named.select("id", "system_id", "system_name")


def keyed_logs(spark, folder):
    """Logs of supplier systems with an API key each; every seventh key is malformed."""
    key = F.when(F.col("event_id") % 7 == 0, F.lit("sk_live_x")).otherwise(
        F.concat(F.lit("sk_"), F.md5((F.col("user_id") % 12).cast("string")))
    )
    return read_table(spark, folder, "events").select(
        "event_id", key.alias("api_key"),
        F.concat(F.lit("sys_"), (F.col("user_id") % 15).cast("string")).alias("system_id"),
        F.concat(F.lit("tenant_"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
    )


KEYED = """WITH keyed AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'sk_live_x'
    ELSE 'sk_' || md5(CAST(user_id % 12 AS VARCHAR)) END AS api_key,
    'sys_' || CAST(user_id % 15 AS VARCHAR) AS system_id, 'tenant_' || CAST(user_id % 5 AS VARCHAR) AS tenant_id FROM events)
"""


@query("authenticated_logs", KEYED + """
SELECT k.* FROM keyed k SEMI JOIN (SELECT 'sys_' || CAST(s_suppkey AS VARCHAR) AS system_id,
  'tenant_' || CAST(s_suppkey % 5 AS VARCHAR) AS tenant_id, 'sk_' || md5(CAST(s_suppkey AS VARCHAR)) AS api_key
  FROM supplier WHERE s_suppkey % 4 <> 0) s
ON k.system_id = s.system_id AND k.tenant_id = s.tenant_id AND k.api_key = s.api_key""")
def _(spark, folder):
    systems = systems_from_suppliers(read_table(spark, folder, "supplier"), AS_OF)
    return dims.authenticated(keyed_logs(spark, folder), systems)


@query("logs_without_revoked_keys", KEYED + """
SELECT * FROM keyed WHERE api_key NOT IN (SELECT 'sk_' || md5(CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_suppkey % 4 = 0)""")
def _(spark, folder):
    revoked = systems_from_suppliers(read_table(spark, folder, "supplier"), AS_OF).filter("status = 0").select(
        F.sha2("api_key", 256).alias("key_hash")
    )
    return dims.not_revoked(keyed_logs(spark, folder), revoked)


@query("malformed_keys", KEYED + "SELECT event_id, api_key FROM keyed WHERE NOT regexp_full_match(api_key, 'sk_[a-f0-9]{32}')")
def _(spark, folder):
    rows = keyed_logs(spark, folder)
    return rows.filter(~dims.well_formed_key(F.col("api_key"))).select("event_id", "api_key")


# Six-hour buckets: the sample has too few rows for one-minute ones.
LIMITS = dict(global_limit=60, tenant_limit=32, system_limit=12, seconds=6 * 3600)
ADMIT = LOGS + """, g AS (SELECT *, CAST(floor(us / 21600000000) AS BIGINT) AS m FROM logs),
p1 AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY m ORDER BY us, id) <= 60),
p2 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY tenant_id, m ORDER BY us, id) <= 32),
p3 AS (SELECT * FROM p2 QUALIFY row_number() OVER (PARTITION BY tenant_id, system_id, m ORDER BY us, id) <= 12)
"""


@query("admitted_logs", ADMIT + "SELECT id, tenant_id, system_id FROM p3")
def _(spark, folder):
    return admission.admit(load_logs(spark, folder), **LIMITS).select("id", "tenant_id", "system_id")


@query("tenant_quota_left", ADMIT + """
SELECT tenant_id, make_timestamp(m * 21600000000) AS minute, greatest(0, 32 - count(*)) AS remaining FROM p1 GROUP BY 1, m""")
def _(spark, folder):
    return admission.tenant_remaining(load_logs(spark, folder), 60, 32, 6 * 3600)


@query("trailing_counts", LOGS + """
SELECT id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)
  - (count(*) OVER (PARTITION BY user_id, us) - row_number() OVER (PARTITION BY user_id, us ORDER BY id)) AS trailing_count
FROM logs""")
def _(spark, folder):
    logs = load_logs(spark, folder).select("id", "ts", "user_id")
    return windows.trailing_count(logs, ["user_id"], 86_400).select("id", "user_id", "trailing_count")


@query("failure_runs", LOGS + """, f AS (SELECT *, CASE WHEN level = 'ERROR' OR status_code >= 500 THEN 1 ELSE 0 END AS bad FROM logs),
i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY operation, user_id ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT id, CAST(sum(bad) OVER (PARTITION BY operation, user_id, island ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_length FROM i""")
def _(spark, folder):
    from ..operators.rules import request_failed

    logs = load_logs(spark, folder).select("id", "ts", "operation", "user_id", "level", "status_code")
    return windows.run_length(logs, ["operation", "user_id"], request_failed()).select("id", "run_length")


@query("failure_runs_by_tenant", LOGS + """, f AS (SELECT *, CASE WHEN response_time > 60 THEN 1 ELSE 0 END AS bad FROM logs),
i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY tenant_id ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT id, CAST(sum(bad) OVER (PARTITION BY tenant_id, island ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_length FROM i""")
def _(spark, folder):
    return windows.run_length(load_logs(spark, folder), ["tenant_id"], F.col("response_time") > 60).select("id", "run_length")


@query("documents_by_content", LOGS + "SELECT module, count(*) AS n FROM logs GROUP BY 1")
def _(spark, folder):
    """Logs without ids, traces and spans, delivered twice: the content names the document, so each stays once."""
    from ..sources.logs import document_id, latest_documents

    bare = load_logs(spark, folder).withColumns({c: F.lit(None).cast("string") for c in ("id", "trace_id", "span_id")})
    rows = bare.unionByName(bare).withColumn("doc_id", document_id())
    return latest_documents(rows, "doc_id").groupBy("module").agg(F.count(F.lit(1)).alias("n"))


@query("latest_version_of_each_log", LOGS + """
SELECT span_id, user_id, id, ts FROM logs QUALIFY row_number() OVER (PARTITION BY span_id, user_id ORDER BY ts DESC, id DESC) = 1""")
def _(spark, folder):
    from ..sources.logs import latest_documents

    doc = F.concat_ws("-", "span_id", "user_id")
    rows = load_logs(spark, folder).withColumn("doc_id", doc)
    return latest_documents(rows, "doc_id").select("span_id", "user_id", "id", "ts")
