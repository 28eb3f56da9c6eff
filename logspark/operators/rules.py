"""Rule detection: which log row violates which rule."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import paths
from ..functions.numbers import percent
from ..session import cut_lineage
from . import spans, windows
from .stats import is_error

RULE_TYPES = (
    "RESPONSE_TIME", "ERROR_RATE", "FIELD_COMPARE", "BATCH_OPERATION", "CONTINUOUS_REQUEST",
)
STATELESS = RULE_TYPES[:3]
#: A system with more rules that look for a text than this has them found by parts of that text.
FEW = 16
# Target prefix, log column it reads and name in state keys.
DIMENSIONS = (
    ("userId:", "user_id", "user:"),
    ("module:", "module", "module:"),
    ("ip:", "ip", "ip:"),
    ("operation:", "operation", "operation:"),
)
# Names of the rule types in alert texts.
TYPE_NAMES = {
    "FIELD_COMPARE": "字段值比较", "BATCH_OPERATION": "批量操作监控",
    "CONTINUOUS_REQUEST": "连续请求监控", "RESPONSE_TIME": "响应时间监控",
    "ERROR_RATE": "错误率监控",
}
RULE_FIELDS = (
    "rule_name", "rule_type", "monitor_target", "monitor_metric", "condition_operator",
    "condition_value", "alert_level", "silence_period", "silence_scope", "allow_escalation",
    "enable_aggregation",
)

# Columns of a hit: the log row it came from, the rule, and what was measured.
HIT_COLUMNS = (
    "id", "ts", "tenant_id", "system_id", "level", "module", "operation", "message", "user_id",
    "user_name", "ip", "request_url", "response_time", "rule_id", *RULE_FIELDS,
    "metric_value", "actual_value", "hit_count",
)
# What stateful rules carry through their shuffles.
_CARRIED = (*HIT_COLUMNS[:-2], "rule_version", "state_key", "threshold", "_signs")


def metric_path() -> Column:
    """Field a rule reads; response time rules may leave it out."""
    return F.expr(
        "coalesce(nullif(monitor_metric, ''), CASE WHEN rule_type = 'RESPONSE_TIME' THEN 'responseTime' END)"
    )


def target_path() -> Column:
    """Path behind the prefix of a target, where it is one: any ``field:``, or a nested one."""
    return F.expr(
        r"""CASE WHEN startswith(monitor_target, 'field:') THEN substr(monitor_target, 7)
            WHEN monitor_target RLIKE '^(userId|module|ip|operation):.*[.\\[]'
            THEN regexp_extract(monitor_target, ':(.*)$', 1) END"""
    )


def target_matches() -> Column:
    """Does the log row lie in the rule's scope? An empty value after a prefix means any."""
    return F.expr(
        """CASE WHEN coalesce(monitor_target, '') = '' THEN true
            WHEN startswith(monitor_target, 'field:') THEN true
            WHEN startswith(monitor_target, 'userId:') THEN coalesce(
                monitor_target = 'userId:' OR monitor_target RLIKE '[.\\\\[]' OR monitor_target = concat('userId:', user_id), false)
            WHEN startswith(monitor_target, 'module:') THEN coalesce(contains(module, substr(monitor_target, 8)), false)
            WHEN startswith(monitor_target, 'ip:') THEN coalesce(
                monitor_target = 'ip:' OR monitor_target = concat('ip:', ip), false)
            WHEN startswith(monitor_target, 'operation:') THEN coalesce(contains(operation, substr(monitor_target, 11)), false)
            ELSE coalesce(contains(request_url, monitor_target), false)
              OR coalesce(contains(module, monitor_target), false)
              OR coalesce(contains(operation, monitor_target), false) END"""
    )


# Signs of (actual - expected) that each number operator accepts.
_SIGNS = """CASE condition_operator WHEN '>' THEN array(1) WHEN '>=' THEN array(0, 1) WHEN '<' THEN array(-1)
    WHEN '<=' THEN array(-1, 0) WHEN '=' THEN array(0) WHEN '==' THEN array(0) WHEN '!=' THEN array(-1, 1) END"""


def _sought() -> Column:
    """The text that a target looks for inside a field; null for targets of other kinds."""
    return F.expr(
        """CASE WHEN coalesce(monitor_target, '') = '' OR startswith(monitor_target, 'field:') OR startswith(monitor_target, 'userId:')
              OR startswith(monitor_target, 'ip:') THEN NULL
            WHEN startswith(monitor_target, 'module:') THEN substr(monitor_target, 8)
            WHEN startswith(monitor_target, 'operation:') THEN substr(monitor_target, 11) ELSE monitor_target END"""
    )


def _thirds(text: str) -> str:
    """SQL of all runs of three characters of a text; none for null and shorter ones."""
    return f"if(coalesce(length({text}), 0) < 3, CAST(array() AS ARRAY<STRING>), transform(sequence(1, length({text}) - 2), i -> substr({text}, i, 3)))"


def _dispatch() -> Column:
    """Key under which a log row finds the rule: the user or address it names, a part of the text it seeks, or ``*`` for all rows.

    The part is picked by a hash, so that rules whose texts begin alike do not all share one.
    """
    return F.expr(
        f"""CASE WHEN startswith(monitor_target, 'userId:') AND monitor_target <> 'userId:' AND NOT monitor_target RLIKE '[.\\\\[]'
            THEN concat('u', substr(monitor_target, 8))
            WHEN startswith(monitor_target, 'ip:') AND monitor_target <> 'ip:' THEN concat('i', substr(monitor_target, 4))
            WHEN length(_sought) >= 3 AND _seeking > {FEW}
            THEN concat('t', array_min(transform({_thirds('_sought')}, t -> named_struct('h', xxhash64(t), 't', t))).t)
            ELSE '*' END"""
    )


def worked_out(rules: DataFrame) -> DataFrame:
    """Adds all that follows from a rule alone: where its paths lead, its operator's signs, its pattern if it compiles."""
    whole = "concat('^(?:', condition_value, ')$')"
    compiles = f"try_reflect('java.util.regex.Pattern', 'matches', {whole}, '') IS NOT NULL"
    return rules.withColumns({"_metric_path": metric_path(), "_target_path": target_path()}).withColumns(
        {
            "_metric": F.expr(paths.place_sql("_metric_path")),
            "_target": F.expr(paths.place_sql("_target_path")),
            "_signs": F.expr(_SIGNS),
            "_pattern": F.expr(f"CASE WHEN condition_operator = 'matches' AND {compiles} THEN {whole} END"),
        }
    ).drop("_metric_path")


def wanted_rules(rules: DataFrame, types=RULE_TYPES) -> DataFrame:
    """Enabled rules of the types, worked out, with the key that log rows find them by. No rule is looked at by the driver."""
    per_system = W.partitionBy("tenant_id", "system_id")
    return (
        worked_out(rules.filter((F.col("status") == 1) & F.col("rule_type").isin(*types)))
        .withColumn("_sought", _sought())
        .withColumn("_seeking", F.count_if(F.length("_sought") >= 3).over(per_system))
        .select(
            F.col("id").alias("rule_id"), F.col("tenant_id").alias("_rule_tenant"), F.col("system_id").alias("_rule_system"),
            *RULE_FIELDS, F.col("update_time").alias("rule_version"), "_metric", "_target", "_target_path", "_signs", "_pattern",
            _dispatch().alias("_rule_key"),
        )
    )


def match_rules(logs: DataFrame, rules: DataFrame, types=RULE_TYPES) -> DataFrame:
    """Logs joined with the enabled rules of their system whose target they meet.

    A log row looks under the keys that its system's rules have: ``*``, its user, its address and, where many rules seek a
    text, all parts of three characters of the fields they seek in. So it is compared with few rules even of thousands.
    """
    wanted = wanted_rules(rules, types)
    kind = lambda letter: F.bool_or(F.startswith("_rule_key", F.lit(letter)))
    kinds = wanted.groupBy(F.col("_rule_tenant").alias("_of_tenant"), F.col("_rule_system").alias("_of_system")).agg(
        kind("*").alias("_plain"), kind("u").alias("_users"), kind("i").alias("_addresses"), kind("t").alias("_seeks")
    )
    own = (F.col("tenant_id") == F.col("_of_tenant")) & (F.col("system_id") == F.col("_of_system"))
    parts = ", ".join(_thirds(c) for c in ("request_url", "module", "operation"))
    # only the keys that some rule of the system has
    keys = F.expr(
        f"""explode(array_compact(concat(
            array(if(_plain, '*', NULL), if(_users, concat('u', user_id), NULL), if(_addresses, concat('i', ip), NULL)),
            if(_seeks, transform(array_distinct(concat({parts})), t -> concat('t', t)), CAST(array() AS ARRAY<STRING>)))))"""
    )
    asked = logs.join(kinds, own).withColumn("_key", keys)
    on = (
        (F.col("tenant_id") == F.col("_rule_tenant")) & (F.col("system_id") == F.col("_rule_system"))
        & (F.col("_key") == F.col("_rule_key")) & target_matches()
    )
    helpers = ("_rule_tenant", "_rule_system", "_rule_key", "_key", "_of_tenant", "_of_system", "_plain", "_users", "_addresses", "_seeks")
    return asked.join(wanted, on).drop(*helpers)


def metric_value() -> Column:
    """The value that the rule's own metric leads to; a default metric is not its own."""
    return F.expr(f"CASE WHEN coalesce(monitor_metric, '') <> '' THEN {paths.text_behind('_metric')} END")


def number_holds(actual: str, expected: str, kind: str = "DOUBLE") -> Column:
    """Does the rule's number operator accept the two values?"""
    return F.expr(
        f"coalesce(array_contains(_signs, CAST(sign(CAST({actual} AS {kind}) - try_cast({expected} AS {kind})) AS INT)), false)"
    )


def compare_texts(actual: Column, expected: Column, operator: Column, pattern: Column) -> Column:
    """``matches`` is tried only with patterns that are known to compile; others are null."""
    hit = (
        F.when(operator == "=", actual == expected)
        .when(operator == "!=", actual != expected)
        .when(operator == "contains", actual.contains(expected))
        .when(operator == "startsWith", actual.startswith(expected))
        .when(operator == "endsWith", actual.endswith(expected))
        .when((operator == "matches") & pattern.isNotNull(), F.rlike(actual, pattern))
    )
    return F.coalesce(hit, F.lit(False))


def stateless_hits(logs: DataFrame, rules: DataFrame, strict_long: bool = False) -> DataFrame:
    """Hits of RESPONSE_TIME, ERROR_RATE and FIELD_COMPARE; works on batches and streams.

    With ``strict_long`` numbers are cut to whole ones and decimal thresholds never match.
    """
    matched = match_rules(logs, rules, STATELESS).withColumns(
        {"_number": F.expr(paths.number_behind("_metric")), "actual_value": F.expr(paths.text_behind("_metric"))}
    ).withColumn("metric_value", F.expr("CASE WHEN coalesce(monitor_metric, '') <> '' THEN actual_value END"))
    expected = "try_cast(condition_value AS BIGINT)" if strict_long else "condition_value"
    actual = "try_cast(_number AS BIGINT)" if strict_long else "_number"
    numeric = number_holds(actual, expected, "DECIMAL(20,0)" if strict_long else "DOUBLE")
    textual = compare_texts(
        F.col("actual_value"), F.col("condition_value"), F.col("condition_operator"),
        F.col("_pattern"),
    )
    fires = (
        F.when(F.col("rule_type") == "RESPONSE_TIME", numeric)
        .when(F.col("rule_type") == "ERROR_RATE", F.col("level") == "ERROR")
        .when(F.col("_number").isNotNull(), numeric)
        .otherwise(textual)
    )
    return matched.filter(F.coalesce(fires, F.lit(False))).drop("_number").withColumn(
        "hit_count", F.lit(1).cast("bigint")
    )


def _state_key(kinds: tuple[str, ...], url: bool) -> Column:
    """Rule and the value of the dimension its target names; a nested path (its value is ``_nested``) may replace the field."""
    branches = ["WHEN contains(monitor_target, '/api/') THEN concat('url:', coalesce(request_url, 'null'))"] if url else []
    nested = "_nested"
    for prefix, column, label in DIMENSIONS:
        if prefix in kinds:
            value = column if url else f"CASE WHEN _target_path IS NOT NULL THEN {nested} ELSE {column} END"
            branches.append(
                f"WHEN startswith(monitor_target, '{prefix}') THEN concat('{label}', coalesce({value}, 'null'))"
            )
    branches.append(f"WHEN startswith(monitor_target, 'field:') THEN concat('field:', coalesce({nested}, 'null'))")
    dimension = f"CASE {' '.join(branches)} ELSE coalesce(monitor_target, '') END"
    return F.expr(f"concat_ws(':', CAST(rule_id AS STRING), tenant_id, system_id, {dimension})")


def batch_operation_rows(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Matched rows of BATCH_OPERATION rules with state key, threshold and window seconds."""
    return as_batch_operations(match_rules(logs, rules, ("BATCH_OPERATION",)))


def as_batch_operations(matched: DataFrame) -> DataFrame:
    parts = F.split("condition_value", ":")
    key = _state_key(tuple(p for p, *_ in DIMENSIONS), url=False)
    return (
        matched.withColumn("_nested", F.expr(paths.text_behind("_target"))).withColumns(
            {
                "state_key": key,
                "metric_value": metric_value(),
                "threshold": F.get(parts, F.lit(0)).try_cast("int"),
                "window_seconds": F.coalesce(F.get(parts, F.lit(1)), F.lit("60")).try_cast("int"),
            }
        )
        .filter("threshold is not null and window_seconds > 0")
        .select(*_CARRIED, "window_seconds")
    )


def batch_operation_hits(logs: DataFrame, rules: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """Every row at which the trailing count of its key meets the rule's condition. Matched rows are stored, since sorting
    them by range passes over them twice.

    ``resets`` (``rule_id``, ``reset_time``) clear what a rule has counted so far.
    """
    rows = cut_lineage(batch_operation_rows(logs, rules))
    if resets is not None:
        rows = windows.restart_keys(rows, resets, "state_key")
    return _counted_hits(windows.trailing_count(rows, ["state_key"], F.col("window_seconds"), name="hit_count"))


def _counted_hits(counted: DataFrame) -> DataFrame:
    return counted.filter(number_holds("hit_count", "threshold")).withColumn("actual_value", F.col("hit_count").cast("string"))


def by_version(rows: DataFrame) -> DataFrame:
    """State keys that an edit of the rule renews, so that what the older version counted is not seen again."""
    version = F.unix_micros("rule_version").cast("string")
    return rows.withColumn("state_key", F.concat_ws("@", "state_key", version))


def batch_operation_run(logs: DataFrame, rules: DataFrame, earlier: DataFrame | None, end) -> tuple[DataFrame, DataFrame]:
    """Hits of one run, and the rows to count in the next: those whose window reaches beyond ``end``."""
    rows = cut_lineage(by_version(batch_operation_rows(logs, rules))).withColumn("_earlier", F.lit(False))
    if earlier is not None:
        rows = rows.unionByName(earlier.withColumn("_earlier", F.lit(True)), allowMissingColumns=True)
    counted = windows.trailing_count(rows, ["state_key"], F.col("window_seconds"), name="hit_count")
    left = rows.filter(F.timestamp_seconds(F.unix_seconds("ts") + F.col("window_seconds") + 1) >= spans.instant(end))
    return _counted_hits(counted.filter("not _earlier")), left.select("state_key", "ts", "id", "window_seconds")


def request_failed() -> Column:
    failed = (F.col("level") == "ERROR") | (F.col("status_code") >= 500)
    return F.coalesce(failed, F.lit(False))


def run_event() -> Column:
    """Does the row extend the run its rule counts? Failures, or successes."""
    return (
        F.when(F.col("monitor_metric") == "continuousFailure", request_failed())
        .when(F.col("monitor_metric") == "continuousSuccess", ~request_failed())
        .otherwise(False)
    )


def continuous_request_rows(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Matched rows of CONTINUOUS_REQUEST rules with state key, threshold and whether they extend a run."""
    return as_continuous_requests(match_rules(logs, rules, ("CONTINUOUS_REQUEST",)))


def as_continuous_requests(matched: DataFrame) -> DataFrame:
    key = _state_key(("module:", "userId:"), url=True)
    return (
        matched.withColumn("_nested", F.expr(paths.text_behind("_target"))).withColumns(
            {
                "state_key": key,
                "metric_value": metric_value(),
                "threshold": F.col("condition_value").try_cast("int"),
                "extends_run": run_event(),
            }
        )
        .filter("threshold is not null")
        .select(*_CARRIED, "extends_run")
    )


def continuous_request_hits(logs: DataFrame, rules: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """Every row of a run whose length meets the rule's condition; the opposite outcome ends it,
    as do ``resets`` (``rule_id``, ``reset_time``)."""
    rows = cut_lineage(continuous_request_rows(logs, rules))
    if resets is not None:
        rows = windows.restart_keys(rows, resets, "state_key")
    return _run_hits(windows.run_length(rows, ["state_key"], F.col("extends_run"), name="hit_count"))


def _run_hits(counted: DataFrame) -> DataFrame:
    fires = F.col("extends_run") & number_holds("hit_count", "threshold")
    return counted.filter(fires).withColumn("actual_value", F.col("hit_count").cast("string"))


def continuous_request_run(logs: DataFrame, rules: DataFrame, earlier: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Hits of one run, and the open runs (with their lengths) to go on from in the next."""
    rows = cut_lineage(by_version(continuous_request_rows(logs, rules))).withColumns({"_earlier": F.lit(False), "_by": F.col("extends_run").cast("bigint")})
    if earlier is not None:
        before = earlier.select("state_key", "ts", F.col("length").alias("_by"), F.lit(True).alias("_earlier"))
        rows = rows.unionByName(before, allowMissingColumns=True)
    counted = windows.run_length(rows, ["state_key"], F.col("_by"), name="hit_count")
    last = F.struct("ts", ~F.col("_earlier"), "id")
    runs = counted.groupBy("state_key").agg(F.max("ts").alias("ts"), F.max_by("hit_count", last).alias("length"))
    return _run_hits(counted.filter("not _earlier")), runs.filter("length > 0")


def detect(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """All hits of all rule types, one row per log row and rule."""
    return _all_hits(stateless_hits(logs, rules), batch_operation_hits(logs, rules), continuous_request_hits(logs, rules))


def _all_hits(*parts: DataFrame) -> DataFrame:
    first, *rest = [p.select(*HIT_COLUMNS) for p in parts]
    for part in rest:
        first = first.unionByName(part)
    return first


def detect_run(logs: DataFrame, rules: DataFrame, counted: DataFrame | None, runs: DataFrame | None, end) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All hits of one of several runs, with what counts and runs of the next one go on from."""
    batch, counted = batch_operation_run(logs, rules, counted, end)
    continuous, runs = continuous_request_run(logs, rules, runs)
    return _all_hits(stateless_hits(logs, rules), batch, continuous), counted, runs


def alert_content() -> Column:
    """Text of an alert from the rule and the row that set it off."""
    names = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in TYPE_NAMES.items())
    word = lambda c: f"coalesce(CAST({c} AS STRING), 'null')"
    return F.expr(
        f"""concat(
            '规则名称: ', {word('rule_name')}, '\\n规则类型: ', CASE rule_type {names} ELSE rule_type END,
            '\\n监控对象: ', {word('monitor_target')}, '\\n监控字段: ', {word('monitor_metric')},
            '\\n触发条件: ', {word('monitor_metric')}, ' ', {word('condition_operator')}, ' ', {word('condition_value')}, '\\n',
            if(metric_value IS NULL, '', concat('实际值: ', metric_value, '\\n')),
            '\\n触发日志详情:\\n时间: ', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"),
            '\\n级别: ', {word('level')}, '\\n模块: ', {word('module')}, '\\n消息: ', {word('message')}, '\\n',
            if(response_time IS NULL, '', concat('响应时间: ', response_time, 'ms\\n')),
            if(user_id IS NULL, '', concat('用户: ', {word('user_name')}, ' (', user_id, ')\\n')))"""
    )


def error_rate_windows(logs: DataFrame, seconds: int, threshold: float) -> DataFrame:
    """Real error rate per system and tumbling window, where it exceeds the threshold."""
    return (
        logs.groupBy("tenant_id", "system_id", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(is_error()).alias("errors"))
        .withColumn("error_rate", percent(F.col("errors"), F.col("total")))
        .filter(F.col("error_rate") > threshold)
        .select("tenant_id", "system_id", F.col("w.start").alias("window_start"), "total", "errors", "error_rate")
    )
