import datetime as dt
import json

from pyspark.sql import functions as F

from logspark.operators import alerts, rules as rule_ops
from logspark.schema import LOG_SCHEMA, RULE_SCHEMA

START = dt.datetime(2024, 1, 1)


def logs(spark, *rows):
    """Log rows from dicts; ids and times count up."""
    out = []
    for i, row in enumerate(rows):
        base = dict.fromkeys(LOG_SCHEMA.fieldNames())
        base.update(id=f"l{i:02d}", ts=START + dt.timedelta(seconds=i), tenant_id="t", system_id="s", level="INFO")
        base.update({k: json.dumps(v) if k == "extra" else v for k, v in row.items()})
        out.append(tuple(base[f] for f in LOG_SCHEMA.fieldNames()))
    return spark.createDataFrame(out, LOG_SCHEMA)


def rules(spark, *rows):
    out = []
    for i, row in enumerate(rows):
        base = dict.fromkeys(RULE_SCHEMA.fieldNames())
        base.update(id=i, tenant_id="t", system_id="s", rule_name=f"rule {i}", status=1, alert_level="WARNING",
                    rule_type="FIELD_COMPARE", allow_escalation=False, enable_aggregation=True)
        base.update(row)
        out.append(tuple(base[f] for f in RULE_SCHEMA.fieldNames()))
    return spark.createDataFrame(out, RULE_SCHEMA)


def rule(metric, op, value, **more):
    return dict(monitor_metric=metric, condition_operator=op, condition_value=value, **more)


def hits(df):
    return sorted((r.rule_id, r.id) for r in df.select("rule_id", "id").collect())


def test_number_operators(spark):
    df = logs(spark, dict(response_time=1500), dict(response_time=5000), dict(response_time=3000), {})
    rs = rules(spark, *[rule("responseTime", op, "3000") for op in (">", ">=", "<", "<=", "=", "==", "!=", "contains")])
    got = hits(rule_ops.stateless_hits(df, rs))
    want = {0: [1], 1: [1, 2], 2: [0], 3: [0, 2], 4: [2], 5: [2], 6: [0, 1], 7: []}
    assert got == sorted((r, f"l{i:02d}") for r, found in want.items() for i in found)


def test_text_operators(spark):
    df = logs(spark, dict(level="INFO", message="all well"), dict(level="ERROR", exception="x.NullPointerException: y", message="order-17 failed"))
    rs = rules(
        spark, rule("level", "=", "ERROR"), rule("exception", "contains", "NullPointerException"), rule("message", "startsWith", "order"),
        rule("message", "endsWith", "well"), rule("message", "matches", r"order-\d+ .*"), rule("message", "matches", "order"),
        rule("message", "matches", "(broken"), rule("level", "!=", "INFO"), rule("message", ">", "1"), rule("nowhere", "=", "1"),
    )
    assert hits(rule_ops.stateless_hits(df, rs)) == [(0, "l01"), (1, "l01"), (2, "l01"), (3, "l00"), (4, "l01"), (7, "l01")]


def test_thousands_of_rules_paths_and_patterns(spark):
    """No bound on rules, paths or patterns, and none of them comes to the driver; each is found under its own key."""
    n = 5000
    df = logs(spark, *[
        dict(user_id=f"u{i}", ip=f"10.0.0.{i}", request_url=f"/api/item/{i:04d}/show", module=f"mod{i}", operation="ab", message=f"m{i}",
             extra={f"f{i}": {"v": [i, f"t{i}"]}})
        for i in range(0, n, 97)
    ])
    rs = rules(
        spark, *[rule(f"extra.f{i}.v[1]", "matches", f"t{i}") for i in range(n)],
        *[rule("message", "matches", f"(m{i}" if i % 2 else f"m{i}", monitor_target=f"/item/{i:04d}/") for i in range(n)],
        *[rule("message", "=", f"m{i}", monitor_target=t) for i in range(0, n, 97) for t in (f"userId:u{i}", f"ip:10.0.0.{i}", f"module:od{i}", "operation:b")],
    )
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    out = rule_ops.stateless_hits(df, rs)
    assert len(jobs.getJobIdsForGroup(None)) == before  # building the plan runs nothing
    got = hits(out)
    rows = range(0, n, 97)
    want = [(i, f"l{k:02d}") for k, i in enumerate(rows)] + [(n + i, f"l{k:02d}") for k, i in enumerate(rows) if i % 2 == 0]
    want += [(2 * n + 4 * k + j, f"l{k:02d}") for k, i in enumerate(rows) for j in range(4)]
    # a module's text may stand in other modules too, but their messages differ
    assert got == sorted(want)


def test_few_and_many_seeking_rules_agree(spark, monkeypatch):
    df = logs(spark, *[dict(module=f"m-{i}-é{i % 7}", operation="op" * (i % 3), request_url=f"/a/{i}" if i % 2 else None, level="ERROR") for i in range(60)])
    targets = ["module:m-1", "module:é3", "operation:opo", "operation:o", "/a/", "a/1", "-é", "module:m-", "module:", "x", "5-é5"]
    rs = rules(spark, *[rule("level", "=", "ERROR", monitor_target=t) for t in targets])
    few = hits(rule_ops.stateless_hits(df, rs))
    monkeypatch.setattr(rule_ops, "FEW", 0)
    assert hits(rule_ops.stateless_hits(df, rs)) == few and len(few) > 100


def test_decimal_thresholds(spark):
    df = logs(spark, dict(extra={"x": {"v": [1.7]}}), dict(extra={"x": {"v": [2]}}))
    rs = rules(spark, rule("extra.x.v[0]", ">", "1.5"), rule("extra.x.v[0]", ">=", "1"), rule("extra.x.v[0]", "=", "1"))
    assert hits(rule_ops.stateless_hits(df, rs)) == [(0, "l00"), (0, "l01"), (1, "l00"), (1, "l01")]
    strict = hits(rule_ops.stateless_hits(df, rs, strict_long=True))
    assert strict == [(1, "l00"), (1, "l01"), (2, "l00")]


def test_targets(spark):
    df = logs(
        spark, dict(user_id="7", module="orders", operation="create", ip="1.1.1.1", request_url="/api/order/create", level="ERROR"),
        dict(user_id="8", module="stock", operation="list", ip="2.2.2.2", request_url="/api/stock", level="ERROR"),
        dict(level="ERROR"),
    )
    targets = [None, "", "userId:7", "userId:", "module:ord", "ip:2.2.2.2", "operation:cre", "/api/stock", "stock", "user:7"]
    rs = rules(spark, *[rule("level", "=", "ERROR", monitor_target=t) for t in targets])
    want = {0: [0, 1, 2], 1: [0, 1, 2], 2: [0], 3: [0, 1, 2], 4: [0], 5: [1], 6: [0], 7: [1], 8: [1], 9: []}
    got = hits(rule_ops.stateless_hits(df, rs))
    assert got == sorted((r, f"l{i:02d}") for r, found in want.items() for i in found)


def test_unknown_type_disabled_and_other_tenants_never_match(spark):
    df = logs(spark, dict(level="ERROR"))
    rs = rules(
        spark, dict(rule_type="CONTINUOUS_FAILURE", condition_value="1"), rule("level", "=", "ERROR", status=0),
        rule("level", "=", "ERROR", tenant_id="other"), rule("level", "=", "ERROR", system_id="other"),
        dict(rule_type="ERROR_RATE", condition_value="90"),
    )
    assert hits(rule_ops.detect(df, rs)) == [(4, "l00")]


def test_fifteen_operations_fire_from_the_eleventh(spark):
    df = logs(spark, *[dict(user_id="u", extra={"dept": {"id": i % 2}}) for i in range(15)])
    rs = rules(
        spark, rule("operationCount", ">", "10:60", rule_type="BATCH_OPERATION", monitor_target="userId:u"),
        rule("operationCount", ">=", "7", rule_type="BATCH_OPERATION", monitor_target="field:extra.dept.id"),
        rule("operationCount", ">", "x:60", rule_type="BATCH_OPERATION", monitor_target="userId:u"),
        rule("operationCount", ">", "2:1", rule_type="BATCH_OPERATION", monitor_target="userId:"),
    )
    got = hits(rule_ops.batch_operation_hits(df, rs))
    assert got == [(0, f"l{i}") for i in range(10, 15)] + [(1, f"l{i}") for i in range(12, 15)]


def test_continuous_failures_and_successes(spark):
    bad, good = dict(level="ERROR", request_url="/api/pay"), dict(level="INFO", request_url="/api/pay")
    df = logs(spark, *[bad] * 8, good, bad, dict(bad, level="WARN", status_code=503), *[good] * 3)
    rs = rules(
        spark, rule("continuousFailure", ">", "5", rule_type="CONTINUOUS_REQUEST", monitor_target="/api/pay"),
        rule("continuousFailure", "=", "2", rule_type="CONTINUOUS_REQUEST", monitor_target="/api/"),
        rule("continuousSuccess", ">=", "3", rule_type="CONTINUOUS_REQUEST", monitor_target="/api/"),
    )
    assert hits(rule_ops.continuous_request_hits(df, rs)) == [(0, "l05"), (0, "l06"), (0, "l07"), (1, "l01"), (1, "l10"), (2, "l13")]


def test_alert_text_and_aggregation(spark):
    df = logs(spark, *[dict(response_time=4000 + i, message="slow", module="m") for i in range(4)], dict(level="INFO"))
    rs = rules(spark, rule(None, ">", "3000", rule_type="RESPONSE_TIME", silence_period=3))
    rows = alerts.create_alerts(rule_ops.stateless_hits(df, rs)).orderBy("trigger_time").collect()
    assert [r.log_id for r in rows] == ["l00", "l03"]
    assert "规则类型: 响应时间监控\n" in rows[0].alert_content and "实际值" not in rows[0].alert_content  # the rule names no metric
    assert "聚合信息" not in rows[0].alert_content
    assert rows[1].alert_content.endswith("共发生 2 次相同告警（2024-01-01T00:00:01.000 ~ 2024-01-01T00:00:02.000）")
    assert {r.status for r in rows} == {"PENDING"} and rows[0].silence_key == "0:t:s"


def test_trigger_counts_include_suppressed(spark):
    df = logs(spark, dict(level="ERROR"), dict(level="ERROR"))
    rs = rules(spark, dict(rule_type="ERROR_RATE", trigger_count=3), dict(rule_type="ERROR_RATE", status=0))
    found = rule_ops.stateless_hits(df, rs)
    got = {r.id: (r.trigger_count, r.last_trigger_time) for r in alerts.trigger_counts(rs, found).collect()}
    assert got == {0: (5, START + dt.timedelta(seconds=1)), 1: (0, None)}


def test_routes(spark):
    df = spark.createDataFrame([("critical",), ("WARNING",), ("odd",), (None,)], "alert_level STRING")
    assert [r.route for r in alerts.with_route(df).collect()] == ["IMMEDIATE", "DIGEST", "DIGEST", "DIGEST"]
    odd = df.withColumns({"tenant_id": F.lit("t")})
    assert tuple(alerts.summary_by_tenant(odd).first()) == ("t", 4, 1, 1, 2)
