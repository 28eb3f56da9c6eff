import datetime as dt

import pytest
from pyspark.sql import functions as F

from logspark.operators import catalog, health, heatmap, retention as ret, rollups, search, spans, stats
from logspark.operators.search import LogQuery
from logspark.sources.events import load_logs

DAY = dt.datetime(2024, 1, 10)
SYSTEMS = "tenant_id STRING, system_id STRING, system_name STRING, status INT, create_time TIMESTAMP"
LOGS = "id STRING, ts TIMESTAMP, tenant_id STRING, system_id STRING, level STRING, status_code INT, response_time BIGINT, module STRING, user_id STRING"


def test_health_scores(spark):
    rows = []
    for name, level, ms in [("ok", "INFO", 0), ("bad", "ERROR", 1000), ("slow", "INFO", 6000)]:
        rows += [(f"{name}{i}", DAY, "t", name, level if i == 0 else "INFO", 200, ms, "m", "u") for i in range(10)]
    systems = spark.createDataFrame([("t", s, s, 1, DAY) for s in ("ok", "bad", "slow", "idle")] + [("t", "off", "off", 0, DAY)], SYSTEMS)
    got = {
        r.system_id: (r.availability_score, r.performance_score, r.exception_score, r.health_score, r.health_level)
        for r in health.recent_health(spark.createDataFrame(rows, LOGS), systems, DAY + dt.timedelta(hours=1)).collect()
    }
    assert got == {
        "ok": (100, 100, 100, 100, "优秀"), "bad": (90, 80, 90, 88, "良好"),
        "slow": (100, 0, 100, 70, "较差"), "idle": (100, 100, 100, 100, "优秀"),
    }


@pytest.mark.parametrize("score,level", [(95, "优秀"), (94.99, "良好"), (85, "良好"), (75, "一般"), (60, "较差"), (59.9, "危险")])
def test_health_levels(spark, score, level):
    assert spark.range(1).select(health.health_level(F.lit(float(score)))).first()[0] == level


def test_heatmap_cells_peaks_and_colours(spark):
    at = lambda h, m=0: DAY + dt.timedelta(hours=h, minutes=m)
    rows = [(str(i), t, "t", "s", "INFO", 200, 10, "m", "u") for i, t in enumerate([at(3), at(3, 59), at(9), at(9, 1), at(23, 59)])]
    df = spark.createDataFrame(rows, LOGS)
    cells = {r.time_index: (r.value, r.heat, r.color) for r in heatmap.with_heat(heatmap.cells(df, DAY)).collect()}
    assert len(cells) == 24 and cells[3] == (2, 100, "#C62828") and cells[0] == (0, 0, "#F5F5F5") and cells[23][1] == 63
    assert heatmap.cells(df, DAY, granularity="HALF_HOUR").count() == 48
    info = heatmap.module_info(df, DAY).first()
    assert (info.peak_index, info.peak_value) == (3, 2)
    total = heatmap.summary(df, DAY).first()
    assert (total.peak_hour, total.valley_hour, total.total_calls, total.most_active_module) == ("03:00", "23:00", 5, "m")


def test_empty_day(spark):
    total = heatmap.summary(spark.createDataFrame([], LOGS), DAY).first()
    assert (total.total_modules, total.total_calls, total.error_rate, total.peak_hour) == (0, 0, 0.0, "00:00")


def test_tiers(spark):
    ages = [7, 8, 30, 31, 90, 91, 98]
    as_of = dt.datetime(2024, 6, 1)
    rows = [((as_of - dt.timedelta(days=a)).date(), a) for a in ages]
    df = spark.createDataFrame(rows, "log_date DATE, age INT").withColumn("tier", ret.tier(as_of))
    assert [r.tier for r in df.orderBy("age").collect()] == ["HOT", "WARM", "WARM", "COLD", "COLD", "DELETED", "DELETED"]
    plan = ret.migration_plan(df.withColumn("tier", F.lit("HOT")), as_of)
    assert {r.age: r.priority for r in plan.collect()} == {8: 1, 30: 2, 31: 4, 90: 6, 91: 8, 98: 10}


@pytest.mark.parametrize("bad", [
    dict(start="2024-02-02", end="2024-02-01"), dict(start="2024-01-01", end="2024-02-01"), dict(keyword="x" * 201),
    dict(page=0), dict(size=0), dict(size=1001), dict(page=11, size=1000), dict(sort_field="password"), dict(sort_order="up"),
    dict(min_response_time=-1), dict(min_response_time=5, max_response_time=4),
])
def test_requests_that_must_not_run(bad):
    with pytest.raises(ValueError):
        LogQuery(**bad).check()


def test_thirty_days_may_run():
    LogQuery(start="2024-01-01", end="2024-01-31", keyword="x" * 200, page=10, size=1000).check()


def test_keyword_terms():
    assert search.keyword_terms('(Order+17) "FAILED"  ') == ["order", "17", "failed"]


def test_approximate_variants_are_close(spark):
    rows = spark.range(5000).select(
        F.col("id").cast("string").alias("id"), F.lit(DAY).cast("timestamp").alias("ts"), F.lit("t").alias("tenant_id"),
        F.lit("s").alias("system_id"), F.lit("INFO").alias("level"), F.lit(200).alias("status_code"),
        F.col("id").alias("response_time"), F.lit("m").alias("module"), (F.col("id") % 1000).cast("string").alias("user_id"),
    )
    exact, near = stats.period_stats(rows).first(), stats.period_stats(rows, approx=True).first()
    assert exact.user_count == 1000 and abs(near.user_count - 1000) < 150
    assert (near.total_count, near.avg_response_time) == (5000, 2500)
    p99 = [health.metrics(rows, ["system_id"], approx).first().p99_ms for approx in (False, True)]
    assert p99[0] == pytest.approx(4949.01) and abs(p99[1] - 4949) < 10


def test_spans():
    assert spans.last_days("2024-03-01 10:00:00", 2) == (dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 2))


def test_scoping(spark):
    df = spark.createDataFrame([("a",), ("default",)], "tenant_id STRING")
    assert [r[0] for r in catalog.scoped(df, "log_alert_record", None).collect()] == ["default"]
    assert [r[0] for r in catalog.scoped(df, "log_alert_record", "a").collect()] == ["a"]
    assert catalog.scoped(df, "sys_tenant", "a").count() == 2


def test_rule_violations(spark):
    ddl = "id INT, tenant_id STRING, system_id STRING, rule_name STRING, rule_type STRING, alert_level STRING"
    df = spark.createDataFrame(
        [(1, "t", "s", "n", "ERROR_RATE", "INFO"), (2, "t", "s", "n", "CONTINUOUS_FAILURE", "CRITICAL"), (3, None, "", "n", None, None)], ddl
    )
    got = sorted((r.id, r.problem) for r in catalog.rule_violations(df).collect())
    assert got == [(2, "unknown rule_type"), (3, "system_id is required"), (3, "tenant_id is required"),
                   (3, "unknown alert_level"), (3, "unknown rule_type")]


def test_rollup_reports_read_no_log_row(spark, tmp_path):
    """A month's report from daily rollups: exact counts and means, users and percentiles within their sketches' bounds."""
    folder, path = "/root/testdata/sf0.1", str(tmp_path / "rollup")
    logs = load_logs(spark, folder)
    rollups.write_rollup(logs.filter("log_date < '2024-01-10'"), path)
    rollups.write_rollup(logs.filter("log_date >= '2024-01-09'"), path)  # the 9th is rolled up again
    days = rollups.read_rollup(spark, path, "2024-01-03", "2024-01-25")
    rows = logs.filter("log_date between '2024-01-03' and '2024-01-25'")
    want, got = stats.period_stats(rows).first(), rollups.period_stats(days).first()
    assert (got.total_count, got.error_count, got.avg_response_time) == (want.total_count, want.error_count, want.avg_response_time)
    assert abs(got.user_count - want.user_count) <= rollups.USER_ERROR * want.user_count
    exact = {r.module: r for r in stats.module_stats(rows).collect()}
    for r in rollups.module_stats(days).collect():
        e = exact[r.module]
        assert (r.call_count, r.error_rate, r.avg_response_time, r["rank"]) == (e.call_count, e.error_rate, e.avg_response_time, e["rank"])
        assert abs(r.user_count - e.user_count) <= rollups.USER_ERROR * e.user_count
    for r in rollups.health_metrics(days, ["tenant_id", "system_id"]).collect():
        mine = rows.filter((F.col("tenant_id") == r.tenant_id) & (F.col("system_id") == r.system_id))
        share = mine.agg(F.avg((F.col("response_time") <= r.p99_ms).cast("double"))).first()[0]
        assert abs(share - 0.99) <= 2 * rollups.RANK_ERROR
    reads = rollups.period_stats(days)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in reads and "events.parquet" not in reads
    assert rollups.period_stats(days.filter("false")).first().total_count == 0
