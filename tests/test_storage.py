import datetime as dt
import gzip
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from logspark.operators import search
from logspark.operators.search import LogQuery
from logspark.operators.windows import latest_per_key
from logspark.plans.detection import run_detection
from logspark.plans.alert_queries import rules_frame
from logspark.plans import lifecycle
from logspark.plans.lifecycle import run_lifecycle
from logspark.schema import LOG_COLUMNS, PARTITION_COLUMNS
from logspark.sources import logs as store, lookups
from logspark.sources.commits import CommitLog
from logspark.sources.events import load_logs
from logspark.sources.states import RunStates

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return load_logs(spark, FOLDER)


@pytest.fixture(scope="module")
def table(spark, logs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("logs"))
    store.write_logs(logs, path, mode="overwrite")
    return path


def same(a, b, columns=("id", "ts", "tenant_id", "system_id", "message", "extra", "response_time")):
    take = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    return take(a) == take(b)


def test_table_round_trip_and_pruning(spark, logs, table):
    assert same(store.read_logs(spark, table), logs)
    one = store.read_logs(spark, table, "tenant_1", ["sys_3"], "2024-01-05", "2024-01-06")
    want = logs.filter("tenant_id = 'tenant_1' and system_id = 'sys_3' and log_date between '2024-01-05' and '2024-01-06'")
    assert same(one, want) and want.count() > 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "log_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_search_reaches_the_scan(spark, table):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    q = LogQuery(tenant_id="tenant_1", level="ERROR", start="2024-01-05 06:00:00", end="2024-01-07", min_response_time=10)
    df = search.search(store.read_logs(spark, table), q).select("id", "message")
    scan = df._jdf.queryExecution().executedPlan().toString().split("FileScan parquet", 1)[1]
    partitions, pushed = scan.split("PartitionFilters:")[1].split("PushedFilters:")
    assert "log_date" in partitions and "tenant_id" in partitions
    assert all(f in pushed for f in ("EqualTo(level,ERROR)", "GreaterThanOrEqual(ts", "GreaterThanOrEqual(response_time,10)"))
    assert "exception" not in pushed.split("ReadSchema:")[1]


def test_names_are_safe(spark):
    df = spark.createDataFrame([(" Acme_1/.. ",), (None,), ("***",), ("X" * 60,)], "v STRING")
    got = [r[0] for r in df.select(store.safe_name(F.col("v"), "default")).collect()]
    assert got == ["acme1", "default", "default", "x" * 50]


def test_ids_are_stored_as_they_are(spark, logs, tmp_path):
    odd = logs.limit(20).withColumn("tenant_id", F.when(F.col("id").cast("int") % 2 == 0, "Acme/EU =1"))
    store.write_logs(odd, str(tmp_path / "t"))
    sizes = {t: store.read_logs(spark, str(tmp_path / "t"), t).count() for t in ("Acme/EU =1", "default")}
    assert sum(sizes.values()) == 20 and all(sizes.values())


def test_long_exports_are_refused(logs, tmp_path):
    with pytest.raises(ValueError):
        store.export_days(logs, str(tmp_path / "d"), "2024-01-01", "2024-01-09")


def test_last_version_of_a_document_wins(spark):
    rows = [("a", "t", "s", 1, "old"), ("a", "t", "s", 2, "new"), (None, "t", "s", 1, "x"), (None, "t", "s", 5, "y")]
    df = spark.createDataFrame(rows, "id STRING, trace_id STRING, span_id STRING, n INT, message STRING")
    keyed = df.withColumn("doc", F.coalesce("id", F.concat_ws("-", "trace_id", "span_id")))
    got = sorted(r.message for r in latest_per_key(keyed, ["doc"], [F.col("n").desc()]).collect())
    assert got == ["new", "y"]


def test_json_export(spark, logs, tmp_path):
    store.export_json(logs, str(tmp_path / "e"), rows_per_file=100)
    files = list((tmp_path / "e").glob("part-*"))
    lines = [len(f.read_text().splitlines()) for f in files]
    assert sum(lines) == logs.count() and max(lines) <= 100
    first = json.loads(files[0].read_text().splitlines()[0])
    assert first["_id"] == first["id"] and first["_index"].startswith(f"{first['tenant_id']}-{first['system_id']}-2024.01.".replace("_", ""))


def test_archive_round_trip(spark, logs, tmp_path):
    path = str(tmp_path / "a")
    store.write_archive(logs, path)
    files = list(pathlib.Path(path).rglob("*.gz"))
    assert files and json.loads(gzip.open(files[0]).readline())["tenant_id"].startswith("tenant_")
    assert same(store.read_archive(spark, path), logs)
    day = store.read_archive(spark, path, "tenant_0", "sys_2", "2024-01-09")
    assert same(day, logs.filter("system_id = 'sys_2' and log_date = '2024-01-09'"))
    found = store.manifest_of_files(spark, path, "archive_")
    assert found.count() == logs.select(*PARTITION_COLUMNS).distinct().count()
    assert found.agg(F.sum("bytes")).first()[0] == sum(f.stat().st_size for f in files)


def test_trace_lookup_opens_only_its_own_partitions(spark, logs, tmp_path):
    path, lookup = str(tmp_path / "t"), str(tmp_path / "lookup")
    store.write_logs(logs, path)
    lookups.write_trace_lookup(logs, lookup)
    trace_id = logs.first().trace_id
    want = [r.id for r in search.trace(logs, trace_id).collect()]
    own = logs.filter(F.col("trace_id") == trace_id).select(*PARTITION_COLUMNS).distinct().collect()
    folders = {f"tenant_id={r.tenant_id}/system_id={r.system_id}/log_date={r.log_date}" for r in own}
    table, index = store.read_logs(spark, path), lookups.read_trace_lookup(spark, lookup)
    for file in pathlib.Path(path).rglob("*.parquet"):
        if str(file.parent.relative_to(path)) not in folders:
            file.write_bytes(b"whoever opens this fails")
    assert [r.id for r in lookups.trace(table, index, trace_id).collect()] == want and want
    assert lookups.trace(table, index, "nowhere").collect() == []
    with pytest.raises(Exception):
        search.trace(table, trace_id).collect()


def test_files_tell_that_they_lack_a_trace(spark, logs, tmp_path):
    """The bloom filter settles a trace that lies between the smallest and the largest of a file."""
    path = str(tmp_path / "t")
    store.write_logs(logs, path)
    traces = sorted(r.trace_id for r in logs.select("trace_id").distinct().collect())
    absent = traces[len(traces) // 2] + "x"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = store.read_logs(spark, path).filter(F.col("trace_id") == absent).select("id")
        assert df.collect() == []
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert scan.metrics().apply("numOutputRows").value() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_dictionary_search_equals_plain_search(spark, logs, tmp_path, monkeypatch):
    path = str(tmp_path / "words")
    half = F.col("id").cast("bigint") % 2 == 0
    lookups.write_dictionary(logs.filter(half), path)
    lookups.write_dictionary(logs.filter(~half), path)
    for q in (LogQuery(keyword="purchese uzer7 77", level="INFO"), LogQuery(keyword="zzzzzz"), LogQuery(keyword="mod_3 clicc", start="2024-01-05", end="2024-01-20"), LogQuery()):
        want = sorted(r.id for r in search.search(logs, q).collect())
        assert sorted(r.id for r in lookups.search(logs, path, q).collect()) == want
    monkeypatch.setattr(lookups, "MOST_NAMED", 1)
    assert sorted(r.id for r in lookups.search(logs, path, LogQuery(keyword="purchese uzer7 77")).collect()) == sorted(
        r.id for r in search.search(logs, LogQuery(keyword="purchese uzer7 77")).collect())


def test_sheet_export(spark, tmp_path, logs):
    long = logs.withColumn("message", F.repeat(F.lit("x"), 501))
    row = store.sheet(long).first()
    assert len(row) == 21 and row.message == "x" * 500 + "..."
    store.export_sheets(logs, str(tmp_path / "s"), rows_per_sheet=300)
    back = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(str(tmp_path / "s"))
    assert back.count() == logs.count()
    store.export_days(logs, str(tmp_path / "d"), "2023-12-30", "2024-01-02")
    assert sorted(p.name for p in (tmp_path / "d").glob("log_date=*")) == ["log_date=2024-01-01", "log_date=2024-01-02"]


def test_batch_export(spark, logs, tmp_path):
    rows = [("tenant_0", "sys_0", dt.date(2024, 1, 3)), ("tenant_1", "sys_1", dt.date(2024, 1, 4)), ("tenant_1", "nope", dt.date(2024, 1, 4))]
    tasks = spark.createDataFrame(rows, "tenant_id STRING, system_id STRING, log_date DATE")
    result = store.batch_export(logs, tasks, str(tmp_path / "b"))
    got = {r.system_id: (r.rows, r.succeeded) for r in result.collect()}
    want = {s: logs.filter((F.col("system_id") == s) & (F.col("log_date") == d)).count() for _, s, d in rows}
    assert got == {s: (n, n > 0) for s, n in want.items()}
    assert tuple(store.success_rate(result).first()) == (3, 2, 66.67)


def test_lifecycle(spark, logs, tmp_path):
    table, archive = str(tmp_path / "t"), str(tmp_path / "a")
    store.write_logs(logs, table)
    before = logs.count()
    assert {r.action for r in run_lifecycle(spark, table, archive, "2024-01-31").collect()} == {"ARCHIVE", "KEEP"}
    assert store.read_logs(spark, table).count() == before
    done = run_lifecycle(spark, table, archive, "2024-01-31", dry_run=False)
    assert done.filter("action = 'ARCHIVE' and not verified").count() == 0
    assert same(store.read_logs(spark, table), logs.filter("log_date > '2024-01-24'"))
    assert same(store.read_archive(spark, archive), logs.filter("log_date <= '2024-01-24'"))
    run_lifecycle(spark, table, archive, "2024-04-15", dry_run=False)
    assert same(store.read_archive(spark, archive), logs.filter("log_date >= '2024-01-16'"))


@pytest.mark.parametrize("step", ["note", "commit", "delete", "close"])
def test_killed_lifecycle_is_completed_by_the_next(spark, logs, tmp_path, monkeypatch, step):
    """A run dies before it notes, before it commits, half way through its deletes, or before it closes."""
    table, archive = str(tmp_path / "t"), str(tmp_path / "a")
    store.write_logs(logs, table)

    class Killed(Exception):
        pass

    def die(*_, **__):
        raise Killed

    real_add, real_complete = CommitLog.add, lifecycle.Journal.complete
    with monkeypatch.context() as patch:
        if step == "note":
            patch.setattr(lifecycle.Journal, "note", die)
        elif step == "commit":
            patch.setattr(CommitLog, "add", die)
        elif step == "close":
            patch.setattr(CommitLog, "add", lambda self, name, *a, **k: die() if name.endswith("-done") else real_add(self, name, *a, **k))
        else:
            def half(self):
                names = self.open_entries()
                if not names:
                    return real_complete(self)
                paths = spark.read.parquet(f"{self.path}/{names[0]}").orderBy("path").limit(20)
                assert paths.mapInPandas(lifecycle._delete_files, "path STRING, error STRING").filter("error is null").count() == 20
                die()

            patch.setattr(lifecycle.Journal, "complete", half)
        with pytest.raises(Killed):
            run_lifecycle(spark, table, archive, "2024-01-31", dry_run=False)
    # rows that arrive late for a day that was archived must survive the completion
    late = logs.filter("log_date = '2024-01-09'").withColumn("id", F.concat(F.lit("late"), "id"))
    store.write_logs(late, table)
    run_lifecycle(spark, table, archive, "2024-01-31", dry_run=False)
    book = lifecycle.Journal(spark, f"{archive}_journal")
    assert book.open_entries() == []
    hot, cold = store.read_logs(spark, table), store.read_archive(spark, archive)
    kept = lambda df: {r.id for r in df.select("id").collect()}
    assert kept(hot) | kept(cold) == kept(logs) | kept(late)
    assert kept(hot.filter("log_date > '2024-01-24'")) == kept(logs.filter("log_date > '2024-01-24'"))
    # what was noted goes; before that, a partition whose late rows are not archived stays whole
    allowed = kept(late) | (kept(logs.filter("log_date = '2024-01-09'")) if step in ("note", "commit") else set())
    assert kept(hot.filter("log_date <= '2024-01-24'")) <= allowed


def test_detection_job(spark, logs, tmp_path):
    out = run_detection(logs, rules_frame(spark), "2024-01-01", "2024-02-01", str(tmp_path / "h"), str(tmp_path / "al"))
    hits, fired = out["hits"].count(), out["alerts"].count()
    assert 0 < fired <= hits
    total = out["executions"].agg(F.sum("match_count"), F.sum("alert_count")).first()
    assert tuple(total) == (hits, fired)
    assert out["rules"].agg(F.sum("trigger_count")).first()[0] == hits
    held = out["alerts"].agg(F.sum("suppressed_count")).first()[0]
    assert held <= hits - fired


def test_runs_with_state_equal_one_long_run(spark, logs, tmp_path):
    """State goes from run to run; one of the runs is repeated, as after a failure."""
    rules, days = rules_frame(spark), [dt.datetime(2024, 1, 1) + dt.timedelta(days=d) for d in (0, 1, 2, 5, 9, 10, 20, 30)]
    logs.filter("system_id in ('sys_0', 'sys_1', 'sys_3')").drop("log_date").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    run_detection(rows, rules, days[0], days[-1], str(tmp_path / "h"), str(tmp_path / "a"))
    for k, (start, end) in enumerate(zip(days, days[1:])):
        for _ in range(2 if k == 3 else 1):
            run_detection(rows, rules, start, end, str(tmp_path / "hs" / f"d={k}"), str(tmp_path / "as" / f"d={k}"), str(tmp_path / "s"))
    for one, many, columns in (
        ("h", "hs", ["rule_id", "id", "hit_count", "actual_value"]),
        ("a", "as", ["id", "log_id", "silence_key", "suppressed_count", "first_occurrence", "last_occurrence", "alert_content"]),
    ):
        take = lambda path: sorted(tuple(map(str, r)) for r in spark.read.parquet(str(tmp_path / path)).select(*columns).collect())
        assert take(one) == take(many) and take(one)
    states = RunStates(spark, str(tmp_path / "s"))
    assert len(states.versions()) == 7
    states.forget(days[5])
    assert len(states.versions()) == 4 and set(states.before(days[5])) == {"counted", "runs", "silences"}
    assert states.before("2023-12-31") == {}


def test_log_columns_are_all_stored(spark, table):
    assert set(LOG_COLUMNS) | {"log_date"} == set(store.read_logs(spark, table).columns)


def test_manifest_and_retention_of_odd_names(spark, tmp_path):
    from logspark.schema import LOG_SCHEMA

    names = [("a:b c", "s/1"), ("p%q", "x+y"), ("k=v", "%25"), ("plain", "sys")]
    rows = [(t, s, f"2024-01-0{1 + i} 10:00:00") for i, (t, s) in enumerate(names)]
    given = spark.createDataFrame(rows, "tenant_id string, system_id string, at string")
    logs = given.select(*[
        F.col(f.name) if f.name in ("tenant_id", "system_id") else F.col("at").cast("timestamp").alias("ts") if f.name == "ts"
        else F.lit(None).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields
    ])
    table, archive = str(tmp_path / "table"), str(tmp_path / "archive")
    store.write_logs(logs, table)
    listed = {(r.tenant_id, r.system_id) for r in store.manifest_of_files(spark, table).collect()}
    assert listed == set(names)
    result = run_lifecycle(spark, table, archive, "2024-02-01 00:00:00", dry_run=False).collect()
    assert {(r.tenant_id, r.system_id) for r in result if r.verified} == set(names)
    assert {(r.tenant_id, r.system_id) for r in store.read_archive(spark, archive).collect()} == set(names)
    assert store.read_logs(spark, table).count() == 0


def test_manifest_keeps_partitions_without_a_date(spark, tmp_path):
    df = spark.createDataFrame([("t", "s", None), ("t", "s", "2024-01-01")], "tenant_id string, system_id string, d string")
    df = df.select("tenant_id", "system_id", F.col("d").cast("date").alias("log_date"), F.lit(1).alias("v"))
    df.write.partitionBy("tenant_id", "system_id", "log_date").parquet(str(tmp_path / "t"))
    dates = {str(r.log_date) for r in store.manifest_of_files(spark, str(tmp_path / "t")).collect()}
    assert dates == {"None", "2024-01-01"}
