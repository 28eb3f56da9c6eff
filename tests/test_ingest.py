import datetime as dt
import json

from pyspark.sql import functions as F

from logspark.operators import ingest

AS_OF = "2024-01-30 12:00:00"
NOW = dt.datetime(2024, 1, 30, 12)


def run(spark, *lines):
    rows = [(i, x if isinstance(x, (str, type(None))) else json.dumps(x)) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "n INT, value STRING")
    return ingest.ingest(df, AS_OF, keep=["n"]).orderBy("n").collect()


def test_validity(spark):
    rows = run(spark, None, "{}", "  { } ", '{"a":', "[1]", "null", {"zzz": 1}, {"message": "ok"})
    assert [r.is_valid for r in rows] == [False] * 6 + [True, True]
    assert rows[0].reject_reason and rows[6].reject_reason is None


def test_aliases_defaults_and_order(spark):
    a, b = run(
        spark,
        {"trace_id": " t ", "traceId": None, "stackTrace": "E: x", "client_ip": "1.2.3.4", "url": "/u", "statusCode": 503,
         "duration": "12", "responseTime": "n/a", "lineNumber": 7.9, "tags": ["a", 1], "tenantId": "T", "system_id": "S"},
        {"message": "m"},
    )
    assert (a.trace_id, a.ip, a.request_url, a.status_code) == ("t", "1.2.3.4", "/u", 503)
    assert (a.response_time, a.line_number, a.tags) == (12, 7, ["a", "1"])
    assert (a.tenant_id, a.system_id, a.exception) == ("T", "S", "E: x")
    assert (b.tenant_id, b.system_id, b.level, b.response_time, b.ts) == ("default", "unknown", "INFO", 0, NOW)


def test_timestamp_forms(spark):
    second = dt.datetime(2024, 1, 1)
    forms = {
        1704067200: second, 1704067200123: second.replace(microsecond=123000),
        "1704067200": second, "1704067200123": second.replace(microsecond=123000),
        "2024-01-01T00:00:00": second, "2024-01-01T00:00": second,
        "2024-01-01T08:00:00+08:00": second, "2024-01-01T01:00:00+01:00[Europe/Paris]": second,
        "2024-01-01 00:00:00": second, "2024-01-01 00:00:00.123": second.replace(microsecond=123000),
        "2024/01/01 00:00:00": second, "2024-01-01": NOW, "junk": NOW, 1.5: NOW, True: NOW, "99999999999999999": NOW,
        3000000000: dt.datetime(1970, 2, 4, 17, 20), "12": dt.datetime(1970, 1, 1, 0, 0, 0, 12000),
        "2024-13-01 00:00:00": NOW,
    }
    rows = run(spark, *[{"timestamp": f} for f in forms])
    assert [r.ts for r in rows] == list(forms.values())
    assert [r.ts_fallback for r in rows] == [v == NOW for v in forms.values()]


def test_secrets_and_masks(spark):
    (row,) = run(spark, {
        "extra": {"apiKey": "k", "Password": 1, "deep": {"token": "kept"}, "n": 2},
        "message": "call 13812345678", "params": "a@bc.de", "userName": "王五",
    })
    assert json.loads(row.extra) == {"apiKey": "***", "Password": "***", "deep": {"token": "kept"}, "n": 2}
    assert (row.message, row.user_name, row.request_params) == ("call 138****5678", "王**", "a@bc.de")


def test_context_stands_in_for_extra(spark):
    a, b, c = run(spark, {"context": {"k": 1}}, {"extra": [1, 2]}, {"extra": "text"})
    assert (a.extra, b.extra, c.extra) == ('{"k":1}', "[1,2]", '"text"')


def test_oversized_batches_are_refused_whole(spark):
    df = spark.range(250).select((F.col("id") / 120).cast("int").alias("batch_id"))
    left = {r.batch_id: r["count"] for r in ingest.accept_batches(df).groupBy("batch_id").count().collect()}
    assert left == {2: 10}


def test_report_and_errors(spark):
    rows = [("a", 0, True, None), ("a", 1, False, "bad"), ("b", 0, True, None)]
    df = spark.createDataFrame(rows, "batch_id STRING, row_index INT, is_valid BOOLEAN, reject_reason STRING")
    report = {r.batch_id: tuple(r)[1:] for r in ingest.ingest_report(df).collect()}
    assert report == {"a": (2, 1, 1), "b": (1, 1, 0)}
    assert [tuple(r) for r in ingest.ingest_errors(df).collect()] == [("a", 1, "bad")]


def test_enrich_is_stable(spark):
    df = spark.createDataFrame([(None, None, None, "m")], "id STRING, tenant_id STRING, ts TIMESTAMP, message STRING")
    a, b = ingest.enrich(df, "acme", AS_OF).first(), ingest.enrich(df, "acme", AS_OF).first()
    assert a == b and len(a.id) == 32 and a.tenant_id == "acme" and a.ts == NOW


def test_id_violations(spark):
    values = [("ok_1",), ("",), (None,), ("x" * 65,), ("a b",), ("my_Select",)]
    df = spark.createDataFrame(values, "tenant_id STRING")
    got = {r.value: r.problem for r in ingest.id_violations(df, "tenant_id", "tenant").collect()}
    assert got == {"": "empty", None: "empty", "x" * 65: "too long", "a b": "bad format", "my_Select": "forbidden word"}
