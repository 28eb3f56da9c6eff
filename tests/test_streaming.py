import datetime as dt
import json
import os
import pathlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logspark.operators import ingest, rules as rule_ops, silence, stats
from logspark.plans.alert_queries import hits_frame, rules_frame
from logspark.plans.ingest_queries import raw_lines
from logspark.schema import JSON_OPTIONS, RULE_SCHEMA
from logspark.sources import logs as store
from logspark.sources.events import load_logs
from logspark.sources.stream_table import StreamTable
from logspark.streaming import detect, ingest as live

FOLDER = "/root/testdata/sf0.001"
AS_OF = "2024-01-30 12:00:00"
ONCE = {"availableNow": True}


def in_files(df, path, parts, order="ts"):
    """Rows as JSON files in time order; the file source goes by modification time."""
    os.makedirs(path)
    line = F.to_json(F.struct(*df.columns), JSON_OPTIONS).alias("line")
    rows = [r.line for r in df.orderBy(order, "id").select(line).collect()]
    size = -(-len(rows) // parts)
    for i in range(parts):
        file = pathlib.Path(path) / f"part-{i:03d}.json"
        file.write_text("\n".join(rows[i * size:(i + 1) * size]))
        os.utime(file, (1_700_000_000 + i * 10,) * 2)
    return path


def stream_of(spark, df, path, parts=4):
    in_files(df, path, parts)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).options(**JSON_OPTIONS).json(path)


def results(stream, name, tmp_path):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(**ONCE).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def test_ingest_stream_equals_batch(spark, tmp_path):
    lines = raw_lines(spark, FOLDER)
    source = tmp_path / "in"
    os.makedirs(source)
    texts = [r.value for r in lines.orderBy("n").collect()]
    for i in range(4):
        (source / f"{i}.txt").write_text("\n".join(texts[i * 250:(i + 1) * 250]))
    table, dead, feed = (str(tmp_path / n) for n in ("table", "dead", "feed"))
    seen = {}

    def start():
        query = live.ingest_stream(
            live.read_files(spark, str(source), 2), table, dead, str(tmp_path / "cp"), feed, AS_OF,
            on_metrics=lambda batch, counts: seen.update({batch: counts}), trigger=ONCE,
        )
        query.awaitTermination(300)
        assert query.exception() is None

    start()
    want = ingest.ingest(lines, AS_OF)
    columns = ["id", "tenant_id", "system_id", "level", "ts", "message", "extra", "response_time"]
    take = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert take(store.read_logs(spark, table)) == take(want.filter("is_valid"))
    assert take(StreamTable(spark, feed).read()) == take(want.filter("is_valid"))
    assert StreamTable(spark, dead).read().count() == want.filter("not is_valid").count()
    assert sum(c["total"] for c in seen.values()) == 1000
    assert sum(c["failed"] for c in seen.values()) == want.filter("not is_valid").count()
    start()  # nothing new: a restart adds nothing
    assert store.read_logs(spark, table).count() == want.filter("is_valid").count()


def batch_of(spark, k, rows=3):
    days = F.expr(f"date_add(DATE '2024-01-01', {k // 50})")
    return spark.range(rows).select((F.col("id") + 1000 * k).alias("n"), F.lit("007").alias("tenant_id"), days.alias("log_date"))


def files_of(path):
    return len(list(pathlib.Path(path).rglob("*.parquet")))


def test_many_batches_leave_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    table = StreamTable(spark, path, ["tenant_id", "log_date"], fan=5)
    for k in range(90):
        assert table.append(batch_of(spark, k), k)
        table.tidy()
    assert len(table.chunks()) <= 5 * 3
    assert table.vacuum(0) > 90 and files_of(path) < 5 * 3 * 3 and len(table.log.names()) <= 5 + 2
    back = StreamTable(spark, path).read("n BIGINT, tenant_id STRING, log_date DATE")
    assert sorted(r.n for r in back.collect()) == sorted(i + 1000 * k for k in range(90) for i in range(3))
    assert {r.tenant_id for r in back.collect()} == {"007"} and back.filter("log_date = '2024-01-02'").count() == 120
    assert not table.append(batch_of(spark, 3), 3)  # a replay
    assert table.compact(everything=True) and len(table.chunks()) == 1 and back.count() == 270
    table.vacuum(0)
    assert StreamTable(spark, path).read().count() == 270


def test_replayed_and_failed_batches(spark, tmp_path, monkeypatch):
    table = StreamTable(spark, str(tmp_path / "t"), fan=3)
    for k in range(2):
        table.append(batch_of(spark, k), k)
    # a batch that fails between write and commit leaves an orphan, which no reader sees
    real = table.log.add
    monkeypatch.setattr(table.log, "add", lambda *a, **b: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError):
        table.append(batch_of(spark, 2), 2)
    with pytest.raises(OSError):
        table.compact(everything=True)
    monkeypatch.setattr(table.log, "add", real)
    again = StreamTable(spark, str(tmp_path / "t"), fan=3)
    assert again.read().count() == 6 and again.append(batch_of(spark, 2), 2) and not again.append(batch_of(spark, 2), 2)
    before = again.read()
    again.tidy()
    assert again.vacuum(3600) == 2 and before.count() == 9  # merged chunks stay for running readers, orphans go
    assert again.vacuum(0) == 3 and again.read().count() == 9
    # of two writers of one name the first succeeds
    assert again.log.add("x1", {"a": 1}) and not again.log.add("x1", {"a": 2}) and again.log.read("x1") == {"a": 1}
    assert again.log.add("x1", {"a": 3}, replace=True) and again.log.read("x1") == {"a": 3}


def test_retries_back_off_and_give_up():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise OSError("down")

    assert isinstance(live.keep_trying(fail, 6, sleep=waits.append), OSError)
    assert len(calls) == 6 and waits == [1.0, 2.0, 4.0, 8.0, 10.0]
    calls.clear()
    assert live.keep_trying(lambda: fail() if len(calls) < 2 else None, sleep=waits.append) is None
    assert len(calls) == 2


def test_failed_writes_go_to_the_dead_letters(spark, tmp_path, monkeypatch):
    real = StreamTable.append

    def broken(self, df, batch_id, placed=False):
        if self.path.endswith("table"):
            raise OSError("down")
        return real(self, df, batch_id, placed)

    monkeypatch.setattr(StreamTable, "append", broken)
    monkeypatch.setattr(live.keep_trying, "__defaults__", (2, 0.0, lambda s: None))
    source = tmp_path / "in"
    os.makedirs(source)
    (source / "a.txt").write_text(json.dumps({"message": "m"}) + "\nnope")
    query = live.ingest_stream(
        live.read_files(spark, str(source)), str(tmp_path / "table"), str(tmp_path / "dead"), str(tmp_path / "cp"), trigger=ONCE
    )
    query.awaitTermination(300)
    got = sorted(r.reject_reason for r in StreamTable(spark, str(tmp_path / "dead")).read().collect())
    assert got == ["invalid JSON or empty log", "write failed: OSError"]


def test_stateless_stream_rereads_rules(spark, tmp_path):
    logs = load_logs(spark, FOLDER).drop("log_date")
    versions = [rules_frame(spark).filter("id = 1"), rules_frame(spark).filter("id in (1, 2)")]
    calls, out = [], str(tmp_path / "hits")

    def load():
        calls.append(1)
        return versions[min(len(calls), 2) - 1]

    query = detect.stateless_stream(
        stream_of(spark, logs, str(tmp_path / "in"), 2), load,
        lambda hits, batch: hits.write.mode("append").parquet(out), str(tmp_path / "cp"), ONCE,
    )
    query.awaitTermination(300)
    assert query.exception() is None and len(calls) == 2
    got = {r.rule_id: r["count"] for r in spark.read.parquet(out).groupBy("rule_id").count().collect()}
    rows = logs.orderBy("ts", "id").limit(500)
    late = logs.join(rows.select("id"), "id", "left_anti")
    want = rule_ops.stateless_hits(logs, versions[0]).count()
    assert got[1] == want
    assert got.get(2, 0) == rule_ops.stateless_hits(late, rules_frame(spark).filter("id = 2")).count()


@pytest.mark.parametrize("kind", ["batch", "continuous"])
def test_stateful_rules_equal_batch(spark, tmp_path, kind):
    """Windows of days need a watermark of days; state then outlives the gaps of the sample."""
    logs = load_logs(spark, FOLDER).drop("log_date")
    rules = rules_frame(spark)
    live_hits = {"batch": detect.batch_operation_stream, "continuous": detect.continuous_request_stream}[kind]
    batch_hits = {"batch": rule_ops.batch_operation_hits, "continuous": rule_ops.continuous_request_hits}[kind]
    stream = live_hits(stream_of(spark, logs, str(tmp_path / "in")), rules, delay="60 days")
    take = lambda df: sorted(map(tuple, df.select("rule_id", "id", "hit_count", "message").collect()))
    got = take(results(stream, f"hits_{kind}", tmp_path))
    assert got == take(batch_hits(logs, rules)) and got


class _Value:
    def __init__(self):
        self.value = None

    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Map(dict):
    """State of a key in memory, which counts what is read."""

    read = 0

    def getValue(self, key):
        self.read += len(self[key][0])
        return self[key]

    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class _Handle:
    getValueState = lambda self, *_: _Value()
    getMapState = lambda self, *_: _Map()
    registerTimer = deleteTimer = lambda self, *_: None


class _Watermark:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def counted_in_batches(batches, window_us, late=0):
    counter, out = detect.TrailingCount(), []
    counter.init(_Handle())
    for batch in batches:
        frame = pd.DataFrame({"us": batch, "tie": [""] * len(batch), "window_us": window_us, "payload": [""] * len(batch)})
        seen = max([us for b in batches[: len(out)] for us in b], default=0) - late
        [result] = counter.handleInputRows(("k",), iter([frame]), _Watermark(max(0, seen)))
        out.append(result["hit_count"].tolist())
    return counter, out


@pytest.mark.parametrize("seed,window,late", [(1, 1_000_000, 0), (2, 500, 0), (3, 100_000, 90_000), (4, 7, 3)])
def test_ring_counts_equal_plain_counts(seed, window, late):
    rnd = random.Random(seed)
    now, seen, batches, want = 10**9, [], [], []
    for _ in range(60):
        batch = []
        for _ in range(rnd.randrange(1, 12)):
            now += rnd.choice([0, 1, 3, 1000, 50_000])
            batch.append(now - (rnd.randrange(late) if late and rnd.random() < 0.3 else 0))
        counts = []
        for us in sorted(batch):
            seen.append(us)
            counts.append(sum(us - window <= u <= us for u in seen))
        batches.append(batch)
        want.append(counts)
    assert counted_in_batches(batches, window, late * 20)[1] == want


def test_work_of_a_batch_does_not_grow_with_the_window():
    read = {}
    for per_batch in (10, 10_000):
        batches = [[10**12 + 1000 * i for i in range(k * per_batch, (k + 1) * per_batch)] for k in range(40)]
        window = 1000 * per_batch * 20
        counter, counts = counted_in_batches(batches, window)
        assert counts[-1][-1] == per_batch * 20 + 1
        before = counter.times.read
        counter.handleInputRows(("k",), iter([pd.DataFrame({"us": [batches[-1][-1] + 1000], "tie": "", "window_us": window, "payload": ""})]), None).__next__()
        read[per_batch] = (counter.times.read - before) / 8
        assert len(counter.times) < 3 * detect.TrailingCount.slots
    # one more row reads the times of the slots on the edges, not the window's 200,000
    assert read[10_000] <= 2 * 10_000 * 20 / detect.TrailingCount.slots + 2


@pytest.mark.parametrize("kind", ["batch", "continuous"])
def test_edited_rules_take_effect_without_a_restart(spark, tmp_path, kind):
    """Rules come as a stream of changes: an edit, a new rule and a disabled one, while the query runs."""
    logs = load_logs(spark, FOLDER).drop("log_date")
    at = lambda day: F.lit(f"2023-01-0{day} 00:00:00").cast("timestamp")
    first = rules_frame(spark).filter("id in (20, 21, 30, 32)").withColumn("update_time", at(1))
    edit = rules_frame(spark).filter("id in (20, 21, 22, 30, 31, 32)").withColumn("update_time", at(2)).withColumns(
        {"condition_value": F.expr("CASE id WHEN 20 THEN '1:86400' WHEN 30 THEN '1' ELSE condition_value END"),
         "status": F.expr("CASE WHEN id IN (21, 32) THEN 0 ELSE status END")})
    late = first.filter("id in (21, 32)")  # an older version, delivered late, revives nothing
    source = str(tmp_path / "rules")
    os.makedirs(source)
    for k, df in enumerate((first, edit, late)):
        file = pathlib.Path(source) / f"{k}.json"
        file.write_text("\n".join(r.j for r in df.select(F.to_json(F.struct("*"), JSON_OPTIONS).alias("j")).collect()))
        os.utime(file, (1_700_000_000 + k,) * 2)
    changes = spark.readStream.schema(RULE_SCHEMA).options(**JSON_OPTIONS).option("maxFilesPerTrigger", 1).json(source)
    live_hits = {"batch": detect.batch_operation_stream, "continuous": detect.continuous_request_stream}[kind]
    batch_hits = {"batch": rule_ops.batch_operation_hits, "continuous": rule_ops.continuous_request_hits}[kind]
    stream = live_hits(stream_of(spark, logs, str(tmp_path / "in"), 4), changes, delay="60 days")
    take = lambda *dfs: sorted(tuple(r) for df in dfs for r in df.select("rule_id", "id", "hit_count", "message").collect())
    got = take(results(stream, f"edited_{kind}", tmp_path))
    # the first of four files meets the first rules, the others the edited ones; an edit starts a rule's counts anew
    ids = [r.id for r in logs.orderBy("ts", "id").select("id").limit(250).collect()]
    old = logs.filter(F.col("id").isin(*ids))
    new = logs.filter(~F.col("id").isin(*ids))
    want = take(batch_hits(old, first), batch_hits(new, edit))
    assert got == want and {r[0] for r in got} >= ({20, 22} if kind == "batch" else {30})


def test_silence_stream_equals_batch(spark, tmp_path):
    hits = hits_frame(spark, FOLDER).drop("log_date")
    stream = silence_input = stream_of(spark, hits, str(tmp_path / "in"))
    out = results(detect.silence_stream(silence_input, delay="60 days"), "fired", tmp_path)
    columns = ["silence_key", "id", "suppressed_count", "first_occurrence", "last_occurrence"]
    take = lambda df: sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())
    assert stream.isStreaming
    assert take(out) == take(silence.fired(silence.with_silence_key(hits)))


def test_idle_state_expires(spark, tmp_path):
    """A key that stays idle while event time goes on for an hour starts anew."""
    rows = [(0, "a", "k"), (1, "b", "k"), (15_000, "c", "other"), (15_001, "d", "other"), (20_000, "e", "k")]
    df = spark.createDataFrame(rows, "s BIGINT, id STRING, k STRING").select(
        "id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), F.lit(True).alias("bad"), "k"
    )
    stream = stream_of(spark, df, str(tmp_path / "in"), 5)
    keyed = detect._keyed(stream, "k", "1 second", extends=F.col("bad"))
    out = results(detect._stateful(stream, keyed, detect.FailureRun(), detect._COUNTED), "idle", tmp_path)
    assert {r.id: r.hit_count for r in out.collect()} == {"a": 1, "b": 2, "c": 1, "d": 2, "e": 1}


def test_windowed_counts_equal_batch(spark, tmp_path):
    logs = load_logs(spark, FOLDER).drop("log_date")
    stream = live.counts_stream(stream_of(spark, logs, str(tmp_path / "in")), "1 hour", "10 minutes")
    take = lambda df: {tuple(r) for r in df.collect()}
    got, want = take(results(stream, "counts", tmp_path)), take(stats.counts_per_window(logs, "1 hour"))
    assert got <= want
    last = max(r[0] for r in want)
    # only windows that the last watermark has not closed may be missing
    assert all(r[0] >= last - dt.timedelta(hours=1) for r in want - got) and got


def test_replayed_rows_are_dropped(spark, tmp_path):
    logs = load_logs(spark, FOLDER).drop("log_date").limit(50)
    twice = logs.unionByName(logs)
    out = results(live.drop_replayed(stream_of(spark, twice, str(tmp_path / "in"), 2), "10 days"), "unique", tmp_path)
    assert out.count() == 50
