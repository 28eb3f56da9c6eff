"""Windows, admission and silencing against brute force, with ties and a hot key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logspark.operators import admission, silence, windows

START = dt.datetime(2024, 1, 1)


def rows_of(seed, n, span, keys=3, hot=0.6, grain=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rnd.random() < hot else rnd.randrange(keys)
        second = rnd.randrange(0, span, grain)
        out.append((f"r{i:05d}", START + dt.timedelta(seconds=second), f"k{key}", rnd.random() < 0.7))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id STRING, ts TIMESTAMP, k STRING, bad BOOLEAN")


@pytest.mark.parametrize("seed,span,window,grain", [(1, 600, 60, 1), (2, 5000, 64, 7), (3, 300, 7200, 1), (4, 90000, 3600, 60)])
def test_trailing_count(spark, parts, seed, span, window, grain):
    rows = rows_of(seed, 500, span, grain=grain)
    got = {r.id: r.trailing_count for r in windows.trailing_count(frame(spark, rows), ["k"], window).collect()}
    want = {
        i: sum(1 for j, u, k2, _ in rows if k2 == k and t - dt.timedelta(seconds=window) <= u <= t and (u, j) <= (t, i))
        for i, t, k, _ in rows
    }
    assert got == want


@pytest.fixture(params=[True, False], ids=["merged parts", "many parts"])
def parts(spark, request):
    """Adaptive execution merges the parts of small tables; without it, keys lie in many."""
    spark.conf.set("spark.sql.adaptive.enabled", str(request.param).lower())
    spark.conf.set("spark.sql.shuffle.partitions", "4" if request.param else "13")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed,keys", [(1, 3), (2, 1), (3, 40)])
def test_run_length(spark, parts, seed, keys):
    rows = rows_of(seed, 500, 900, keys=keys)
    out = windows.run_length(frame(spark, rows), ["k"], F.col("bad"))
    got = {r.id: r.run_length for r in out.collect()}
    want, runs = {}, {}
    for i, t, k, bad in sorted(rows, key=lambda r: (r[1], r[0])):
        runs[k] = runs.get(k, 0) + 1 if bad else 0
        want[i] = runs[k]
    assert got == want


def test_a_hot_key_lies_in_many_parts(spark, parts):
    """Runs longer than a part, and a single reset far behind."""
    rows = [(f"r{i:05d}", START + dt.timedelta(seconds=i), "hot", i != 777) for i in range(4000)]
    got = {r.id: r.run_length for r in windows.run_length(frame(spark, rows), ["k"], F.col("bad")).collect()}
    assert got == {f"r{i:05d}": i + 1 if i < 777 else i - 777 for i in range(4000)}
    plan = windows.run_length(frame(spark, rows), ["k"], F.col("bad"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_eight_failures_fire_from_the_sixth(spark):
    rows = [(f"r{i}", START + dt.timedelta(seconds=i), "k", True) for i in range(8)]
    out = windows.run_length(frame(spark, rows), ["k"], F.col("bad")).filter("run_length > 5")
    assert sorted(r.id for r in out.collect()) == ["r5", "r6", "r7"]


def test_top_n_with_a_hot_group(spark):
    rows = rows_of(5, 400, 50)
    got = windows.top_n_per_group(frame(spark, rows), ["k"], [F.col("ts").desc(), F.col("id").asc()], 7, "id")
    want = set()
    for key in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == key), key=lambda r: (-(r[1] - START).total_seconds(), r[0]))
        want |= {r[0] for r in mine[:7]}
    assert {r.id for r in got.collect()} == want


@pytest.mark.parametrize("limit", [0, 1, 37, 80, 1000])
def test_global_admission_ranks_only_full_minutes(spark, limit):
    rows = rows_of(6, 400, 240, grain=5) + [(f"same{i}", START, "k0", True) for i in range(60)]
    got = {r.id for r in admission.pass_global(frame(spark, rows), limit).collect()}
    want = set()
    for minute in range(4):
        mine = sorted((r for r in rows if (r[1] - START).total_seconds() // 60 == minute), key=lambda r: (r[1], r[0]))
        want |= {r[0] for r in mine[:limit]}
    assert got == want


def test_admission_levels_use_quota_in_sequence(spark):
    rows = [(f"a{i}", START + dt.timedelta(seconds=i), "t0", "s0") for i in range(6)]
    rows += [(f"b{i}", START + dt.timedelta(seconds=10 + i), "t1", "s1") for i in range(6)]
    df = spark.createDataFrame(rows, "id STRING, ts TIMESTAMP, tenant_id STRING, system_id STRING")
    got = sorted(r.id for r in admission.admit(df, 9, 4, 2).collect())
    assert got == ["a0", "a1", "b0", "b1"]  # b got three of nine, of which two pass its system
    left = {r.tenant_id: r.remaining for r in admission.tenant_remaining(df, 9, 4).collect()}
    assert left == {"t0": 0, "t1": 1}


RANKS = {"CRITICAL": 1, "WARNING": 2, "INFO": 3, "OTHER": 999}


def hit_frame(spark, rows):
    ddl = "id STRING, ts TIMESTAMP, silence_key STRING, alert_level STRING, allow_escalation BOOLEAN, silence_period INT"
    return spark.createDataFrame(rows, ddl)


def brute_silence(rows):
    state, held, out = {}, {}, {}
    for i, t, k, level, escalates, period in sorted(rows, key=lambda r: (r[1], r[0])):
        last = state.get(k)
        if last is None or t >= last[0] + dt.timedelta(seconds=period) or (escalates and RANKS[level] < last[1]):
            state[k] = (t, RANKS[level])
            past = held.pop(k, [])
            out[k, i] = (len(past), past[0] if past else None, past[-1] if past else None)
        else:
            held.setdefault(k, []).append(t)
    return out, held


def test_silence_boundaries(spark):
    rows = [(f"h{s:03d}", START + dt.timedelta(seconds=s), "k", "INFO", False, None) for s in (0, 100, 299, 300, 301)]
    got = {(r.hit_id): r.suppressed_count for r in silence.segments(hit_frame(spark, rows)).collect()}
    assert got == {"h000": 0, "h300": 2, None: 1}


def test_escalation_fires_inside_silence(spark):
    rows = [("a", START, "k", "INFO", True, 300), ("b", START + dt.timedelta(seconds=10), "k", "CRITICAL", True, 300),
            ("c", START + dt.timedelta(seconds=20), "k", "WARNING", True, 300)]
    got = [r.id for r in silence.fired(hit_frame(spark, rows)).orderBy("id").collect()]
    assert got == ["a", "b"]


@pytest.mark.parametrize("seed,period,span,escalate,part_rows", [
    (1, 300, 200_000, False, 1000), (2, 300, 200_000, True, 200), (3, 60, 300_000, True, 40), (4, 7200, 2_000_000, True, 20),
    (5, 1, 30_000, False, 100), (6, 86_400, 300_000, True, 30), (7, 86_400, 900_000, False, 50),
])
def test_silence_over_many_parts(spark, seed, period, span, escalate, part_rows):
    rows = silence_rows(seed, period, span, escalate)
    want, held = brute_silence(rows)
    parts = silence.segments(hit_frame(spark, rows), part_rows=part_rows).collect()
    got = {
        (r.silence_key, r.hit_id): (r.suppressed_count, r.first_occurrence, r.last_occurrence) for r in parts if r.fired
    }
    assert got == want
    rest = {r.silence_key: r.suppressed_count for r in parts if not r.fired}
    assert rest == {k: len(v) for k, v in held.items()}


def test_no_part_holds_more_than_its_share_of_a_key(spark):
    rows = [(f"h{i:05d}", START + dt.timedelta(seconds=i), "hot", "INFO", False, 86_400) for i in range(3000)]
    narrow = silence._narrow(hit_frame(spark, rows), None)
    placed, parts = silence.sorted_parts(narrow, 200)
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert parts == 15 and len(sizes) == 15 and max(sizes) < 3 * 200


def test_equal_times_spread_over_parts(spark):
    """A burst within one microsecond: one hit fires, the copies count."""
    rows = [(None, START, "k", "INFO", False, 60)] * 500 + [("z", START + dt.timedelta(seconds=60), "k", "INFO", False, 60)]
    got = silence.fired(hit_frame(spark, rows), part_rows=50).collect()
    assert sorted((str(r.id), r.suppressed_count) for r in got) == [("None", 0), ("z", 499)]


def test_different_periods_of_a_key_are_refused(spark):
    rows = [(f"h{i}", START + dt.timedelta(seconds=i), "k", "INFO", False, 60 + i // 50) for i in range(100)]
    for part_rows in (1000, 20):
        with pytest.raises(Exception, match="different silence periods"):
            silence.segments(hit_frame(spark, rows), part_rows=part_rows).collect()


@pytest.mark.parametrize("seed,period,escalate,runs", [(1, 300, True, 30), (2, 86_400, True, 7), (3, 7200, False, 12)])
def test_silence_runs_hand_over_their_state(spark, seed, period, escalate, runs):
    rows = silence_rows(seed, period, 600_000, escalate)
    want, held = brute_silence(rows)
    state, got = None, {}
    for k in range(runs):
        inside = [r for r in rows if 600_000 * k <= (r[1] - START).total_seconds() * runs < 600_000 * (k + 1)]
        out, state = silence.fired_and_state(hit_frame(spark, inside), state, part_rows=100)
        got.update({(r.silence_key, r.id): (r.suppressed_count, r.first_occurrence, r.last_occurrence) for r in out.collect()})
        state = spark.createDataFrame(state.collect(), silence.STATE_DDL)
    assert got == {k: v for k, v in want.items()}
    assert {r.silence_key: r.held for r in state.collect() if r.held} == {k: len(v) for k, v in held.items()}


def silence_rows(seed, period, span, escalate):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(40)}"
        # dense stretches around a few moments, so that chains cross slot borders
        second = int(rnd.gauss(rnd.choice([0.2, 0.5, 0.8]) * span, span / 40)) if rnd.random() < 0.5 else rnd.randrange(span)
        level = rnd.choice(["CRITICAL", "WARNING", "INFO", "INFO", "OTHER"])
        rows.append((f"h{i:04d}", START + dt.timedelta(seconds=max(0, second)), key, level, escalate, period))
    return rows
