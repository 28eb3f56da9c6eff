"""Rules and silencing on streams. State is kept per key by event time and expires when idle.

Rows are processed in time order inside a micro-batch; input in time order therefore gives
exactly the hits and alerts of the batch operators.
"""

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.levels import alert_priority
from ..functions.numbers import micros
from ..operators import rules as rule_ops, silence
from ..schema import JSON_OPTIONS
from ..session import send_code_of

IDLE_SECONDS = 3600


def stateless_stream(logs: DataFrame, load_rules: Callable[[], DataFrame], write: Callable[[DataFrame, int], None],
                     checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Stateless hits of each micro-batch; the rules are read anew for every one of them."""

    def process(batch: DataFrame, batch_id: int) -> None:
        hits = rule_ops.stateless_hits(batch, load_rules()).select(*rule_ops.HIT_COLUMNS)
        write(hits, batch_id)

    return (
        logs.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All rows of a key in the micro-batch, whose size the trigger bounds."""
    return pd.concat(list(rows), ignore_index=True).sort_values(["us", "tie"], kind="stable")


def _frame(columns: dict, texts: tuple[str, ...]) -> pd.DataFrame:
    return pd.DataFrame(
        {name: pd.Series(values, dtype=object if name in texts else "int64") for name, values in columns.items()}
    )


class _Expiring(StatefulProcessor):
    """Forget a key that has been idle for a while of event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wake = handle.getValueState("wake", "ms BIGINT")
        self.open(handle)

    def touch(self, us: int, idle_seconds: int = IDLE_SECONDS) -> None:
        when = us // 1000 + idle_seconds * 1000
        if self.wake.exists():
            old = self.wake.get()[0]
            if when <= old:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(when)
        self.wake.update((when,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.wake.clear()
        self.forget()
        return iter([])

    def close(self) -> None:
        pass


class TrailingCount(_Expiring):
    """Rows of the key inside the window that ends at each row.

    The window is cut into slots. A ring holds how many rows each slot has, and in how many pieces their times are
    stored; a micro-batch adds a piece to the slots it has rows in, and reads the times of the slots that lie on an edge
    of its rows' windows. All slots between count by the ring, so the work does not grow with the rows in the window.
    Slots go when no row that the watermark lets through can reach them.
    """

    slots = 1024

    def open(self, handle):
        self.ring = handle.getValueState("ring", "newest BIGINT, slots BINARY, counts BINARY, pieces BINARY")
        self.times = handle.getMapState("times", "slot BIGINT, piece INT", "us BINARY")

    def forget(self):
        self.ring.clear()
        self.times.clear()

    def _slot(self, slot: int, pieces: int) -> np.ndarray:
        parts = [np.frombuffer(self.times.getValue((slot, k))[0], np.int64) for k in range(pieces)]
        return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

    def handleInputRows(self, key, rows, timerValues):
        frame = _in_order(rows)
        us, width = frame["us"].to_numpy(np.int64), int(frame["window_us"].iloc[0])
        step = max(1, width // self.slots)
        newest, ring = -(2**62), [np.zeros(0, np.int64)] * 3
        if self.ring.exists():
            newest, *ring = self.ring.get()
            ring = [np.frombuffer(x, np.int64) for x in ring]
        slots, counts, pieces = ring
        before = np.concatenate([[0], np.cumsum(counts)])
        known: dict[int, np.ndarray] = {}

        def stored_up_to(x: np.ndarray) -> np.ndarray:
            """How many stored rows are not later than each of the times."""
            at = np.searchsorted(slots, x // step)
            out = before[at]
            inside = at < len(slots)
            inside[inside] = slots[at[inside]] == x[inside] // step
            for k in np.unique(at[inside & (x < newest)]).tolist():
                if k not in known:
                    known[k] = self._slot(int(slots[k]), int(pieces[k]))
                mine = inside & (at == k)
                out[mine] += np.searchsorted(known[k], x[mine], side="right")
            return np.where(x >= newest, before[-1], out)

        own = np.arange(1, len(us) + 1) - np.searchsorted(us, us - width)
        hits = stored_up_to(us) - stored_up_to(us - width - 1) + own
        newest = max(newest, int(us[-1]))
        reached = newest if timerValues is None else min(newest, timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(us, step, (reached - width) // step, newest, slots, counts, pieces)
        self.touch(newest, max(IDLE_SECONDS, width // 1_000_000))
        yield _frame({"payload": frame["payload"].tolist(), "hit_count": hits.tolist()}, ("payload",))

    def _keep(self, us, step, low, newest, slots, counts, pieces) -> None:
        """Store the rows, and drop the slots below the lowest that can still be reached."""
        ring = {s: [c, p] for s, c, p in zip(slots.tolist(), counts.tolist(), pieces.tolist())}
        for s in [s for s in ring if s < low]:
            for piece in range(ring.pop(s)[1]):
                self.times.removeKey((s, piece))
        slot = us // step
        for s in np.unique(slot[slot >= low]).tolist():
            mine = us[slot == s]
            entry = ring.setdefault(s, [0, 0])
            self.times.updateValue((s, entry[1]), (mine.tobytes(),))
            entry[0] += len(mine)
            entry[1] += 1
        kept = sorted(ring)
        columns = kept, [ring[s][0] for s in kept], [ring[s][1] for s in kept]
        self.ring.update((newest, *(np.array(c, np.int64).tobytes() for c in columns)))


class FailureRun(_Expiring):
    """Length of the run that ends at each row."""

    def open(self, handle):
        self.length = handle.getValueState("length", "n BIGINT")

    def forget(self):
        self.length.clear()

    def handleInputRows(self, key, rows, timerValues):
        frame = _in_order(rows)
        n = self.length.get()[0] if self.length.exists() else 0
        counts = []
        for extends in frame["extends"].tolist():
            n = n + 1 if extends else 0
            counts.append(n)
        self.length.update((n,))
        self.touch(int(frame["us"].iloc[-1]))
        yield _frame({"payload": frame["payload"].tolist(), "hit_count": counts}, ("payload",))


class Silence(_Expiring):
    """Hits that fire, each with the hits held back since the one before."""

    def open(self, handle):
        self.state = handle.getValueState(
            "silence", "last_us BIGINT, last_rank BIGINT, held BIGINT, first_us BIGINT, final_us BIGINT"
        )

    def forget(self):
        self.state.clear()

    def handleInputRows(self, key, rows, timerValues):
        frame = _in_order(rows)
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        names = ["us", "rank", "escalates", "period_us", "payload"]
        for us, rank, escalates, period, payload in zip(*(frame[c].tolist() for c in names)):
            if state is None or us >= state[0] + period or (escalates and rank < state[1]):
                held, first, final = state[2:] if state else (0, 0, 0)
                out.append((payload, held, first, final))
                state = (us, rank, 0, 0, 0)
            else:
                state = (*state[:2], state[2] + 1, state[3] or us, us)
        self.state.update(tuple(int(v) for v in state))
        idle = max(IDLE_SECONDS * 2, int(frame["period_us"].max()) // 1_000_000)
        self.touch(int(frame["us"].iloc[-1]), idle)
        columns = [list(c) for c in zip(*out)] if out else [[], [], [], []]
        yield _frame(dict(zip(("payload", "held", "first_us", "last_us"), columns)), ("payload",))


def _keyed(rows: DataFrame, key: str, delay: str | None, **extra) -> DataFrame:
    """Narrow rows for a state operator: the whole row travels as one JSON text. No delay: the rows have a watermark."""
    kept = [F.col(c) for c in rows.columns if not c.startswith("_")]
    return (rows.withWatermark("ts", delay) if delay else rows).select(
        "ts", F.col(key).alias("key"), micros(F.col("ts")).alias("us"), F.col("id").alias("tie"),
        F.to_json(F.struct(*kept), JSON_OPTIONS).alias("payload"), *[c.alias(n) for n, c in extra.items()],
    )


def _unpack(out: DataFrame, rows: DataFrame) -> DataFrame:
    fields = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if not f.name.startswith("_")
    )
    return out.withColumn("r", F.from_json("payload", fields, JSON_OPTIONS)).select("r.*", *[c for c in out.columns if c != "payload"])


def _stateful(rows: DataFrame, keyed: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    out = keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return _unpack(out, rows)


_COUNTED = "payload STRING, hit_count BIGINT"


def _versioned(rows: DataFrame) -> DataFrame:
    """An edited rule gets new state keys; those of its older version age out."""
    return rule_ops.by_version(rows).withColumn("signs", F.col("_signs"))


def batch_operation_stream(logs: DataFrame, rules: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Hits of a stream; ``rules`` is a table, or a stream of rule changes (see ``matched_stream``)."""
    if rules.isStreaming:
        return _batch_operations(rule_ops.as_batch_operations(matched_stream(logs, rules, ("BATCH_OPERATION",), delay)), None)
    return _batch_operations(rule_ops.batch_operation_rows(logs, rules), delay)


def _batch_operations(rows: DataFrame, delay: str | None) -> DataFrame:
    flat = _versioned(rows)
    keyed = _keyed(flat, "state_key", delay, window_us=F.col("window_seconds").cast("bigint") * 1_000_000)
    return _hits(_stateful(flat, keyed, TrailingCount(), _COUNTED))


def continuous_request_stream(logs: DataFrame, rules: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Hits of a stream; ``rules`` is a table, or a stream of rule changes (see ``matched_stream``)."""
    if rules.isStreaming:
        return _continuous_requests(rule_ops.as_continuous_requests(matched_stream(logs, rules, ("CONTINUOUS_REQUEST",), delay)), None)
    return _continuous_requests(rule_ops.continuous_request_rows(logs, rules), delay)


def _continuous_requests(rows: DataFrame, delay: str | None) -> DataFrame:
    flat = _versioned(rows)
    keyed = _keyed(flat, "state_key", delay, extends=F.col("extends_run"))
    return _hits(_stateful(flat, keyed, FailureRun(), _COUNTED).filter("extends_run"))


# --- rules as a stream ---

#: Tasks among which the logs of one system are dealt when they meet its rules.
LANES = 16


class CurrentRules(StatefulProcessor):
    """Each log row with the rules of its system as they are in its micro-batch. Changes come before logs; the newest
    version of a rule stays, and a rule that is disabled goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rules = handle.getMapState("rules", "rule_id BIGINT", "version BIGINT, rule STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        change = frame["rule_id"].to_numpy() >= 0
        for rule_id, us, enabled, rule in frame[change][["rule_id", "us", "enabled", "payload"]].sort_values("us", kind="stable").itertuples(index=False):
            at = (int(rule_id),)
            if self.rules.containsKey(at) and self.rules.getValue(at)[0] > us:
                continue
            # a disabled rule leaves its version behind, so that an older change that comes late does not revive it
            self.rules.updateValue(at, (int(us), rule if enabled else ""))
        logs = frame[~change]
        if len(logs):
            current = [value[1] for _, value in self.rules.iterator() if value[1]]
            listed = "[" + ",".join(current) + "]"
            yield pd.DataFrame({"ts": logs["ts"].to_numpy(), "payload": logs["payload"].tolist(), "rules": [listed] * len(logs)})

    def close(self) -> None:
        pass


def matched_stream(logs: DataFrame, changes: DataFrame, types: tuple[str, ...], delay: str = "10 minutes") -> DataFrame:
    """Logs of a stream with the rules whose target they meet, where rules are a stream of changes as well.

    ``changes`` has the columns of rules; every row is a new version of a rule (by ``update_time``). Changes become
    control rows of the operator that the logs pass, one for each lane of their system, so an edited, new or disabled
    rule takes effect with the micro-batch it arrives in and no query restarts. Rows come with a watermark.
    """
    lane = lambda c: F.pmod(c, F.lit(LANES)).cast("int")
    never = F.lit(-1).cast("bigint")
    asked = logs.withWatermark("ts", delay).select(
        "ts", "tenant_id", "system_id", lane(F.xxhash64("id", "ts", "message")).alias("lane"), micros(F.col("ts")).alias("us"),
        never.alias("rule_id"), F.lit(True).alias("enabled"), F.to_json(F.struct(*logs.columns), JSON_OPTIONS).alias("payload"),
    )
    at = F.coalesce("update_time", "create_time", F.timestamp_seconds(F.lit(0)))
    # the watermark is that of the logs: a change may be old, and must not be late
    control = changes.filter(F.col("rule_type").isin(*types)).select(
        F.current_timestamp().alias("ts"), "tenant_id", "system_id", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"),
        micros(at).alias("us"), F.col("id").alias("rule_id"), (F.coalesce("status", F.lit(0)) == 1).alias("enabled"),
        F.to_json(F.struct(*changes.columns), JSON_OPTIONS).alias("payload"),
    )
    met = asked.unionByName(control).groupBy("tenant_id", "system_id", "lane").transformWithStateInPandas(
        statefulProcessor=CurrentRules(), outputStructType="ts TIMESTAMP, payload STRING, rules STRING", outputMode="Append",
        timeMode="EventTime", eventTimeColumnName="ts",
    )
    kinds = lambda schema: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rule = "rule." + ", rule.".join(rule_ops.RULE_FIELDS)
    rows = (
        met.withColumn("log", F.from_json("payload", kinds(logs.schema), JSON_OPTIONS))
        .withColumn("rule", F.explode(F.from_json("rules", f"array<struct<{_colons(changes.schema)}>>", JSON_OPTIONS)))
        .select("ts", *[f"log.{c}" for c in logs.columns if c != "ts"], F.col("rule.id").alias("rule_id"), *rule.split(", "),
                F.col("rule.update_time").alias("rule_version"))
    )
    return rule_ops.worked_out(rows).filter(rule_ops.target_matches())


def _colons(schema) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema.fields)


def _hits(counted: DataFrame) -> DataFrame:
    fires = rule_ops.number_holds("hit_count", "threshold")
    return (
        counted.withColumn("_signs", F.col("signs")).filter(fires)
        .withColumn("actual_value", F.col("hit_count").cast("string"))
        .select(*rule_ops.HIT_COLUMNS)
    )


def silence_stream(hits: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Fired hits of a stream of hits, with what was suppressed before each."""
    rows = silence.with_silence_key(hits)
    period = F.when(F.col("silence_period") > 0, F.col("silence_period")).otherwise(silence.DEFAULT_PERIOD)
    keyed = _keyed(
        rows, "silence_key", delay,
        rank=alert_priority(F.col("alert_level")).cast("bigint"),
        escalates=F.coalesce("allow_escalation", F.lit(False)),
        period_us=period.cast("bigint") * 1_000_000,
    )
    out = _stateful(rows, keyed, Silence(), "payload STRING, held BIGINT, first_us BIGINT, last_us BIGINT")
    instant = lambda c: F.when(F.col("held") > 0, F.timestamp_micros(F.col(c)))
    return out.withColumns(
        {
            "suppressed_count": F.col("held"), "first_occurrence": instant("first_us"),
            "last_occurrence": instant("last_us"),
        }
    ).drop("held", "first_us", "last_us")


send_code_of(sys.modules[__name__])
