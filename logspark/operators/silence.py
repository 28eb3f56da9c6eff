"""Alert silencing: which hits fire, and which fall into the silence of an earlier one.

A hit that fires decides by itself which hit of its key fires next: the first one at or after its time plus the period,
or an earlier one that escalates over it. The hits that fire are thus a linked list through the hits of a key, and the
list is ranked without walking it:

1. hits are sorted by key and time into parts of bounded size, so that a hot key lies in many parts;
2. one row a part says where a key goes on from the part before; only there does anything have to be passed on;
3. such a part tells, for every state it can be entered in, in which state which later part is entered next;
4. doubling these links (a link, then two, four, ...) from the parts in which keys begin finds the states that really occur;
5. every part then marks its own hits, and what was held back is added up across the borders.

State of earlier runs (`carry`) enters as a first hit of each key that has fired already.
"""

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.levels import OTHER_PRIORITY, alert_priority
from ..functions.numbers import micros
from ..session import cut_lineage, send_code_of
from .spans import instant
from .windows import restart_keys

DEFAULT_PERIOD = 300
#: Rows of a part; no task holds much more of a key than this.
PART_ROWS = 100_000
FAR = 2**62

DIFFERENT = "hits of one silence key have different silence periods"

# Kinds of rows: a hit that fired in an earlier run, hits that run held back, a hit of this run, the rest of a run.
STATE, PENDING, HIT, REST = range(4)

_ORDER = ["silence_key", "is_hit", "us", "hit_id", "hit_no"]
_TO = "to_part INT, to_wake BIGINT, to_rank INT"
_SUMMARY = f"part INT, level INT, bound_us BIGINT, {_TO}"
_AT, _NEXT = ["part", "wake", "rank"], ["to_part", "to_wake", "to_rank"]
_SEGMENT = (
    "part INT, place BIGINT, silence_key STRING, kind INT, hit_id STRING, hit_no BIGINT, end_us BIGINT, rank INT, period_us BIGINT, "
    "held BIGINT, first_us BIGINT, last_us BIGINT, edge BOOLEAN"
)
STATE_DDL = "silence_key STRING, last_us BIGINT, last_rank INT, period_us BIGINT, held BIGINT, first_us BIGINT, final_us BIGINT"


def silence_key(default_scope: str = "RULE"):
    """Rule, tenant and system, plus the target or the user where the rule asks for it."""
    scope = F.upper(F.coalesce(F.nullif(F.col("silence_scope"), F.lit("")), F.lit(default_scope)))
    target = F.col("monitor_target")
    word = lambda c: F.coalesce(F.col(c), F.lit("null"))
    by_target = (
        F.when(target.startswith("userId:"), F.concat(F.lit("user:"), word("user_id")))
        .when(target.startswith("module:"), F.concat(F.lit("module:"), word("module")))
        .when(target.startswith("ip:"), F.concat(F.lit("ip:"), word("ip")))
        .when(target.startswith("operation:"), F.concat(F.lit("operation:"), word("operation")))
        .when(target.contains("/"), F.concat(F.lit("url:"), word("request_url")))
        .otherwise(F.concat(F.lit("target:"), word("monitor_target")))
    )
    by_user = F.concat(F.lit("user:"), F.coalesce("user_id", F.lit("unknown")))
    part = F.when(scope == "TARGET", by_target).when(scope == "USER", by_user)
    return F.concat_ws(":", F.col("rule_id").cast("string"), "tenant_id", "system_id", part)


def with_silence_key(hits: DataFrame) -> DataFrame:
    return hits.withColumn("silence_key", silence_key())


def hit_key(hits: DataFrame):
    """A name for a hit whose log has no id: a hash of all columns, nulls included."""
    plain = [F.col(f"`{c}`") for c in hits.columns]
    return F.sha2(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}), 256)


def _narrow(hits: DataFrame, state: DataFrame | None) -> DataFrame:
    period = F.when(F.col("silence_period") > 0, F.col("silence_period")).otherwise(DEFAULT_PERIOD).cast("bigint")
    us = micros(F.col("ts"))
    number = F.col("hit_no") if "hit_no" in hits.columns else F.lit(-1)
    rows = hits.select(
        "silence_key", F.lit(True).alias("is_hit"), us.alias("us"), F.col("id").alias("hit_id"), number.cast("bigint").alias("hit_no"),
        F.lit(HIT).alias("kind"), alert_priority(F.col("alert_level")).alias("rank"),
        F.coalesce("allow_escalation", F.lit(False)).alias("escalates"), (period * 1_000_000).alias("period_us"),
        F.lit(1).cast("bigint").alias("weight"), us.alias("first_us"), us.alias("last_us"),
    )
    if state is None:
        return rows
    before = state.select(
        "silence_key", F.lit(False).alias("is_hit"), F.col("last_us").alias("us"), F.lit(None).cast("string").alias("hit_id"),
        F.explode(F.when(F.col("held") > 0, F.array(F.lit(STATE), F.lit(PENDING))).otherwise(F.array(F.lit(STATE)))).alias("kind"),
        "last_rank", "period_us", "held", "first_us", "final_us",
    )
    pending = F.col("kind") == PENDING
    return rows.unionByName(before.select(
        "silence_key", "is_hit", "us", "hit_id", F.col("kind").cast("bigint").alias("hit_no"), "kind",
        F.when(pending, OTHER_PRIORITY).otherwise(F.col("last_rank")).alias("rank"), F.lit(False).alias("escalates"), "period_us",
        F.when(pending, F.col("held")).otherwise(0).cast("bigint").alias("weight"),
        F.coalesce("first_us", F.lit(0)).alias("first_us"), F.coalesce("final_us", F.lit(0)).alias("last_us"),
    ))


class _Runs:
    """The rows of a part as arrays, cut into runs of one key. Times are laid out on one axis on which runs never meet."""

    def __init__(self, rows: pd.DataFrame):
        self.key = rows["silence_key"].to_numpy()
        self.rank, self.kind = rows["rank"].to_numpy(), rows["kind"].to_numpy()
        self.escalates = rows["escalates"].to_numpy(dtype=bool)
        n = len(rows)
        opens = np.ones(n, bool)
        opens[1:] = self.key[1:] != self.key[:-1]
        self.start = np.flatnonzero(opens)
        self.group = np.cumsum(opens) - 1
        self.end = np.append(self.start[1:], n)
        given = rows["period_us"].to_numpy()
        self.period = given[self.end - 1][self.group]  # hits come last, and know the rule as it is now
        if (given != self.period)[self.kind == HIT].any():
            raise ValueError(DIFFERENT)
        self.us = rows["us"].to_numpy().copy()
        for k in np.flatnonzero(self.kind[self.start] == STATE):
            mine = slice(self.start[k], self.end[k])
            self.us[mine] = np.maximum(self.us[mine], self.us[self.start[k]])
        self.inside = self.us - self.us[self.start][self.group]
        room = self.inside[self.end - 1] + self.period[self.start] + 1
        if float(room.sum()) >= FAR:
            raise OverflowError("the times of one part lie too far apart")
        self.base = np.append(0, np.cumsum(room)[:-1])
        self.axis = self.base[self.group] + self.inside
        self.follow = self._follow()

    def _follow(self) -> np.ndarray:
        """For each row, if it fires: the next row of its run to fire, or the run's end."""
        limit = self.end[self.group]
        follow = np.minimum(np.searchsorted(self.axis, self.axis + self.period), limit)
        for level in np.unique(self.rank):
            urgent = np.flatnonzero(self.escalates & (self.rank < level))
            if len(urgent):
                mine = np.flatnonzero(self.rank == level)
                sooner = np.append(urgent, len(self.us))[np.searchsorted(urgent, mine, side="right")]
                follow[mine] = np.minimum(follow[mine], sooner)
        return np.minimum(follow, limit)

    def first_urgent(self, run: int, level: int) -> int:
        """The first row of the run that escalates over the level; the run's end if there is none."""
        at = slice(self.start[run], self.end[run])
        found = np.flatnonzero(self.escalates[at] & (self.rank[at] < level))
        return int(self.start[run] + found[0]) if len(found) else int(self.end[run])

    def entered(self, run: int, wake: int, rank: int) -> int:
        """The first row of the run to fire after a hit of that rank whose silence ends at ``wake``."""
        at = slice(self.start[run], self.end[run])
        calm = int(self.start[run] + np.searchsorted(self.us[at], wake))
        return min(calm, self.first_urgent(run, rank))

    def exits(self, at: np.ndarray) -> np.ndarray:
        """Last row to fire in the run, for each row that may fire first."""
        limit = self.end[self.group[at]]
        while True:
            step = self.follow[at]
            moving = step < limit
            if not moving.any():
                return at
            at = np.where(moving, step, at)


def _whole(frames: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """All rows of a part, whose number the sort bounds."""
    held = [f for f in frames if len(f)]
    return pd.concat(held, ignore_index=True) if held else None


# --- borders ------------------------------------------------------------------------------------------------------

_BORDER = (
    "part INT, first_key STRING, last_key STRING, start_us BIGINT, end_us BIGINT, least_rank INT, first_period BIGINT, last_period BIGINT"
)


def _border(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for a part: its first and last key, and of the first key's run its times and its most urgent escalation."""
    rows = _whole(frames)
    if rows is None:
        return
    runs = _Runs(rows)
    first = slice(0, int(runs.end[0]))
    urgent = runs.rank[first][runs.escalates[first]]
    yield pd.DataFrame({
        "part": rows["part"].iloc[:1], "first_key": runs.key[:1], "last_key": runs.key[-1:], "start_us": runs.us[:1],
        "end_us": runs.us[first][-1:], "least_rank": np.array([urgent.min() if len(urgent) else FAR >> 32], np.int32),
        "first_period": runs.period[:1], "last_period": runs.period[-1:],
    })


@dataclass
class _Borders:
    """For each part whose first key came over its border: place and times along its chain. Arrays hold one entry a part."""

    place: dict[int, int]  # part -> index into the arrays below
    begins: dict[int, int]  # part in which a chain begins -> index of the first part after it
    last: np.ndarray  # index behind the last part of the chain
    part: np.ndarray
    start_us: np.ndarray
    end_us: np.ndarray
    least_rank: np.ndarray
    before_us: np.ndarray  # last time of the chain before the part

    @classmethod
    def of(cls, rows: list) -> "_Borders":
        rows = sorted(rows, key=lambda r: r.part)
        came = [k > 0 and r.first_key == rows[k - 1].last_key for k, r in enumerate(rows)]
        over = [k for k, c in enumerate(came) if c]
        begins, last, first = {}, np.zeros(len(over), np.int64), 0
        for i, k in enumerate(over):
            before = rows[k - 1]
            if rows[k].first_period != before.last_period:
                raise ValueError(DIFFERENT)
            if not (came[k - 1] and before.first_key == before.last_key):
                first = begins[before.part] = i
            last[first : i + 1] = i + 1
        pick = lambda values: np.array(values, np.int64)
        parts = [rows[k] for k in over]
        # the part before may begin with another key; the chain then began there at the start of this part or earlier
        before_us = [rows[k - 1].end_us if rows[k - 1].first_key == rows[k].first_key else rows[k].start_us for k in over]
        return cls(
            {r.part: i for i, r in enumerate(parts)}, begins, last, pick([r.part for r in parts]), pick([r.start_us for r in parts]),
            pick([r.end_us for r in parts]), pick([r.least_rank for r in parts]), pick(before_us),
        )

    def landing(self, first: int, stop: int, wake: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the parts [first, stop) holds the next hit to fire, and the state it is entered in; part -1 for none.

        States that a part cannot tell apart become one.
        """
        to = first + np.searchsorted(self.end_us[first:stop], wake)
        for level in np.unique(rank):
            urgent = np.flatnonzero(self.least_rank[first:stop] < level)
            if len(urgent):
                to = np.where(rank == level, np.minimum(to, first + urgent[0]), to)
        none = to >= stop
        if none.all():
            return np.full(len(to), -1), np.zeros(len(to), np.int64), np.zeros(len(to), np.int64)
        at = np.where(none, first, to)
        by_time = (wake <= self.start_us[at]) | (self.least_rank[at] >= rank)
        wake = np.maximum(wake, self.start_us[at])
        return np.where(none, -1, self.part[at]), np.where(none, 0, wake), np.where(none | by_time, 0, rank)


# --- links between parts ------------------------------------------------------------------------------------------


def _summaries(borders):
    """Per part of a chain: the state in which the next part is entered, for every way to enter this one.

    Rows of level -1: the key begins here. Level 0: entered by time, at the first bound at or after the end of the
    silence. Other levels: entered by escalation over that level, if its bound lies before the end of the silence.
    """

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(frames)
        if rows is None:
            return
        b: _Borders = _Borders(**borders.value)
        part, runs, out = int(rows["part"].iloc[0]), _Runs(rows), []

        def add(first: int, stop: int, levels, bounds, at: np.ndarray) -> None:
            left = runs.exits(at)
            to = b.landing(first, stop, runs.us[left] + runs.period[left], runs.rank[left])
            frame = pd.DataFrame(dict(zip(_NEXT, to)))
            frame["part"], frame["level"], frame["bound_us"] = part, levels, bounds
            out.append(frame)

        if part in b.begins:
            i = b.begins[part]
            add(i, b.last[i], -1, 0, runs.start[-1:])
        if part in b.place:
            i, end = b.place[part], int(runs.end[0])
            within = int(np.searchsorted(runs.us[:end], b.before_us[i] + runs.period[0], side="right"))
            ways = np.arange(min(within + 1, end))
            add(i + 1, b.last[i], 0, runs.us[ways], ways)
            # neighbours that lead to the same state are one way in, up to the last of them
            calm = out[-1]
            same = (calm[_NEXT].to_numpy()[1:] == calm[_NEXT].to_numpy()[:-1]).all(axis=1)
            out[-1] = calm[np.append(~same, True)]
            for level in np.unique(np.append(runs.rank[:end], [2, 3, OTHER_PRIORITY])):
                urgent = runs.first_urgent(0, int(level))
                if urgent < end:
                    add(i + 1, b.last[i], int(level), int(runs.us[urgent]), np.array([urgent]))
        for frame in out:
            yield frame[["part", "level", "bound_us", *_NEXT]]

    return summarise


def _resolve(summary: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    """The state that follows each of the states of one part."""
    calm = summary[summary["level"] == 0].sort_values("bound_us", kind="stable")
    wake, rank = states["wake"].to_numpy(), states["rank"].to_numpy()
    at = np.searchsorted(calm["bound_us"].to_numpy(), wake)
    nothing = np.array([[-1, 0, 0]])
    table = np.concatenate([calm[_NEXT].to_numpy(), nothing])
    to = table[at]
    for level, bound, *way in summary[summary["level"] > 0][["level", "bound_us", *_NEXT]].itertuples(index=False):
        to[(rank == level) & (bound < wake)] = way
    out = states[_AT].reset_index(drop=True)
    out[_NEXT] = to
    return out


def _links(summaries: DataFrame, part_rows: int) -> DataFrame:
    """Links from each state that occurs in a summary to the state after it.

    States of a part that many ways lead to are dealt to several tasks, each with the summary of the part.
    """
    states = summaries.filter("to_part >= 0").select(
        F.col("to_part").alias("part"), F.col("to_wake").alias("wake"), F.col("to_rank").alias("rank")
    ).distinct()
    states = cut_lineage(states)
    lots = cut_lineage(states.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("lots")))
    lot = F.pmod(F.xxhash64("wake", "rank"), F.col("lots")).cast("int").alias("lot")
    dealt = states.join(lots, "part").select(*_AT, lot)
    each = F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")
    every = summaries.filter("level >= 0").join(lots.select(F.col("part").alias("of"), "lots"), F.col("part") == F.col("of"))
    every = every.select(F.col("of").alias("part"), "level", "bound_us", *_NEXT, each)
    links = every.groupBy("part", "lot").cogroup(dealt.groupBy("part", "lot")).applyInPandas(
        _resolve, f"part INT, wake BIGINT, rank INT, {_TO}"
    )
    return cut_lineage(links.filter("to_part >= 0"))


def _reached(roots: DataFrame, links: DataFrame) -> list:
    """The states on the ways from the roots, by doubling the links. Each part is entered once at most."""
    reached = roots
    while True:
        ends = reached.join(links, _AT).select(*[F.col(t).alias(a) for t, a in zip(_NEXT, _AT)])
        reached = cut_lineage(reached.unionByName(ends).distinct())
        second = links.select(*[F.col(a).alias(t) for a, t in zip(_AT, _NEXT)], *[F.col(t).alias(f"_{t}") for t in _NEXT])
        links = cut_lineage(links.join(second, _NEXT).select(*_AT, *[F.col(f"_{t}").alias(t) for t in _NEXT]))
        if links.isEmpty():
            return reached.collect()  # one row a part


# --- marks --------------------------------------------------------------------------------------------------------


def _mark(entries, came, goes_on):
    """A row for each row that fires, with what was held back before it, and one for the rest of a run."""

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(frames)
        if rows is None:
            return
        part, runs, n = int(rows["part"].iloc[0]), _Runs(rows), len(rows)
        at = runs.start.copy()
        if part in came:
            at[0] = runs.entered(0, *entries[part]) if part in entries else runs.end[0]
        fired = np.zeros(n, bool)
        limit = runs.end
        while True:
            live = at < limit
            if not live.any():
                break
            at, limit = at[live], limit[live]
            fired[at] = True
            at = runs.follow[at]
        begins = np.zeros(n, bool)
        begins[runs.start] = True
        begins[1:] |= fired[:-1]
        first = np.flatnonzero(begins)
        last = np.append(first[1:], n) - 1
        weight = np.where(fired, 0, rows["weight"].to_numpy())
        counts = weight > 0
        edge = np.zeros(len(first), bool)
        edge[0] = part in came
        edge[-1] |= part in goes_on and not fired[-1]
        yield pd.DataFrame({
            "part": np.full(len(first), part, np.int32), "place": first, "silence_key": runs.key[last],
            "kind": np.where(fired[last], runs.kind[last], REST).astype(np.int32),
            "hit_id": pd.Series(np.where(fired[last], rows["hit_id"].to_numpy()[last], None), dtype=object),
            "hit_no": rows["hit_no"].to_numpy()[last], "end_us": runs.us[last], "rank": runs.rank[last].astype(np.int32),
            "period_us": runs.period[last], "held": np.add.reduceat(weight, first),
            "first_us": np.minimum.reduceat(np.where(counts, rows["first_us"].to_numpy(), FAR), first),
            "last_us": np.maximum.reduceat(np.where(counts, rows["last_us"].to_numpy(), -FAR), first), "edge": edge,
        })

    return mark


def _joined_edges(marks: DataFrame) -> DataFrame:
    """What was held back before a border goes to the next hit that fires behind it. A few rows a part."""
    before = W.partitionBy("silence_key").orderBy("part", "place").rowsBetween(W.unboundedPreceding, -1)
    fires = (F.col("kind") != REST).cast("int")
    grouped = marks.withColumn("no", F.coalesce(F.sum(fires).over(before), F.lit(0)))
    of_hit = [F.max(F.when(F.col("kind") != REST, F.col(c))).alias(c) for c in ("hit_id", "hit_no", "end_us", "rank")]
    return grouped.groupBy("silence_key", "no").agg(
        F.min("kind").alias("kind"), *of_hit, F.max("period_us").alias("period_us"), F.sum("held").alias("held"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
    ).drop("no")


def sorted_parts(rows: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, int]:
    """The stored narrow rows in parts of about ``part_rows`` rows, sorted by key and time across all of them."""
    parts = max(1, math.ceil(rows.count() / part_rows))
    if parts == 1:
        return rows.coalesce(1).sortWithinPartitions(*_ORDER).withColumn("part", F.lit(0)), 1
    placed = rows.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    return cut_lineage(placed.withColumn("part", F.spark_partition_id())), parts


def _segments(hits: DataFrame, state: DataFrame | None, part_rows: int) -> DataFrame:
    """Rows of ``_SEGMENT`` without part, place and edge, those of earlier runs included. Reads the hits twice."""
    rows, parts = sorted_parts(_narrow(hits, state), part_rows)
    entries, came, goes_on = {}, frozenset(), frozenset()
    if parts > 1:
        borders = _Borders.of(rows.mapInPandas(_border, _BORDER).collect())  # one row a part
        came = frozenset(borders.place)
        goes_on = frozenset(borders.begins) | {p for p, i in borders.place.items() if i + 1 < borders.last[i]}
    if came:
        sent = hits.sparkSession.sparkContext.broadcast(vars(borders))
        chained = rows.filter(F.col("part").isin(*(came | goes_on)))
        summaries = cut_lineage(chained.mapInPandas(_summaries(sent), _SUMMARY))
        roots = summaries.filter("level = -1 and to_part >= 0").select(*[F.col(t).alias(a) for t, a in zip(_NEXT, _AT)])
        entries = {r.part: (r.wake, r["rank"]) for r in _reached(roots, _links(summaries, part_rows))}
    marks = rows.mapInPandas(_mark(entries, came, goes_on), _SEGMENT)
    columns = ["silence_key", "kind", "hit_id", "hit_no", "end_us", "rank", "period_us", "held", "first_us", "last_us"]
    if not came:
        return marks.select(*columns)
    marks = cut_lineage(marks)
    return marks.filter("not edge").select(*columns).unionByName(_joined_edges(marks.filter("edge")).select(*columns))


def _instant(column: str):
    return F.when(F.col("held") > 0, F.timestamp_micros(column))


def _readable(parts: DataFrame) -> DataFrame:
    is_fired = F.col("kind") == HIT
    return parts.filter((F.col("kind") == HIT) | ((F.col("kind") == REST) & (F.col("held") > 0))).select(
        "silence_key", is_fired.alias("fired"), F.when(is_fired, F.col("hit_id")).alias("hit_id"),
        F.when(is_fired, F.col("hit_no")).alias("hit_no"), F.when(is_fired, F.timestamp_micros("end_us")).alias("fired_at"),
        F.col("held").alias("suppressed_count"), _instant("first_us").alias("first_occurrence"), _instant("last_us").alias("last_occurrence"),
    )


def segments(keyed_hits: DataFrame, state: DataFrame | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per fired hit with the hits held back before it, and one for those after the last.

    Only narrow columns are shuffled, and no task receives more of a key than a part. The silence period is a setting of
    the rule; different ones within a key are refused. ``hit_no`` tells hits apart, if they have it.
    """
    needed = ["silence_key", "ts", "id", "alert_level", "allow_escalation", "silence_period", "hit_no"]
    hits = cut_lineage(keyed_hits.select(*[c for c in needed if c in keyed_hits.columns]))
    return _readable(_segments(hits, state, part_rows))


def numbered(hits: DataFrame) -> DataFrame:
    """The hits, stored, with a number of their own, whether or not their logs carry ids."""
    return cut_lineage(hits).withColumn("hit_no", F.monotonically_increasing_id())


def _fired(hits: DataFrame, parts: DataFrame) -> DataFrame:
    marks = _readable(parts.filter(F.col("kind") == HIT))
    return hits.join(marks.select("hit_no", "suppressed_count", "first_occurrence", "last_occurrence"), "hit_no")


def fired(keyed_hits: DataFrame, state: DataFrame | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Fired hits with all their columns, their number, and what was suppressed before them."""
    hits = numbered(keyed_hits)
    return _fired(hits, _segments(hits, state, part_rows))


def fired_and_state(keyed_hits: DataFrame, state: DataFrame | None = None, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """Fired hits as by ``fired``, and the state to hand to the next run; both from one stored pass."""
    hits = numbered(keyed_hits)
    parts = cut_lineage(_segments(hits, state, part_rows))
    return _fired(hits, parts), carry(parts)


def carry(parts: DataFrame) -> DataFrame:
    """Per key, as rows of ``STATE_DDL``: the last hit that fired, and what was held back since."""
    rest = F.col("kind") == REST
    # of hits that fired at one instant, each escalated over the one before
    at = F.when(~rest, F.struct("end_us", -F.col("rank")))
    return parts.groupBy("silence_key").agg(
        F.max_by("end_us", at).alias("last_us"), F.max_by("rank", at).alias("last_rank"), F.max_by("period_us", at).alias("period_us"),
        F.coalesce(F.sum(F.when(rest, F.col("held"))), F.lit(0)).cast("bigint").alias("held"),
        F.min(F.when(rest, F.col("first_us"))).alias("first_us"), F.max(F.when(rest, F.col("last_us"))).alias("final_us"),
    )


def still_needed(state: DataFrame, as_of) -> DataFrame:
    """State that can still matter: a silence that has not ended, or hits not reported yet."""
    return state.filter((F.col("held") > 0) | (F.col("last_us") + F.col("period_us") > micros(instant(as_of))))


def silence_stats(parts: DataFrame, as_of, expire_hours: int = 2) -> DataFrame:
    """Active keys, keys with suppressed hits not yet reported, and how many those are."""
    per_key = parts.groupBy("silence_key").agg(
        F.max("fired_at").alias("last_alert"),
        F.coalesce(F.sum(F.when(~F.col("fired"), F.col("suppressed_count"))), F.lit(0)).alias("open"),
    )
    live = per_key.filter(
        F.col("last_alert") >= F.lit(str(as_of)).cast("timestamp") - F.make_dt_interval(hours=F.lit(expire_hours))
    )
    return live.agg(
        F.count(F.lit(1)).alias("active_silences"),
        F.count_if(F.col("open") > 0).alias("pending_aggregations"),
        F.coalesce(F.sum("open"), F.lit(0)).alias("total_suppressed"),
    )


def apply_resets(keyed_hits: DataFrame, resets: DataFrame) -> DataFrame:
    """A reset starts a new silence state for every key of the rule."""
    return restart_keys(keyed_hits, resets, "silence_key")


send_code_of(sys.modules[__name__])
