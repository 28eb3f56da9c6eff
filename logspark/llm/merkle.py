"""A Merkle manifest of a dataset: digests, roots and membership proofs by descent through a content-addressed DAG.

A row's leaf is the digest of its fields. The leaves of a group ascend by id; every run of two consecutive nodes (the
last run may have one) becomes the digest of the run, until one node, the group's subroot, is left. The subroots in the
order of their groups give the root the same way.

The tree is kept as records digest -> children, in segments of HEIGHT levels that are addressed by the digest of their
top. A leaf is requested by its rank: the descent starts at the root, takes at each level the child that the next
binary digit of the rank names, and collects the children it does not take. Requests that share the upper part of their
way share that descent, so a segment is descended once for each way out of it, and at the bottom once a leaf. What is
collected runs from the root to the leaf; the proof is the reversed segments, one behind the other. Children are read
by digest and their digest is computed again, so a damaged record is found.

Ranks come from one sort by range and the row counts of its parts, so a group may hold any share of the rows. No task
takes more than one segment of 2 ** HEIGHT nodes at a time, and nothing that grows with the table comes to the driver.

Results of odd rows: null fields count as "-". Null ids come first in their group; rows of equal group and id are
ordered by their leaf, so only equal rows are interchangeable. A null group is a group, the first one. A single leaf is
its own subroot, a single subroot the root; an empty table gives no rows. Repeated rows are leaves of their own.
Extra columns are not read unless they are named as fields.
"""

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logspark.llm.frames import exact, light, stored

#: Levels of a segment; a segment has up to 2 ** HEIGHT nodes at its lower end.
HEIGHT = 9
_WIDE = 32


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def parent(run: bytes) -> bytes:
    """Digest of a run of digests, which enter as hex text."""
    return digest(run.hex().encode())


def field(column: Column) -> Column:
    """Byte count, colon and value of a field; a dash for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """Digest of the fields of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)).cast("binary"), 256))


# --- ranks --------------------------------------------------------------------------------------------------------


def ranked(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """The rows, stored, with ``rank`` (from 0, by the order within the tree) and ``n`` (rows of the tree)."""
    placed = rows.repartitionByRange(F.col(tree), *order).sortWithinPartitions(F.col(tree), *order)
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(
        F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = W.partitionBy("_tree").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        "_tree", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(W.partitionBy("_tree")).alias("n"),
    )
    # as many rows as the sort has parts, plus one for each further tree of a part
    joined = placed.join(light(stored(runs)), (F.col(tree) == F.col("_tree")) & (part == F.col("_part")))
    rank = F.col("_before") + F.col("_at") - F.col("_first")
    return joined.withColumn("rank", rank).drop("_at", "_tree", "_part", "_first", "_before", "_rows")


# --- building -----------------------------------------------------------------------------------------------------


def segment(nodes: list[bytes], levels: int | None) -> tuple[bytes, bytes]:
    """Top of a segment and its records: the runs of children, level by level from below.

    Without a number of levels the segment ends where one node is left.
    """
    runs: list[bytes] = []
    height = 0
    while (levels is None and len(nodes) > 1) or (levels is not None and height < levels):
        level = [b"".join(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        runs += level
        nodes = [parent(run) for run in level]
        height += 1
    return nodes[0], b"".join(len(run).to_bytes(1, "big") + run for run in runs)


def children_of(records: bytes) -> dict[bytes, bytes]:
    """The records as a table digest -> children; digests are computed from the children."""
    out, at = {}, 0
    while at < len(records):
        size = records[at]
        run = records[at + 1 : at + 1 + size]
        out[parent(run)] = run
        at += 1 + size
    return out


def _blocks(nodes: DataFrame) -> DataFrame:
    """Segments over nodes (tree, rank, n, node): rows (tree, rank, n, node, records) of the next level."""

    def over(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, block, n = key
        ordered = rows.sort_values("rank")["node"].tolist()
        top, records = segment(ordered, None if n <= 2**HEIGHT else HEIGHT)
        return pd.DataFrame({
            "tree": [tree], "rank": [block], "n": [-(-n // 2**HEIGHT)], "node": [top], "records": [records],
        })

    block = F.shiftright("rank", HEIGHT).alias("block")
    narrow = nodes.select("tree", block, "n", "rank", "node")
    return narrow.groupBy("tree", "block", "n").applyInPandas(over, "tree binary, rank bigint, n bigint, node binary, records binary")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Stored segments, level over level, until every tree has one."""
    levels: list[DataFrame] = []
    while True:
        levels.append(stored(_blocks(nodes)))
        nodes = levels[-1].drop("records")
        if nodes.agg(F.max("n")).first()[0] in (None, 1):
            return levels


@dataclass
class Manifest:
    """A stored DAG: segments of the groups and of the subroots, level by level from below, and one row a subroot."""

    group_levels: list[DataFrame]
    top_levels: list[DataFrame]
    subroots: DataFrame

    @property
    def root(self) -> bytes | None:
        first = self.top_levels[-1].select("node").first()
        return first and bytes(first[0])

    @property
    def store(self) -> DataFrame:
        """The records by the digest of their segment. Equal segments are one; a segment of a single node has none."""
        levels = [level.select(F.col("node").alias("digest"), "records") for level in (*self.group_levels, *self.top_levels)]
        out = levels[0]
        for level in levels[1:]:
            out = out.unionByName(level)
        return out.where(F.octet_length("records") > 0).dropDuplicates(["digest"])


def build(rows: DataFrame) -> Manifest:
    """The DAG over rows (tree, group, rank, n, node)."""
    group_levels = _levels(rows.select("tree", "rank", "n", "node"))
    # one row a tree: the name of its group beside its subroot
    names = rows.where("rank = 0").select("tree", "group")
    tops = group_levels[-1].join(names, "tree").select(
        F.lit(b"top").alias("top"), "group", F.col("tree").alias("of"), "node")
    subroots = ranked(tops, "top", [F.col("group").asc_nulls_first()]).withColumnRenamed("top", "tree")
    subroots = stored(subroots)
    return Manifest(group_levels, _levels(subroots.select("tree", "rank", "n", "node")), subroots)


# --- descending ---------------------------------------------------------------------------------------------------


def descend(start: bytes, rank: int, depth: int, children: dict[bytes, bytes]) -> tuple[bytes, bytes]:
    """The node that the digits of the rank lead to, and the children not taken, from the lowest to the highest."""
    node, path = start, []
    for bit in range(depth - 1, -1, -1):
        run = children[node]
        take = rank >> bit & 1
        node = run[take * _WIDE : (take + 1) * _WIDE]
        other = run[(1 - take) * _WIDE : (2 - take) * _WIDE]
        if other:
            path.append(other)
    return node, b"".join(reversed(path))


def _depth(n: int) -> int:
    """Levels of a segment over the nodes of a tree with so many: all of a small tree, else HEIGHT."""
    return min(HEIGHT, (n - 1).bit_length())


def _opened(requests: DataFrame, store: DataFrame, below: DataFrame) -> DataFrame:
    """Descends from requested segments to what lies under them.

    requests: (tree, rank, node, path) of segments of one level; below: (tree, rank, n, ...) of the level under it.
    Returns requests for that level.
    """

    def open_segments(wanted: pd.DataFrame, lower: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(wanted):
            start, path, children = _request(wanted)
            for tree, rank, n in zip(lower["tree"], lower["rank"].tolist(), lower["n"].tolist()):
                node, own = descend(start, rank, _depth(n), children)
                out.append((tree, rank, node, own + path))
        return exact(out, ["tree", "rank", "node", "path"])

    found = requests.join(store, F.col("node") == F.col("digest"), "left").drop("digest")
    lower = below.select("tree", "rank", "n", F.shiftright("rank", HEIGHT).alias("block"))
    return found.groupBy("tree", "rank").cogroup(lower.groupBy("tree", "block")).applyInPandas(
        open_segments, "tree binary, rank bigint, node binary, path binary")


def _request(wanted: pd.DataFrame) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    """Start, path above it and records of the one request of a group."""
    row = wanted.iloc[0]
    return bytes(row["node"]), bytes(row["path"]), children_of(bytes(row["records"] or b""))


def requested(manifest: Manifest) -> DataFrame:
    """Requests (tree, rank, node, path, subroot, top_rank, top_n) for the lowest segments of all groups."""
    store = manifest.store
    at = manifest.top_levels[-1].select("tree", "rank", "node", F.lit(b"").alias("path"))
    for below in (*reversed(manifest.top_levels[:-1]), manifest.subroots):
        at = _opened(at, store, below)
    places = manifest.subroots.select(F.col("of").alias("tree"), F.col("rank").alias("top_rank"), F.col("n").alias("top_n"))
    tops = stored(at.drop("tree").withColumnRenamed("rank", "top_rank").join(places, "top_rank"))
    at = tops.select("tree", F.lit(0).cast("bigint").alias("rank"), "node", "path")
    for below in reversed(manifest.group_levels[:-1]):
        at = _opened(at, store, below)
    return at.join(tops.select("tree", F.col("node").alias("subroot"), "top_rank", "top_n"), "tree")


def fold(node: bytes, rank: int, n: int, path: bytes) -> tuple[bytes, bytes]:
    """The top of a tree of n nodes over a node of the given rank, from its siblings; and what is left of the path."""
    while n > 1:
        if rank ^ 1 < n:
            other, path = path[:_WIDE], path[_WIDE:]
            node = parent(other + node if rank & 1 else node + other)
        else:
            node = parent(node)
        rank, n = rank >> 1, (n + 1) >> 1
    return node, path


# --- the operator -------------------------------------------------------------------------------------------------


def tree_of(group: Column) -> Column:
    """A key of fixed size for a group, null included."""
    return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-")).cast("binary"), 256))


def leaves(
    docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", changes: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows (id, group, tree, node, tampered, rank, n); tampered is the leaf after the changes, null where they change nothing."""
    of = lambda c: F.col(f"`{c}`")
    changes = changes or {}
    changed = F.lit(False)
    for c, new in changes.items():
        changed = changed | ~new.eqNullSafe(of(c))
    rows = docs.select(
        of(id_col).alias("id"), of(group_col).alias("group"), tree_of(of(group_col)).alias("tree"),
        leaf(*[of(c) for c in fields]).alias("node"),
        F.when(changed, leaf(*[changes.get(c, of(c)) for c in fields])).alias("tampered"),
    )
    return ranked(rows, "tree", [F.col("id").asc_nulls_first(), F.col("node")])


def proofs(
    docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", changes: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: id, group, leaf, subroot, root, path, proof (digest of the path), folded_root, verified.

    ``path`` holds the siblings from the leaf's up to the root's child, 32 bytes each. ``folded_root`` comes from the
    leaf as ``changes`` leave it (new values of columns) and the original path.
    """
    rows = leaves(docs, fields, id_col, group_col, changes)
    manifest = build(rows)
    found = prove(rows, manifest)
    root = manifest.root or b""
    kind = lambda c: docs.schema[c].dataType
    return found.select(
        F.col("id").cast(kind(id_col)).alias("id"), F.col("group").cast(kind(group_col)).alias("group"), "leaf", "subroot",
        F.lit(root).alias("root"), "path", "proof", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"),
    )


_PROVED = ["id", "group", "leaf", "subroot", "path", "proof", "folded_root"]


def prove(rows: DataFrame, manifest: Manifest) -> DataFrame:
    """Descends from the lowest segments to every leaf and folds the way back. Ids and groups come as text."""

    def answer(wanted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(wanted):
            start, above, children = _request(wanted)
            subroot, top_rank, top_n = (wanted[c].iloc[0] for c in ("subroot", "top_rank", "top_n"))
            columns = ("id", "group", "rank", "n", "node", "tampered")
            for name, group, rank, n, node, tampered in zip(*(asked[c].tolist() for c in columns)):
                found, own = descend(start, rank, _depth(n), children)
                if found != node:
                    raise ValueError("a leaf is not where its rank leads")
                path = own + above
                top, rest = fold(node if tampered is None else tampered, rank, n, path)
                root, _ = fold(top, int(top_rank), int(top_n), rest)
                out.append((name, group, node, subroot, path, parent(path), root))
        return exact(out, _PROVED)

    requests = requested(manifest)
    requests = requests.join(manifest.store, F.col("node") == F.col("digest"), "left").drop("digest")
    asked = rows.select(
        "tree", F.shiftright("rank", HEIGHT).alias("block"), "rank", "n", F.col("id").cast("string").alias("id"),
        F.col("group").cast("string").alias("group"), "node", "tampered",
    )
    return requests.groupBy("tree", "rank").cogroup(asked.groupBy("tree", "block")).applyInPandas(
        answer, "id string, group string, leaf binary, subroot binary, path binary, proof binary, folded_root binary")
