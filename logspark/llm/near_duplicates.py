"""Near duplicates on word shingles by chosen-path set similarity join.

Every distinct shingle set gets minwise tokens. A tree starts with all sets in one node; each node chooses a few
of the token positions, and a set moves on to the children named by its tokens there, so sets that share most
shingles keep meeting while the others part. A node with few sets is compared exhaustively. So is a node that
keeps more than half of its parent's sets: its sets are alike throughout and further branching would not part
them; it is compared in blocks of bounded size. Independent trees repeat this until a pair at the threshold is
missed less than once in a million.

The comparison of tokens proposes pairs, with a margin of five standard errors. What the proposals connect forms
a family; the full shingle sets of each family are then compared, again in bounded blocks, and only exact links
count. Identical sets are one class from the start, and blocks put out spanning links, never all pairs.

Nulls and empty texts: a text that is null or has no words has an empty set and no links. Repeated rows and ties:
rows with the same words share a class. Extra columns are not read.
"""

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logspark.llm.frames import Union, connected, exact, light, runs, stored, unused
from logspark.llm.words import WordHashes, mixed, shingles, spaced


@dataclass(frozen=True)
class Similarity:
    """Link texts whose shingle sets share at least percent / 100 of their union.

    words: length of a shingle. tokens: minwise tokens of a set. trees, branch: independent trees, and token
    positions that each node chooses. node_limit: sets that one comparison takes. block_shingles: shingles that
    one exact comparison takes on average. deepest: levels after which what is left is compared in blocks.
    """

    words: int = 5
    percent: int = 80
    tokens: int = 128
    trees: int = 4
    branch: int = 2
    node_limit: int = 1000
    block_shingles: int = 400_000
    deepest: int = 10

    @property
    def least_size(self) -> int:
        """Smaller sets have no link with a different set."""
        return -(-self.percent // (100 - self.percent))

    @property
    def alike(self) -> float:
        """Share of equal one-byte tokens from which a pair is compared on full sets."""
        j = self.percent / 100
        return j + (1 - j) / 256 - 5 * (j * (1 - j) / self.tokens) ** 0.5


def class_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Similarity = Similarity()) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, first_key, and is_first.

    component_id is the smallest id reachable over links, null if all ids of the component are null. text_key is a
    hash of the text. is_first marks the rows that stand for their component; repeated rows of it are all marked.
    """
    seen = stored(
        docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
        .mapInPandas(_sketcher(rule), "doc_id bigint, text_key bigint, size bigint, class binary, tokens binary")
    )
    rows = seen.select("doc_id", "text_key", "size", "class")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = stored(
        seen.where("size > 0").groupBy("class")
        .agg(F.min(order).alias("head"), F.first("size").alias("size"), F.first("tokens").alias("tokens"))
        .select("class", "size", "tokens", "head")
    )
    families = connected(_proposals(classes.where(F.col("size") >= rule.least_size).select("class", "size", "tokens"), rule))
    members = families.join(classes.select(F.col("class").alias("node"), "size", "head"), "node")
    links = connected(_exact_links(docs, members, id_col, text_col, rule))
    labelled = classes.select("class", "head").join(links.withColumnRenamed("node", "class"), "class", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "class"))
    heads = labelled.groupBy("root").agg(F.min("head").alias("first"))
    components = labelled.join(heads, "root").select("class", "first")
    out = rows.join(components, "class", "left")
    alone = F.col("size") == 0
    return out.select(
        "doc_id", "text_key", F.col("size").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.when(alone, F.col("text_key")).otherwise(F.col("first.text_key")).alias("first_key"),
    ).withColumn("is_first", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Similarity = Similarity()) -> DataFrame:
    """The documents without those that another of their component stands for; texts without words all stay."""
    found = stored(class_ids(docs, id_col, text_col, rule).where("n_shingles > 0"))
    key, name = unused(docs, "text_key"), unused(docs, "doc_key")
    gone = light(stored(found.where("NOT is_first").select(F.col("doc_id").alias(name), F.col("text_key").alias(key)).distinct()))
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    left = keyed.join(gone, F.col(f"`{id_col}`").eqNullSafe(gone[name]) & (keyed[key] == gone[key]), "left_anti")
    # rows that occur several times are rare: only they are gathered
    several = stored(found.where("is_first").groupBy("doc_id", "text_key").count().where("count > 1").select(
        F.col("doc_id").alias(name), F.col("text_key").alias(key)))
    if several.isEmpty():
        return left.drop(key)
    several = light(several)
    same = left[id_col].eqNullSafe(several[name]) & (left[key] == several[key])
    once = left.join(several, same, "left_semi").dropDuplicates([id_col, key])
    return left.join(several, same, "left_anti").unionByName(once).drop(key)


def class_of(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _multipliers(count: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minwise(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """For each hash function the smallest value of the set, as 32 bits."""
    least = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(values), 512):
        product = multipliers[:, None] * values[None, start : start + 512]
        np.minimum(least, (product >> np.uint64(32)).min(axis=1).astype(np.uint32), out=least)
    return least


def _sketcher(rule: Similarity):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, multipliers = WordHashes(), _multipliers(rule.tokens)
        for batch in batches:
            out = []
            for doc_id, text, key in zip(batch["doc_id"].array, batch["text"].array, batch["text_key"].tolist()):
                text = text if isinstance(text, str) else None
                values = shingles(hashes(spaced(text)), rule.words)
                tokens = minwise(values, multipliers).tobytes() if len(values) >= rule.least_size else b""
                out.append((None if doc_id is None else int(doc_id), key, len(values), class_of(values), tokens))
            yield exact(out, ["doc_id", "text_key", "size", "class", "tokens"], "doc_id")

    return sketch


def _brancher(rule: Similarity, level: int):
    """Moves each set of a node to the children that the node's choice of positions names; marks are one-byte tokens."""

    def branch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        picks = np.arange(1, rule.trees * rule.branch + 1 if level == 0 else rule.branch + 1, dtype=np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            tokens = np.frombuffer(b"".join(batch["tokens"]), np.uint32).reshape(len(batch), -1)
            marks = np.empty(len(batch), object)
            marks[:] = [row.tobytes() for row in tokens.astype(np.uint8)]
            node = batch["node"].to_numpy().astype(np.int64).view(np.uint64)
            lanes = []
            for pick in picks:
                tree = (pick - np.uint64(1)) // np.uint64(rule.branch) if level == 0 else np.uint64(0)
                place = mixed(node + tree * np.uint64(0x51ED2701) + pick * np.uint64(0x9E3779B97F4A7C15))
                at = (place % np.uint64(rule.tokens)).astype(np.int64)
                lanes.append(mixed(place ^ mixed(tokens[np.arange(len(batch)), at].astype(np.uint64) + np.uint64(1))))
            n = len(picks)
            yield pd.DataFrame({
                "class": np.repeat(batch["class"].to_numpy(), n),
                "size": np.repeat(batch["size"].to_numpy(), n),
                "marks": np.repeat(marks, n),
                "parent_count": np.repeat(batch["count"].to_numpy(), n),
                "node": np.stack(lanes, axis=1).ravel().view(np.int64),
            })

    return branch


def _proposals(sets: DataFrame, rule: Similarity) -> DataFrame:
    """Links (a, b) that connect every pair of sets that the trees bring together and whose tokens are alike.

    Counts decide first which nodes are large; only they are joined back, so most sets are shuffled once a level.
    """
    rows = "class binary, size bigint, marks binary, parent_count bigint, node bigint"
    found = None
    level = 0
    members = sets.select("class", "size", "tokens", F.lit(0).cast("bigint").alias("node"), F.lit(1 << 62).alias("count"))
    while True:
        children = members.mapInPandas(_brancher(rule, level), rows)
        large = stored(children.groupBy("node").agg(F.count("*").alias("count")).where(F.col("count") > rule.node_limit))
        some_large = not large.isEmpty()
        large = light(large)
        small = children.join(large, "node", "left_anti").select(F.col("node").alias("block"), "class", "size", "marks")
        links = _compared(small, rule)
        if some_large:
            dense = (F.col("count") * 2 > F.col("parent_count")) | F.lit(level + 1 >= rule.deepest)
            held = children.join(large, "node")
            chunks = F.ceil(F.col("count") / rule.node_limit).cast("bigint")
            blocks = in_blocks(held.where(dense), "node", chunks, F.pmod(F.xxhash64("class"), F.col("_n")))
            links = links.unionByName(_compared(blocks.select("block", "class", "size", "marks"), rule))
            members = light(stored(held.where(~dense).select("class", "node", "count")))
            members = stored(sets.select("class", "size", "tokens").join(members, "class"))
        links = stored(links)
        found = links if found is None else found.unionByName(links)
        if not some_large or members.isEmpty():
            return found
        level += 1


def in_blocks(members: DataFrame, key: str, count, chunk) -> DataFrame:
    """Deals the members of each key to blocks: every two of them meet in one block, and a block holds two chunks.

    count: chunks of the key. chunk: the member's own. A key with one chunk is one block.
    """
    dealt = members.withColumn("_n", count).withColumn("_own", chunk)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    one, two = F.least("_own", "_other"), F.greatest("_own", "_other")
    return dealt.withColumn("block", F.xxhash64(key, one, two))


def _compared(members: DataFrame, rule: Similarity) -> DataFrame:
    """Compares the sets of each block by tokens; puts out spanning links."""
    parts = members.repartition("block").sortWithinPartitions("block")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, "block"):
            if len(group) < 2:
                continue
            ids, size = group["class"].to_numpy(), group["size"].to_numpy()
            tokens = np.frombuffer(b"".join(group["marks"]), np.uint8).reshape(len(group), -1)
            need = rule.alike * rule.tokens
            sets = Union(len(ids))
            for i in range(len(ids) - 1):
                fits = np.minimum(size[i + 1 :], size[i]) * 100 >= np.maximum(size[i + 1 :], size[i]) * rule.percent
                at = np.flatnonzero(fits) + i + 1
                if len(at):
                    near = (tokens[at] == tokens[i]).sum(axis=1) >= need
                    for j in at[near]:
                        sets.join(i, int(j))
            yield from _stars(sets, ids)

    return parts.mapInPandas(compare, "a binary, b binary")


def _stars(sets: Union, ids: np.ndarray) -> Iterator[pd.DataFrame]:
    root = [sets.root(i) for i in range(len(ids))]
    pairs = [(ids[r], ids[i]) for i, r in enumerate(root) if r != i and ids[r] != ids[i]]
    if pairs:
        yield pd.DataFrame(pairs, columns=["a", "b"])


def _exact_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, rule: Similarity) -> DataFrame:
    """Links between sets of one family that hold on the full sets: spanning links of each block."""
    weights = members.groupBy("root").agg(F.sum("size").alias("weight"), F.count("*").alias("count"))
    chunks = F.greatest(F.ceil(F.col("count") * 2 / rule.node_limit), F.ceil(F.col("weight") / rule.block_shingles)).cast("bigint")
    wanted = light(stored(members.join(weights, "root").select(
        "root", F.col("node").alias("class"), "head.doc_id", "head.text_key", chunks.alias("chunks")
    )))
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    # id and text find the row: many rows may lack an id
    same = wanted["doc_id"].eqNullSafe(keyed["doc_id"]) & (wanted["text_key"] == keyed["key"])
    texts = wanted.join(keyed, same).select("root", "class", "text", "chunks")
    blocks = in_blocks(texts, "root", F.col("chunks"), F.pmod(F.xxhash64("class"), F.col("_n")))
    parts = blocks.select("block", "class", "text").repartition("block").sortWithinPartitions("block")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for group in runs(batches, "block"):
            own = {}
            for name, text in zip(group["class"], group["text"]):
                if name not in own:
                    values = shingles(hashes(spaced(text if isinstance(text, str) else None)), rule.words)
                    if class_of(values) == name:
                        own[name] = values
            if len(own) > 1:
                ids = np.empty(len(own), object)
                ids[:] = list(own)
                yield from _stars(exact_sets(list(own.values()), rule.percent), ids)

    return parts.mapInPandas(link, "a binary, b binary")


def exact_sets(values: list[np.ndarray], percent: int) -> Union:
    """Joins the sets of a block whose intersection is at least percent / 100 of their union."""
    n = len(values)
    size = np.array([len(v) for v in values])
    sets = Union(n)
    if n <= 4:
        for i, j in itertools.combinations(range(n), 2):
            if min(size[i], size[j]) * 100 >= max(size[i], size[j]) * percent and sets.root(i) != sets.root(j):
                shared = len(np.intersect1d(values[i], values[j], assume_unique=True))
                if shared * 100 >= (size[i] + size[j] - shared) * percent:
                    sets.join(i, j)
        return sets
    every, at = np.unique(np.concatenate(values), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    shared = np.zeros((n, n), np.float32)  # exact below 2**24
    for start in range(0, len(every), 4096):
        held = (at >= start) & (at < start + 4096)
        grid = np.zeros((n, min(4096, len(every) - start)), np.float32)
        grid[owner[held], at[held] - start] = 1
        shared += grid @ grid.T
    for i in range(n - 1):
        both = shared[i, i + 1 :].astype(np.int64)
        for j in np.flatnonzero(both * 100 >= (size[i] + size[i + 1 :] - both) * percent):
            sets.join(i, i + 1 + int(j))
    return sets
