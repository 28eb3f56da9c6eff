"""Removal of repeated byte strings by suffix sorting.

Every byte covered by a string of `length` bytes that also starts earlier (in a smaller document, or before in the
same one) is removed. To sort the suffixes of a corpus in parts, equal strings must meet in one part:

1. Each string of `length` bytes picks the run of 32 bytes with the smallest hash inside it as its anchor, so equal
   strings pick equal anchors. The consecutive strings of a text with one anchor form a piece. Pieces (hashes,
   places) are packed and dealt to shards by anchor. There, all but the first occurrence of a piece are repeats. An
   anchor with two or more different pieces stays open.
2. The texts send the bytes of the first occurrences of open pieces to shards by anchor. There, pieces are cut into
   strips of few starts; strips meet if they agree in the bytes that all strings of the strip share. What then
   still differs is laid end to end, and its suffixes are sorted by linear grouping; neighbours that agree
   for `length` bytes are one string, of which the earliest place stays. An anchor with more than `crowd` different
   pieces is no group of bounded size. Its strings are dealt one by one by their own 128-bit hash, so that differing
   neighbours spread over all shards; equal strings of one batch of texts travel once.
3. The ranges found go back to their documents.

Identical pieces are one from the start, so a passage with any number of copies is sorted once. Everything moves in
packed blobs of bounded size; texts are shuffled twice.

The order of documents is by id, nulls last, then by a hash of the text. Repeated rows of an id and text follow
each other. Null and empty texts have no bytes. Other columns are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logspark.llm.frames import exact, runs, stored
from logspark.llm.lm import narrow, pack, unpack
from logspark.llm.suffixes import suffix_array
from logspark.llm.words import mixed

ANCHOR = 32
STRIP = 8
_NO_ID = np.int64(2**63 - 1)


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start, anchor place and anchor hash of each piece of a text of at least that length."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    width = 1
    while width < ANCHOR:
        x = (x[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[width:] + np.uint64(width * 0x51ED27))
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        width *= 2
    place = _least(x, length - ANCHOR + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    return first, last, place[first], x[place[first]]


def _least(x: np.ndarray, window: int, block: int = 1 << 23) -> np.ndarray:
    """Place of the smallest hash of each window, ties to the left; by the same 40 bits of a hash in a text of any size.

    A hash and the place within a block of windows share one number, so a minimum of numbers finds both.
    """
    out = np.empty(len(x) - window + 1, np.int64)
    for start in range(0, len(out), block):
        part = x[start : start + block + window - 1]
        least = part >> np.uint64(24) << np.uint64(24) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width * 2 <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = window - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        out[start : start + block] = (least & np.uint64(0xFFFFFF)).astype(np.int64) + start
    return out


def removed_bytes(
    docs: DataFrame, length: int = 100, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text",
    crowd: int = 256,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges, as text).

    crowd: different pieces that an anchor has at most while they are sorted together; it does not change the result.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(_NO_ID))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    shards = 1 + total // shard_bytes
    pieces = rows.mapInPandas(_cutter(length, shards), "shard bigint, data binary")
    first = stored(
        pieces.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
        .mapInPandas(_piece_matcher(length, shards, crowd), "bucket bigint, kind int, data binary")
    )
    found, open_pieces = first.where("kind = 1"), first.where("kind = 2")

    key = _key_udf()
    keyed = rows.withColumn("text_key", key("text"))
    bucket = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(shards))
    # blobs carry the bucket by the same rule
    texts = keyed.select(bucket.alias("bucket"), F.lit(3).alias("kind"), "doc_id", "text_key", F.col("text").alias("data"))

    def with_blobs(blobs: DataFrame) -> DataFrame:
        none = F.lit(0).cast("bigint")  # a null would turn the column into floats in pandas
        both = texts.unionByName(blobs.select("bucket", "kind", none.alias("doc_id"), none.alias("text_key"), "data"))
        return both.repartitionById(shards, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "kind", "doc_id", "text_key")

    answers = with_blobs(open_pieces).mapInPandas(_piece_sender(length, shards), "shard bigint, kind int, data binary")
    more = answers.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "kind").mapInPandas(
        _sorter(length, shards), "bucket bigint, kind int, data binary")
    return with_blobs(found.unionByName(more)).mapInPandas(
        _remover(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string")


def text_key(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _key_udf():
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([text_key(t) for t in texts], dtype="int64")

    return F.pandas_udf(keys, "bigint")


def _cutter(length: int, shards: int, most: int = 8 << 20):
    """Packs the pieces of bounded amounts of text, by shard."""

    def flush(ids, keys, parts) -> Iterator[pd.DataFrame]:
        ids, keys = np.array(ids, np.int64), np.array(keys, np.int64)
        doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        start, end, place, anchor, piece = (np.concatenate([p[i] for p in parts]) for i in range(5))
        shard = (anchor >> np.uint64(40)) % np.uint64(shards)
        order = np.lexsort((anchor, shard))
        cuts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            used, local = np.unique(doc[own], return_inverse=True)
            yield pd.DataFrame([(int(shard[own[0]]), pack(
                ids[used], keys[used], narrow(local), narrow(start[own]), (end - start)[own].astype(np.uint8),
                (place - start)[own].astype(np.uint8), anchor[own], piece[own]))], columns=["shard", "data"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        ids, keys, parts, held = [], [], [], 0
        for batch in batches:
            for doc_id, data in zip(batch["doc_id"], batch["text"]):
                if len(data) < length:
                    continue
                data = bytes(data)
                first, last, place, anchor = anchors(data, length)
                hashed = xxhash.xxh3_64_intdigest
                piece = np.array([hashed(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], np.uint64)
                ids.append(int(doc_id))
                keys.append(text_key(data))
                parts.append((first, last, place, anchor, piece))
                held += len(data)
                if held >= most or len(ids) >= 60_000:
                    yield from flush(ids, keys, parts)
                    ids, keys, parts, held = [], [], [], 0
        if ids:
            yield from flush(ids, keys, parts)

    return cut


class Places:
    """Documents by order, from the document tables of several blobs."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        ids, keys = (np.concatenate([t[i] for t in tables]) for i in range(2))
        order = np.lexsort((keys, ids))
        new = np.ones(len(order), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        self.ids, self.keys = ids[order][new], keys[order][new]
        self.ranks = np.split(rank, np.cumsum([len(t[0]) for t in tables])[:-1])

    def buckets(self, shards: int) -> np.ndarray:
        return spark_bucket(self.ids, self.keys, shards)


def spark_bucket(ids: np.ndarray, keys: np.ndarray, shards: int) -> np.ndarray:
    """The bucket of documents; the same numbers as the column expression gives."""
    import xxhash

    def hashed(a: int, b: int) -> int:
        h = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)
        return xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), h)

    signed = np.array([hashed(a, b) for a, b in zip(ids.tolist(), keys.tolist())], np.uint64).view(np.int64)
    return np.mod(signed, shards)


def _by_bucket(places: Places, doc: np.ndarray, columns: list[np.ndarray], shards: int, kind: int) -> Iterator[pd.DataFrame]:
    """Packs rows of documents (given by rank) by the bucket of the document."""
    if not len(doc):
        return
    bucket = places.buckets(shards)[doc]
    order = np.lexsort((doc, bucket))
    cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        used, local = np.unique(doc[own], return_inverse=True)
        data = pack(places.ids[used], places.keys[used], narrow(local), *[c[own] for c in columns])
        yield pd.DataFrame([(int(bucket[own[0]]), kind, data)], columns=["bucket", "kind", "data"])


def _piece_matcher(length: int, shards: int, crowd: int):
    """Ranges of repeated pieces (kind 1), and first occurrences of the pieces of open anchors (kind 2)."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, "shard"):
            blobs = [unpack(d) for d in group["data"]]
            places = Places([(b[0], b[1]) for b in blobs])
            doc = np.concatenate([r[b[2].astype(np.int64)] for r, b in zip(places.ranks, blobs)])
            start, more, lead, anchor, piece = (np.concatenate([b[i] for b in blobs]) for i in range(3, 8))
            start = start.astype(np.int64)
            order = np.lexsort((start, doc, piece, anchor))
            doc, start, more, lead, anchor, piece = (c[order] for c in (doc, start, more, lead, anchor, piece))
            other_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            other_piece = other_anchor | np.concatenate([[True], piece[1:] != piece[:-1]])
            again = ~other_piece & ~np.concatenate([[False], (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])])
            at = np.flatnonzero(again)
            merged = _union(doc[at], start[at], start[at] + more[at] + length)
            yield from _by_bucket(places, merged[0], [merged[1], merged[2]], shards, 1)
            kinds = np.cumsum(other_anchor) - 1
            different = np.bincount(kinds, other_piece)
            at = np.flatnonzero(other_piece & (different > 1)[kinds])
            crowded = (different > crowd)[kinds[at]]
            yield from _by_bucket(places, doc[at], [start[at], more[at], lead[at], anchor[at], crowded], shards, 2)

    return match


def _union(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the overlapping and touching ranges of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # running end within a document: documents are shifted far apart
    shift = doc.astype(np.int64) << 40
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return doc[first], start[first], (reach - shift)[np.append(first[1:], len(doc)) - 1]


def _piece_sender(length: int, shards: int, most: int = 30_000):
    """Sends the bytes of open pieces to the shard of their anchor (kind 2), and those of crowded anchors as hashes of
    their strings to the shards of these (kind 4). Strings that repeat an earlier one of the same batch are ranges (kind
    1) of this bucket already."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bucket, blobs, rows in _buckets(batches):
            wanted = _by_document(blobs)
            ids, keys, own, pieces, single = [], [], [], [], []
            for doc_id, key, data in rows:
                asked = wanted.pop((doc_id, key), None)
                if asked is None:
                    continue
                for start, more, lead, anchor, crowded in zip(*(np.concatenate(c) for c in zip(*asked))):
                    piece = data[start : start + more + length]
                    if crowded:
                        single.append((len(ids), int(start), piece))
                    else:
                        own.append((len(ids), start, more, lead, anchor))
                        pieces.append(piece)
                ids.append(doc_id)
                keys.append(key)
                if len(own) + len(single) > most:
                    yield from flush(bucket, ids, keys, own, pieces, single)
                    ids, keys, own, pieces, single = [], [], [], [], []
            yield from flush(bucket, ids, keys, own, pieces, single)

    def flush(bucket, ids, keys, own, pieces, single) -> Iterator[pd.DataFrame]:
        ids, keys = np.array(ids, np.int64), np.array(keys, np.int64)
        if own:
            doc, start, more, lead, anchor = (np.array(c) for c in zip(*own))
            anchor = anchor.astype(np.uint64)
            # another hash than before, so that the parts are mixed anew
            shard = (mixed(anchor) % np.uint64(shards)).astype(np.int64)
            for at in _groups(shard):
                data = pack(ids, keys, narrow(doc[at]), start[at].astype(np.int64), more[at].astype(np.uint8),
                            lead[at].astype(np.uint8), anchor[at], b"".join(pieces[i] for i in at))
                yield pd.DataFrame([(int(shard[at[0]]), 2, data)], columns=["shard", "kind", "data"])
        if single:
            doc, start, high, low = strings(single, length)
            order, again = _again(doc, start, high, low)
            at = order[again]
            merged = _union(doc[at], start[at], start[at] + length)
            if len(at):
                used, local = np.unique(merged[0], return_inverse=True)
                data = pack(ids[used], keys[used], narrow(local), merged[1], merged[2])
                yield pd.DataFrame([(bucket, 1, data)], columns=["shard", "kind", "data"])
            doc, start, high, low = (c[order[~again]] for c in (doc, start, high, low))
            shard = (low % np.uint64(shards)).astype(np.int64)
            for at in _groups(shard):
                used, local = np.unique(doc[at], return_inverse=True)
                data = pack(ids[used], keys[used], narrow(local), narrow(start[at]), high[at], low[at])
                yield pd.DataFrame([(int(shard[at[0]]), 4, data)], columns=["shard", "kind", "data"])

    return send


def strings(pieces: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and 128-bit hash (high, low) of each string of the pieces (document, start, bytes)."""
    import xxhash

    hashed = xxhash.xxh3_128_digest
    count = np.array([len(data) - length + 1 for _, _, data in pieces])
    digests = np.frombuffer(b"".join(hashed(data[k : k + length]) for _, _, data in pieces for k in range(len(data) - length + 1)), ">u8")
    high, low = digests.astype(np.uint64).reshape(-1, 2).T
    doc = np.repeat(np.array([p[0] for p in pieces], np.int64), count)
    first = np.repeat(np.array([p[1] for p in pieces], np.int64) - np.cumsum(count) + count, count)
    return doc, first + np.arange(len(doc)), high, low


def _again(doc: np.ndarray, start: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash and place, and whether the string there stands in an earlier place too."""
    order = np.lexsort((start, doc, high, low))
    again = np.zeros(len(order), bool)
    again[1:] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    return order, again


def _groups(numbers: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each different number."""
    order = np.argsort(numbers, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], numbers[order][1:] != numbers[order][:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield order[a:b]


def _buckets(batches: Iterator[pd.DataFrame]):
    """(bucket, blobs, rows) of a stream sorted by bucket and kind; rows (id, key, bytes) are an iterator to use up."""
    state = {"bucket": None, "blobs": [], "left": None}

    def flat():
        for batch in batches:
            yield from zip(batch["bucket"], batch["kind"], batch["doc_id"], batch["text_key"], batch["data"])

    stream = flat()
    state["left"] = next(stream, None)

    def rows(bucket):
        while state["left"] is not None and state["left"][0] == bucket:
            _, _, doc_id, key, data = state["left"]
            yield int(doc_id), int(key), bytes(data)
            state["left"] = next(stream, None)

    while state["left"] is not None:
        bucket, blobs = state["left"][0], []
        while state["left"] is not None and state["left"][0] == bucket and state["left"][1] != 3:
            blobs.append(unpack(state["left"][4]))
            state["left"] = next(stream, None)
        it = rows(bucket)
        yield bucket, blobs, it
        for _ in it:
            pass


def _by_document(blobs: list) -> dict[tuple[int, int], list[list[np.ndarray]]]:
    """The columns of each document, as they came: {(id, key): [[columns], ...]}."""
    out: dict[tuple[int, int], list[list[np.ndarray]]] = {}
    for ids, keys, local, *columns in blobs:
        cuts = np.flatnonzero(np.concatenate([[True], local[1:] != local[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            doc = int(local[a])
            out.setdefault((int(ids[doc]), int(keys[doc])), []).append([c[a:b] for c in columns])
    return out


def _sorter(length: int, shards: int):
    """Ranges of strings of open pieces that start earlier elsewhere (kind 1)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, "shard"):
            for shard, kind, data in zip(group["shard"], group["kind"], group["data"]):
                if kind == 1:
                    yield pd.DataFrame([(shard, 1, data)], columns=["bucket", "kind", "data"])
            for kind, settle in ((2, pieces), (4, singles)):
                blobs = [unpack(d) for d in group["data"][group["kind"] == kind]]
                if blobs:
                    places = Places([(b[0], b[1]) for b in blobs])
                    doc = np.concatenate([r[b[2].astype(np.int64)] for r, b in zip(places.ranks, blobs)])
                    merged = _union(*settle(doc, blobs))
                    yield from _by_bucket(places, merged[0], [merged[1], merged[2]], shards, 1)

    def pieces(doc: np.ndarray, blobs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, more, lead, anchor = (np.concatenate([b[i] for b in blobs]) for i in range(3, 7))
        data = b"".join(b[7] for b in blobs)
        size = more.astype(np.int64) + length
        offset = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        order = np.lexsort((start, doc, anchor))
        cuts = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1], [True]]))
        out: list[tuple[int, int, int]] = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            out += repeated(
                [(int(doc[i]), int(start[i]), int(lead[i]), data[offset[i] : offset[i] + size[i]]) for i in own], length)
        return tuple(np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def singles(doc: np.ndarray, blobs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, high, low = (np.concatenate([b[i] for b in blobs]) for i in range(3, 6))
        start = start.astype(np.int64)
        order, again = _again(doc, start, high, low)
        at = order[again]
        return doc[at], start[at], start[at] + length

    return work


def repeated(pieces: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(document, start, end) of the strings of pieces that start earlier in another piece of the anchor.

    A piece is (document, start, anchor's distance from the start, bytes); pieces come in order of their places.
    """
    out = []
    meet: dict[tuple[int, bytes], dict[bytes, tuple[int, int]]] = {}
    for doc, start, lead, data in pieces:
        # strings by the distance from their start to the anchor, in strips of equal quotient
        at, count = 0, len(data) - length + 1
        while at < count:
            strip = (lead - at) // STRIP
            stop = min(count, lead - strip * STRIP + 1)  # strings at .. stop - 1
            # bytes that all strings of the strip share, whatever part of it a piece has
            core = data[lead - strip * STRIP : lead - (strip + 1) * STRIP + 1 + length]
            crop = data[at : stop - 1 + length]
            same = meet.setdefault((strip, core), {})
            if crop in same:
                out.append((doc, start + at, start + stop - 1 + length))
            else:
                same[crop] = (doc, start + at)
            at = stop
    for same in meet.values():
        if len(same) > 1:
            out += _sorted_repeats(list(same.items()), length)
    return out


def _sorted_repeats(crops: list[tuple[bytes, tuple[int, int]]], length: int) -> list[tuple[int, int, int]]:
    text: list[int] = []
    owner: dict[int, tuple[bytes, int, int, int]] = {}  # start in the text -> crop, offset, document, start
    for data, (doc, start) in crops:
        for k in range(len(data) - length + 1):
            owner[len(text) + k] = (data, k, doc, start + k)
        text += [c + 1 for c in data]
        text.append(0)
    out = []
    same: list[tuple[int, int]] = []
    last = b""
    for suffix in suffix_array(text):
        if suffix not in owner:
            continue
        data, k, doc, start = owner[suffix]
        string = data[k : k + length]
        if string != last:
            if len(same) > 1:
                same.remove(min(same))
                out += [(d, s, s + length) for d, s in same]
            same, last = [], string
        same.append((doc, start))
    if len(same) > 1:
        same.remove(min(same))
        out += [(d, s, s + length) for d, s in same]
    return out


def _remover(length: int):
    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        for _, blobs, rows in _buckets(batches):
            ranges = _by_document(blobs)
            out, before = [], None
            for doc_id, key, data in rows:
                if (doc_id, key) == before:
                    spans = [(0, len(data))] if len(data) >= length else []
                else:
                    spans = []
                    if (doc_id, key) in ranges:
                        begin, end = (np.concatenate(c).astype(np.int64) for c in zip(*ranges[doc_id, key]))
                        _, begin, end = _union(np.zeros(len(begin), np.int64), begin, end)
                        spans = list(zip(begin.tolist(), end.tolist()))
                before = (doc_id, key)
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((None if doc_id == int(_NO_ID) else doc_id, len(data), sum(b - a for a, b in spans), len(spans),
                            kept.hexdigest(), ",".join(f"{a}:{b}" for a, b in spans)))
                if len(out) == 5000:
                    yield exact(out, names, "doc_id")
                    out = []
            yield exact(out, names, "doc_id")

    return remove
