"""Language-model scores of texts from a bigram model kept as Elias-Fano tries.

p(v | u) = (c(u v) + prior * p(v)) / (c(u) + prior) with p(v) = (c(v) + 1) / (N + V + 1): bigram counts smoothed with
a Dirichlet prior towards unigram counts with one added, so probabilities of all words sum to one. A text's words
and one end token are counted; its first word follows a start symbol.

The model grows with the corpus and is never gathered in one place. Texts are packed into chunks of bounded size
(local word numbers, the hashes they stand for). Words are dealt by range of their hashes; each range adds up the
counts of all chunks and sends every chunk the counts of its own words. Then each chunk sorts its distinct bigrams by context and deals them to shards by context; a
context with many occurrences is spread over several shards by its successors. A shard merges the training counts
of all chunks, builds its trie (contexts, monotone pointers, successors, one-byte log-probabilities), and answers
each chunk's bigrams by a search among the successors of their context; a bigram that the trie lacks is backed
off. The shard sends back one partial sum per text of the chunk, and the chunk's sums are added up.

A chunk sends a shard each successor and its unigram probability once, and for each bigram the gap to the successor
before it in its context; texts that hold a bigram are sent as gaps as well.

Words are told apart by 63-bit hashes, successors within a context by 40 bits. Stored log-probabilities are
rounded to a step of 1/32, or a wider one in a shard with a probability below 10 ** -7.97.

Nulls and empty texts have the end token only. Repeated rows count as often as they occur. Extra columns are not
read.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logspark.llm.frames import runs, stored
from logspark.llm.ngram import SUCCESSOR_BITS, EliasFano, Trie
from logspark.llm.words import mixed, spaced

END = b" "  # no word holds a space
#: Unigram log-probabilities travel in steps of 1 / PART.
PART = 128


def word_hash(word: bytes) -> int:
    """63 bits."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word) >> 1


END_HASH = word_hash(END)
_LOST = np.uint64(64 - SUCCESSOR_BITS)


def is_held_out(id_column: Column) -> Column:
    """Whether the checksum of the id leaves 2 when divided by 7."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def pack(*arrays, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(arrays, protocol=5))


def unpack(data: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def packed_set(hashes: np.ndarray) -> bytes:
    """Ascending hashes as an Elias-Fano sequence."""
    return EliasFano.encode(hashes)


def unpacked_set(data: bytes) -> np.ndarray:
    sequence, _ = EliasFano.view(np.frombuffer(data, np.uint8))
    return sequence[np.arange(sequence.n)] if sequence.n else np.zeros(0, np.uint64)


def planes(x: np.ndarray) -> list[np.ndarray]:
    """Numbers by bytes, which compress better apart; as many bytes as the largest number needs."""
    size = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return [(x >> 8 * k & 255).astype(np.uint8) for k in range(size)]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0].astype(np.int64)
    for k, part in enumerate(parts[1:], 1):
        out |= part.astype(np.int64) << 8 * k
    return out


def gaps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences to the number before; numbers at ``first`` stay, where an ascending stretch begins."""
    out = np.diff(x, prepend=0)
    out[first] = x[first]
    return out


def from_gaps(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of stretches of the given sizes."""
    total = np.cumsum(x)
    first = np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - x[first], sizes)


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def scores(
    docs: DataFrame, held_out: Column, prior: float = 500.0, chunk_tokens: int = 1_500_000, shard_tokens: int = 3_000_000,
    range_words: int = 2_000_000, hot: int = 200_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    chunks = stored(rows.mapInPandas(
        _chunker(chunk_tokens), "chunk bigint, tokens bigint, kinds bigint, texts binary, words binary, counts binary"))
    tokens, kinds = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds")]).first()
    shards = 1 + tokens // shard_tokens
    bits = int(kinds // range_words).bit_length()
    ranges = chunks.select("chunk", "words", "counts").mapInPandas(_ranged(bits), "part int, chunk bigint, words binary, counts binary")
    counted = stored(
        ranges.repartitionById(1 << bits, "part").sortWithinPartitions("part", "chunk")
        .mapInPandas(_counted, "chunk bigint, part int, counts binary, n bigint, v bigint")
    )
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    none = F.lit(None).cast("binary")
    whole = chunks.select("chunk", F.lit(-1).alias("part"), "texts", "words", none.alias("counts"))
    parts = counted.select("chunk", "part", none.alias("texts"), none.alias("words"), "counts")
    meeting = whole.unionByName(parts).repartition("chunk").sortWithinPartitions("chunk", "part")
    dealt = meeting.mapInPandas(_dealer(n, v, shards, hot), "shard bigint, chunk bigint, data binary")
    answered = dealt.repartitionById(shards, F.pmod("shard", F.lit(shards)).cast("int")).sortWithinPartitions("shard", "chunk").mapInPandas(
        _answerer(prior), "chunk bigint, kind int, data binary")
    summed = answered.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInPandas(
        _summer, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return summed.withColumn("train_tokens", F.lit(n).cast("bigint"))


def _chunker(most: int):
    """Packs texts into chunks: ids, held flags, lengths and local word numbers; the words' hashes, ascending, and training counts."""

    def flush(number: int, ids, held, sizes, numbers, hashes: np.ndarray):
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        local = rank[np.concatenate(numbers)]
        # frequent words get small numbers in the packed text
        seen = np.bincount(local, minlength=len(order))
        by_use = np.argsort(-seen, kind="stable")
        number_of = np.empty(len(order), np.int64)
        number_of[by_use] = np.arange(len(order))
        sizes = np.array(sizes)
        counts = np.bincount(local[np.repeat(~np.array(held), sizes)], minlength=len(order))
        texts = pack(ids, np.array(held), narrow(sizes), narrow(seen), planes(number_of[local]))
        return number, int(sizes.sum()), len(order), texts, packed_set(hashes[order]), pack(narrow(counts))

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        names = ["chunk", "tokens", "kinds", "texts", "words", "counts"]
        number = TaskContext.get().partitionId() << 32
        vocabulary: dict[bytes, int] = {}
        ids, held, sizes, numbers, total = [], [], [], [], 0

        def hashes() -> np.ndarray:
            return np.array([word_hash(w) for w in vocabulary], np.uint64)

        for batch in batches:
            for doc_id, text, out in zip(batch["doc_id"], batch["text"], batch["held_out"]):
                words = spaced(text if isinstance(text, str) else None)
                words.append(END)
                try:
                    local = [vocabulary[w] for w in words]
                except KeyError:
                    local = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
                numbers.append(np.array(local, np.int64))
                ids.append(None if doc_id is None else int(doc_id))
                held.append(bool(out))
                sizes.append(len(words))
                total += len(words)
                if total >= most or len(ids) >= 60_000:
                    yield pd.DataFrame([flush(number, ids, held, sizes, numbers, hashes())], columns=names)
                    number += 1
                    vocabulary.clear()
                    ids, held, sizes, numbers, total = [], [], [], [], 0
        if ids:
            yield pd.DataFrame([flush(number, ids, held, sizes, numbers, hashes())], columns=names)

    return chunk


def _ranged(bits: int):
    """Cuts each chunk's words into equal ranges of hashes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(63 - bits)
        for batch in batches:
            for number, words, counts in zip(batch["chunk"], batch["words"], batch["counts"]):
                hashes, [each] = unpacked_set(words), unpack(counts)
                cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
                rows = [(part, number, packed_set(hashes[a:b]), pack(each[a:b])) for part, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pd.DataFrame(rows, columns=["part", "chunk", "words", "counts"])

    return cut


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up the counts of a range and answers every chunk in the order of its words; one row carries the sums."""
    for group in runs(batches, "part"):
        sets = [unpacked_set(w) for w in group["words"]]
        words, at = np.unique(np.concatenate(sets), return_inverse=True)
        each = np.concatenate([unpack(c)[0].astype(np.int64) for c in group["counts"]])
        total = np.bincount(at, each, len(words)).astype(np.int64)
        answers = np.split(total[at], np.cumsum([len(x) for x in sets])[:-1])
        first = np.arange(len(group)) == 0
        yield pd.DataFrame({
            "chunk": group["chunk"], "part": group["part"], "counts": [pack(narrow(a)) for a in answers],
            "n": np.where(first, total.sum(), 0), "v": np.where(first, (total > 0).sum(), 0),
        })


def _dealer(n: int, v: int, shards: int, hot: int):
    """Base scores of each chunk's texts, and its bigrams with what their shard needs to score them."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, "chunk"):
            yield from finish(int(group["chunk"].iloc[0]), group["texts"].iloc[0], group["words"].iloc[0], list(group["counts"].iloc[1:]))

    def finish(number: int, texts: bytes, words: bytes, counts: list[bytes]) -> Iterator[pd.DataFrame]:
        ids, held, sizes, seen, numbers = unpack(texts)
        by_use = np.argsort(-seen.astype(np.int64), kind="stable")
        local = by_use[joined(numbers)]
        hashes = unpacked_set(words)
        count = np.concatenate([unpack(c)[0].astype(np.int64) for c in counts])
        sizes, local = sizes.astype(np.int64), local.astype(np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        log_p = np.log10((count + 1) / (n + v + 1))
        base = np.bincount(text, log_p[local], len(sizes))
        known = np.bincount(text, count[local] > 0, len(sizes)).astype(np.int64)
        names = ["shard", "chunk", "data"]
        yield pd.DataFrame([(-1 - number % shards, number, pack(ids, held, sizes, known, base))], columns=names)

        # the start symbol takes the number after the last word
        k = len(hashes)
        before = np.empty_like(local)
        before[1:] = local[:-1]
        before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = k
        keys, times = np.unique((before * (k + 1) + local) * len(sizes) + text, return_counts=True)
        pair, doc = keys // len(sizes), keys % len(sizes)
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        entries = np.diff(np.append(first, len(pair)))
        u, w = pair[first] // (k + 1), pair[first] % (k + 1)
        context = np.append(hashes, np.uint64(2**63 - 1))[u]
        # as many starts as ends were counted
        ends = count[np.searchsorted(hashes, np.uint64(END_HASH))]
        context_count = np.append(count, ends)[u]
        successor = hashes[w] >> (_LOST - np.uint64(1))
        lots = (1 + context_count // hot).astype(np.uint64)
        shard = ((mixed(context) + successor % lots) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]])) if len(order) else [0]
        starts = first
        for begin, end in zip(cuts[:-1], cuts[1:]):
            own = order[begin:end]
            edge = np.flatnonzero(np.concatenate([[True], u[own][1:] != u[own][:-1]]))
            inside = np.cumsum(entries[own]) - entries[own]
            spread = np.repeat(starts[own] - inside, entries[own]) + np.arange(entries[own].sum())
            used, at = np.unique(w[own], return_inverse=True)
            yield pd.DataFrame([(int(shard[own[0]]), number, pack(
                np.packbits(held), len(held), packed_set(context[own][edge]), narrow(np.diff(np.append(edge, len(own)))), narrow(context_count[own][edge]),
                packed_set(hashes[used] >> (_LOST - np.uint64(1))), planes(np.clip(np.rint(-log_p[used] * PART), 0, 65535).astype(np.int64)),
                planes(gaps(at.astype(np.int64), edge)), narrow(entries[own]), planes(gaps(doc[spread], inside)), narrow(times[spread]), level=3,
            ))], columns=names)

    return deal


class Request:
    """A chunk's bigrams of one shard."""

    def __init__(self, data: bytes):
        (held, texts, contexts, fanout, context_count, used, log_p, at, entries, doc, times) = unpack(data)
        self.contexts = unpacked_set(contexts)
        self.held = np.unpackbits(held)[:texts].astype(bool)
        self.fanout, self.context_count = fanout.astype(np.int64), context_count.astype(np.int64)
        place = from_gaps(joined(at), self.fanout)
        self.successors, self.log_p = unpacked_set(used)[place], joined(log_p)[place] / -float(PART)
        self.entries, self.times = entries.astype(np.int64), times.astype(np.int64)
        self.doc = from_gaps(joined(doc), self.entries)

    def training_counts(self) -> np.ndarray:
        at = np.repeat(np.arange(len(self.entries)), self.entries)
        return np.bincount(at, self.times * ~self.held[self.doc], len(self.entries)).astype(np.int64)


def build(requests: list[Request], prior: float) -> Trie:
    """The trie of all training bigrams of a shard."""
    parts = [(np.repeat(r.contexts, r.fanout), r.successors, r.training_counts(), np.repeat(r.context_count, r.fanout), r.log_p) for r in requests]
    seen = [p[2] > 0 for p in parts]
    context, successor, count, of, log_p = (np.concatenate([p[i][s] for p, s in zip(parts, seen)]) for i in range(5))
    order = np.lexsort((successor, context))
    context, successor = context[order], successor[order]
    new = np.ones(len(order), bool)
    new[1:] = (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])
    first = np.flatnonzero(new)
    count = np.add.reduceat(count[order], first) if len(first) else count
    context, successor, of, log_p = context[first], successor[first], of[order][first], log_p[order][first]
    edge = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    log = np.log10((count + prior * 10**log_p) / (of + prior))
    return Trie(np.frombuffer(Trie.encode(context[edge], np.diff(np.append(edge, len(context))), successor, -log), np.uint8))


def answer(request: Request, trie: Trie, prior: float) -> np.ndarray:
    """The summed log-probability of the request's bigrams for each text of the chunk."""
    hit, value = trie.look_up(request.contexts, request.fanout, request.successors)
    backed_off = np.repeat(np.log10(prior / (request.context_count + prior)), request.fanout) + request.log_p
    log = np.where(hit, -value, backed_off)
    return np.bincount(request.doc, np.repeat(log, request.entries) * request.times, len(request.held))


def _answerer(prior: float):
    def answer_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, "shard"):
            if group["shard"].iloc[0] < 0:
                yield pd.DataFrame({"chunk": group["chunk"], "kind": 0, "data": group["data"]})
                continue
            requests = [Request(d) for d in group["data"]]
            trie = build(requests, prior)
            for number, request in zip(group["chunk"], requests):
                yield pd.DataFrame([(number, 1, pack(answer(request, trie, prior).astype(np.float32)))], columns=["chunk", "kind", "data"])

    return answer_all


def _summer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for group in runs(batches, "chunk"):
        data = list(group["data"])
        ids, held, sizes, known, base = unpack(data[0])
        total = np.zeros(len(sizes))
        for part in data[1:]:
            total += unpack(part)[0]
        yield pd.DataFrame({
            "doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": sizes, "n_known": known, "base_score": base, "score": total,
        })
