"""A two-level n-gram trie in Elias-Fano form.

Level one holds the contexts, level two the successors of all contexts. Both are strictly increasing sequences
(contexts by hash; successors by context rank, then hash), and so are the pointers from contexts to their
successors. An Elias-Fano sequence keeps the low bits of its n values packed and the high bits in unary in a bit
vector of about 2n bits; zeros of that vector bound the values that share their high bits, so the successor of a
value is found within one such bucket. Probabilities are one byte each, a number of steps on a logarithmic scale; the
step is chosen so that the least probability of the trie still has its place, and stands in front of the levels.

All parts lie one after the other in one buffer; a trie is opened on a buffer or a memory-mapped file without
copying. Every query works on whole arrays.
"""

import struct

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
# place of the k-th one of a byte
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)
SUCCESSOR_BITS = 40


class BitVector:
    """Select over ones and zeros, by running counts per 64 bits."""

    def __init__(self, data: np.ndarray):
        self.data = data
        ones = _ONES[data].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the k-th (from 0) one or zero."""
        counts = self.ones if bit else self.zeros
        word = np.searchsorted(counts, k, side="right") - 1
        left = k - counts[word]
        place = word * 8
        for _ in range(7):
            byte = self.data[place]
            here = _ONES[byte if bit else byte ^ 0xFF]
            more = left >= here
            if not more.any():
                break
            left = np.where(more, left - here, left)
            place = place + more
        byte = self.data[place]
        return place * 8 + _PLACE[byte if bit else byte ^ 0xFF, left]


class EliasFano:
    """A non-decreasing sequence of integers below 2**63."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low = n, low_bits, low
        self.high = BitVector(high)
        # eight bytes from any byte on
        self.windows = np.ndarray((max(0, len(low) - 7),), "<u8", buffer=low, strides=(1,)) if len(low) >= 8 else None

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = (n + (top >> bits) + 2 + 63) // 64 * 8
        unary = np.zeros(length, np.uint8)
        np.bitwise_or.at(unary, high >> 3, (1 << (high & 7)).astype(np.uint8))
        return struct.pack("<qqqq", n, bits, n * bits // 8 + 16, length) + _packed(values, bits) + unary.tobytes()

    @classmethod
    def view(cls, data: np.ndarray) -> tuple["EliasFano", np.ndarray]:
        """The sequence at the start of a buffer, and the rest of the buffer."""
        n, bits, low, high = struct.unpack("<qqqq", data[:32].tobytes())
        return cls(n, bits, data[32 : 32 + low], data[32 + low : 32 + low + high]), data[32 + low + high :]

    def low_part(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        return (self.windows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = (self.high.select(i, 1) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.low_part(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element that is not below the value; n if there is none."""
        if not self.n:
            return np.zeros(len(values), np.int64)
        bits = np.uint64(self.low_bits)
        high = (values >> bits).astype(np.int64)
        beyond = high > int(self.high.zeros[-1]) - 1
        high = np.where(beyond, 0, high)
        # elements before the bucket are the ones before its zero
        start = np.where(high > 0, self.high.select(np.maximum(high - 1, 0), 0) - (high - 1), 0)
        end = self.high.select(high, 0) - high
        want = values & np.uint64((1 << self.low_bits) - 1)
        todo = np.flatnonzero(start < end)
        while len(todo):
            mid = (start[todo] + end[todo]) >> 1
            below = self.low_part(mid) < want[todo]
            start[todo] = np.where(below, mid + 1, start[todo])
            end[todo] = np.where(below, end[todo], mid)
            todo = todo[start[todo] < end[todo]]
        return np.where(beyond, self.n, start)


def _packed(values: np.ndarray, bits: int) -> bytes:
    """The low bits of the values, one after the other, and some padding."""
    n = len(values)
    out = np.zeros(n * bits // 8 + 16, np.uint8)
    for start in range(0, n if bits else 0, 1 << 16):  # a multiple of 8 values starts at a whole byte
        part = values[start : start + (1 << 16)]
        grid = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
        data = np.packbits(grid.ravel(), bitorder="little")
        at = start * bits // 8
        out[at : at + len(data)] = data
    return out.tobytes()


class Trie:
    """Contexts (63-bit hashes), their successors (40-bit hashes), and one byte for each successor."""

    def __init__(self, data: np.ndarray):
        (self.step,) = struct.unpack("<d", data[:8].tobytes())
        self.contexts, rest = EliasFano.view(data[8:])
        self.pointers, rest = EliasFano.view(rest)
        self.successors, rest = EliasFano.view(rest)
        self.values = rest[: self.successors.n]

    @staticmethod
    def encode(contexts: np.ndarray, fanout: np.ndarray, successors: np.ndarray, values: np.ndarray, finest: float = 1 / 32) -> bytes:
        """Contexts ascending, with the number of their successors; successors ascending within each context.

        Values from 0 on are kept in steps of ``finest``, or wider ones if the largest value needs them.
        """
        step = max(finest, float(values.max(initial=0)) / 255)
        rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), fanout)
        pointers = np.concatenate([[0], np.cumsum(fanout)]).astype(np.uint64)
        relative = (rank << np.uint64(SUCCESSOR_BITS)) | successors
        parts = (EliasFano.encode(contexts), EliasFano.encode(pointers), EliasFano.encode(relative))
        return struct.pack("<d", step) + b"".join(parts) + np.clip(np.rint(values / step), 0, 255).astype(np.uint8).tobytes()

    @classmethod
    def open(cls, path: str) -> "Trie":
        return cls(np.memmap(path, np.uint8, "r"))

    def look_up(self, contexts: np.ndarray, fanout: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the successors of each context: whether the trie has them, and their values."""
        rank = self.contexts.find(contexts)
        known = rank < self.contexts.n
        known[known] = self.contexts[rank[known]] == contexts[known]
        rank, known = np.repeat(rank, fanout), np.repeat(known, fanout)
        hit = np.zeros(len(successors), bool)
        out = np.zeros(len(successors))
        at = np.flatnonzero(known)
        if len(at):
            want = (rank[at].astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successors[at]
            place = self.successors.find(want)
            inside = (place >= self.pointers[rank[at]].astype(np.int64)) & (place < self.pointers[rank[at] + 1].astype(np.int64))
            same = np.zeros(len(at), bool)
            same[inside] = self.successors[place[inside]] == want[inside]
            hit[at[same]] = True
            out[at[same]] = self.values[place[same]] * self.step
        return hit, out
