"""Words of a text as bytes. Every delimiter is ASCII, so UTF-8 bytes split exactly like code points."""

import numpy as np

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes.maketrans(_UPPER, _LOWER)
#: The same, and turns every ASCII byte that is no digit or letter into a space.
ALNUM = bytes(
    LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def spaced(text: str | None) -> list[bytes]:
    """Lower-cased runs without white space (space, tab to carriage return)."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def alphanumeric(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and anything outside ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound so that each frequent word is hashed once."""

    def __init__(self, most: int = 100_000):
        self.most, self.ids = most, {}
        self.values = np.empty(1024, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.ids) > self.most:
            self.ids = {}
        ids = self.ids
        try:
            at = [ids[w] for w in words]
        except KeyError:
            for w in words:
                if w not in ids:
                    if len(ids) == len(self.values):
                        self.values = np.concatenate([self.values, np.empty_like(self.values)])
                    self.values[len(ids)] = xxhash.xxh3_64_intdigest(w)
                    ids[w] = len(ids)
            at = [ids[w] for w in words]
        return self.values[np.asarray(at, np.int64)]


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words; a shorter text is one run, no words are none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
    return np.unique(out)
