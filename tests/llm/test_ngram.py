import numpy as np
import pytest

from logspark.llm.ngram import SUCCESSOR_BITS, EliasFano, Trie


@pytest.mark.parametrize("n, top", [(0, 10), (1, 1), (1, 2**62), (9, 4), (1000, 50), (5000, 2**63 - 1), (70000, 10**9), (300, 2**20)])
def test_sequence_against_plain_search(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    data = np.frombuffer(EliasFano.encode(values) + b"rest", np.uint8)
    seq, rest = EliasFano.view(data)
    assert rest.tobytes() == b"rest"
    if n:
        assert (seq[np.arange(n)] == values).all()
    asked = np.concatenate([values, rng.integers(0, 2**63 - 1, 2000, dtype=np.uint64), values + np.uint64(1), np.arange(5, dtype=np.uint64)])
    assert (seq.find(asked) == np.searchsorted(values, asked)).all()


def test_trie_round_trip(tmp_path):
    rng = np.random.default_rng(0)
    contexts = np.unique(rng.integers(0, 2**63 - 1, 400, dtype=np.uint64))
    lists = [np.unique(rng.integers(0, 2**SUCCESSOR_BITS, rng.integers(1, 200 if i else 9000), dtype=np.uint64)) for i in range(len(contexts))]
    fanout = np.array([len(x) for x in lists])
    values = rng.integers(0, 256, fanout.sum()) / 32
    data = Trie.encode(contexts, fanout, np.concatenate(lists), values)
    (tmp_path / "trie").write_bytes(data)
    for trie in (Trie(np.frombuffer(data, np.uint8)), Trie.open(str(tmp_path / "trie"))):
        hit, got = trie.look_up(contexts, fanout, np.concatenate(lists))
        assert hit.all() and (got == values).all() and trie.step == 1 / 32
        other = np.sort(rng.integers(0, 2**63 - 1, 50, dtype=np.uint64))
        hit, _ = trie.look_up(np.concatenate([other, contexts[:3]]), np.full(53, 4), rng.integers(0, 2**SUCCESSOR_BITS, 212, dtype=np.uint64))
        assert not hit.any()
    empty = Trie(np.frombuffer(Trie.encode(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0)), np.uint8))
    assert not empty.look_up(contexts, fanout, np.concatenate(lists))[0].any()


def test_the_step_widens_for_small_probabilities():
    contexts, fanout, successors = np.array([5], np.uint64), np.array([3]), np.array([1, 2, 3], np.uint64)
    values = np.array([0.0, 6.0, 20.4])
    trie = Trie(np.frombuffer(Trie.encode(contexts, fanout, successors, values), np.uint8))
    hit, got = trie.look_up(contexts, fanout, successors)
    assert hit.all() and np.abs(got - values).max() <= trie.step / 2 and got[2] == 20.4
