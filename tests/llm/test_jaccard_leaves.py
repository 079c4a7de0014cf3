"""Leaves hold few unrelated sets: parts of many shingles come first, empty ones last."""
import numpy as np
import pytest

jaccard = pytest.importorskip("pairforge.llm.jaccard")


def _sets(rows):
    rows = [np.unique(x) for x in rows]
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])


def test_unrelated_sets_share_no_leaf():
    """Of two equal shingles in sets of the same band (and of parts that both leave empty) no leaf is made."""
    r = np.random.default_rng(3)
    bands = jaccard.Bands(80, 100)
    common = r.integers(0, (1 << 64) - 1, 2, dtype=np.uint64)
    h, offs = _sets([np.concatenate([r.integers(0, (1 << 64) - 1, n, dtype=np.uint64), common]) for n in r.integers(200, 400, 500)])
    row, key = jaccard.leaves(h, offs, bands)
    _, members = np.unique(key, return_counts=True)
    assert members.max() < 5 and members[members > 1].sum() < len(key) / 1000  # 26, and 2,677 of 71,401, when every filled part was a leaf
    for rows, band in bands.of(np.diff(offs)):
        assert (bands.differing(np.diff(offs)[rows], band) <= bands.most[band]).all()


def test_first_parts_are_the_fullest():
    r = np.random.default_rng(4)
    of = np.repeat(np.arange(30), r.integers(0, 25, 30))
    key, load, need = r.integers(0, 1 << 63, len(of), dtype=np.uint64), r.integers(1, 30, len(of)), r.integers(1, 12, 30)
    kept = jaccard._first(key, of, load, need)
    for i in range(30):
        order = sorted(np.flatnonzero(of == i).tolist(), key=lambda j: (-min(load[j], jaccard.LOADS), key[j]))
        assert set(np.flatnonzero(kept & (of == i)).tolist()) == set(order[:need[i]])


@pytest.mark.parametrize("threshold", [(80, 100), (85, 100), (1, 2)])
def test_linked_sets_share_a_leaf_at_every_size(threshold):
    r = np.random.default_rng(5)
    num, den = threshold
    bands, met = jaccard.Bands(num, den), 0
    for n in [2, 3, 4, 5, 6, 9, 10, 14, 15, 16, 21, 22, 33, 75, 200, 900]:
        for _ in range(60):
            a = np.unique(r.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
            most = len(a) * (den - num) // den
            cut = int(r.integers(0, most + 1))
            b = np.unique(np.concatenate([a[r.permutation(len(a))[cut:]], r.integers(0, (1 << 64) - 1, int(r.integers(0, most + 2)), dtype=np.uint64)]))
            o = len(np.intersect1d(a, b))
            if not len(b) or den * o < num * (len(a) + len(b) - o) or len(a) == len(b) == o:
                continue
            row, key = jaccard.leaves(*_sets([a, b]), bands)
            assert set(key[row == 0].tolist()) & set(key[row == 1].tolist()), (n, len(a), len(b), o)
            met += 1
    assert met > 100
