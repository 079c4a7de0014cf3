import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pairforge.llm import _components, jaccard


def shingles(t, k=4):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    least = {}
    for x, (d, _) in enumerate(docs):
        least[find(x)] = min(least.get(find(x), d), d)
    return sorted((d, len(sets[x]), least[find(x)]) for x, (d, _) in enumerate(docs))


def ran(spark, docs):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id bigint, text string, s1 int, component_id string")
    return sorted((r.id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())


def edited(r, words, edits):
    w = list(words)
    for _ in range(edits):
        p = r.randrange(len(w))
        kind = r.random()
        if kind < 0.6:
            w[p] = f"z{r.randrange(10 ** 6)}"
        elif kind < 0.8:
            w.insert(p, f"y{r.randrange(10 ** 6)}")
        else:
            w.append(f"t{r.randrange(10 ** 6)}")
    return w


@pytest.mark.parametrize("small", [True, False])
def test_groups_at_the_threshold_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "BLOCK", 5)  # blocks within leaves are exercised too
    if not small:  # the ways beyond the bounds of broadcast and one-task tables and of families
        monkeypatch.setattr(jaccard, "FAMILY", 1)
        monkeypatch.setattr(jaccard, "SENT_POINTS", -1)
        monkeypatch.setattr(jaccard, "SENT_PAIRS", -1)
        monkeypatch.setattr(_components, "ONE_TASK", -1)
    r = random.Random(11)
    docs = []
    for g, size in enumerate([6, 7, 9, 12, 14, 20, 30, 45, 60, 90, 200, 400]):
        base = [f"w{g}_{i}" for i in range(size)]
        docs.append((len(docs) * 7 % 1009, " ".join(base)))
        last = base
        for _ in range(14):
            last = edited(r, last if r.random() < 0.5 else base, r.randint(0, max(1, size // 50)))
            docs.append((len(docs) * 7 % 1009, r.choice([" ", "\n", "  "]).join(x.upper() if r.random() < 0.1 else x for x in last)))
    docs += [(2000, None), (2001, ""), (2002, " \t"), (2003, "a b"), (2004, "A  b"), (2005, "a b c"), (1999, "a b"),
             (2006, "a b c d"), (2007, "a b c d e"), (docs[3][0], docs[3][1])]
    docs += [(3000 + i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12)))) for i in range(60)]
    want = brute(docs)
    assert ran(spark, docs) == want
    sizes = [sum(x[2] == c for x in want) for c in {x[2] for x in want}]
    assert max(sizes) > 5 and sizes.count(1) > 20


def test_empty_table(spark):
    assert ran(spark, []) == []
    assert ran(spark, [(5, None)]) == [(5, 0, 5)]


def test_leaf_guarantee():
    """Any linked pair shares a leaf: the filter loses nothing, at any size."""
    r = np.random.default_rng(2)
    bands = jaccard.Bands(85, 100)
    for n in [5, 6, 7, 8, 11, 12, 13, 18, 27, 28, 60, 150, 700, 3000]:
        for _ in range(30):
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            cut, add = r.integers(0, n // 8 + 2, 2)
            b = np.concatenate([a[cut:], r.integers(0, 1 << 63, add, dtype=np.uint64)])
            a.sort(), b.sort()
            o = len(np.intersect1d(a, b))
            if not len(b) or 100 * o < 85 * (len(a) + len(b) - o) or len(a) == len(b) == o:
                continue
            row, key = jaccard.leaves(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
            assert set(key[row == 0]) & set(key[row == 1]), (n, cut, add)


def test_bound_is_never_below_the_overlap():
    t = pa.array([" ".join(f"w{i % 300}" for i in range(3, 900, 2)), " ".join(f"w{i}" for i in range(300)), "a " * 50, None])
    h, offs = jaccard.shingle_sets(t, 4)
    p = [jaccard._point(x) for x in jaccard.points(h, offs)]
    for i in range(4):
        for j in range(4):
            o = len(np.intersect1d(h[offs[i]:offs[i + 1]], h[offs[j]:offs[j + 1]]))
            assert jaccard._overlap(p[i], p[j]) >= o
    assert list(np.diff(offs)) == [len(shingles(x.as_py())) for x in t]


@pytest.mark.parametrize("one_task", [200_000, -1])
def test_components_of_chains_stars_and_rings(spark, monkeypatch, one_task):
    monkeypatch.setattr(_components, "ONE_TASK", one_task)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5), (300, 299)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {x.node: x.comp for x in _components.components(spark, df).collect()}
    want = {i: 0 for i in range(41)} | {x: 100 for x in range(100, 130)} | {x: 200 for x in range(200, 209)} | {299: 299, 300: 299}
    assert got == want
    assert _components.components(spark, df.limit(0)).count() == 0


def test_a_refused_best_pair_hides_no_link(spark, monkeypatch):
    """P-Q link and L-Q do not, though L-Q's bound is no lower: in every order of the hashes all three are one component."""
    for seed in range(3):
        long = [f"l{seed}x{i}" for i in range(599)]
        more = long + [f"p{seed}"]
        edited_more = list(more)
        for i in range(12):
            edited_more[20 + 45 * i] = f"q{seed}x{i}"
        docs = [(0, " ".join(long)), (1, " ".join(more)), (2, " ".join(edited_more))]
        want = brute(docs)
        assert [x[2] for x in want] == [0, 0, 0]
        assert ran(spark, docs) == want


def test_a_leaf_of_unlinked_near_copies(spark):
    """Thousands of texts that share a leaf but don't link: nothing links, and no table grows with their pairs."""
    r = random.Random(13)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(1500):
        w = list(base)
        for p in r.sample(range(4, 56, 8), 3):
            w[p] = f"z{i}x{p}"
        docs.append((i, " ".join(w)))
    docs += [(5000 + i, docs[i][1]) for i in range(0, 60, 2)]
    assert ran(spark, docs) == brute(docs)


def test_texts_without_ids_link_others(spark):
    base = [f"w{i}" for i in range(100)]
    a, b, c = " ".join(base), " ".join(base + ["x1"]), " ".join(base[10:] + [f"y{i}" for i in range(4)])
    df = spark.createDataFrame([(7, a), (None, b), (None, b), (9, c), (None, "alone in this world here")], "doc_id bigint, text string")
    got = sorted(((r.id, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert (7, 7) in got and got.count((None, 7)) == 2 and got.count((None, None)) == 1
