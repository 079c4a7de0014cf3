"""Rounds fetch chains of the leading pairs, tokens are counted where they stand."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pairforge.operators import bpe_rounds as BR
from pairforge.operators import encode as EN


def _plain(counts, most, least):
    words, out = [(list(w), c) for w, c in counts.items()], []
    while len(out) < most:
        n = Counter()
        for s, c in words:
            for p in zip(s, s[1:]):
                n[p] += c
        p = min(n, key=lambda p: (-n[p], p), default=None)
        if p is None or n[p] < least:
            break
        out.append((*p, n[p]))
        for s, _ in words:
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == p:
                    s[i:i + 2] = [s[i] + s[i + 1]]
                i += 1
    return out


def _learned(spark, counts, most, **bounds):
    log = []
    df = spark.createDataFrame(list(counts.items()), "token string, count long")
    got = [tuple(x)[1:] for x in BR.learn(df, most, log=log, **bounds).orderBy("rank").collect()]
    assert all(n <= bounds["words"] for _, n in log)
    return got, log


def test_many_words_take_few_rounds(spark):
    """Words that hold a leading pair are eight times the bound; their chains are not."""
    r = random.Random(2)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    counts = {"".join(r.choice(parts) for _ in range(r.randint(2, 5))): r.randint(1, 9) for _ in range(6000)}
    got, log = _learned(spark, counts, 60, words=500)
    assert got == _plain(counts, 60, 3)
    assert len(counts) > 4000 and len(log) < 15 and len(log) < len(got) / 4


def test_a_round_ends_after_a_symbol_that_was_there():
    """Its pairs may stand in chains and elsewhere."""
    def replay(symbols, bar):
        lists = [pa.array([list("abcab"), list("cab"), list("bcbc")], pa.list_(pa.string()))]
        return BR.Replay(BR.Words(lists, BR.Names(), np.array([5, 4, 3])), set(symbols), bar).run(9, 1)

    want = [("a", "b", 14), ("c", "ab", 9), ("b", "c", 6), ("ab", "cab", 5), ("bc", "bc", 3)]
    assert replay("abc", None) == replay(["a", "b", "c", "ab"], None) == replay("abc", 0) == want
    assert replay(["a", "b", "c", "cab"], 0) == want[:2] and replay("abc", 5) == want[:3] and replay("abc", 6) == want[:2]


def test_long_runs_and_few_chains(spark):
    for seed, alphabet in ((1, "aab"), (4, "aaab")):
        r = random.Random(seed)
        counts = {"".join(r.choice(alphabet) for _ in range(r.randint(5, 30))): r.randint(1, 9) for _ in range(120)}
        assert _learned(spark, counts, 40, words=50)[0] == _plain(counts, 40, 3)


def test_chains_are_the_runs_of_leading_pairs():
    first, last = BR._chain_cuts(np.array([0, 1, 1, 0, 0, 1, 0, 1, 0], bool))
    assert (first.tolist(), last.tolist()) == ([1, 5, 7], [3, 6, 8])
    first, last = BR._chain_cuts(np.zeros(0, bool))
    assert len(first) == len(last) == 0


def test_pairs_in_order_like_a_stable_sort(monkeypatch):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 9, 500).astype(np.int32), r.integers(0, 9, 500).astype(np.int32)
    quick = BR._by_pair(a, b)
    monkeypatch.setattr(BR, "_BITS", 3)  # numbers and places that don't fit
    for x, y in zip(quick, BR._by_pair(a, b)):
        assert x.tolist() == y.tolist()


def test_counts_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(EN, "_HELD_COUNTS", 3)
    df = spark.createDataFrame([(["a", "b", "a", None],), ([],), (None,), (["c", "a", "", "d", "e"],), ([None, "b"],)], "t array<string>")
    got = EN.vocab_counts(df, "t", 1)
    assert got.columns == ["token", "count"] and {tuple(x) for x in got.collect()} == {("a", 3), ("b", 2), (None, 2), ("c", 1), ("", 1), ("d", 1), ("e", 1)}
    assert {tuple(x) for x in EN.vocab_counts(df, "t", 3).collect()} == {("a", 3)}
    assert EN.vocab_counts(df.limit(0), "t", 1).count() == 0
