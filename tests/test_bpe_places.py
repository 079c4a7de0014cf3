"""Merges are replayed on arrays of places; words that fit the bound are fetched once."""
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
    return out, [s for s, _ in words]


def _some(r, alphabet, n):
    return {"".join(r.choice(alphabet) for _ in range(r.randint(2, 14))): r.randint(1, 5) for _ in range(n)}


def test_replay_is_one_merge_at_a_time(monkeypatch):
    monkeypatch.setattr(BR, "_CHUNK", 50)
    for seed in range(60):
        r = random.Random(seed)
        counts = _some(r, ("ab", "abcdé😀", "aab")[seed % 3], r.randint(1, 60))
        words = BR.Words(BR._runs([pa.array([list(w)], pa.list_(pa.string())) for w in counts]), BR.Names(), np.array(list(counts.values()), np.int64))
        got = BR.Replay(words, set("".join(counts))).run(500, 2)
        assert (got, words.symbols().to_pylist()) == _plain(counts, 500, 2)


def test_characters_bound_a_round(spark):
    counts = _some(random.Random(1), "abcde", 200)
    df = spark.createDataFrame(list(counts.items()), "token string, count long")
    log = []
    got = [tuple(x)[1:] for x in BR.learn(df, 40, chars=700, log=log).orderBy("rank").collect()]
    assert got == _plain(counts, 40, 3)[0] and len(log) > 1


def test_more_words_than_before_take_one_round(spark):
    df = spark.range(250_000).selectExpr("concat(id % 500, 'x', id div 500) as token", "1 + id % 3 as count")
    log = []
    assert BR.learn(df, 12, log=log).count() == 12
    assert log == [(12, 250_000)]


def test_short_words_like_long_ones(monkeypatch):
    r = random.Random(8)
    for _ in range(300):
        symbols, ranks = list("abc"), {}
        for k in range(r.randint(1, 25)):
            a, b = r.choice(symbols), r.choice(symbols)
            ranks.setdefault((a, b), k)
            symbols.append(a + b)
        word = "".join(r.choice("abc") for _ in range(r.randint(0, 40)))
        monkeypatch.setattr(EN, "_SHORT", -1)
        long = EN.bpe_word(word, ranks)
        monkeypatch.setattr(EN, "_SHORT", 48)
        assert EN.bpe_word(word, ranks) == long
