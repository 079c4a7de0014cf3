"""Short words are encoded many at a time, with the same pieces as one by one."""
import random

import pyarrow as pa

from pairforge.operators import encode as EN


def _ranks(r, alphabet, n):
    symbols, ranks = list(alphabet), {}
    for k in r.sample(range(-n, 9 * n), n):  # in any order: a merge may make a pair of a lower rank
        a, b = r.choice(symbols), r.choice(symbols)
        ranks.setdefault((a, b), k)
        symbols.append(a + b)
    return ranks


def test_many_words_at_once_like_one_by_one():
    for seed in range(40):
        r = random.Random(seed)
        alphabet = ("abc", "aé😀z", "ab")[seed % 3]
        ranks = _ranks(r, alphabet, r.randint(1, 60))
        words = ["".join(r.choice(alphabet + "x") for _ in range(r.randint(1, 40))) for _ in range(200)] + ["a" * n for n in range(1, 48)]
        assert EN._Merges.fit(ranks)
        got = EN._Merges(ranks).pieces(pa.array(words))
        assert got.to_pylist() == [EN.bpe_word(w, ranks) for w in words]


def test_few_words_are_worked_on_one_by_one(monkeypatch):
    """Only long, empty and special words are (all were, at 8 microseconds or more a word)."""
    ranks, alone = {("a", "b"): 0, ("ab", "ab"): 1}, []
    one = EN.bpe_word
    monkeypatch.setattr(EN, "bpe_word", lambda w, t: alone.append(w) or one(w, t))
    words = [f"abab{i}" for i in range(1000)] + ["", "ab" * 40, "abab"]
    got = EN._pieces(pa.array(words), EN._Merges(ranks), ranks, frozenset(["abab"])).to_pylist()
    assert alone == ["", "ab" * 40]
    assert got[:2] == [["abab", "0"], ["abab", "1"]] and got[-3:] == [[], ["abab"] * 20, ["abab"]]


def test_tables_without_an_order_and_empty_ones(spark):
    texts = spark.createDataFrame([(1, ["abab", "", "b", None]), (2, [])], "k long, t array<string>")
    same = spark.createDataFrame([(0, "a", "b"), (0, "b", "a")], "rank int, left string, right string")
    for merges, first in ((same, ["ab", "ab"]), (same.limit(0), list("abab"))):
        got = {r.pos: r.pieces for r in EN.bpe_encode(texts, "k", "t", merges).collect()}
        assert got == {0: first, 1: [], 2: ["b"]}


def test_kept_words_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(EN, "_KEPT_WORDS", 4)
    known, asked = EN._Known(), []

    def encoded(some):
        asked.append(some.to_pylist())
        return pa.array([list(w) for w in some.to_pylist()], pa.list_(pa.string()))

    for run in (["ab", "c", "ab"], ["c", "de", "c"], [], ["f", "ab"], ["g", "de"], ["f", "g"], ["c"]):
        got = known.pieces(pa.array(run, pa.string()).dictionary_encode(), encoded)
        assert got.to_pylist() == [list(w) for w in run]
    assert asked == [["ab", "c"], ["de"], ["f"], ["g"], ["f"], ["c"]]  # at the fifth word those of the run stay
