"""Golden values for one prediction/gold line."""
import pytest
from pyspark.sql import functions as F

from pairforge.functions import text as T
from pairforge.functions.keywords import JAVA
from pairforge.operators import bleu as B
from pairforge.operators import textmetrics as TM
from pairforge.operators.overlap import ngram_stats, ngram_stats_long

GOLD, PRED = "The cat sat on the mat", "The cat is sitting on the mat"


@pytest.fixture()
def pair(spark):
    return spark.createDataFrame([(1, PRED, GOLD)], "pair_id int, pred string, gold string")


def _stats(pair, tok=T.py_split, max_n=4, keywords=None):
    p = pair.select("pair_id", tok(F.col("pred")).alias("hyp"), F.array(tok(F.col("gold"))).alias("refs"))
    return ngram_stats(p, max_n=max_n, keywords=keywords)


def test_clipped_counts(pair):
    r = _stats(pair).first()
    assert [r.m1, r.m2, r.m3, r.m4] == [5, 3, 1, 0]
    assert r.hyp_len == 7


def test_corpus_bleu(pair):
    assert round(B.corpus_bleu(_stats(pair)).first().bleu, 2) == 41.11


def test_smooth_bleu(pair):
    tok = lambda c: T.nist_normalize(T.split_puncts(F.lower(T.py_strip(c))))
    assert round(B.smooth_bleu_corpus(_stats(pair, tok)).first().bleu, 2) == 40.61


def test_ngram_match(pair):
    assert B.ngram_match(_stats(pair)).first().score == pytest.approx(0.2055668, abs=1e-6)


def test_weighted_ngram_match(pair):
    st = _stats(pair, keywords=JAVA)
    assert B.weighted_ngram_match(st).first().score == pytest.approx(0.2540664, abs=1e-6)


def test_bag_f1(pair):
    r = TM.bag_f1(_stats(pair, T.word_tokens, max_n=1)).first()
    assert (round(r.precision, 6), round(r.recall, 6), round(r.f1, 6)) == (0.714286, 0.833333, 0.769231)


def test_rouge(pair):
    st = _stats(pair)
    assert TM.rouge_n(st, 4, smooth=False).first().rouge_n == pytest.approx(1.7089286, abs=1e-6)
    assert TM.rouge_n(st, 4, smooth=True).first().rouge_n == pytest.approx(1.5863095, abs=1e-6)
    p = pair.select(T.py_split(F.col("pred")).alias("hyp"), T.py_split(F.col("gold")).alias("ref"))
    assert TM.rouge_l(p, smooth=False).first().rouge_l == pytest.approx(0.8333333, abs=1e-6)
    assert TM.rouge_l(p, smooth=True).first().rouge_l == pytest.approx(0.8571429, abs=1e-6)


def test_long_form_equals_array_form(spark):
    rows = [(1, "a b c d a b", ["a b c", "b c d a b x"]), (2, "x y", ["y x", "x y z"]), (3, "", ["q"])]
    arr = spark.createDataFrame([(k, h, r) for k, h, r in rows], "pair_id int, h string, r array<string>")
    a = ngram_stats(arr.select("pair_id", T.py_split("h").alias("hyp"),
                               F.transform("r", lambda x: T.py_split(x)).alias("refs"))).orderBy("pair_id").collect()
    hyps = arr.select("pair_id", T.py_split("h").alias("hyp"))
    refs = arr.select("pair_id", F.posexplode("r").alias("ref_id", "t")).select("pair_id", "ref_id", T.py_split("t").alias("ref"))
    b = ngram_stats_long(hyps, refs).orderBy("pair_id").collect()
    for x, y in zip(a, b):
        for c in ("hyp_len", "ref_min", "ref_closest", "m1", "m2", "m3", "m4", "rm1", "rm2", "rm3", "rm4", "rden2"):
            assert x[c] == y[c], c


def test_empty_prediction_counts_zero(spark):
    df = spark.createDataFrame([(1, "", "a b")], "pair_id int, pred string, gold string")
    r = _stats(df).first()
    assert (r.hyp_len, r.m1, r.ref_min) == (0, 0, 2)


def test_sentence_smoothing_methods(spark):
    """The eight smoothing methods on the classic guide-to-action sentence pair."""
    hyp = "It is a guide to action which ensures that the military always obeys the commands of the party"
    ref = "It is a guide to action that ensures that the military will forever heed Party commands"
    df = spark.createDataFrame([(1, hyp, ref)], "pair_id int, pred string, gold string")
    st = _stats(df, max_n=5)
    expected = [0.4118, 0.4118, 0.4489, 0.4118, 0.4118, 0.4905, 0.4135, 0.4905]
    # the published values are printed prefixes (truncated, not rounded)
    got = [int(B.sentence_bleu(st, smoothing=m).first().score * 10000) / 10000 for m in range(8)]
    assert got == expected


def _py_stats(hyp, refs, max_n=4):
    from collections import Counter

    def grams(t, n):
        return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
    out = {"hyp_len": len(hyp), "ref_min": min(len(r) for r in refs),
           "ref_closest": min((len(r) for r in refs), key=lambda L: (abs(L - len(hyp)), L))}
    for n in range(1, max_n + 1):
        h = grams(hyp, n)
        mx = Counter()
        for r in refs:
            mx |= grams(r, n)
        out[f"m{n}"] = sum((h & mx).values())
        out[f"rm{n}"] = sum(sum((grams(r, n) & h).values()) for r in refs)
    return out


def test_stats_match_python_counters(spark):
    import random
    rnd = random.Random(17)
    rows = []
    for i in range(40):
        hyp = [rnd.choice("abcde") for _ in range(rnd.randint(0, 12))]
        refs = [[rnd.choice("abcde") for _ in range(rnd.randint(0, 12))] for _ in range(rnd.randint(1, 3))]
        rows.append((i, hyp, refs))
    df = spark.createDataFrame(rows, "pair_id int, hyp array<string>, refs array<array<string>>")
    multi = {r.pair_id: r for r in ngram_stats(df).collect()}
    single = {r.pair_id: r for r in ngram_stats(df.select("pair_id", "hyp", F.slice("refs", 1, 1).alias("refs")),
                                                   single_ref=True).collect()}
    for i, hyp, refs in rows:
        for got, rs in ((multi[i], refs), (single[i], refs[:1])):
            exp = _py_stats(hyp, rs)
            assert {k: got[k] for k in exp} == exp, (i, hyp, rs)
