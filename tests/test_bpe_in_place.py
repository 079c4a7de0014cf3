"""Pieces are found where the tokens stand."""
from pairforge.operators import encode as EN


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bpe_encode_does_not_shuffle_tokens(spark):
    d = spark.createDataFrame([(1, ["abab", "<s>", None, "b"]), (1, ["abab"]), (None, ["ab"]), (3, []), (4, None)], "k long, t array<string>")
    merges = spark.createDataFrame([(0, "a", "b"), (1, "ab", "ab"), (2, "a", "b"), (3, "<", "s")], "rank int, left string, right string")
    out = EN.bpe_encode(d, "k", "t", merges, ["<s>"])
    assert out.columns == ["token", "k", "pos", "pieces"] and "Exchange" not in _plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        ("abab", 1, 0, ["abab"]), ("<s>", 1, 1, ["<s>"]), ("b", 1, 3, ["b"]), ("abab", 1, 0, ["abab"]), ("ab", None, 0, ["ab"])], key=str)
