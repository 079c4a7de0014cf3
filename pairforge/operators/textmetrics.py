"""Text-pair metrics beyond BLEU.

All corpus scores are sums of per-pair values (partial aggregation map-side).
Only the LCS of ROUGE-L needs Python: an Arrow-batched pandas UDF running a
bit-parallel LCS (O(n * m / word) per pair) on each executor.
"""
from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pairforge.functions.text import py_strip
from pairforge.operators.bleu import _group
from pairforge.operators.overlap import possible


# ---------------------------------------------------------------- B13 / D13
def exact_match(pred, gold) -> Column:
    """``pred.strip() == gold.strip()`` as 0/1."""
    return (py_strip(pred) == py_strip(gold)).cast("int")


def exact_match_rate(pairs: DataFrame, pred: str = "pred", gold: str = "gold", group_cols: Sequence[str] = (),
                     rollup: bool = False) -> DataFrame:
    """Mean exact match x 100."""
    em = exact_match(F.col(pred), F.col(gold))
    return _group(pairs.select(*group_cols, em.alias("_em")), group_cols, rollup).agg(
        F.count(F.lit(1)).alias("n_pairs"), (F.avg("_em") * 100.0).alias("em"))


def post_process(pred, label) -> Column:
    """Strip both; the label becomes a one-element reference list."""
    return F.struct(py_strip(pred).alias("pred"), F.array(py_strip(label)).alias("refs"))


# ---------------------------------------------------------------- D10
def bag_f1(stats: DataFrame, group_cols: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """D10 (reported as "METEOR" by the reference): unigram bag precision/recall per
    pair (0 on an empty side), averaged over pairs; F1 of the means, 0 if either is 0.

    ``stats`` must come from ``ngram_stats(..., max_n=1)`` over ``word_tokens``
    with one reference per pair.
    """
    p = F.when(F.col("hyp_len") > 0, F.col("m1") / F.col("hyp_len")).otherwise(F.lit(0.0))
    r = F.when(F.col("ref_min") > 0, F.col("m1") / F.col("ref_min")).otherwise(F.lit(0.0))
    g = _group(stats.select(*group_cols, p.alias("_p"), r.alias("_r")), group_cols, rollup).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("_p").alias("precision"), F.avg("_r").alias("recall"))
    f1 = F.when((F.col("precision") == 0) | (F.col("recall") == 0), F.lit(0.0)).otherwise(
        2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return g.select(*group_cols, "n_pairs", "precision", "recall", f1.alias("f1"))


# ---------------------------------------------------------------- D11
def rouge_n(stats: DataFrame, max_order: int = 2, smooth: bool = False, compat: bool = True,
            group_cols: Sequence[str] = (), rollup: bool = False, both: bool = False) -> DataFrame:
    """ROUGE-N.

    ``compat=True`` reproduces the reference: the overlap of **all** orders is
    added to every order slot and the possible count of 0-based order ``o`` is
    ``max(ref_len - o + 1, 0)``, so values can exceed 1.  ``compat=False`` is the
    usual per-order recall.  ``both=True`` returns ``rouge_n_compat`` and
    ``rouge_n`` from one aggregation.  Needs ``ngram_stats`` with ``max_n >= max_order``.
    """
    def ratio(m, p):
        return (m + 1.0) / (p + 1.0) if smooth else F.when(p > 0, m / p).otherwise(F.lit(0.0))

    aggs = [F.count(F.lit(1)).alias("n_pairs"), F.sum(sum(F.col(f"rm{n}") for n in range(1, max_order + 1))).alias("_ov")]
    for o in range(max_order):
        # possible matches of 0-based order o: sum over refs of max(len - o + 1, 0)
        aggs.append(F.sum((F.col("rposs1") + F.col("n_refs")) if o == 0 else F.col(f"rposs{o}")).alias(f"_p{o}"))
    for n in range(1, max_order + 1):
        aggs += [F.sum(f"rm{n}").alias(f"_m{n}"), F.sum(f"rposs{n}").alias(f"_q{n}")]
    g = _group(stats, group_cols, rollup).agg(*aggs)
    comp = sum(ratio(F.col("_ov"), F.col(f"_p{o}")) for o in range(max_order)) / max_order
    std = sum(ratio(F.col(f"_m{n}"), F.col(f"_q{n}")) for n in range(1, max_order + 1)) / max_order
    if both:
        return g.select(*group_cols, "n_pairs", comp.alias("rouge_n_compat"), std.alias("rouge_n"))
    return g.select(*group_cols, "n_pairs", (comp if compat else std).alias("rouge_n"))


# ---------------------------------------------------------------- D12
def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def _lcs_batch(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(r) if r is not None else [], list(h) if h is not None else [])
                      for r, h in zip(ref, hyp)], dtype="int64")


_UDFS: dict = {}


def lcs_udf(ref, hyp) -> Column:
    """Arrow-batched LCS length of two token-array columns (built on first use)."""
    if "lcs" not in _UDFS:
        _UDFS["lcs"] = pandas_udf(_lcs_batch, "long")
    return _UDFS["lcs"](ref, hyp)


def rouge_l(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref", smooth: bool = True,
            group_cols: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """Micro recall of the LCS length: sum LCS / sum reference length ((+1)/(+1) if smooth).

    ``pairs`` holds one row per (hypothesis, reference) with token arrays.
    """
    per = pairs.select(*group_cols, lcs_udf(F.col(ref), F.col(hyp)).alias("_lcs"), F.size(ref).alias("_rl"))
    g = _group(per, group_cols, rollup).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("_lcs").alias("lcs"),
                                            F.sum("_rl").alias("ref_tokens"))
    score = ((F.col("lcs") + 1.0) / (F.col("ref_tokens") + 1.0)) if smooth else \
        F.when(F.col("ref_tokens") > 0, F.col("lcs") / F.col("ref_tokens")).otherwise(F.lit(0.0))
    return g.select(*group_cols, "n_pairs", "lcs", "ref_tokens", score.alias("rouge_l"))
