"""BLEU family over per-pair n-gram statistics.

Inputs are the output of :func:`pairforge.operators.overlap.ngram_stats`.
Every corpus score is a sum of per-pair counts (associative, so Spark's
partial aggregation runs map-side) followed by a few lines of column
arithmetic on the one aggregated row per group.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators.overlap import possible

# fixed value: sys.float_info.min == java.lang.Double.MIN_NORMAL
FLOAT_MIN = 2.2250738585072014e-308


def _group(df: DataFrame, group_cols: Sequence[str], rollup: bool):
    if not group_cols:
        return df.groupBy()
    return df.rollup(*group_cols) if rollup else df.groupBy(*group_cols)


STAT_COLS = re.compile(r"(w?r?m|rden|rposs|wden)\d+|ref_min|ref_closest|n_refs")


def passthrough(stats: DataFrame) -> list[str]:
    """Columns of a stats frame that are not n-gram statistics."""
    return [c for c in stats.columns if not STAT_COLS.fullmatch(c)]


# ---------------------------------------------------------------- D3
def corpus_bleu(stats: DataFrame, group_cols: Sequence[str] = (), max_n: int = 4, smooth: bool = True,
                rollup: bool = False) -> DataFrame:
    """D3: corpus BLEU with merged (max) reference counts and shortest reference length.

    Returns ``group_cols, n_pairs, bleu`` where bleu is on the 0-100 scale.
    """
    g = _group(stats, group_cols, rollup).agg(F.count(F.lit(1)).alias("n_pairs"), *_corpus_sums(max_n))
    return g.select(*group_cols, "n_pairs", _corpus_score(max_n, smooth).alias("bleu"))


def _corpus_sums(max_n: int) -> list[Column]:
    aggs = [F.sum("hyp_len").alias("_tl"), F.sum("ref_min").alias("_rl")]
    for n in range(1, max_n + 1):
        aggs += [F.sum(f"m{n}").alias(f"_m{n}"), F.sum(possible(F.col("hyp_len"), n)).alias(f"_p{n}")]
    return aggs


def _corpus_score(max_n: int, smooth: bool) -> Column:
    precs = []
    for n in range(1, max_n + 1):
        m, p = F.col(f"_m{n}"), F.col(f"_p{n}")
        precs.append(((m + 1.0) / (p + 1.0)) if smooth else F.when(p > 0, m / p).otherwise(F.lit(0.0)))
    geo = F.when(F.least(*precs) > 0, F.exp(sum(F.log(x) for x in precs) / max_n)).otherwise(F.lit(0.0)) if max_n > 1 else \
        F.when(precs[0] > 0, precs[0]).otherwise(F.lit(0.0))
    ratio = F.try_divide("_tl", "_rl")
    bp = F.when(ratio > 1.0, F.lit(1.0)).when(ratio > 0, F.exp(1.0 - 1.0 / ratio)).otherwise(F.lit(0.0))
    return F.when(F.col("_rl") > 0, geo * bp * 100.0)


def pair_scores(stats: DataFrame, weighted: bool = False, weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """D3, D5 and, with ``weighted``, D6 of all pairs out of one aggregate over the statistics:
    ``n_pairs, bleu, ngram_match[, weighted_ngram_match]``."""
    n = len(weights)
    aggs = [F.count(F.lit(1)).alias("n_pairs"), *_corpus_sums(n), *_match_sums(n), *(_weighted_sums(n, True) if weighted else [])]
    g = stats.agg(*aggs)
    out = [F.col("n_pairs"), _corpus_score(n, True).alias("bleu"), _bleu_from_sums(g, n, weights, 1, False).alias("ngram_match")]
    if weighted:
        out.append(_bleu_from_sums(g, n, weights, 1, False, "_wn", "_wd", "_wh", "_wr").alias("weighted_ngram_match"))
    return g.select(*out)


# ---------------------------------------------------------------- D4
def sentence_smooth_bleu(stats: DataFrame, max_n: int = 4, smooth: bool = True) -> DataFrame:
    """D4 per pair: ``[bleu, p1..pN]`` of the smoothed NIST-style sentence BLEU.

    Smoothing adds one to numerator and denominator for orders >= 2 only;
    brevity ``min(0, 1 - (reflen+1)/(testlen+1))`` only enters the combined score.
    """
    log_terms = []
    ps = []
    for n in range(1, max_n + 1):
        correct = F.col(f"m{n}").cast("double")
        guess = possible(F.col("hyp_len"), n).cast("double")
        add = 1.0 if (smooth and n > 1) else 0.0
        log_terms.append(F.log(correct + add + FLOAT_MIN) - F.log(guess + add + FLOAT_MIN))
        ps.append(F.when(guess == 0, F.lit(0.0)).otherwise(F.exp(F.log(correct + FLOAT_MIN) - F.log(guess))).alias(f"p{n}"))
    reflen = F.col("ref_min")
    brev = F.least(F.lit(0.0), 1.0 - (reflen + 1.0) / (F.col("hyp_len") + 1.0))
    bleu = F.exp(sum(log_terms) / max_n + brev)
    return stats.select(*passthrough(stats), bleu.alias("bleu"), *ps)


def smooth_bleu_corpus(stats: DataFrame, group_cols: Sequence[str] = (), max_n: int = 4, rollup: bool = False) -> DataFrame:
    """D4 corpus form (``bleuFromMaps``): macro mean of sentence scores x 100."""
    per = sentence_smooth_bleu(stats, max_n)
    aggs = [F.count(F.lit(1)).alias("n_pairs"), (F.avg("bleu") * 100.0).alias("bleu")]
    aggs += [(F.avg(f"p{n}") * 100.0).alias(f"p{n}") for n in range(1, max_n + 1)]
    return _group(per, group_cols, rollup).agg(*aggs)


# ---------------------------------------------------------------- D5 / D7
def _smooth(method: int, nums: list[Column], dens: list[Column], hyp_total: Column, epsilon: float = 0.1, k: int = 5):
    """D7 corpus-level smoothing (methods 0-4): returns precision columns."""
    out = []
    if method == 0:
        return [F.when(nm != 0, nm / dn).otherwise(F.lit(FLOAT_MIN)) for nm, dn in zip(nums, dens)]
    if method == 1:
        return [F.when(nm == 0, (nm + epsilon) / dn).otherwise(nm / dn) for nm, dn in zip(nums, dens)]
    if method == 2:
        return [(nm + 1.0) / (dn + 1.0) for nm, dn in zip(nums, dens)]
    if method == 3:
        # k-th zero-count order gets 1 / (2^k * denominator)
        zeros_before = F.lit(0)
        for nm, dn in zip(nums, dens):
            inc = zeros_before + 1
            out.append(F.when(nm == 0, 1.0 / (F.pow(F.lit(2.0), inc) * dn)).otherwise(nm / dn))
            zeros_before = zeros_before + F.when(nm == 0, 1).otherwise(0)
        return out
    if method == 4:
        for i, (nm, dn) in enumerate(zip(nums, dens)):
            # ln of a one-token hypothesis is 0: it has no increment and stays unsmoothed
            inc = i + F.try_divide(F.lit(float(k)), F.log(hyp_total))
            out.append(F.when((nm == 0) & (hyp_total > 1), inc / dn).otherwise(nm / dn))
        return out
    raise ValueError("corpus-level smoothing supports methods 0-4; 5-7 look at one hypothesis (use sentence_bleu)")


def ngram_match(stats: DataFrame, group_cols: Sequence[str] = (), weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25),
                smoothing: int | Sequence[int] = 1, auto_reweigh: bool = False, rollup: bool = False) -> DataFrame:
    """Corpus BLEU as in CodeBLEU's n-gram match (micro-averaged modified precision).

    Denominator per pair and order is max(1, #hyp grams); closest reference length
    (ties to the shorter); bp = 1 if hyp > ref, 0 if hyp == 0, else exp(1 - ref/hyp).
    ``smoothing`` may list several methods (D7): one ``score_m{k}`` column each,
    all from the same single aggregation.
    """
    max_n = len(weights)
    g = _group(stats, group_cols, rollup).agg(F.count(F.lit(1)).alias("n_pairs"), *_match_sums(max_n))
    if isinstance(smoothing, int):
        return g.select(*group_cols, "n_pairs", _bleu_from_sums(g, max_n, weights, smoothing, auto_reweigh).alias("score"))
    return g.select(*group_cols, "n_pairs",
                    *[_bleu_from_sums(g, max_n, weights, m, auto_reweigh).alias(f"score_m{m}") for m in smoothing])


def _match_sums(max_n: int) -> list[Column]:
    aggs = [F.sum("hyp_len").alias("_h"), F.sum("ref_closest").alias("_r")]
    for n in range(1, max_n + 1):
        aggs += [F.sum(f"m{n}").alias(f"_n{n}"), F.sum(F.greatest(F.lit(1), possible(F.col("hyp_len"), n))).alias(f"_d{n}")]
    return aggs


def _weighted_sums(max_n: int, compat_bp: bool) -> list[Column]:
    aggs = [F.sum("hyp_len").alias("_wh"), F.sum(F.lit(2) if compat_bp else F.col("ref_closest")).alias("_wr"),
            F.sum("wrm1").alias("_wn1"), F.sum("wden1").alias("_wd1")]
    for n in range(2, max_n + 1):
        aggs += [F.sum(f"rm{n}").alias(f"_wn{n}"), F.sum(f"rden{n}").alias(f"_wd{n}")]
    return aggs


def _bleu_from_sums(g, max_n, weights, smoothing, auto_reweigh, num_prefix="_n", den_prefix="_d", hyp="_h", ref="_r"):
    nums = [F.col(f"{num_prefix}{n}").cast("double") for n in range(1, max_n + 1)]
    dens = [F.col(f"{den_prefix}{n}").cast("double") for n in range(1, max_n + 1)]
    return _bleu_terms(nums, dens, F.col(hyp), F.col(ref), weights, smoothing, auto_reweigh)


def _bleu_terms(nums, dens, h, r, weights, smoothing, auto_reweigh):
    max_n = len(weights)
    bp = F.when(h > r, F.lit(1.0)).when(h == 0, F.lit(0.0)).otherwise(F.exp(1.0 - r / h))
    ps = _smooth(smoothing, nums, dens, h)
    s = sum(w * F.log(p) for w, p in zip(weights, ps))
    if auto_reweigh and tuple(weights) == (0.25, 0.25, 0.25, 0.25):
        # uniform weights over the first hyp_len orders when fewer than 4 tokens in total
        alt = F.lit(0.0)
        for L in (1, 2, 3):
            alt = F.when(h == L, sum((1.0 / L) * F.log(p) for p in ps[:L])).otherwise(alt)
        s = F.when(h < 4, alt).otherwise(s)
    # a zero precision makes the geometric mean 0 (Spark's log(0) is null)
    return F.when(nums[0] == 0, F.lit(0.0)).otherwise(F.coalesce(bp * F.exp(s), F.lit(0.0)))


# ---------------------------------------------------------------- D6
def weighted_ngram_match(stats: DataFrame, group_cols: Sequence[str] = (), weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25),
                         compat_bp: bool = True, rollup: bool = False) -> DataFrame:
    """Keyword-weighted n-gram **recall** (CodeBLEU part 2), smoothing method 1.

    Needs stats built with ``keywords=`` (columns ``wrm1`` and ``wden1``).
    ``compat_bp`` reproduces the reference: the "reference length" in the brevity
    penalty is 2 per pair.
    """
    max_n = len(weights)
    g = _group(stats, group_cols, rollup).agg(F.count(F.lit(1)).alias("n_pairs"), *_weighted_sums(max_n, compat_bp))
    score = _bleu_from_sums(g, max_n, weights, 1, False, "_wn", "_wd", "_wh", "_wr")
    return g.select(*group_cols, "n_pairs", score.alias("score"))


# ---------------------------------------------------------------- D8 + D7 methods 5-7
def _sentence_smooth(method: int, nums, dens, hyp_len, next_prec=None, alpha: float = 5.0, k: int = 5, epsilon: float = 0.1):
    """Per-sentence smoothing; methods 5-7 look at the sentence's own counts."""
    if method <= 4:
        return _smooth(method, nums, dens, hyp_len, epsilon, k)
    if method == 6:
        out = [nums[0] / dens[0], nums[1] / dens[1]]
        for i in range(2, len(nums)):
            pi0 = F.when(out[i - 2] == 0, F.lit(0.0)).otherwise(out[i - 1] * out[i - 1] / out[i - 2])
            # numerator = clipped count, l = number of hypothesis grams of this order
            out.append((nums[i] + alpha * pi0) / (possible(hyp_len, i + 1) + alpha))
        return out
    base = [nm / dn for nm, dn in zip(nums, dens)] if method == 5 else _smooth(4, nums, dens, hyp_len, epsilon, k)
    plus1 = base + [next_prec]
    out, prev = [], base[0] + 1.0
    for i in range(len(base)):
        v = (prev + base[i] + plus1[i + 1]) / 3.0
        out.append(v)
        prev = v
    return out


def sentence_score(smoothing: int = 1, weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25), auto_reweigh: bool = False) -> Column:
    """D8 score of one pair as a column over a stats row (``m1..``, ``hyp_len``,
    ``ref_closest``).  Smoothing methods 5 and 7 also read ``m{len(weights)+1}``."""
    max_n = len(weights)
    nums = [F.col(f"m{n}").cast("double") for n in range(1, max_n + 1)]
    dens = [F.greatest(F.lit(1), possible(F.col("hyp_len"), n)).cast("double") for n in range(1, max_n + 1)]
    h, r = F.col("hyp_len"), F.col("ref_closest")
    if smoothing <= 4:
        return _bleu_terms(nums, dens, h, r, weights, smoothing, auto_reweigh)
    nxt = None
    if smoothing in (5, 7):
        nxt = F.col(f"m{max_n + 1}") / F.greatest(F.lit(1), possible(h, max_n + 1))
    bp = F.when(h > r, F.lit(1.0)).when(h == 0, F.lit(0.0)).otherwise(F.exp(1.0 - r / h))
    ps = _sentence_smooth(smoothing, nums, dens, h, nxt)
    # a zero precision makes the geometric mean 0 (Spark's log(0) would be null)
    return F.when(nums[0] == 0, F.lit(0.0)).when(F.least(*ps) <= 0, F.lit(0.0)).otherwise(
        bp * F.exp(sum(w * F.log(p) for w, p in zip(weights, ps))))


def sentence_bleu(stats: DataFrame, weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25), smoothing: int = 1,
                  auto_reweigh: bool = False) -> DataFrame:
    """D5 on each pair separately (one score per pair).  Smoothing methods 5 and 7
    need the order len(weights)+1 counts in ``stats`` (``ngram_stats(max_n=5)``)."""
    return stats.select(*passthrough(stats), sentence_score(smoothing, weights, auto_reweigh).alias("score"))
