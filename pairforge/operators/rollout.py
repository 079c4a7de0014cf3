"""Rollout analytics over stored reinforcement-learning rollouts (SURVEY I1-I10,
E3, E5, D22-D24, H19, H20).

One row per generated sequence with array columns (``logprobs``,
``ref_logprobs``, ``values``, ``scores``, ...).  Every per-token quantity is an
array expression on its own row; batch statistics are means of per-sequence
values, so the only shuffle is the final partial aggregate.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.arrays import bind, clip, entropy_from_logits, whiten

# fixed values: trainer defaults of the reference PPO implementation
PPO_DEFAULTS = {"init_kl_coef": 100.0, "target": 6.0, "horizon": 10000.0, "gamma": 1.0, "lam": 0.95,
                "cliprange": 0.2, "cliprange_value": 0.2, "vf_coef": 0.1, "batch_size": 48}

#: elements of one padded block of sequences in ``gae``
_BATCH_ELEMENTS = 4_000_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mean(a) -> Column:
    """Mean of an array; null for an empty one."""
    return bind(a, lambda v: F.try_divide(_sum(v), F.size(v)))


def _sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x)


def _var_samp(a) -> Column:
    """Sample variance of an array; 1 for fewer than two elements (as in whitening)."""
    return bind(a, lambda v: bind(_mean(v), lambda m: F.when(F.size(v) > 1, F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.greatest(F.size(v) - 1, F.lit(1))).otherwise(F.lit(1.0))))


def kl_rewards(logprobs, ref_logprobs, scores, kl_coef: float) -> Column:
    """Per-token reward ``-coef * (logp - ref_logp) + score``; returns
    ``struct(rewards, non_score_reward)``."""
    nsr = F.zip_with(_c(logprobs), _c(ref_logprobs), lambda a, b: -kl_coef * (a - b))
    return F.struct(F.zip_with(nsr, _c(scores), lambda a, b: a + b).alias("rewards"), nsr.alias("non_score_reward"))


def gae(rewards, values, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalised advantages, delta_t = r_t + gamma V_{t+1} - V_t (V past the end 0),
    A_t = delta_t + gamma lam A_{t+1}; returns ``struct(advantages, returns)``.

    One reverse pass over the tokens, for an Arrow batch of sequences at once (array expressions have no running
    sum, so they would take the square of the length)."""
    @F.pandas_udf("struct<advantages:array<double>,returns:array<double>>")
    def run(r: pd.Series, v: pd.Series) -> pd.DataFrame:
        adv: list = [None] * len(r)
        ret: list = [None] * len(r)
        rows = sorted((i for i in range(len(r)) if r.iloc[i] is not None and v.iloc[i] is not None), key=lambda i: len(r.iloc[i]))
        while rows:  # sequences of like length side by side, a bounded number of elements at a time
            n = len(r.iloc[rows[-1]])
            take, rows = rows[-max(1, _BATCH_ELEMENTS // max(n, 1)):], rows[:-max(1, _BATCH_ELEMENTS // max(n, 1))]
            delta, val = np.zeros((len(take), n)), np.zeros((len(take), n + 1))
            for k, i in enumerate(take):
                m = len(r.iloc[i])
                val[k, :m] = v.iloc[i][:m]
                delta[k, :m] = r.iloc[i] + gamma * val[k, 1:m + 1] - val[k, :m]
            run = np.zeros(len(take))
            for t in range(n - 1, -1, -1):
                delta[:, t] = run = delta[:, t] + gamma * lam * run
            for k, i in enumerate(take):
                m = len(r.iloc[i])
                adv[i], ret[i] = delta[k, :m], delta[k, :m] + val[k, :m]
        return pd.DataFrame({"advantages": pd.Series(adv, dtype=object), "returns": pd.Series(ret, dtype=object)})
    return run(_c(rewards), _c(values))


def advantages(rewards, values, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """GAE then whitening of the advantages (per sequence)."""
    return bind(gae(rewards, values, gamma, lam), lambda g: F.struct(
        whiten(g["advantages"]).alias("advantages"), g["returns"].alias("returns")))


def ppo_losses(old_logprobs, logprobs, values, vpred, adv, returns, cliprange: float = 0.2,
               cliprange_value: float = 0.2, vf_coef: float = 0.1, logits=None) -> Column:
    """I3 + I4 per sequence: clipped value and policy losses, clip fractions and diagnostics.

    ``logits`` (array of logit arrays, one per token) adds the mean ``entropy`` of the policy.  Means of an empty
    sequence are null, variances of one element 1."""
    inputs = F.struct(_c(old_logprobs).alias("old"), _c(logprobs).alias("new"), _c(values).alias("v"), _c(vpred).alias("vp"),
                      _c(returns).alias("ret"), _c(adv).alias("a"))

    def tokens(x: Column) -> Column:
        v = F.zip_with(F.zip_with(x["vp"], x["v"], lambda p, q: F.struct(p.alias("p"), q.alias("v"))), x["ret"], lambda z, r: F.struct(
            ((z["p"] - r) * (z["p"] - r)).alias("l1"), (_clamp(z["p"], z["v"], cliprange_value) - r).alias("c")))
        d = F.zip_with(x["new"], x["old"], lambda p, q: p - q)
        pg = F.zip_with(x["a"], d, lambda a, e: F.struct((-a * F.exp(e)).alias("p1"),
                                                        (-a * clip(F.exp(e), 1.0 - cliprange, 1.0 + cliprange)).alias("p2")))
        return F.struct(F.transform(v, lambda z: F.struct(z["l1"].alias("l1"), (z["c"] * z["c"]).alias("l2"))).alias("vl"),
                        d.alias("diff"), pg.alias("pg"), x["v"].alias("v"), x["vp"].alias("vp"), x["ret"].alias("ret"), x["a"].alias("a"))

    def losses(t: Column) -> Column:
        pg_loss = _mean(F.transform(t["pg"], lambda z: F.greatest(z["p1"], z["p2"])))
        vf_loss = 0.5 * _mean(F.transform(t["vl"], lambda z: F.greatest(z["l1"], z["l2"])))
        fields = [
            pg_loss.alias("pg_loss"), vf_loss.alias("vf_loss"), (pg_loss + vf_coef * vf_loss).alias("loss"),
            _mean(F.transform(t["pg"], lambda z: (z["p2"] > z["p1"]).cast("double"))).alias("pg_clipfrac"),
            _mean(F.transform(t["vl"], lambda z: (z["l2"] > z["l1"]).cast("double"))).alias("vf_clipfrac"),
            (0.5 * _mean(F.transform(t["diff"], lambda d: d * d))).alias("approxkl"), _mean(t["diff"]).alias("policykl"),
            _mean(t["ret"]).alias("return_mean"), _var_samp(t["ret"]).alias("return_var"),
            _mean(t["v"]).alias("value_mean"), _var_samp(t["v"]).alias("value_var"),
            _mean(t["vp"]).alias("vpred_mean"), _mean(F.transform(t["vl"], lambda z: z["l1"])).alias("val_error"),
            _mean(t["a"]).alias("adv_mean")]
        if logits is not None:
            fields.append(_mean(F.transform(_c(logits), entropy_from_logits)).alias("entropy"))
        return F.struct(*fields)

    return bind(inputs, lambda x: bind(tokens(x), losses))


def _clamp(p: Column, around: Column, width: float) -> Column:
    return F.greatest(F.least(p, around + width), around - width)


def batch_mean(df: DataFrame, per_seq: str, fields: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean of per-sequence statistics (``stack_dicts`` then mean)."""
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n_seqs"), *[F.avg(F.col(per_seq)[f]).alias(f) for f in fields])


def step_stats(df: DataFrame, logprobs: str, ref_logprobs: str, non_score_reward: str, kl_coef: float) -> DataFrame:
    """|mean_seq sum_t (logp - ref)|, mean_seq sum_t -logp, mean_seq sum_t non-score reward."""
    kl = F.zip_with(F.col(logprobs), F.col(ref_logprobs), lambda a, b: a - b)
    g = df.agg(F.count(F.lit(1)).alias("n_seqs"), F.avg(_sum(kl)).alias("_kl"),
               F.avg(_sum(F.transform(F.col(logprobs), lambda x: -x))).alias("entropy"),
               F.avg(_sum(F.col(non_score_reward))).alias("mean_non_score_reward"))
    return g.select("n_seqs", F.abs("_kl").alias("kl"), "entropy", "mean_non_score_reward", F.lit(kl_coef).alias("kl_coef"))


def var_explained(val_error: Column, return_var: Column) -> Column:
    """1 - value error / return variance (both batch means)."""
    return 1.0 - F.try_divide(val_error, return_var)


def mean_arrays(df: DataFrame, arr: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean of arrays per group, long form ``(group, pos, mean)``."""
    e = df.select(*group_cols, F.posexplode(arr).alias("pos", "_x"))
    return e.groupBy(*group_cols, "pos").agg(F.avg("_x").alias("mean"))


def stack_padded(df: DataFrame, arr: str, group_col: str, fill: float = 1.0) -> DataFrame:
    """Pad each array to its group's maximum length with ``fill`` (ones by default).

    Group maxima are one partial aggregate; joining them back moves no group
    into one task."""
    m = df.groupBy(group_col).agg(F.max(F.size(arr)).alias("_max"))
    j = df.join(m, group_col)
    padded = F.concat(F.col(arr), F.array_repeat(F.lit(fill), F.col("_max") - F.size(arr)))
    return j.withColumn(arr, padded).drop("_max")


def composite_reward(valid_syntax, compiles, detected) -> Column:
    """0-3 reward, one point per satisfied boolean signal (detected as the string 'true')."""
    return (_c(valid_syntax).cast("int") + _c(compiles).cast("int") + (_c(detected) == F.lit("true")).cast("int"))


def dense_reward(length, eos_pos, compiled, ast_match, dfg_match) -> Column:
    """I8: +-1 compile reward plus AST and data-flow match, placed at the EOS position."""
    from pairforge.functions.arrays import one_hot_reward
    val = F.when(_c(compiled), F.lit(1.0)).otherwise(F.lit(-1.0)) + _c(ast_match) + _c(dfg_match)
    return one_hot_reward(length, eos_pos, val)


def batch_reward_stats(df: DataFrame, batch: str, compiled: str, ast_match: str, dfg_match: str, reward: str | None = None,
                       counts: Sequence[str] = ()) -> DataFrame:
    """Per batch, mean compile reward (+-1), mean AST and data-flow match, optionally the mean ``reward``, and the
    sums of ``counts`` (error and node counts of both sides)."""
    more = [F.avg(reward).alias("mean_reward")] if reward else []
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("n"),
                                 F.avg(F.when(F.col(compiled), 1.0).otherwise(-1.0)).alias("compile_rate"),
                                 F.avg(ast_match).alias("ast_match"), F.avg(dfg_match).alias("dfg_match"),
                                 *more, *(F.sum(c).cast("long").alias(c) for c in counts))


# fixed values: the columns of a training-log row, in order
TRAINING_FIELDS = ("time", "run", "train_batch_size", "max_source_length", "max_target_length", "lr", "epoch", "step", "reward",
                   "errors", "errors_ref", "nodes", "nodes_ref", "kl", "entropy", "loss", "pg_loss", "vf_loss", "advantage_mean",
                   "return_mean", "value_mean", "compile_rate", "ast_match", "dfg_match")


def training_rows(samples: DataFrame, steps: DataFrame, key: Sequence[str] = ("run", "step")) -> DataFrame:
    """One 24-field row per step: ``samples`` (one row per generated sample with reward, error and node counts) gives
    five per-sample means rounded to 4 decimals, ``steps`` (one row per step) everything else."""
    means = ("reward", "errors", "errors_ref", "nodes", "nodes_ref")
    m = samples.groupBy(*key).agg(*(F.round(F.avg(c), 4).alias(c) for c in means))
    return steps.join(m, list(key)).select(*TRAINING_FIELDS)
