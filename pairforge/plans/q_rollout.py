"""Registered rollout queries.  Each embedding row is read as one stored rollout
of 16 tokens: old log-probs = values 1-16, reference log-probs = 17-32, value
estimates = 33-48, updated log-probs = 49-64, response ids derived from the old
log-probs (EOS id 2) and the sequence score = label / 10 placed at the EOS."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import arrays as A
from pairforge.operators import rollout as RL
from pairforge.plans.catalog import query
from pairforge.sources.tables import table

R6 = 6
T = 16
EOS = 2
KL = RL.PPO_DEFAULTS["init_kl_coef"]


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    r = e.select("vec_id", "label", F.slice("e", 1, T).alias("old_logprobs"), F.slice("e", 17, T).alias("ref_logprobs"),
                 F.slice("e", 33, T).alias("values"), F.slice("e", 49, T).alias("logprobs"))
    r = r.withColumn("response_ids", F.transform("old_logprobs", lambda x: (F.floor(F.abs(x) * 1000) % 50).cast("int")))
    r = r.withColumn("eos_pos", A.reward_len("response_ids", EOS))
    r = r.withColumn("scores", A.one_hot_reward(F.lit(T), F.col("eos_pos"), F.col("label") / 10.0))
    kr = RL.kl_rewards("old_logprobs", "ref_logprobs", "scores", KL)
    r = r.withColumn("rewards", kr["rewards"]).withColumn("non_score_reward", kr["non_score_reward"])
    g = RL.gae("rewards", "values", RL.PPO_DEFAULTS["gamma"], RL.PPO_DEFAULTS["lam"])
    r = r.withColumn("adv_raw", g["advantages"]).withColumn("returns", g["returns"])
    return r.withColumn("advantages", A.whiten("adv_raw")).withColumn("vpred", F.reverse("values"))


# ---- SQL side: the same rollout as DuckDB list expressions
def _lt(body: str, n: int = T) -> str:
    return f"list_transform(range(1, {n + 1}), lambda t: {body})"


ROLLOUT_CTES = f"""b AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
r0 AS (SELECT vec_id, label, e[1:16] AS olp, e[17:32] AS ref, e[33:48] AS v, e[49:64] AS nlp,
              list_transform(e[1:16], lambda x: (floor(abs(x) * 1000)::BIGINT % 50)::INTEGER) AS ids FROM b),
r1 AS (SELECT *, CASE WHEN list_contains(ids, 2) THEN list_position(ids, 2) - 1 ELSE 16 END AS eos_pos FROM r0),
r2 AS (SELECT *, {_lt("-100.0 * (olp[t] - ref[t]) + CASE WHEN t - 1 = least(eos_pos, 15) THEN label / 10.0 ELSE 0.0 END")} AS rew,
              {_lt("-100.0 * (olp[t] - ref[t])")} AS nsr FROM r1),
r3 AS (SELECT *, {_lt("rew[t] + 1.0 * coalesce(v[t + 1], 0.0) - v[t]")} AS delta FROM r2),
r4 AS (SELECT *, {_lt("list_sum(list_transform(range(t, 17), lambda s: pow(0.95, s - t) * delta[s]))")} AS adv FROM r3),
r5 AS (SELECT *, {_lt("adv[t] + v[t]")} AS ret, list_avg(adv) AS am, list_aggregate(adv, 'var_samp') AS avar FROM r4),
r6 AS (SELECT *, list_transform(adv, lambda x: (x - am) / sqrt(avar + 1e-8)) AS wadv, list_reverse(v) AS vp FROM r5)"""


_ADV_SQL = f"""WITH {ROLLOUT_CTES}
SELECT vec_id, eos_pos::BIGINT AS eos_pos, round(list_sum(rew), 6) AS reward_sum, list_transform(adv, lambda x: round(x, 6)) AS advantages,
       list_transform(ret, lambda x: round(x, 6)) AS returns, list_transform(wadv, lambda x: round(x, 6)) AS whitened FROM r6"""


@query("rollout_advantages_embeddings", "I1 E3 I2 H19 H20 E5", _ADV_SQL)
def rollout_advantages_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KL-penalised rewards, GAE advantages and returns, whitened advantages per rollout."""
    r = rollouts(spark, sf_dir)
    return r.select("vec_id", "eos_pos", F.round(RL._sum("rewards"), R6).alias("reward_sum"),
                    *(F.transform(c, lambda x: F.round(x, R6)).alias(n)
                      for c, n in (("adv_raw", "advantages"), ("returns", "returns"), ("advantages", "whitened"))))


#: neighbouring rows (one 64-value embedding each) that make one long rollout
ROWS = 32

_LONG_SQL = """WITH x AS (SELECT vec_id // 32 AS seq, vec_id % 32 AS r, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
l AS (SELECT seq, r % 4 AS part, list(v ORDER BY r, i) AS a FROM x GROUP BY ALL),
p AS (SELECT seq, min(len(a)) AS n, max(a) FILTER (part = 0) AS olp, max(a) FILTER (part = 1) AS ref, max(a) FILTER (part = 2) AS val,
             max(a) FILTER (part = 3) AS nlp FROM l GROUP BY seq HAVING count(*) = 4),
c AS (SELECT seq, n, olp[1:n] AS olp, ref[1:n] AS ref, val[1:n] AS v, nlp[1:n] AS nlp FROM p),
d AS (SELECT *, list_transform(range(1, n + 1), lambda t: -100.0 * (olp[t] - ref[t]) + coalesce(v[t + 1], 0.0) - v[t]) AS delta FROM c),
g AS (SELECT *, list_transform(range(1, n + 1), lambda t: list_sum(list_transform(range(t, n + 1), lambda s: pow(0.95, s - t) * delta[s]))) AS adv FROM d),
w AS (SELECT *, list_avg(adv) AS am, list_aggregate(adv, 'var_samp') AS avar FROM g)
SELECT seq, n AS n_tokens, round(list_sum(adv), 4) AS adv_sum,
       round(list_sum(list_transform(range(1, n + 1), lambda t: t * (adv[t] - am) / sqrt(avar + 1e-8))), 4) AS whitened_moment,
       round(list_avg(list_transform(range(1, n + 1), lambda t: greatest(-(adv[t] - am) / sqrt(avar + 1e-8) * exp(nlp[t] - olp[t]),
             -(adv[t] - am) / sqrt(avar + 1e-8) * greatest(least(exp(nlp[t] - olp[t]), 1.2), 0.8)))), 6) AS pg_loss FROM w"""


@query("long_rollouts_embeddings", "I1 E3 I2 H19 I3", _LONG_SQL)
def long_rollouts_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts of up to 512 tokens: 32 neighbouring rows, dealt in turn to the old, reference, value and new streams.

    The last rows make a shorter rollout, as long as its shortest stream."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    r = F.col("vec_id") % ROWS
    g = e.groupBy(F.floor(F.col("vec_id") / ROWS).cast("long").alias("seq")).agg(
        F.sort_array(F.collect_list(F.struct(r.alias("r"), "e"))).alias("rows"))  # at most 32 rows each
    names = ("old", "ref", "v", "new")
    for k, name in enumerate(names):
        g = g.withColumn(name, F.flatten(F.transform(F.filter("rows", _in_part(k)), lambda x: x["e"])))
    g = g.withColumn("n", F.least(*(F.size(c) for c in names))).filter("n > 0")
    g = g.withColumns({c: F.slice(c, F.lit(1), F.col("n")) for c in names})
    kr = RL.kl_rewards("old", "ref", F.transform("old", lambda _: F.lit(0.0)), KL)
    g = g.withColumn("adv", RL.gae(kr["rewards"], "v", RL.PPO_DEFAULTS["gamma"], RL.PPO_DEFAULTS["lam"]))
    g = g.withColumn("white", A.whiten(F.col("adv.advantages")))
    loss = RL.ppo_losses("old", "new", "v", "v", "white", F.col("adv.returns"))["pg_loss"]
    moment = RL._sum(F.transform("white", lambda x, t: x * (t + 1)))
    return g.select("seq", F.col("n").cast("long").alias("n_tokens"), F.round(RL._sum(F.col("adv.advantages")), 4).alias("adv_sum"),
                    F.round(moment, 4).alias("whitened_moment"), F.round(loss, R6).alias("pg_loss"))


def _in_part(k: int):
    return lambda x: x["r"] % 4 == k


_PPO_FIELDS = ["pg_loss", "vf_loss", "loss", "pg_clipfrac", "vf_clipfrac", "approxkl", "policykl", "return_mean",
               "return_var", "value_mean", "value_var", "vpred_mean", "val_error", "adv_mean"]

_PPO_SQL = f"""WITH {ROLLOUT_CTES},
p1 AS (SELECT *, {_lt("greatest(least(vp[t], v[t] + 0.2), v[t] - 0.2)")} AS vclip,
              {_lt("nlp[t] - olp[t]")} AS diff FROM r6),
p2 AS (SELECT *, {_lt("(vp[t] - ret[t]) * (vp[t] - ret[t])")} AS l1, {_lt("(vclip[t] - ret[t]) * (vclip[t] - ret[t])")} AS l2,
              {_lt("-wadv[t] * exp(diff[t])")} AS pg1, {_lt("-wadv[t] * greatest(least(exp(diff[t]), 1.2), 0.8)")} AS pg2 FROM p1),
s AS (SELECT 0.5 * list_avg({_lt("greatest(l1[t], l2[t])")}) AS vf_loss, list_avg({_lt("CASE WHEN l2[t] > l1[t] THEN 1.0 ELSE 0.0 END")}) AS vf_clipfrac,
             list_avg({_lt("greatest(pg1[t], pg2[t])")}) AS pg_loss, list_avg({_lt("CASE WHEN pg2[t] > pg1[t] THEN 1.0 ELSE 0.0 END")}) AS pg_clipfrac,
             0.5 * list_avg(list_transform(diff, lambda d: d * d)) AS approxkl, list_avg(diff) AS policykl,
             list_avg(ret) AS return_mean, list_aggregate(ret, 'var_samp') AS return_var, list_avg(v) AS value_mean,
             list_aggregate(v, 'var_samp') AS value_var, list_avg(vp) AS vpred_mean, list_avg(l1) AS val_error, list_avg(wadv) AS adv_mean FROM p2)
SELECT count(*) AS n_seqs, round(avg(pg_loss), 6) AS pg_loss, round(avg(vf_loss), 6) AS vf_loss, round(avg(pg_loss + 0.1 * vf_loss), 6) AS loss,
       round(avg(pg_clipfrac), 6) AS pg_clipfrac, round(avg(vf_clipfrac), 6) AS vf_clipfrac, round(avg(approxkl), 6) AS approxkl,
       round(avg(policykl), 6) AS policykl, round(avg(return_mean), 6) AS return_mean, round(avg(return_var), 6) AS return_var,
       round(avg(value_mean), 6) AS value_mean, round(avg(value_var), 6) AS value_var, round(avg(vpred_mean), 6) AS vpred_mean,
       round(avg(val_error), 6) AS val_error, round(avg(adv_mean), 6) AS adv_mean,
       round(1 - avg(val_error) / avg(return_var), 6) AS var_explained FROM s"""


@query("ppo_losses_embeddings", "I3 I4 I5 H16", _PPO_SQL)
def ppo_losses_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped PPO policy/value losses and diagnostics averaged over rollouts."""
    r = rollouts(spark, sf_dir)
    r = r.select(RL.ppo_losses("old_logprobs", "logprobs", "values", "vpred", "advantages", "returns").alias("s"))
    out = RL.batch_mean(r, "s", _PPO_FIELDS)
    out = out.withColumn("var_explained", RL.var_explained(F.col("val_error"), F.col("return_var")))
    return out.select("n_seqs", *[F.round(c, R6).alias(c) for c in _PPO_FIELDS + ["var_explained"]])


_STEP_SQL = f"""WITH {ROLLOUT_CTES},
t AS (SELECT *, CASE WHEN list_contains(ids, 2) THEN list_position(ids, 2) ELSE 1 END AS curr_len FROM r2)
SELECT count(*) AS n_seqs, round(abs(avg(list_sum(list_transform(range(1, curr_len + 1), lambda i: olp[i] - ref[i])))), 6) AS kl,
       round(avg(list_sum(list_transform(olp[1:curr_len], lambda x: -x))), 6) AS entropy,
       round(avg(list_sum(nsr[1:curr_len])), 6) AS mean_non_score_reward, 100.0::DOUBLE AS kl_coef FROM t"""


@query("step_stats_embeddings", "E5 I9 I5", _STEP_SQL)
def step_stats_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step statistics after cutting every rollout at the PPO length (first EOS + 1, 1 when none)."""
    r = rollouts(spark, sf_dir)
    n = A.ppo_curr_len("response_ids", EOS)
    r = r.select(*[A.truncate_at(c, n).alias(c) for c in ("old_logprobs", "ref_logprobs", "non_score_reward")])
    out = RL.step_stats(r, "old_logprobs", "ref_logprobs", "non_score_reward", KL)
    return out.select("n_seqs", *[F.round(c, R6).alias(c) for c in ("kl", "entropy", "mean_non_score_reward")], "kl_coef")


_MEAN_SQL = """WITH b AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT label, pos, round(avg(x), 6) AS mean FROM b GROUP BY label, pos"""


@query("mean_arrays_embeddings", "D22", _MEAN_SQL)
def mean_arrays_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise mean of the values per label (long form)."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("a"))
    out = RL.mean_arrays(e, "a", ["label"])
    return out.select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", R6).alias("mean"))


_PAD_SQL = f"""WITH {ROLLOUT_CTES},
c AS (SELECT vec_id, label, olp[1:eos_pos] AS a FROM r1),
m AS (SELECT label, max(len(a)) AS mx FROM c GROUP BY label)
SELECT vec_id, m.mx AS padded_len, round(coalesce(list_sum(a), 0.0) + (m.mx - len(a)) * 1.0, 6) AS padded_sum FROM c JOIN m USING (label)"""


@query("stack_padded_embeddings", "D23 B20", _PAD_SQL)
def stack_padded_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts cut at their EOS, padded with ones to the longest of their label group."""
    r = rollouts(spark, sf_dir).select("vec_id", "label", A.truncate_at("old_logprobs", F.col("eos_pos")).alias("a"))
    out = RL.stack_padded(r, "a", "label")
    return out.select("vec_id", F.size("a").cast("long").alias("padded_len"), F.round(RL._sum("a"), R6).alias("padded_sum"))
