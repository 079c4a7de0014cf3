"""Registered evaluation-log queries: each user of ``events`` is a run, events in
time order are its evaluation steps and ``value`` is the metric."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators import evallog as EV
from pairforge.plans.catalog import query
from pairforge.sources.tables import table


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run"), F.col("ts").alias("step"),
                                                 "event_type", "value")


_ERR_SQL = """SELECT event_id, user_id AS run,
  round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w / count(*) OVER w, 5) AS error_rate
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("running_error_rate_events", "E2", _ERR_SQL)
def running_error_rate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative error rate per run in time order (5 decimals)."""
    out = EV.running_error_rate(_log(spark, sf_dir), "run", "step", (F.col("event_type") == "error").cast("long"), F.lit(1))
    return out.select("event_id", "run", "error_rate")


_BEST_SQL = """WITH b AS (SELECT user_id, max(value) AS best FROM events GROUP BY user_id)
SELECT e.user_id AS run, count(*) AS n_evals, max(b.best) AS best_value, min(e.ts) FILTER (WHERE e.value = b.best) AS best_step
FROM events e JOIN b USING (user_id) GROUP BY e.user_id"""


@query("best_checkpoint_events", "D21", _BEST_SQL)
def best_checkpoint_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best metric per run and the first step reaching it."""
    out = EV.best_checkpoint(_log(spark, sf_dir), "run", "step", "value", "max")
    return out.select("run", "n_evals", "best_value", F.timestamp_micros("_bs").cast("timestamp_ntz").alias("best_step"))


_STOP_SQL = """WITH a AS (SELECT user_id, ts, value, row_number() OVER w AS idx,
         greatest(coalesce(max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0), -1.0) AS prev
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, max(CASE WHEN value > prev THEN idx ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM a)
SELECT user_id AS run, count(*) AS n_evals, max(value) AS best_value, min(ts) FILTER (WHERE idx - last > 3) AS stop_step
FROM b GROUP BY user_id"""


@query("early_stop_events", "E4", _STOP_SQL)
def early_stop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early-stopping step per run with patience 3 (max mode, initial best -1)."""
    out = EV.early_stop(_log(spark, sf_dir), "run", "step", "value", patience=3, mode="max")
    return out.select("run", "n_evals", "best_value", "stop_step")


_JOINT_SQL = """WITH v AS (SELECT user_id, ts, value AS score, event_id % 7 + value / 2 AS loss FROM events),
a AS (SELECT *, row_number() OVER w AS idx,
         greatest(coalesce(max(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0), -1.0) AS ps,
         least(coalesce(min(loss) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e6), 1e6) AS pl
  FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, max(CASE WHEN score > ps THEN idx ELSE 0 END) OVER w AS ls, max(CASE WHEN loss < pl THEN idx ELSE 0 END) OVER w AS ll
  FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id AS run, count(*) AS n_evals, round(min(loss), 6) AS best_loss, max(score) AS best_score,
       min(ts) FILTER (WHERE idx - ls > 3 AND idx - ll > 3) AS stop_step FROM b GROUP BY user_id"""


@query("joint_early_stop_events", "E4", _JOINT_SQL)
def joint_early_stop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early stopping that waits for both counters (loss and score) to exceed patience 3."""
    log = _log(spark, sf_dir).withColumn("loss", F.col("event_id") % 7 + F.col("value") / 2)
    out = EV.joint_early_stop(log, "run", "step", "loss", "value", patience=3)
    return out.withColumn("best_loss", F.round("best_loss", 6))


_KL_SQL = """SELECT event_id, user_id AS run, round(100.0 * exp(coalesce(sum(ln(1.0 + greatest(least(value / 6.0 - 1.0, 0.2), -0.2) * 48 / 10000.0))
  OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)), 4) AS kl_coef
FROM events"""


@query("kl_coef_path_events", "E7 I6", _KL_SQL)
def kl_coef_path_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive KL coefficient in force at each step (value = measured KL; init 100,
    target 6, horizon 10000, 48 steps per update)."""
    out = EV.kl_coef_path(_log(spark, sf_dir), "run", "step", "value")
    # products of thousands of factors: 4 decimals keep engines' summation order out of the digits
    return out.select("event_id", "run", F.round("kl_coef", 4).alias("kl_coef"))


_CHANGED_SQL = """WITH p AS (SELECT user_id AS run, event_id AS step, value,
    max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events)
SELECT run, step, 'best changed' AS criteria, 'bleu+em' AS metric, value, printf('[%d] Best bleu+em changed into %.2f', step, value) AS line
FROM p WHERE prev IS NULL OR value > prev"""


@query("best_changes_events", "A20", _CHANGED_SQL)
def best_changes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a run's best value as an evaluation-log row, appended to a table and read back."""
    import uuid

    from pairforge.session import ensure_checkpoint_dir
    from pairforge.sources.sinks import append_table
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/eval-log-{uuid.uuid4().hex}"
    append_table(EV.best_changes(log, "run", "step", "value", decimals=2, label="bleu+em"), path)
    return spark.read.parquet(path)
