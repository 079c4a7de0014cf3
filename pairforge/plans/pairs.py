"""Pair sets built from the supplied tables.

The tables carry no code pairs, so prediction/gold pairs are derived with
equi-joins on unique keys (linear, no hot key, no all-pairs expansion):

* ``doc_pairs``   gold = document k, prediction = document k+1 (same shape as a
  model's output that drifted from its target), keyed by the gold id.
* ``turn_pairs``  gold = a user turn, prediction = the assistant turn after it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.sources.tables import table


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, lang, pred, gold``: document k (gold) against document k+1 (prediction)."""
    d = table(spark, sf_dir, "documents")
    g = d.select(F.col("doc_id").alias("pair_id"), F.col("lang"), F.col("text").alias("gold"))
    p = d.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("pred"))
    return g.join(p, "pair_id")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, conv_id, turn, pred, gold``: user turn t (gold) against assistant turn t+1."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("gold"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    j = u.join(a, ["conv_id", "turn"])
    return j.select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"), "conv_id", "turn", "pred", "gold")
