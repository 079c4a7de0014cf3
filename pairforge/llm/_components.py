"""Connected components of a table of links, as joins and aggregations only.

Alternates two steps until the links no longer change: every node ties its
larger neighbours to the smallest node it sees, then its smaller ones.  All
links then point at the smallest node of their component.  Each round is
written to the shared folder, so a lost executor costs one round at most.
Up to ``ONE_TASK`` links (counted, 16 bytes each) are worked on in one partition,
where no step needs a shuffle; more are spread by their nodes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm._arrow import written


#: links that one task may hold
ONE_TASK = 200_000


def _tie_larger(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    j = both.join(least, both.a == least.k)
    return j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _tie_smaller(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    j = e.join(least, e.a == least.k)
    rest = j.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, comp)`` for every node of a link; ``comp`` is the smallest node reachable."""
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(spark, e, "links")
    n = e.count()
    while n:
        e = e.coalesce(1) if n <= ONE_TASK else e
        e = written(spark, _tie_larger(e).distinct(), "larger")
        e = e.coalesce(1) if n <= ONE_TASK else e
        e = written(spark, _tie_smaller(e).distinct(), "smaller")
        # done when every node has one link, to a node that has none
        few = e.coalesce(1) if n <= ONE_TASK else e
        inner = few.join(few.select(F.col("b").alias("r")).distinct(), F.col("a") == F.col("r"), "left_semi")
        twice = few.groupBy("a").count().filter("count > 1").select("a")
        if inner.select("a").union(twice).isEmpty():
            break
    e = e.coalesce(1) if n <= ONE_TASK else e
    ends = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return ends.union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
