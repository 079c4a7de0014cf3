"""Exact sampling, splitting, ordering and batching.

Random order is a seeded hash, ``md5(seed || ':' || id)``, so any engine can
reproduce it.  Exact sizes (``int(0.7 * n)`` rows, ``min(5000, n)`` rows) need
the k-th smallest key, found without sorting the data: each pass counts rows
per 4-hex-digit prefix of the key (at most 65,536 small rows reach the
driver) and narrows to the bucket holding rank k, so a trillion rows need
about three light aggregation passes.  Rows are then labelled by comparing
their key with the threshold: a map-only step, no shuffle of the rows.

Dense row numbers (E6, E11) do need a global order: a range-partitioned sort
materialised once with checkpoint(), per-partition counts (one row per
partition), and a broadcast of those offsets (size bounded by the number of
partitions).
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

KEY_HEX = 32  # md5 hex digits


def hash_key(seed, id_col) -> Column:
    """Seeded random order key: ``md5(seed:id)`` as 32 hex digits."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), idc.cast("string")))


def order_key(col) -> Column:
    """Natural order of a long column as a fixed-width hex string (sign bit flipped)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _bucket_counts(df: DataFrame, key: str, prefix: str, width: int) -> list:
    sub = df.filter(F.col(key).startswith(prefix)) if prefix else df
    return sub.groupBy(F.substring(key, len(prefix) + 1, width).alias("b")).count().orderBy("b").collect()


def _descend(df: DataFrame, key: str, k: int, buckets: list, width: int) -> str | None:
    prefix, remaining = "", k
    while True:
        cum, chosen, chosen_count = 0, None, 0
        for row in buckets:
            if cum + row["count"] >= remaining:
                chosen, chosen_count = row["b"], row["count"]
                break
            cum += row["count"]
        if chosen is None:
            return None  # fewer than k rows
        prefix += chosen
        remaining -= cum
        if chosen_count == 1:
            return df.filter(F.col(key).startswith(prefix)).agg(F.min(key)).first()[0]
        if len(chosen) < width:  # reached the end of the key: ties
            return prefix
        buckets = _bucket_counts(df, key, prefix, width)


def kth_smallest_many(df: DataFrame, key: str, ks: Sequence[int], width: int = 4) -> tuple[int, list]:
    """Row count and the k-th smallest (1-based) values of a unique hex-string key.

    The first pass (counts per key prefix, at most 16**width rows) is shared by
    every k and also gives the row count; each k then narrows its own bucket."""
    first = _bucket_counts(df, key, "", width)
    n = sum(r["count"] for r in first)
    return n, [(_descend(df, key, k, first, width) if 0 < k <= n else None) for k in ks]


def kth_smallest(df: DataFrame, key: str, k: int, width: int = 4) -> str | None:
    """The k-th smallest (1-based) value of a unique hex-string key column."""
    return kth_smallest_many(df, key, [k], width)[1][0]


def _with_key(df: DataFrame, id_col: str, seed) -> DataFrame:
    return df.withColumn("_key", hash_key(seed, id_col))


def exact_split(df: DataFrame, id_col: str, fractions: Sequence[float] = (0.7, 0.1), seed="1234",
                names: Sequence[str] = ("train", "valid", "test"), key: Column | None = None) -> DataFrame:
    """shuffled split with exact sizes ``int(f * n)`` per leading part, remainder last.

    ``key`` overrides the seeded hash (e.g. ``order_key(id)`` for F5's ordered split).
    """
    d = df.withColumn("_key", key) if key is not None else _with_key(df, id_col, seed)
    # the row count comes out of the first bucket pass, shared by every boundary
    first = _bucket_counts(d, "_key", "", 4)
    n = sum(r["count"] for r in first)
    bounds, acc = [], 0
    for f in fractions:
        acc += int(f * n)
        bounds.append(_descend(d, "_key", acc, first, 4) if 0 < acc <= n else None)
    label = F.lit(names[len(fractions)])
    for b, name in reversed(list(zip(bounds, names))):
        if b is not None:
            label = F.when(F.col("_key") <= F.lit(b), F.lit(name)).otherwise(label)
    return d.withColumn("split", label).drop("_key")


def ordered_split(df: DataFrame, order_col: str, fraction: float = 0.8, names=("train", "test")) -> DataFrame:
    """first ``int(fraction * n)`` rows in natural order, no shuffle."""
    return exact_split(df, order_col, (fraction,), names=names, key=order_key(order_col))


def sample_n(df: DataFrame, id_col: str, n: int = 5000, seed="1234") -> DataFrame:
    """``min(n, count)`` rows without replacement, seeded."""
    d = _with_key(df, id_col, seed)
    t = kth_smallest(d, "_key", n)
    if t is None:  # fewer rows than n: all of them
        return d.drop("_key")
    return d.filter(F.col("_key") <= F.lit(t)).drop("_key")


def sample_frac(df: DataFrame, id_col: str, fraction: float = 0.1, seed="1234") -> DataFrame:
    """exactly ``int(fraction * count)`` rows."""
    d = _with_key(df, id_col, seed)
    first = _bucket_counts(d, "_key", "", 4)
    k = int(fraction * sum(r["count"] for r in first))
    if k == 0:
        return d.filter(F.lit(False)).drop("_key")
    return d.filter(F.col("_key") <= F.lit(_descend(d, "_key", k, first, 4))).drop("_key")


def head(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """the first ``n`` examples in order (-1 = all); rows without an order value come first.

    By an integer column the n-th smallest value is found by counting and the rows are compared with it where they lie, so a large ``n``
    is neither sorted nor gathered; only rows that share that value are limited.  Other columns are sorted."""
    if n < 0:
        return df
    if dict(df.dtypes)[order_col] not in ("tinyint", "smallint", "int", "bigint"):
        return df.orderBy(order_col).limit(n)
    d = df.withColumn("_key", F.coalesce(order_key(order_col), F.lit("")))
    bar = kth_smallest(d, "_key", n) if n else ""
    if bar is None:  # fewer rows than n
        return df
    first = d.filter(F.col("_key") < F.lit(bar)).drop("_key")
    if not n:
        return first
    tied = d.filter(F.col("_key") == F.lit(bar)).drop("_key")
    return first.unionByName(tied.limit(n - first.count()))


def with_row_index(df: DataFrame, order: Sequence[Column | str], name: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Dense 0-based row number in the given order, without a single-partition window.

    The range-partitioned, sorted rows get their partition id and in-partition
    position once and are checkpointed (reliably, into the shared checkpoint
    folder): the per-partition counts and the final join then read the same
    materialised rows.  Recomputing the range partitioning for each branch could
    sample different boundaries and mis-number rows.
    """
    from pairforge.session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    # one row per partition: a window over it is tiny
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = s.join(F.broadcast(offsets.select("_pid", "_off", "_base")), "_pid")
    return out.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_base")).drop("_pid", "_mid", "_off", "_base")


def batch_assign(df: DataFrame, order: Sequence[Column | str], size: int, name: str = "batch") -> DataFrame:
    """Fixed-size batches in the given order (shuffled when ordered by a hash key)."""
    return with_row_index(df, order, "_idx").withColumn(name, F.floor(F.col("_idx") / size).cast("long"))


def task_sampling_probs(df: DataFrame, task: str, alpha: float = 0.7) -> DataFrame:
    """p_i proportional to (n_i / N) ** alpha (one row per task)."""
    c = df.groupBy(task).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # tasks are a small dimension
    c = c.withColumn("_q", F.pow(F.col("n") / F.sum("n").over(w), alpha))
    return c.withColumn("prob", F.col("_q") / F.sum("_q").over(w)).drop("_q")


def uniform(seed, id_col) -> Column:
    """Deterministic uniform [0, 1) from the first 13 hex digits of md5(seed:id)."""
    return F.conv(F.substring(hash_key(seed, id_col), 1, 13), 16, 10).cast("double") / float(16 ** 13)


def task_schedule(steps: DataFrame, step_col: str, probs: DataFrame, task: str, seed="1234") -> DataFrame:
    """draw one task per step with the given probabilities.

    The tasks' cumulative bounds (one row per task) go to the workers, which find a step's draw by
    binary search, a batch at a time, so the steps are labelled without a join."""
    t = probs.select(task, "prob").toArrow()
    if not t.num_rows:
        raise ValueError("no task to draw from")
    t = t.take(pc.sort_indices(t, sort_keys=[(task, "ascending")]))
    names, bounds = t.column(task).combine_chunks(), np.cumsum(t.column("prob").to_numpy())
    sent = steps.sparkSession.sparkContext.broadcast((names, bounds))
    drawn = steps.select(F.col(step_col).alias("step"), uniform(seed, step_col).alias("u"))

    def draw(batches):
        names, bounds = sent.value
        for b in batches:
            at = np.searchsorted(bounds, b.column("u").to_numpy(zero_copy_only=False), side="right")
            picked = names.take(pa.array(np.minimum(at, len(names) - 1)))  # rounding may leave the last bound below 1
            yield pa.RecordBatch.from_arrays([b.column("step"), picked], ["step", "task"])

    kinds = StructType([StructField("step", steps.schema[step_col].dataType), StructField("task", probs.schema[task].dataType)])
    return drawn.mapInArrow(draw, kinds).withColumnRenamed("step", step_col)
