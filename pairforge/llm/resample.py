r"""Quality selection by importance resampling (operator 2).

A text is the bag of its hashed tokens (words and runs of punctuation) and token pairs.  Two generative models
over the hash buckets are counted, one of target text and one of raw text
(every row); a row's log weight is the sum over its bag of the log ratio of the
two.  Adding Gumbel noise to the log weights and taking the k largest draws k
rows without replacement, in proportion to the weights (Gumbel top-k).

The noise is a hash of the row's id and a seed, so a lost task draws the same
noise again.  The k-th largest key is found by counting keys per prefix, never
by sorting rows; the raw model's counts cover all rows.  The target model is fitted
on a bounded sample of labelled rows: the texts of at most ``target_rows``
target ids, smallest hash first, sent as one broadcast of ids of that size.

Defined results: texts of any length are read whole; an empty table gives no
rows; null, empty and blank texts have log weight 0; rows of equal
id and text (repeated rows) share a key, and where the k-th largest key falls among them
as many of them are selected as are missing, so exactly k rows are; rows without id take noise
of the null id; without target rows all weights are 0 (a uniform draw); an
empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import _words
from pairforge.llm._arrow import id_and_text, map_texts, pieces, schema_of, written
from pairforge.operators.sampling import kth_smallest_many
from pairforge.sources.readers import with_line_index

BUCKETS = 10_000
TARGET_ROWS = 20_000
FRACTION = 0.5


def bag(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, bucket) of every token and token pair; the number of rows."""
    row, words, _, _, counts = _words.split(texts, _words.WORDS_AND_MARKS)
    pairs = _words.grams(words, 2)
    inside = row[:len(pairs)] == row[1:1 + len(pairs)]
    b = np.concatenate([words, pairs[inside]]) % np.uint64(buckets)
    return np.concatenate([row, row[:len(pairs)][inside]]), b.astype(np.int64), len(counts)


def count_models(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 target_col: str = "doc_id", target_rows: int = TARGET_ROWS, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket counts of raw text (all rows) and of target text, as a 2 x buckets array."""
    ids = targets.select(F.col(f"`{target_col}`").alias("id")).filter("id IS NOT NULL").distinct() \
        .orderBy(F.xxhash64("id"), "id").limit(target_rows).withColumn("target", F.lit(True))
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(ids), "id", "left") \
        .select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def run(batches):
        total = np.zeros((2, buckets), dtype=np.int64)
        for b in pieces(batches, 1 << 20):
            row, bucket, _ = bag(b.column("text"), buckets)
            total[0] += np.bincount(bucket, minlength=buckets)
            total[1] += np.bincount(bucket[b.column("target").to_numpy(zero_copy_only=False)[row]], minlength=buckets)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "target"])

    got = rows.mapInArrow(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket") \
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    out = np.zeros((2, buckets), dtype=np.int64)
    out[:, got.column("bucket").to_numpy()] = np.stack([got.column("raw").to_numpy(), got.column("target").to_numpy()])
    return out


def log_ratio(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log of target over raw probability of each bucket (additive smoothing)."""
    if not counts[1].sum():
        return np.zeros(counts.shape[1])
    p = (counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * counts.shape[1])
    return np.log(p[1] / p[0])


def _descending(x: np.ndarray) -> list[str]:
    """Hex strings that sort as the numbers do from large to small."""
    b = (-x + 0.0).view(np.int64)
    b = np.where(b < 0, ~b, b ^ np.int64(-(1 << 63))).view(np.uint64)
    return [f"{v:016x}" for v in b.tolist()]


def resample(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "doc_id",
             fraction: float = FRACTION, k: int | None = None, seed: int = 7, buckets: int = BUCKETS,
             target_rows: int = TARGET_ROWS) -> DataFrame:
    """``id``, ``n_grams``, ``log_weight``, ``gumbel_key`` and ``selected`` per row; ``k`` rows are selected
    (by default ``fraction`` of all)."""
    spark = docs.sparkSession
    ratio = spark.sparkContext.broadcast(log_ratio(count_models(docs, targets, id_col, text_col, target_col, target_rows, buckets)))

    def run(texts: pa.Array) -> list[pa.Array]:
        row, bucket, n = bag(texts, buckets)
        return [pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(np.bincount(row, ratio.value[bucket], minlength=n).astype(np.float64))]

    scored = map_texts(docs, run, "n_grams bigint, log_weight double", id_col, text_col, 1 << 20)
    # a uniform number strictly between 0 and 1 from 52 bits of a hash
    u = (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    scored = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))

    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_descending(b.column("gumbel_key").to_numpy()))], [*b.schema.names, "key"])

    scored = scored.mapInArrow(keyed, schema_of(docs, id_col, "n_grams bigint, log_weight double, gumbel_key double, key string")) \
        .withColumn("key", F.concat("key", F.lpad(F.hex(F.xxhash64("id")), 16, "0")))
    scored = written(spark, scored, "weights")
    n = scored.count()
    take = int(fraction * n) if k is None else min(k, n)
    bar = kth_smallest_many(scored, "key", [take])[1][0] if take else None
    columns = ["id", "n_grams", "log_weight", "gumbel_key"]
    if bar is None:
        return scored.select(*columns, F.lit(False).alias("selected"))
    at = F.col("key") == F.lit(bar)
    above, tied = scored.agg(F.count_if(F.col("key") < F.lit(bar)), F.count_if(at)).first()
    if tied == 1:
        return scored.select(*columns, (F.col("key") <= F.lit(bar)).alias("selected"))
    # copies of one row share the last key: as many of them as are missing, numbered by their place in the written table
    last = with_line_index(scored.filter(at), "rank").select(*columns, (F.col("rank") < take - above).alias("selected"))
    return scored.filter(~at).select(*columns, (F.col("key") < F.lit(bar)).alias("selected")).unionByName(last)
