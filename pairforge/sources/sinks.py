"""Writers for the reference's outputs.

Each is a DataFrame writer call; appends are atomic per Spark job (exactly once with a batch id) and
partitioned output replaces the reference's per-repository file naming
(full ``owner/name`` partitions, so two owners' repositories never collide).
"""
from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.text import py_strip, tabs_to_spaces


def write_jsonl(df: DataFrame, path: str, mode: str = "append", partition_by: str | None = None) -> None:
    """One JSON object per line."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def write_predictions(df: DataFrame, path: str, with_id: bool = False, id_col: str = "idx", pred: str = "pred",
                      gold: str = "gold", src: str = "source", mode: str = "overwrite") -> None:
    """Aligned ``.output`` / ``.gold`` / ``.src`` texts (``id \\t text`` when ``with_id``),
    each stripped.  All three are sorted by the id and then by the whole row, so lines stay aligned when ids repeat
    (and however the sorts cut their part files)."""
    d = df.orderBy(id_col, src, gold, pred)
    for suffix, c in (("output", pred), ("gold", gold), ("src", src)):
        line = F.concat_ws("\t", F.col(id_col).cast("string"), py_strip(F.col(c))) if with_id else py_strip(F.col(c))
        d.select(line.alias("value")).write.mode(mode).text(f"{path}.{suffix}")


def write_labels(df: DataFrame, path: str, cols: list[str], mode: str = "overwrite") -> None:
    """A14 (classification): ``url1 \\t url2 \\t 0/1`` or ``idx \\t 0/1`` lines."""
    df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value")).write.mode(mode).text(path)


def write_comparison_csv(df: DataFrame, path: str, cols=("ss", "gt", "ft")) -> None:
    """CSV with header, tabs turned into spaces."""
    df.select(*[tabs_to_spaces(F.col(c)).alias(c) for c in cols]).write.mode("overwrite").option("header", True).csv(path)


def append_table(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Typed append (training log, reward log, eval log).

    With ``batch`` the rows are appended exactly once: they are written aside and appear whole, under ``batch=...`` (a column when
    the table is read), and a batch that is there already is left as it is.  A table takes batches always or never."""
    if batch is None:
        df.write.mode("append").parquet(path)
    else:
        _publish(df, f"{path.rstrip('/')}/batch={quote(str(batch), safe='')}")


def reward_blocks(samples: DataFrame, batch: str, order: str, query: str = "query", response: str = "response", reward: str = "reward") -> DataFrame:
    """The log text of each generated sample, in a table ``(batch, order, query, response, reward, block)``; the last
    sample of a batch ends it."""
    from pyspark.sql import Window
    last = F.row_number().over(Window.partitionBy(batch).orderBy(F.col(order).desc())) == 1  # one batch's samples
    block = F.concat(F.lit("\nSmelly Code:\n"), F.col(query), F.lit("\nRefactored Code:\n"), F.col(response), F.lit("\nReward:\n"),
                     F.col(reward).cast("string"), F.when(last, "\n============End of batch================\n").otherwise(""))
    return samples.select(batch, order, query, response, reward, block.alias("block"))


def write_job_results(df: DataFrame, path: str) -> DataFrame:
    """``{result, name}`` records; returns the summary by result."""
    df.select("result", "name").write.mode("overwrite").json(path)
    return df.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


def materialize_features(df: DataFrame, path: str, sampled: bool = False) -> DataFrame:
    """Write encoded features once and read them back afterwards; sampled data is
    never cached.  The cache appears under its name only when it is whole."""
    spark = df.sparkSession
    if sampled:
        return df
    _publish(df, path)
    return spark.read.parquet(path)


def _publish(df: DataFrame, path: str) -> None:
    """Write a folder that appears under its name only when it is whole; one that is there is left as it is.

    The rows are staged beside it in a hidden folder.  Where two writers meet, the later one's rename puts its folder inside the
    other's, where readers pass over it, so the rows are there once."""
    spark = df.sparkSession
    if _exists(spark, path):
        return
    parent, _, name = path.rstrip("/").rpartition("/")
    part = f"{parent}/_{name}.tmp-{uuid.uuid4().hex}"
    df.write.parquet(part)
    jvm = spark.sparkContext._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(x) for x in (part, path))
    if not old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(old, new) and not _exists(spark, path):
        raise OSError(f"cannot rename {part} to {path}")


def _exists(spark: SparkSession, path: str) -> bool:
    """Is the path there?  Asked of its own file system; errors other than absence come out."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def feature_cache_key(split: str, only_src: bool = False, all_data: bool = True, n: int | None = None) -> str:
    """A19 cache name: split, then ``_src`` and ``_all`` / ``_N`` (the reference's
    operator-precedence slip in this key is not reproduced)."""
    return split + ("_src" if only_src else "") + ("_all" if all_data else f"_{n}")
