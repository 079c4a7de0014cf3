"""Structured Streaming forms of the reference's incremental habits.

J1: repositories finish one by one and append JSONL files; a file-source stream
collates them into Parquet exactly once (the checkpoint records which files
were taken).  J2: running error averages updated per batch as a streaming
aggregation in update mode.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairforge.sources.readers import TRIPLE_SCHEMA


def stream_collate(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: str = TRIPLE_SCHEMA,
                   max_files_per_trigger: int = 100, available_now: bool = True) -> StreamingQuery:
    """JSONL files landing in ``in_dir`` appended to Parquet at ``out_dir`` exactly once."""
    src = (spark.readStream.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE")
           .option("maxFilesPerTrigger", max_files_per_trigger).json(in_dir)
           .withColumn("source_file", F.col("_metadata.file_path")))
    w = src.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def running_error_stream(batches: DataFrame, run: str = "run", errors: str = "errors", seen: str = "seen") -> DataFrame:
    """Per run, cumulative errors / cumulative samples as new batches arrive."""
    g = batches.groupBy(run).agg(F.sum(errors).alias("total_errors"), F.sum(seen).alias("total_seen"))
    return g.withColumn("error_rate", F.round(F.try_divide("total_errors", "total_seen"), 5))


def start_running_error(spark: SparkSession, in_dir: str, schema: str, out_path: str, checkpoint: str, run: str = "run",
                        snapshot_every: int = 20, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """J2 end to end: Parquet batch logs -> update-mode aggregate -> Parquet table at ``out_path``.

    Every micro-batch's changed rows are written to their own folder ``batch_id=n`` (a batch that is repeated after a failure overwrites
    its folder).  Each ``snapshot_every`` batches the newest row of each run goes to ``snapshot=n``, made from the snapshot before
    it and the batches since, and what is older than that earlier snapshot is removed.  A reader thus meets one snapshot and at most
    ``snapshot_every`` batches however long the stream has run; one that began just before a snapshot still finds its files."""
    root = out_path.rstrip("/")

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")
        if (batch_id + 1) % snapshot_every:
            return
        snapshots, batches = _written(spark, root)
        base = max((n for n in snapshots if n < batch_id), default=None)
        since = [n for n in batches if (base is None or n > base) and n <= batch_id]
        _newest(spark, root, base, since, run).write.mode("overwrite").parquet(f"{root}/snapshot={batch_id}")
        if base is not None:
            fs, path = _file_system(spark, root)
            for kind, old in (("batch_id", [n for n in batches if n <= base]), ("snapshot", [n for n in snapshots if n < base])):
                for n in old:
                    fs.delete(path(f"{root}/{kind}={n}"), True)

    source = spark.readStream.schema(schema)
    if max_files_per_trigger:
        source = source.option("maxFilesPerTrigger", max_files_per_trigger)
    return (running_error_stream(source.parquet(in_dir), run).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_error_rates(spark: SparkSession, out_path: str, run: str = "run") -> DataFrame:
    """The newest state of each run written by ``start_running_error``: its last snapshot and the batches after it."""
    root = out_path.rstrip("/")
    snapshots, batches = _written(spark, root)
    base = max(snapshots, default=None)
    return _newest(spark, root, base, [n for n in batches if base is None or n > base], run).drop("batch_id")


def _newest(spark: SparkSession, root: str, base: int | None, batches: list[int], run: str) -> DataFrame:
    """The row of each run with the largest batch among a snapshot's and the batches' (``batch_id`` is kept in a snapshot)."""
    parts = [] if base is None else [spark.read.parquet(f"{root}/snapshot={base}")]
    if batches:
        parts.append(spark.read.option("basePath", root).parquet(*[f"{root}/batch_id={n}" for n in batches])
                     .withColumn("batch_id", F.col("batch_id").cast("long")))
    if not parts:
        raise FileNotFoundError(f"no batch has been written to {root}")
    t = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rest = [c for c in t.columns if c != run]
    return t.groupBy(run).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("s")).select(run, "s.*")


def _file_system(spark: SparkSession, root: str):
    """The root's own file system and its kind of path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _written(spark: SparkSession, root: str) -> tuple[list[int], list[int]]:
    """Numbers of the snapshots and batches that are whole (Spark marks a folder when its job is done)."""
    fs, path = _file_system(spark, root)
    found = {"snapshot": [], "batch_id": []}
    if fs.exists(path(root)):
        for f in fs.listStatus(path(root)):
            kind, _, n = f.getPath().getName().partition("=")
            if kind in found and n.isdigit() and fs.exists(path(f.getPath(), "_SUCCESS")):
                found[kind].append(int(n))
    return sorted(found["snapshot"]), sorted(found["batch_id"])
