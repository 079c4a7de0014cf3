"""Small helpers to run a function over Arrow batches of (id, text) rows."""
from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pairforge.session import ensure_checkpoint_dir


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that are needed, under fixed names (other columns never clash)."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts hold about ``max_bytes`` (one longer text stays whole)."""
    for b in batches:
        text = b.column("text")
        n = b.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            held += int(sizes[i])
            if held >= max_bytes:
                yield b.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < n:
            yield b.slice(start, n - start)


def schema_of(df: DataFrame, id_col: str, rest: str) -> StructType:
    """``id`` with the type it has in ``df``, then the columns of a DDL string."""
    return StructType([StructField("id", df.schema[id_col].dataType), *StructType.fromDDL(rest).fields])


def map_texts(df: DataFrame, fn: Callable[[pa.Array], list[pa.Array]], rest: str, id_col: str,
              text_col: str, max_bytes: int = 4 << 20, keep_text: bool = False) -> DataFrame:
    """One output row per input row: ``id`` (and ``text``), then the columns of ``rest`` as ``fn(texts)`` gives them."""
    schema = schema_of(df, id_col, "text string, " * keep_text + rest)
    names = schema.names

    def run(batches):
        for b in pieces(batches, max_bytes):
            yield pa.RecordBatch.from_arrays([b.column("id"), *([b.column("text")] * keep_text), *fn(b.column("text"))], names=names)

    return id_and_text(df, id_col, text_col).mapInArrow(run, schema)


_HELD: dict = {}


def held(kind: str, value, build: Callable):
    """What a worker keeps between batches and tasks: ``build(value)``, made once for each broadcast ``value``.

    Workers outlive the stages they serve, so what another operator held is let go first (two values of one are kept)."""
    key = (kind, id(value))
    if key not in _HELD:
        if len(_HELD) > 1 or any(k != kind for k, _ in _HELD):
            _HELD.clear()
            _give_back()
        _HELD[key] = (value, build(value))  # with the value, so that its id stays its own
        _give_back()  # what building it left
    return _HELD[key][1]


def _give_back() -> None:
    """Free memory goes back to the system; a worker that idles between stages would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # no such call in this C library


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it again."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
