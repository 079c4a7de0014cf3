"""User callback surface.

K1 batched map -> ``mapInPandas``; K2 row function -> ``pandas_udf``; K3
formatting function and K7 tokenizer -> plain ``Column -> Column`` callables;
K4 metric callbacks -> the registry below; K6 smoothing -> an integer argument
of the BLEU functions; K8 collate -> ``pad_to`` over a batch maximum.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.arrays import pad_to

MetricFn = Callable[[DataFrame], DataFrame]
_METRICS: dict[str, MetricFn] = {}


def register_metric(name: str, fn: MetricFn) -> None:
    """K4: a metric is a function from a predictions frame to a one-row frame."""
    _METRICS[name] = fn


def compute_metrics(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """K4: run registered metrics and merge their one-row results."""
    from pairforge.operators.classify import metric_row
    frames = [_METRICS[n](df) for n in (names or list(_METRICS))]
    return metric_row(*frames)


def batched_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """K1: ``dataset.map(f, batched=True)`` over Arrow batches on the executors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)


def row_function(fn: Callable, return_type: str):
    """K2: a per-row Python function vectorised as a pandas UDF."""
    from pyspark.sql.functions import pandas_udf

    def batch(*cols: pd.Series) -> pd.Series:
        return pd.Series([fn(*vals) for vals in zip(*cols)])
    return pandas_udf(batch, return_type)


def collate_batch(df: DataFrame, batch: str, ids: str, pad_id: int = 0) -> DataFrame:
    """K8: pad every id array to the longest of its batch (batch maxima are one
    aggregate joined back, so no batch is gathered into one task)."""
    m = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_max"))
    return df.join(m, batch).withColumn(ids, pad_to(F.col(ids), F.col("_max"), pad_id)).drop("_max")


Formatter = Callable[[Column], Column]
