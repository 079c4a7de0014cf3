"""Nested-record helpers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def flatten_struct(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested struct fields become top-level columns named by their path.

    A field name that already contains the separator is an error, as in the reference."""
    cols: list[Column] = []

    def walk(schema: StructType, path: list[str]):
        for f in schema.fields:
            if sep in f.name:
                raise ValueError(f"separator {sep!r} in key {f.name!r}")
            p = path + [f.name]
            if isinstance(f.dataType, StructType):
                walk(f.dataType, p)
            else:
                cols.append(F.col(".".join(f"`{x}`" for x in p)).alias(sep.join(p)))

    walk(df.schema, [])
    return df.select(*cols)


def add_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Rename every column with a suffix."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns})


def build_batch_requests(df: DataFrame, idx: str, messages: Sequence[tuple[str, Column]], model: str,
                         url: str = "/v1/chat/completions") -> DataFrame:
    """One batch-API request per row as JSON text (``custom_id = request-{idx}``) with any number of
    (role, content) messages."""
    body = F.struct(F.lit(model).alias("model"), F.array(
        *(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in messages)).alias("messages"))
    req = F.struct(F.concat(F.lit("request-"), F.col(idx).cast("string")).alias("custom_id"), F.lit("POST").alias("method"),
                   F.lit(url).alias("url"), body.alias("body"))
    return df.select(F.col(idx), F.to_json(req).alias("request"))


RESULT_SCHEMA = "custom_id string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>"


def parse_batch_results(df: DataFrame, json_col: str) -> DataFrame:
    """``custom_id`` and the first choice's message content of batch results."""
    r = F.from_json(F.col(json_col), RESULT_SCHEMA)
    return df.select(r["custom_id"].alias("custom_id"),
                     F.get(r["response"]["body"]["choices"], 0)["message"]["content"].alias("content"))
