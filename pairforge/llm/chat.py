r"""Chat formatting with Spark expressions only (operator 1).

Turns are collected as structs and sorted, neighbouring turns of one role are
merged into one block, and everything is concatenated::

    <s>role[INST]text[/INST][INST]next text of this role[/INST]</s><s>role...</s>

Control strings (``<s> </s> [INST] [/INST]``) inside roles and texts get a
backslash after their first character, and strings that already look escaped
get one more, so the escaping is one-to-one and a control string in the output
is always the template's own; ``parse`` reads the turns back.

The loss mask is a list of spans (start from 0, length; code points of the
formatted string) over the texts of the roles that are learned.

Defined results: texts of any length are read whole; an empty table gives no
rows; null roles and texts are empty; turns are ordered by
(turn, role, text), nulls first, so ties and repeated rows have one order and
stay; rows without id are one conversation; other columns are not read; an
empty table gives no rows.  One conversation is one row by the task's nature:
its turns are held together.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"<(\\*)(/?s>)", r"<\\$1$2"), r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"<\\(\\*)(/?s>)", "<$1$2"), r"\[\\(\\*)(/?INST\])", "[$1$2")


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once (a plain reference would be expanded inside lambdas)."""
    return F.transform(F.array(value), fn)[0]


def _pieces(turns: Column, learned: list[str]) -> Column:
    """Per turn: what stands before its text, the text, what stands after; and whether it is learned."""
    def one(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get(turns, i - 1)["role"] != t["role"])
        closes = (i == F.size(turns) - 1) | (F.get(turns, i + 1)["role"] != t["role"])
        return F.struct(
            F.concat(F.when(opens, F.concat(F.lit("<s>"), escape(t["role"]))).otherwise(""), F.lit("[INST]")).alias("head"),
            escape(t["text"]).alias("body"),
            F.concat(F.lit("[/INST]"), F.when(closes, "</s>").otherwise("")).alias("tail"),
            t["role"].isin(learned).alias("learned"))
    return F.transform(turns, one)


def _spans(pieces: Column) -> Column:
    """Spans of the learned texts: one pass that carries the place reached."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["head"])
        n = F.length(p["body"]).cast("bigint")
        here = F.array(F.struct(a.alias("start"), n.alias("length")))
        return F.struct((a + n + F.length(p["tail"])).alias("at"),
                        F.when(p["learned"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"))
    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def format_chat(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``id``, ``formatted`` and ``loss_spans array<struct<start,length>>`` of every conversation."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    sorted_turns = F.sort_array(F.collect_list(F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))))
    grouped = turns.groupBy(F.col(f"`{id_col}`").alias("id")).agg(sorted_turns.alias("turns"))
    made = _let(F.col("turns"), lambda t: _let(_pieces(t, list(learned)), lambda p: F.struct(
        F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        _spans(p).alias("loss_spans"))))
    return grouped.select("id", made.alias("made")).select("id", "made.formatted", "made.loss_spans")


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, as ``array<struct<role,text>>``."""
    def block(b: Column) -> Column:
        return _let(F.split(F.substr(b, F.lit(4)), r"\[INST\]", -1), lambda parts: F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda x: F.struct(unescape(parts[0]).alias("role"),
                               unescape(F.substring(x, F.lit(1), F.length(x) - 7)).alias("text"))))
    return _let(F.split(formatted, "</s>", -1), lambda blocks: F.flatten(
        F.transform(F.slice(blocks, 1, F.size(blocks) - 1), block)))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
