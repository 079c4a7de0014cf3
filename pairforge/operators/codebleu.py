"""CodeBLEU's structural parts over supplied parse tables (SURVEY C8, C9, D9, D25,
E8, E10, I10).

Parsing is not done here: subtrees ``(pair_id, side, sexp)`` and data-flow
items ``(pair_id, side, item_no, var, pos, rel, par_vars, par_pos)`` are input
tables.  Matching is a shuffle on (pair, item) with map-side pre-aggregation;
variable renaming is a per-pair ordering computed with aggregates and a window
over one pair's names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def syntax_match(subtrees: DataFrame, key: str = "pair_id") -> DataFrame:
    """Share of reference subtrees whose s-expression occurs anywhere among the
    candidate's subtrees (candidates are not consumed).  ``side`` is 'ref'/'cand'.

    Returns one row: ``matched, total, score`` (score null when there is no reference subtree).
    """
    ref = subtrees.filter(F.col("side") == "ref").groupBy(key, "sexp").agg(F.count(F.lit(1)).alias("n"))
    cand = subtrees.filter(F.col("side") == "cand").select(key, "sexp").distinct().withColumn("_hit", F.lit(1))
    j = ref.join(cand, [key, "sexp"], "left")
    g = j.agg(F.sum(F.when(F.col("_hit") == 1, F.col("n")).otherwise(F.lit(0))).alias("matched"), F.sum("n").alias("total"))
    return g.select("matched", "total", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).alias("score"))


def prune_merge_dataflow(items: DataFrame, key: str = "pair_id", side: str = "side") -> DataFrame:
    """Keep items that have parents or are named as a parent's position; merge
    items sharing a position (last var/rel in item order wins, parents united and sorted)."""
    parent_pos = items.select(key, side, F.explode("par_pos").alias("pos")).distinct().withColumn("_ref", F.lit(True))
    j = items.join(parent_pos, [key, side, "pos"], "left")
    kept = j.filter((F.size("par_vars") > 0) | F.col("_ref").isNotNull()).drop("_ref")
    return kept.groupBy(key, side, "pos").agg(
        F.max_by("var", "item_no").alias("var"), F.max_by("rel", "item_no").alias("rel"),
        F.min("item_no").alias("item_no"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("par_vars")))).alias("par_vars"))


def normalize_dataflow(items: DataFrame, key: str = "pair_id", side: str = "side") -> DataFrame:
    """Rename variables ``var_i`` in order of first appearance, where an item's
    parents come before its own variable.  Output rows carry ``norm`` = the
    normalised (var, rel, parents) as one comparable string."""
    # F8: items are taken in token-position order
    slots = items.select(key, side, "item_no", "pos", F.posexplode(F.concat("par_vars", F.array("var"))).alias("slot", "name"))
    first = slots.groupBy(key, side, "name").agg(F.min(F.struct("pos", "slot")).alias("_o"))
    w = Window.partitionBy(key, side).orderBy("_o")
    names = first.withColumn("vid", F.concat(F.lit("var_"), (F.row_number().over(w) - 1).cast("string")))
    named = slots.join(names.select(key, side, "name", "vid"), [key, side, "name"])
    per_item = named.groupBy(key, side, "item_no").agg(F.array_sort(F.collect_list(F.struct("slot", "vid"))).alias("_s"))
    it = items.join(per_item, [key, side, "item_no"])
    vids = F.transform("_s", lambda x: x["vid"])
    norm = F.concat_ws("|", F.element_at(vids, -1), F.col("rel"), F.array_join(F.slice(vids, 1, F.size(vids) - 1), ","))
    return it.select(key, side, "item_no", norm.alias("norm"))


def dataflow_match(normalized: DataFrame, key: str = "pair_id") -> DataFrame:
    """Each reference item consumes one equal candidate item: sum of
    min(ref count, cand count) over distinct items / number of reference items."""
    c = normalized.groupBy(key, "norm").agg(F.count_if(F.col("side") == "ref").alias("r"),
                                            F.count_if(F.col("side") == "cand").alias("c"))
    g = c.agg(F.sum(F.least("r", "c")).alias("matched"), F.sum("r").alias("total"))
    return g.select("matched", "total", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(F.lit(0.0)).alias("score"))


def codebleu(ngram: Column, weighted: Column, syntax: Column, dataflow: Column,
             weights=(0.25, 0.25, 0.25, 0.25)) -> Column:
    """Alpha * ngram + beta * weighted + gamma * syntax + theta * dataflow."""
    a, b, g, t = weights
    return a * ngram + b * weighted + g * syntax + t * dataflow


def parse_error_counts(nodes: DataFrame, key: str, node_type: str = "type") -> DataFrame:
    """Number of ERROR nodes and of other nodes per tree."""
    return nodes.groupBy(key).agg(F.count_if(F.col(node_type) == "ERROR").alias("errors"),
                                  F.count_if(F.col(node_type) != "ERROR").alias("nodes"))


_OPEN, _CLOSE = "({[", ")}]"


def structure_check(code) -> Column:
    """I10 (stand-in for a parser's validity test): brackets ``(){}[]`` balance and nest.

    Runs over the bracket characters only, keeping the open-bracket stack as a string.
    """
    c = F.col(code) if isinstance(code, str) else code
    chars = F.split(F.regexp_replace(c, r"[^(){}\[\]]", ""), "")
    chars = F.filter(chars, lambda x: x != "")

    def step(acc, ch):
        top = F.substring(acc["stack"], -1, 1)
        is_open = F.instr(F.lit(_OPEN), ch) > 0
        want = F.substring(F.lit(_OPEN), F.instr(F.lit(_CLOSE), ch), 1)
        ok_close = (F.length(acc["stack"]) > 0) & (top == want)
        new_stack = F.when(is_open, F.concat(acc["stack"], ch)).when(
            ok_close, F.substring(acc["stack"], 1, F.greatest(F.length(acc["stack"]) - 1, F.lit(0)))).otherwise(acc["stack"])
        return F.struct(new_stack.alias("stack"), (acc["ok"] & (is_open | ok_close)).alias("ok"))

    res = F.aggregate(chars, F.struct(F.lit("").alias("stack"), F.lit(True).alias("ok")), step)
    return res["ok"] & (F.length(res["stack"]) == 0)
