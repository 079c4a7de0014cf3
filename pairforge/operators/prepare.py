"""Dataset preparation: pair building, filters, prefixes and length statistics
(SURVEY B5-B12, B19, D1, D2, K3, K7).

Every function is a projection or filter (no shuffle) except the length
statistics, which are one partially-aggregated global (or grouped) aggregate.
Tokenizers are pluggable ``Column -> array<string>`` functions (K7).
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import py_split, tabs_to_spaces
from pairforge.operators.bleu import _group

Tokenizer = Callable[[Column], Column]

# --- fixed values: prompt and instruction texts used to format pairs ---
REFACTOR_PROMPT = "Refactor this method: {src}\n Refactored code: {tgt}"
INSTRUCTION_PROMPT = (
    "You are a powerful code refactoring model. Your job is to refactor the given method using extract method "
    "refactoring. \n\n                        ### To be-refacored code:\n                        {src}\n\n"
    "                        ### Refactored Code:\n                        "
)
PERFORM_PROMPT = "Perform extract method refactoring on the following code: \n\n"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _py_str(c) -> Column:
    """Python ``str(x)``: null prints as ``None``."""
    return F.coalesce(_c(c), F.lit("None"))


def triple_layout(method: Column, class_text: Column, with_context: bool, smelly: bool) -> Column:
    """With context the smelly sample is class text + newline + method; the other two
    are class text + method without newline."""
    if not with_context:
        return method
    return F.concat(class_text, F.lit("\n"), method) if smelly else F.concat(class_text, method)


def pair_style(style: str, s: Column, a: Column, e: Column) -> Column:
    """``struct(source, target)`` in one of the six reference styles.

    a: after + newline + extracted (null -> "None");  b: after + extracted;
    c: extracted only;  d: one training text "Refactor this method: ...";
    e: instruction prompt around the smelly method (target empty);
    f: "Perform extract method ..." prompt with tabs as spaces (target empty).
    """
    if style == "a":
        src, tgt = _py_str(s), F.concat(_py_str(a), F.lit("\n"), _py_str(e))
    elif style == "b":
        src, tgt = s, F.concat(a, e)
    elif style == "c":
        src, tgt = s, e
    elif style == "d":
        src, tgt = F.concat(F.lit("Refactor this method: "), s, F.lit("\n Refactored code: "), a, e), F.lit("")
    elif style == "e":
        head, tail = INSTRUCTION_PROMPT.split("{src}")
        src, tgt = F.concat(F.lit(head), s, F.lit(tail)), F.lit("")
    elif style == "f":
        src, tgt = F.concat(F.lit(PERFORM_PROMPT), tabs_to_spaces(s)), F.lit("")
    else:
        raise ValueError(style)
    return F.struct(src.alias("source"), tgt.alias("target"))


def build_pairs(triples: DataFrame, style: str, smelly: str = "smelly", after: str = "after",
                extracted: str = "extracted") -> DataFrame:
    """(source, target) of every triple in a style; with several letters, one row per style and a ``style`` column
    (the triples are read once)."""
    others = [c for c in triples.columns if c not in (smelly, after, extracted)]
    pairs = [F.struct(F.lit(x).alias("style"), pair_style(x, _c(smelly), _c(after), _c(extracted)).alias("p")) for x in style]
    out = triples.select(*others, F.explode(F.array(*pairs)).alias("_x"))
    return out.select(*others, *([F.col("_x.style")] if len(style) > 1 else []), "_x.p.source", "_x.p.target")


def length_filter(triples: DataFrame, tokenizer: Tokenizer = py_split, max_len: int = 512, smelly: str = "smelly",
                  after: str = "after", extracted: str = "extracted") -> DataFrame:
    """Drop rows whose smelly tokens or (after || extracted) tokens exceed ``max_len``."""
    return triples.filter((F.size(tokenizer(_c(smelly))) <= max_len)
                          & (F.size(tokenizer(F.concat(_py_str(after), _py_str(extracted)))) <= max_len))


def apply_task_prefix(source, task: str, sub_task: str = "none") -> Column:
    """``"{task} {sub}: "`` or ``"{task}: "``."""
    pre = f"{task} {sub_task}: " if sub_task != "none" else f"{task}: "
    return F.concat(F.lit(pre), _c(source))


def apply_lang_tag(target, task: str, sub_task: str = "none") -> Column:
    """Language tag by task / sub-task; defect unchanged."""
    tag = {"summarize": "<en> ", "refine": "<java> ", "concode": "<java> "}.get(task)
    if task == "translate":
        tag = "<c_sharp> " if sub_task == "java-cs" else "<java> "
    return F.concat(F.lit(tag), _c(target)) if tag else _c(target)


def escape_special(c) -> Column:
    """``</s>`` -> ``<unk>``."""
    return F.replace(_c(c), F.lit("</s>"), F.lit("<unk>"))


def label_to_text(label) -> Column:
    """0 -> false, 1 -> true, anything else raises."""
    lab = _c(label)
    return F.when(lab == 0, F.lit("false")).when(lab == 1, F.lit("true")).otherwise(
        F.raise_error(F.concat(F.lit("label must be 0 or 1, got "), lab.cast("string"))))


def text_to_label(text) -> Column:
    """B11 (clone files): ``'0'`` -> 0, anything else 1."""
    return F.when(_c(text) == "0", F.lit(0)).otherwise(F.lit(1))


def toxicity_filter(df: DataFrame, toxicity: str, threshold: float = 0.3) -> DataFrame:
    """Keep rows whose toxicity is not null and above the threshold."""
    return df.filter(F.col(toxicity).isNotNull() & (F.col(toxicity) > threshold))


def sampled_length(seed: str, key, lo: int, hi: int) -> Column:
    """Deterministic length in [lo, hi) drawn from md5(seed:key) (B12's LengthSampler)."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), _c(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return (F.lit(lo) + (u % (hi - lo))).cast("int")


def toxicity_queries(df: DataFrame, key: str, prompt: str, continuation: str, toxicity: str, threshold: float = 0.3, lo: int = 5,
                     hi: int = 10, tokenizer: Tokenizer = py_split, seed: str = "42") -> DataFrame:
    """Rows above the threshold; prompt and continuation concatenated and cut to a sampled number of tokens."""
    tokens = tokenizer(F.concat(F.col(prompt), F.col(continuation)))
    kept = toxicity_filter(df, toxicity)
    return kept.select(key, F.array_join(F.slice(tokens, 1, sampled_length(seed, F.col(key), lo, hi)), " ").alias("query"))


# ---------------------------------------------------------------- D1 / D2
def length_stats(pairs: DataFrame, source: str = "source", target: str = "target", tokenizer: Tokenizer | None = None,
                 group_cols: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """Count, mean and max whitespace-token lengths (and tokenizer lengths when given)."""
    s, t = F.size(py_split(_c(source))), F.size(py_split(_py_str(target)))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(s).alias("avg_src_len"), F.avg(t).alias("avg_trg_len"),
            F.max(s).alias("max_src_len"), F.max(t).alias("max_trg_len")]
    if tokenizer is not None:
        ts, tt = F.size(tokenizer(_c(source))), F.size(tokenizer(_py_str(target)))
        aggs += [F.avg(ts).alias("avg_src_tok"), F.avg(tt).alias("avg_trg_tok"), F.max(ts).alias("max_src_tok"),
                 F.max(tt).alias("max_trg_tok")]
    return _group(pairs, group_cols, rollup).agg(*aggs)


def length_stats_collated(triples: DataFrame, tokenizer: Tokenizer, max_len: int = 512, smelly: str = "smelly",
                          after: str = "after", extracted: str = "extracted") -> DataFrame:
    """D1 over triples plus the after+extracted lengths (word counts summed, tokens
    counted on the concatenation) and the three counts above ``max_len``."""
    s, a, e = _c(smelly), _py_str(after), _py_str(extracted)
    ws_s, ws_a = F.size(py_split(s)), F.size(py_split(a))
    ws_col = ws_a + F.size(py_split(e))
    tk_s, tk_a, tk_col = F.size(tokenizer(s)), F.size(tokenizer(a)), F.size(tokenizer(F.concat(a, e)))
    return triples.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ws_s).alias("avg_src_len"), F.avg(ws_a).alias("avg_trg_len"), F.avg(ws_col).alias("avg_trg_col_len"),
        F.max(ws_s).alias("max_src_len"), F.max(ws_a).alias("max_trg_len"), F.max(ws_col).alias("max_trg_col_len"),
        F.avg(tk_s).alias("avg_src_tok"), F.avg(tk_a).alias("avg_trg_tok"), F.avg(tk_col).alias("avg_trg_col_tok"),
        F.max(tk_s).alias("max_src_tok"), F.max(tk_a).alias("max_trg_tok"), F.max(tk_col).alias("max_trg_col_tok"),
        F.count_if(tk_s > max_len).alias("src_over"), F.count_if(tk_a > max_len).alias("trg_over"),
        F.count_if(tk_col > max_len).alias("trg_col_over"))


def replace_literals(c) -> Column:
    """Blank out string and char literals (kept as empty quotes) before structure checks; comments must be gone
    already, as an apostrophe in one would open a literal."""
    return F.regexp_replace(_c(c), r"""\"(?:\\.|[^\\"])*+"|'(?:\\.|[^\\'])*+'""", '""')


# ---------------------------------------------------------------- H24
def split_task(cur_task) -> Column:
    """``task_subtask`` -> struct(task = text before the first '_', sub_task = after the last '_')."""
    parts = F.split(_c(cur_task), "_")
    return F.struct(F.get(parts, 0).alias("task"), F.element_at(parts, -1).alias("sub_task"))


def max_target_length(task, sub_task) -> Column:
    """Maximum target length by task (fixed values of the multi-task setup)."""
    t, s = _c(task), _c(sub_task)
    return (F.when(t == "summarize", 128).when(t == "translate", 256)
            .when((t == "refine") & (s == "small"), 120).when(t == "refine", 240)
            .when(t == "concode", 150).when(t == "defect", 3))


def batch_size_for(task, sub_task, small_model: bool) -> Column:
    """Batch size by task and model size (fixed values of the multi-task setup)."""
    t, s = _c(task), _c(sub_task)
    if small_model:
        return F.when((t == "summarize") | (t == "translate") | ((t == "refine") & (s == "small")), 64).otherwise(32)
    return F.when(t == "translate", 25).when(t == "summarize", 40).otherwise(28)


def restore_indentation_df(df: DataFrame, key: str, text: str, out: str = "code") -> DataFrame:
    """E1 over whole texts: lines exploded with their position, the running depth as a
    window over one text's own lines, and the lines reassembled in order (linear in
    the number of lines, unlike the array form)."""
    from pyspark.sql import Window
    from pairforge.functions.text import WS, py_strip
    lines = df.select(key, F.posexplode(F.split(F.col(text), "NEW_LINE")).alias("pos", "_l"))
    ln = py_strip(F.col("_l"))
    lines = lines.select(key, "pos", ln.alias("_l"))
    cnt = lambda m: ((F.length("_l") - F.length(F.replace(F.col("_l"), F.lit(m), F.lit("")))) / len(m)).cast("int")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_d", F.sum(cnt("INDENT") - cnt("DEDENT")).over(w))
    clean = F.regexp_replace(F.regexp_replace(F.col("_l"), "INDENT" + WS + "?", ""), "DEDENT" + WS + "?", "")
    lines = lines.select(key, "pos", F.concat(F.repeat(F.lit("\t"), F.greatest(F.col("_d"), F.lit(0)).cast("int")), clean).alias("_o"))
    g = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "_o"))).alias("_s"))
    return g.select(key, F.array_join(F.transform("_s", lambda x: x["_o"]), "\n").alias(out))
