"""Clipped n-gram overlap between a hypothesis and its references.

One pass produces every sufficient statistic the BLEU/ROUGE/F1 family needs.
Per pair (``key``):

* ``hyp_len``      hypothesis length
* ``ref_min``      shortest reference length
* ``ref_closest``  reference length closest to ``hyp_len`` (ties to the shorter)
* ``n_refs``       number of references
* ``m{n}``         sum over hypothesis grams of min(count, max count in any reference)
                   (``Counter & (|= refs)``: BLEU's clipped matches)
* ``rm{n}``        sum over references of sum over grams of min(ref count, hyp count)
                   (per-reference intersection: ROUGE / weighted recall numerators)
* ``rden{n}``      sum over references of max(1, #grams of order n)
* ``wrm1, wden1``  keyword-weighted ``rm1`` and its denominator (when ``keywords``)

Two physical shapes:

``ngram_stats`` (references in an array column, the common case of a fixed
number of reference files).  Tokens and grams are counted as integer codes, a
batch of pairs at a time in Arrow batches: no exchange, no gram as a string.
Per-pair work is bounded by the pair's own texts and pair keys are unique.

``ngram_stats_long`` (references as rows, e.g. a gold file whose ids repeat).
A key may carry any number of references, so nothing is gathered per key:
grams are counted per (key, n, gram, ref) with map-side partial aggregation,
reference counts are joined to the hypothesis count of the same gram, then
reduced per (key, n, gram) and per key.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType


def possible(length: Column, n: int) -> Column:
    """Number of n-grams in a sequence of ``length`` tokens: max(len - n + 1, 0)."""
    return F.greatest(length - n + 1, F.lit(0))


def keyword_weight(token: Column, keywords: Sequence[str], hit: float = 1.0, miss: float = 0.2) -> Column:
    """1 for a language keyword, 0.2 otherwise."""
    return F.when(token.isin(list(keywords)), F.lit(hit)).otherwise(F.lit(miss))


def weighted_total(tokens: Column, keywords: Sequence[str]) -> Column:
    """Sum of keyword weights over a token array."""
    kw = F.array(*[F.lit(k) for k in keywords])
    return F.aggregate(tokens, F.lit(0.0), lambda b, t: b + F.when(F.array_contains(kw, t), 1.0).otherwise(0.2))


def _count_cols(max_n: int, keywords) -> list[str]:
    cols = [f"m{n}" for n in range(1, max_n + 1)] + [f"rm{n}" for n in range(1, max_n + 1)]
    return cols + (["wrm1"] if keywords is not None else [])


def _gram_aggs(max_n: int, keywords) -> list[Column]:
    aggs = []
    for n in range(1, max_n + 1):
        aggs.append(F.coalesce(F.sum(F.when(F.col("n") == n, F.col("clip"))), F.lit(0)).cast("long").alias(f"m{n}"))
    for n in range(1, max_n + 1):
        aggs.append(F.coalesce(F.sum(F.when(F.col("n") == n, F.col("rmin"))), F.lit(0)).cast("long").alias(f"rm{n}"))
    if keywords is not None:
        aggs.append(F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("rmin") * keyword_weight(F.col("g"), keywords))),
                               F.lit(0.0)).alias("wrm1"))
    return aggs


def ngram_stats(
    pairs: DataFrame,
    key: str = "pair_id",
    hyp: str = "hyp",
    refs: str = "refs",
    max_n: int = 4,
    extra: Sequence[str] = (),
    keywords: Sequence[str] | None = None,
    single_ref: bool = False,
    texts: bool = False,
) -> DataFrame:
    """Per-pair statistics; ``hyp`` is ``array<string>``, ``refs`` is ``array<array<string>>``.

    ``single_ref=True`` states that every pair has at most one reference; more are an error.  ``texts=True`` takes whole
    texts (``hyp string``, ``refs array<string>``) and splits them at white space where they are counted.
    """
    many = F.col(refs)
    if single_ref:
        kind = pairs.schema[refs].dataType.simpleString()
        many = F.when(F.size(refs) <= 1, many).otherwise(F.raise_error(F.lit("single_ref takes one reference a pair")).cast(kind))
    df = pairs.select(key, *extra, F.col(hyp).alias("_hyp"), many.alias("_refs"))
    counts = _count_cols(max_n, keywords) + (["wden1"] if keywords is not None else [])
    carried = [df.schema[c] for c in (key, *extra)]
    types = [DoubleType() if c.startswith("w") else LongType() for c in counts]
    schema = StructType([*carried, StructField("_lens", ArrayType(IntegerType())), StructField("hyp_len", IntegerType()), *(StructField(c, t) for c, t in zip(counts, types))])
    kept = [f.name for f in carried]

    def run(batches):
        for b in batches:
            for some in _runs(b, texts):
                hyps, many = some.column("_hyp"), some.column("_refs")
                if texts:
                    hyps, many = _split(hyps), _relist(many, _split(many.flatten()))
                cols = _count_pairs(hyps, many, max_n, keywords)
                lens = _relist(many, pa.array(_lengths(many.flatten()).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), lens,
                                                  *(pa.array(cols[c]) for c in ("hyp_len", *counts))], names=schema.names)

    out = df.select(*kept, "_hyp", "_refs").mapInArrow(run, schema)
    hl, lens = F.col("hyp_len"), F.col("_lens")
    closest = F.array_min(F.transform(lens, lambda r: F.struct(F.abs(r - hl).alias("d"), r.alias("r"))))["r"]
    per_ref = [F.aggregate(lens, F.lit(0).cast("long"), f(n)).alias(f"{name}{n}") for f, name in ((_den, "rden"), (_poss, "rposs"))
               for n in range(1, max_n + 1)]
    return out.select(key, *extra, "hyp_len", F.coalesce(F.array_min(lens), F.lit(0)).alias("ref_min"),
                      F.coalesce(closest, F.lit(0)).alias("ref_closest"), F.size(lens).alias("n_refs"), *per_ref,
                      *(["wden1"] if keywords is not None else []), *_count_cols(max_n, keywords))


#: tokens, or bytes of text, of both sides that are split and counted at once in a task: a worker's memory doesn't grow with its batch
_RUN_TOKENS, _RUN_BYTES = 1 << 17, 1 << 20


def _runs(batch: pa.RecordBatch, texts: bool):
    """Runs of a batch's rows that hold a bounded number of tokens or bytes of text, or one longer pair."""
    hyps, refs = batch.column("_hyp"), batch.column("_refs")
    size = (lambda x: pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if texts else _lengths
    inner = np.concatenate([[0], np.cumsum(size(refs.flatten()))])
    total, most, at = np.cumsum(size(hyps)) + inner[np.cumsum(_lengths(refs))], _RUN_BYTES if texts else _RUN_TOKENS, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _lengths(lists: pa.Array) -> np.ndarray:
    """Lengths of a list column (a null list is empty)."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _relist(like: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` in lists of the lengths of another list column."""
    ends = np.concatenate([[0], np.cumsum(_lengths(like))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _split(texts: pa.Array) -> pa.Array:
    """White-space tokens of each text (``str.split``); a null text has none."""
    words = [t.split() if t else [] for t in texts.to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for w in words for x in w], pa.string()))


def _count_pairs(hyp: pa.Array, refs: pa.Array, max_n: int, keywords) -> dict[str, np.ndarray]:
    """Clipped matches of every order (and keyword-weighted sums) of each row's token list and reference lists.

    Tokens are numbered once; a gram of order n is the pair (its first n - 1 tokens' number, last token), numbered again,
    with the row in the first number, so all counts are exact and no gram is built as a string.  A gram that both sides
    have consists of two shorter ones that both have, so only places of these are looked at from order 2 on."""
    hl, per_row = _lengths(hyp), _lengths(refs)
    rows, inner = len(hl), refs.flatten()
    rl = _lengths(inner)
    text = lambda x: x.flatten().cast(pa.string())
    both = pa.concat_arrays([text(hyp), text(inner)]).dictionary_encode()
    token = pc.fill_null(both.indices, len(both.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(both.dictionary) + 1
    ref_row = np.repeat(np.arange(rows), per_row)
    of_list = np.concatenate([np.repeat(np.arange(rows), hl), rows + np.repeat(np.arange(len(rl)), rl)])
    row_of = np.concatenate([np.arange(rows), ref_row])
    out: dict[str, np.ndarray] = {"hyp_len": hl.astype(np.int32)}
    gram = row_of[of_list]
    at = np.arange(len(of_list))
    for n in range(1, max_n + 1):
        number, _ = pd.factorize(gram[at] * size + token[at + n - 1])
        count = int(number.max()) + 1 if len(number) else 0
        lists = of_list[at]
        is_hyp = lists < rows
        hc = np.bincount(number[is_hyp], minlength=count)
        of = np.zeros(count, np.int64)
        of[number] = row_of[lists]
        if len(rl) <= rows and (per_row <= 1).all():  # one reference a row: its counts are the gram's
            rgram, rc = np.arange(count), np.bincount(number[~is_hyp], minlength=count)
        else:
            code, seen = pd.factorize(number[~is_hyp] * (len(rl) + 1) + (lists[~is_hyp] - rows))
            rgram, rc = (seen // (len(rl) + 1)).astype(np.int64), np.bincount(code, minlength=len(seen))
        most = np.zeros(count, np.int64)
        np.maximum.at(most, rgram, rc)
        shared = np.minimum(rc, hc[rgram])
        out[f"m{n}"] = np.bincount(of, np.minimum(hc, most), minlength=rows).astype(np.int64)
        out[f"rm{n}"] = np.bincount(of[rgram], shared, minlength=rows).astype(np.int64)
        if n == 1 and keywords is not None:
            known = np.isin(np.array(both.dictionary.to_pylist(), dtype=object), list(keywords))
            w = np.append(np.where(known, 1.0, 0.2), 0.2)  # the last: null tokens
            weight = np.zeros(count)
            weight[number] = w[token[at]]
            out["wrm1"] = np.bincount(of[rgram], shared * weight[rgram], minlength=rows) + 0.0
            of_ref = of_list[len(of_list) - int(rl.sum()):] - rows
            each = np.maximum(1.0, np.bincount(of_ref, w[token[len(token) - len(of_ref):]], minlength=len(rl)))
            out["wden1"] = np.bincount(ref_row, each, minlength=rows) + 0.0
        gram = np.zeros(len(of_list), np.int64)
        gram[at] = number
        both_have = np.zeros(len(of_list), bool)
        both_have[at] = ((hc > 0) & (most > 0))[number]
        at = np.flatnonzero(both_have[:-1] & both_have[1:])
        at = at[at + n < len(of_list)]
        at = at[of_list[at] == of_list[at + n]]
    return out


def explode_grams(df: DataFrame, key: str, k: str, tokens: str, max_n: int, carry: Sequence[str] = ()) -> DataFrame:
    """Rows ``(key, n, g, k)``: every gram of orders 1..max_n of each token array.

    Tokens are exploded with their position and each position emits its grams by
    index access, so generators, ``GetArrayItem`` and ``ConcatWs`` all run inside
    whole-stage codegen (a higher-order lambda per gram would run interpreted).
    """
    # a blank inside a token must not look like the blank between two tokens
    t = F.col(tokens)
    t = F.when(F.contains(F.array_join(t, ""), F.lit(" ")), F.transform(t, lambda x: F.replace(x, F.lit(" "), F.lit("\x00")))).otherwise(t)
    pos = df.select(key, *carry, F.col(k).alias("k"), t.alias("_t")).select("*", F.posexplode("_t").alias("_i", "_w"))
    size = F.size("_t")
    per_pos = F.array(*[
        F.struct(F.lit(n).alias("n"), F.when(F.col("_i") + n <= size,
                                              F.concat_ws(" ", *[F.col("_t")[F.col("_i") + j] for j in range(n)])).alias("g"))
        for n in range(1, max_n + 1)])
    return pos.select(key, *carry, "k", F.explode(per_pos).alias("_x")).select(
        key, *carry, F.col("_x.n").alias("n"), F.col("_x.g").alias("g"), "k").filter(F.col("g").isNotNull())


def _den(n):
    return lambda a, x: a + F.greatest(F.lit(1), possible(x, n))


def _poss(n):
    return lambda a, x: a + possible(x, n)


def ngram_stats_long(
    hyps: DataFrame,
    refs: DataFrame,
    key: str = "pair_id",
    hyp: str = "hyp",
    ref: str = "ref",
    ref_id: str = "ref_id",
    max_n: int = 4,
    keywords: Sequence[str] | None = None,
) -> DataFrame:
    """Per-pair statistics with references as rows ``(key, ref_id, ref tokens)``.

    ``hyps`` has one row per key.  Keys without references get zero counts.
    Nothing is gathered per key, so a key with millions of references is split
    across tasks like any other data.
    """
    h = hyps.select(key, F.col(hyp).alias("_t"))
    r = refs.select(key, F.col(ref_id).alias("_k"), F.col(ref).alias("_t"))
    # Hypothesis counts are unique per (key, n, gram); each reference's count is
    # joined to them instead of gathering a gram's references into one list.  A
    # gram shared by very many references of one key is a skewed join key that
    # AQE's skew-join splits.  Reference ids may be of any type and value.
    hc = explode_grams(h.select(key, F.lit(0).alias("k"), "_t"), key, "k", "_t", max_n) \
        .groupBy(key, "n", "g").agg(F.count(F.lit(1)).alias("hc"))
    rc = explode_grams(r.select(key, F.col("_k").alias("k"), "_t"), key, "k", "_t", max_n) \
        .groupBy(key, "n", "g", "k").agg(F.count(F.lit(1)).alias("c")).select(key, "n", "g", "c")
    j = rc.join(hc, [key, "n", "g"])
    per_gram = j.groupBy(key, "n", "g").agg(
        F.least(F.max("hc"), F.max("c")).alias("clip"), F.sum(F.least(F.col("c"), F.col("hc"))).alias("rmin"))
    counts = per_gram.groupBy(key).agg(*_gram_aggs(max_n, keywords))

    hl = h.select(key, F.size("_t").alias("hyp_len"))
    rl = r.select(key, F.size("_t").alias("_l"), *([weighted_total(F.col("_t"), keywords).alias("_w")] if keywords is not None else []))
    rl = rl.join(hl, key)
    ref_aggs = [F.min("_l").alias("ref_min"),
                F.min(F.struct(F.abs(F.col("_l") - F.col("hyp_len")).alias("d"), F.col("_l").alias("r")))["r"].alias("ref_closest"),
                F.count(F.lit(1)).alias("n_refs")]
    ref_aggs += [F.sum(F.greatest(F.lit(1), possible(F.col("_l"), n))).alias(f"rden{n}") for n in range(1, max_n + 1)]
    ref_aggs += [F.sum(possible(F.col("_l"), n)).alias(f"rposs{n}") for n in range(1, max_n + 1)]
    if keywords is not None:
        ref_aggs.append(F.sum(F.greatest(F.lit(1.0), F.col("_w"))).alias("wden1"))
    ragg = rl.groupBy(key).agg(*ref_aggs)

    out = hl.join(ragg, key, "left").join(counts, key, "left")
    fill = {c: 0 for c in ["ref_min", "ref_closest", "n_refs"] + [f"rden{n}" for n in range(1, max_n + 1)]
            + [f"rposs{n}" for n in range(1, max_n + 1)] + _count_cols(max_n, None)}
    if keywords is not None:
        fill.update({"wden1": 0.0, "wrm1": 0.0})
    return out.fillna(fill)
