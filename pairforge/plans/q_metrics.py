"""Registered metric queries over pair sets derived from the supplied tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import text as T
from pairforge.operators import bleu as B
from pairforge.operators import textmetrics as TM
from pairforge.operators.overlap import ngram_stats
from pairforge.plans import oracle as O
from pairforge.plans.catalog import query
from pairforge.plans.pairs import doc_pairs, turn_pairs
from pairforge.functions.keywords import JAVA

R6 = 6  # decimals kept in float outputs of registered queries


def doc_bleu_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = doc_pairs(spark, sf_dir).select(
        "pair_id", "lang", F.col("pred").alias("hyp"), F.array("gold").alias("refs"))
    return ngram_stats(p, extra=["lang"], single_ref=True, texts=True)


# ------------------------------------------------------------------ D3 (flagship)
_SQL_CORPUS_BLEU = f"""WITH {O.DOC_PAIRS},
{O.ngram_stats('doc_pairs', O.split('pred'), O.split('gold'), extra=('lang',))}
{O.corpus_bleu_select('stats', 'lang', rollup=True)}"""


@query("corpus_bleu_by_lang", "H1 H6 C7 G2 G3 D3", _SQL_CORPUS_BLEU)
def corpus_bleu_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed corpus BLEU (x100) of document k+1 against document k, per language and in total."""
    out = B.corpus_bleu(doc_bleu_stats(spark, sf_dir), ["lang"], smooth=True, rollup=True)
    return out.select("lang", "n_pairs", F.round("bleu", R6).alias("bleu"))


def _r(df: DataFrame, keep: list[str], floats: list[str]) -> DataFrame:
    return df.select(*keep, *[F.round(c, R6).alias(c) for c in floats])


def nist_tokens(c):
    """Tokenisation of the smoothed sentence BLEU: strip, lower, split punctuation, NIST normalise."""
    return T.nist_normalize(T.split_puncts(F.lower(T.py_strip(c))))


# ------------------------------------------------------------------ D4 on turn pairs
_SQL_SMOOTH_TURNS = f"""WITH {O.TURN_PAIRS},
{O.ngram_stats('turn_pairs', O.nist_normalize(O.split_puncts('lower(' + O.strip('pred') + ')')),
               O.nist_normalize(O.split_puncts('lower(' + O.strip('gold') + ')')))}
{O.smooth_bleu_select('stats')}"""


@query("smooth_bleu_turns", "H2 H3 H4 C11 D4", _SQL_SMOOTH_TURNS)
def smooth_bleu_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed sentence BLEU (macro mean x100, plus p1..p4) of assistant turn t+1 vs user turn t."""
    p = turn_pairs(spark, sf_dir).select("pair_id", nist_tokens(F.col("pred")).alias("hyp"),
                                         F.array(nist_tokens(F.col("gold"))).alias("refs"))
    out = B.smooth_bleu_corpus(ngram_stats(p, single_ref=True))
    return _r(out, ["n_pairs"], ["bleu", "p1", "p2", "p3", "p4"])


# ------------------------------------------------------------------ A11 + G2 + C3 + D4 (multi-reference)
_SQL_SMOOTH_CONV = f"""WITH conv_pred AS (
  SELECT conv_id AS pair_id, max_by(text, turn) AS pred FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
conv_gold AS (
  SELECT conv_id AS pair_id, turn, text AS gold FROM conversations WHERE role = 'user'),
conv_h AS (SELECT * FROM conv_pred WHERE pair_id IN (SELECT pair_id FROM conv_gold)),
{O.ngram_stats('conv_h', O.nist_normalize(O.split_puncts('lower(' + O.strip('pred') + ')')),
               O.nist_normalize(O.split_puncts('lower(' + O.strip('gold') + ')')), ref_src='conv_gold', ref_id='turn')}
{O.smooth_bleu_select('stats')}"""


@query("smooth_bleu_conversations", "A11 C3 G2 D4", _SQL_SMOOTH_CONV)
def smooth_bleu_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction/gold maps keyed by conversation: the last assistant turn is the
    prediction (last one per id wins) and every user turn of the id is a reference."""
    from pairforge.sources.tables import table
    from pairforge.operators.overlap import ngram_stats_long
    c = table(spark, sf_dir, "conversations")
    pred = c.filter(F.col("role") == "assistant").groupBy(F.col("conv_id").alias("pair_id")).agg(
        F.max_by("text", "turn").alias("pred"))
    gold = c.filter(F.col("role") == "user").select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("ref_id"),
                                                    nist_tokens(F.col("text")).alias("ref"))
    hyps = pred.join(gold.select("pair_id").distinct(), "pair_id", "left_semi").select(
        "pair_id", nist_tokens(F.col("pred")).alias("hyp"))
    out = B.smooth_bleu_corpus(ngram_stats_long(hyps, gold))
    return _r(out, ["n_pairs"], ["bleu", "p1", "p2", "p3", "p4"])


# ------------------------------------------------------------------ D5 + D7
_SQL_NGRAM_MATCH = f"""WITH {O.DOC_PAIRS},
{O.ngram_stats('doc_pairs', O.split('pred'), O.split('gold'), extra=('lang',))}
{O.ngram_match_select('stats', 'lang', rollup=True)}"""


@query("ngram_match_by_lang", "D5", _SQL_NGRAM_MATCH)
def ngram_match_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CodeBLEU n-gram match (smoothing method 1) per language and in total."""
    out = B.ngram_match(doc_bleu_stats(spark, sf_dir), ["lang"], rollup=True)
    return _r(out, ["lang", "n_pairs"], ["score"])


_SQL_SMOOTHING = f"""WITH {O.TURN_PAIRS},
{O.ngram_stats('turn_pairs', O.split('pred'), O.split('gold'))}
{O.ngram_match_select('stats', None, methods=(0, 1, 2, 3, 4), names=tuple(f'score_m{m}' for m in range(5)))}"""


@query("bleu_smoothing_methods", "D7", _SQL_SMOOTHING)
def bleu_smoothing_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus n-gram match of turn pairs under smoothing methods 0-4 (one aggregation)."""
    p = turn_pairs(spark, sf_dir).select("pair_id", T.py_split(F.col("pred")).alias("hyp"),
                                         F.array(T.py_split(F.col("gold"))).alias("refs"))
    out = B.ngram_match(ngram_stats(p, single_ref=True), smoothing=[0, 1, 2, 3, 4])
    return _r(out, ["n_pairs"], [f"score_m{m}" for m in range(5)])


# ------------------------------------------------------------------ D6
_SQL_WEIGHTED = f"""WITH {O.DOC_PAIRS},
{O.ngram_stats('doc_pairs', O.split('pred'), O.split('gold'), extra=('lang',), keywords=JAVA)}
{O.weighted_match_select('stats', 'lang', rollup=True)}"""


@query("weighted_ngram_match_by_lang", "H25 C10 D6", _SQL_WEIGHTED)
def weighted_ngram_match_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-weighted n-gram recall (Java keyword list) per language and in total."""
    p = doc_pairs(spark, sf_dir).select(
        "pair_id", "lang", F.col("pred").alias("hyp"), F.array("gold").alias("refs"))
    out = B.weighted_ngram_match(ngram_stats(p, extra=["lang"], keywords=JAVA, single_ref=True, texts=True), ["lang"], rollup=True)
    return _r(out, ["lang", "n_pairs"], ["score"])


# ------------------------------------------------------------------ D8
_SQL_SENTENCE = f"""WITH {O.TURN_PAIRS},
{O.ngram_stats('turn_pairs', O.split('pred'), O.split('gold'))}
SELECT pair_id, hyp_len, round({O.bleu_from_sums([f'm{n}::DOUBLE' for n in range(1, 5)],
                               [f'greatest(1, {O.possible("hyp_len", n)})::DOUBLE' for n in range(1, 5)],
                               'hyp_len', 'ref_closest', 1)}, 6) AS score FROM stats"""


@query("sentence_bleu_turns", "D8", _SQL_SENTENCE)
def sentence_bleu_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-level n-gram match (method 1) of every turn pair."""
    p = turn_pairs(spark, sf_dir).select("pair_id", T.py_split(F.col("pred")).alias("hyp"),
                                         F.array(T.py_split(F.col("gold"))).alias("refs"))
    out = B.sentence_bleu(ngram_stats(p, single_ref=True))
    return _r(out.withColumn("hyp_len", F.col("hyp_len").cast("long")), ["pair_id", "hyp_len"], ["score"])


# ------------------------------------------------------------------ D10
_SQL_BAG_F1 = f"""WITH {O.DOC_PAIRS},
{O.ngram_stats('doc_pairs', O.word_tokens('pred'), O.word_tokens('gold'), max_n=1, extra=('lang',))}
{O.bag_f1_select('stats', 'lang', rollup=True)}"""


@query("bag_f1_by_lang", "H5 D10", _SQL_BAG_F1)
def bag_f1_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag-of-words precision / recall / F1 over lower-cased word tokens."""
    p = doc_pairs(spark, sf_dir).select("pair_id", "lang", T.word_tokens(F.col("pred")).alias("hyp"),
                                        F.array(T.word_tokens(F.col("gold"))).alias("refs"))
    out = TM.bag_f1(ngram_stats(p, extra=["lang"], max_n=1, single_ref=True), ["lang"], rollup=True)
    return _r(out, ["lang", "n_pairs"], ["precision", "recall", "f1"])


# ------------------------------------------------------------------ D11
_SQL_ROUGE_N = f"""WITH {O.TURN_PAIRS},
{O.ngram_stats('turn_pairs', O.split('pred'), O.split('gold'))}
{O.rouge_n_select('stats', 4, True)}"""


@query("rouge_n_turns", "D11", _SQL_ROUGE_N)
def rouge_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-N (order 4, smoothed): the reference's all-order form and per-order recall."""
    p = turn_pairs(spark, sf_dir).select("pair_id", T.py_split(F.col("pred")).alias("hyp"),
                                         F.array(T.py_split(F.col("gold"))).alias("refs"))
    st = ngram_stats(p, single_ref=True)
    out = TM.rouge_n(st, 4, smooth=True, both=True)
    return _r(out, ["n_pairs"], ["rouge_n_compat", "rouge_n"])


# ------------------------------------------------------------------ D12 (rows-only: LCS has no SQL twin)
# the longest common subsequence by thresholds: t[k] is the first place in the reference at which a common subsequence of length k
# can end; a token's places improve every threshold once
_ROUGE_L_SQL = f"""WITH {O.TURN_PAIRS},
s AS (SELECT {O.split('pred')} AS hyp, {O.split('gold')} AS ref FROM turn_pairs),
p AS (SELECT ref, list_transform(hyp, lambda y: list_filter(range(1, len(ref) + 1), lambda i: ref[i] = y)) AS places FROM s),
l AS (SELECT len(ref) AS n, len(list_reduce(places, lambda t, p: list_filter(list_transform(range(1, len(t) + 2), lambda k:
        list_min(list_append(list_filter(p, lambda x: x > CASE WHEN k = 1 THEN 0 ELSE t[k - 1] END), t[k]))), lambda x: x IS NOT NULL),
        []::BIGINT[])) AS lcs FROM p)
SELECT count(*) AS n_pairs, sum(lcs)::BIGINT AS lcs, sum(n)::BIGINT AS ref_tokens, round((sum(lcs) + 1.0) / (sum(n) + 1.0), 6) AS rouge_l FROM l"""


@query("rouge_l_turns", "D12", _ROUGE_L_SQL)
def rouge_l_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L (smoothed micro LCS recall) of assistant turn t+1 against user turn t."""
    p = turn_pairs(spark, sf_dir).select(T.py_split(F.col("pred")).alias("hyp"), T.py_split(F.col("gold")).alias("ref"))
    out = TM.rouge_l(p, smooth=True)
    return _r(out, ["n_pairs", "lcs", "ref_tokens"], ["rouge_l"])


# ------------------------------------------------------------------ B13 / D13
_SQL_EM = f"""WITH {O.DOC_PAIRS}
SELECT lang, count(*) AS n_pairs, round(avg(CASE WHEN {O.strip('pred')} = {O.strip('gold')} THEN 1 ELSE 0 END) * 100.0, 6) AS em
FROM doc_pairs GROUP BY ROLLUP(lang)"""


@query("exact_match_by_lang", "H2 B13 D13", _SQL_EM)
def exact_match_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-match rate (x100) after stripping both sides."""
    out = TM.exact_match_rate(doc_pairs(spark, sf_dir), group_cols=["lang"], rollup=True)
    return _r(out, ["lang", "n_pairs"], ["em"])


# ------------------------------------------------------------------ D7 (all eight methods, per sentence)
_SQL_SENT_METHODS = f"""WITH {O.TURN_PAIRS},
{O.ngram_stats('turn_pairs', O.split('pred'), O.split('gold'), max_n=5)}
SELECT count(*) AS n_pairs, {', '.join(f'round(avg({O.sentence_score_sql(m)}), 6) AS score_m{m}' for m in range(8))}
FROM stats"""


@query("sentence_smoothing_turns", "D7 D8 K6", _SQL_SENT_METHODS)
def sentence_smoothing_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean sentence-level n-gram match of turn pairs under smoothing methods 0-7."""
    p = turn_pairs(spark, sf_dir).select("pair_id", T.py_split(F.col("pred")).alias("hyp"),
                                         F.array(T.py_split(F.col("gold"))).alias("refs"))
    st = ngram_stats(p, max_n=5, single_ref=True)
    # all eight scores are projections of the same per-pair row
    per = st.select(*[B.sentence_score(m).alias(f"score_m{m}") for m in range(8)])
    out = per.agg(F.count(F.lit(1)).alias("n_pairs"), *[F.avg(f"score_m{m}").alias(f"score_m{m}") for m in range(8)])
    return _r(out, ["n_pairs"], [f"score_m{m}" for m in range(8)])


# ------------------------------------------------------------------ E-3 evaluation report (D20 over D3, D10, D13)
_SQL_REPORT = f"""WITH {O.DOC_PAIRS},
{O.ngram_stats('doc_pairs', O.split('pred'), O.split('gold'), name='s4')},
{O.ngram_stats('doc_pairs', O.word_tokens('pred'), O.word_tokens('gold'), max_n=1, name='s1')},
b AS ({O.corpus_bleu_select('s4', None)}),
f AS ({O.bag_f1_select('s1', None)}),
e AS (SELECT avg(CASE WHEN {O.strip('pred')} = {O.strip('gold')} THEN 1 ELSE 0 END) * 100.0 AS em FROM doc_pairs)
SELECT round(e.em, 4) AS em, round_even(b.bleu, 2) AS bleu, round_even(f.f1 * 100, 0) AS meteor FROM b, f, e"""


@query("eval_report_docs", "D20 D3 D10 D13", _SQL_REPORT)
def eval_report_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation row as the fine-tuning loop reports it: exact match x100, corpus
    BLEU rounded to 2 decimals, bag-of-words F1 ("meteor") x100 rounded half-even."""
    from pairforge.operators.classify import metric_row
    pairs = doc_pairs(spark, sf_dir)
    em = TM.exact_match_rate(pairs).select(F.round("em", 4).alias("em"))
    bleu = B.corpus_bleu(doc_bleu_stats(spark, sf_dir)).select(F.bround(F.round("bleu", 6), 2).alias("bleu"))
    p1 = pairs.select("pair_id", T.word_tokens(F.col("pred")).alias("hyp"), F.array(T.word_tokens(F.col("gold"))).alias("refs"))
    f1 = TM.bag_f1(ngram_stats(p1, max_n=1, single_ref=True)).select(F.bround(F.round("f1", 6) * 100, 0).alias("meteor"))
    return metric_row(em, bleu, f1, decimals=6)


# ------------------------------------------------------------------ G2 with two references per pair
_SQL_TWO_REFS = f"""WITH h AS (SELECT p.doc_id - 1 AS pair_id, p.text AS pred FROM documents p
                   JOIN documents g ON g.doc_id = p.doc_id - 1 JOIN documents g2 ON g2.doc_id = p.doc_id + 1),
r AS (SELECT g.doc_id AS pair_id, 0 AS ref_no, g.text AS gold FROM documents g
        JOIN documents p ON p.doc_id = g.doc_id + 1 JOIN documents g2 ON g2.doc_id = g.doc_id + 2
      UNION ALL
      SELECT g2.doc_id - 2 AS pair_id, 1 AS ref_no, g2.text AS gold FROM documents g2
        JOIN documents p ON p.doc_id = g2.doc_id - 1 JOIN documents g ON g.doc_id = g2.doc_id - 2),
{O.ngram_stats('h', O.split('pred'), O.split('gold'), ref_src='r', ref_id='ref_no')},
b AS ({O.corpus_bleu_select('stats', None)}),
n AS ({O.ngram_match_select('stats', None)})
SELECT b.n_pairs, b.bleu, n.score AS ngram_match FROM b, n"""


@query("two_reference_bleu_docs", "G2 D3 D5", _SQL_TWO_REFS)
def two_reference_bleu_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus BLEU and n-gram match of document k+1 against two references, documents k
    and k+2 (clipping by the larger reference count, shortest / closest reference length)."""
    from pairforge.sources.tables import table
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    g = d.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("r0"))
    p = d.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("pred"))
    g2 = d.select((F.col("doc_id") - 2).alias("pair_id"), F.col("text").alias("r1"))
    j = g.join(p, "pair_id").join(g2, "pair_id")
    st = ngram_stats(j.select("pair_id", F.col("pred").alias("hyp"), F.array("r0", "r1").alias("refs")), texts=True)
    return B.pair_scores(st).select("n_pairs", F.round("bleu", R6).alias("bleu"), F.round("ngram_match", R6).alias("ngram_match"))
