"""Registered classification / loss queries over labels, embeddings and events."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import arrays as A
from pairforge.operators import classify as C
from pairforge.plans.catalog import query
from pairforge.sources.tables import table

R6 = 6


def _r(df: DataFrame, keep: list[str], floats: list[str], d: int = R6) -> DataFrame:
    return df.select(*keep, *[F.round(c, d).alias(c) for c in floats])


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


_PRF_SQL = """WITH c AS (
  SELECT count(*) AS n,
         sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
         sum(CASE WHEN quality <> 1 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
         sum(CASE WHEN quality = 1 AND toxic <> 1 THEN 1 ELSE 0 END)::BIGINT AS fn
  FROM labels),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM c)
SELECT n, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1 FROM p"""


@query("binary_prf_labels", "D14", _PRF_SQL)
def binary_prf_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision / recall / F1 of class 1 with ``quality`` as truth and ``toxic`` as prediction."""
    df = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"))
    return _r(C.binary_prf(df), ["n", "tp", "fp", "fn"], ["precision", "recall", "f1"])


_E = "list_transform(embedding, lambda x: x::DOUBLE)"


def _sql_fold(k: int) -> str:
    """All values of an embedding folded into ``k`` logits: logit c sums the positions with the same remainder."""
    return f"list_transform(range({k}), lambda c: list_sum(list_transform(range(c + 1, len(embedding) + 1, {k}), lambda i: embedding[i]::DOUBLE)))"


def _fold(e, k: int):
    def one(c):
        return F.aggregate(F.filter(F.transform(e, lambda x, i: F.when(i % k == c, x)), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    return F.array(*(one(c) for c in range(k)))


_HEAD2 = f"(SELECT label, {_sql_fold(2)} AS l FROM embeddings)"
_LSE = "(list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))))"
_THRESH_SQL = f"""WITH s AS (
  SELECT CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
         CASE WHEN exp(l[2] - {_LSE}) > 0.5 THEN 1 ELSE 0 END AS p FROM {_HEAD2}),
c AS (SELECT count(*) AS n, sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
             sum(CASE WHEN y <> 1 AND p = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
             sum(CASE WHEN y = 1 AND p <> 1 THEN 1 ELSE 0 END)::BIGINT AS fn FROM s),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM c)
SELECT n, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6) AS f1 FROM q"""


@query("threshold_prf_embeddings", "H17 H26 B14 D14", _THRESH_SQL)
def threshold_prf_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-class head: softmax of the 64 values folded into two logits, class 1 when its probability > 0.5;
    truth is ``label >= 5``."""
    e = _emb(spark, sf_dir).select("label", _fold(F.col("e"), 2).alias("l"))
    p1 = F.get(A.softmax("l"), 1)
    df = e.select((A.scalarize(F.col("label")) >= 5).cast("int").alias("label"), C.threshold_predict(p1).alias("pred"))
    return _r(C.binary_prf(df), ["n", "tp", "fp", "fn"], ["precision", "recall", "f1"])


_HEAD10 = f"(SELECT label, {_sql_fold(10)} AS l FROM embeddings)"
_ACC_SQL = f"""SELECT count(*) AS n,
  round(avg(CASE WHEN label = list_position(l, list_max(l)) - 1 THEN 1.0 ELSE 0.0 END), 4) AS acc,
  round(avg({_LSE} - l[label + 1]), 6) AS eval_loss,
  round(avg({_LSE} - list_sum(list_transform(l, lambda x: exp(x - {_LSE}) * x))), 6) AS entropy
FROM {_HEAD10}"""


@query("accuracy_embeddings", "H17 H18 D15", _ACC_SQL)
def accuracy_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class head over the 64 values folded into ten logits: arg-max accuracy (4 decimals), mean cross entropy and
    mean entropy."""
    e = _emb(spark, sf_dir).select("label", _fold(F.col("e"), 10).alias("logits"))
    df = e.select("label", A.argmax("logits").alias("pred"), (-A.logprob_of_label("logits", "label")).alias("loss"),
                  A.entropy_from_logits("logits").alias("h"))
    out = C.metric_row(C.accuracy(df, loss="loss"), df.agg(F.avg("h").alias("entropy")), decimals=12)
    return out.select("n", F.round("acc", 4).alias("acc"), F.round("eval_loss", R6).alias("eval_loss"), F.round("entropy", R6).alias("entropy"))


_MASK_SQL = f"""SELECT round(sum(CASE WHEN label <> 0 THEN {_LSE} - l[label + 1] ELSE 0 END) / sum(CASE WHEN label <> 0 THEN 1 ELSE 0 END), 6) AS loss,
  round(sum(CASE WHEN label <> 0 THEN {_LSE} - l[label + 1] ELSE 0 END), 6) AS loss_x_n,
  sum(CASE WHEN label <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_tokens
FROM {_HEAD10}"""


@query("masked_token_loss_embeddings", "H18 D17", _MASK_SQL)
def masked_token_loss_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross entropy over positions whose target is not the pad id 0."""
    e = _emb(spark, sf_dir).select("label", _fold(F.col("e"), 10).alias("logits"))
    out = C.masked_token_loss(e, "logits", "label", (F.col("label") != 0).cast("long"))
    return out.select(F.round("loss", R6).alias("loss"), F.round("loss_x_n", R6).alias("loss_x_n"), "n_tokens")


_SEQ_SQL = """WITH t AS (SELECT vec_id, p, list_transform(embedding[8 * p + 1:8 * p + 8], lambda x: x::DOUBLE) AS l,
         (floor(abs(embedding[8 * p + 9]) * 1000)::BIGINT % 8)::INTEGER AS y FROM embeddings, (SELECT unnest(range(7)) AS p)),
s AS (SELECT list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) - l[y + 1] AS nll FROM t WHERE y <> 0)
SELECT round(avg(nll), 6) AS loss, round(sum(nll), 4) AS loss_x_n, count(*) AS n_tokens FROM s"""


@query("sequence_loss_embeddings", "H18 D17", _SEQ_SQL)
def sequence_loss_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted, masked cross entropy: eight tokens a row with eight logits each, targets from the values, 0 is padding."""
    e = _emb(spark, sf_dir)
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.slice("e", p * 8 + 1, 8))
    d = e.select(tokens.alias("logits"))
    d = d.withColumn("targets", F.transform("logits", lambda x: (F.floor(F.abs(F.get(x, 0)) * 1000) % 8).cast("int")))
    out = C.sequence_token_loss(d, "logits", "targets", "targets")
    return out.select(F.round("loss", R6).alias("loss"), F.round("loss_x_n", 4).alias("loss_x_n"), F.col("n_tokens").cast("long").alias("n_tokens"))


_PPL_SQL = """SELECT event_type AS task, count(*) AS n_batches, round(exp(avg(ln(1 + value))), 5) AS ppl
FROM events GROUP BY event_type"""


@query("perplexity_by_task", "D16", _PPL_SQL)
def perplexity_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity per task: event type as task, ln(1 + value) as the batch loss."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.log1p("value").alias("loss"))
    out = C.perplexity(ev, "loss", ["task"])
    return out.select("task", "n_batches", F.round("ppl", 5).alias("ppl"))


_ROW_SQL = """WITH c AS (
  SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS acc,
         sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN quality <> 1 AND toxic = 1 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN quality = 1 AND toxic <> 1 THEN 1 ELSE 0 END) AS fn FROM labels),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM c)
SELECT n, round(acc, 4) AS acc, round(pr, 4) AS precision, round(rc, 4) AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 4) AS f1 FROM p"""


@query("metric_row_labels", "D20", _ROW_SQL)
def metric_row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and P/R/F1 merged into one row, rounded to 4 decimals."""
    df = table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"))
    a = C.accuracy(df).select("n", "acc")
    b = C.binary_prf(df).select("precision", "recall", "f1")
    return C.metric_row(a, b)
