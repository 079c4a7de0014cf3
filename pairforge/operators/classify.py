"""Classification and loss metrics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.arrays import bind, logprob_of_label
from pairforge.operators.bleu import _group


def threshold_predict(prob_class1, threshold: float = 0.5) -> Column:
    """Class-1 probability strictly above the threshold -> 1."""
    p = F.col(prob_class1) if isinstance(prob_class1, str) else prob_class1
    return (p > threshold).cast("int")


def binary_prf(df: DataFrame, label: str = "label", pred: str = "pred", group_cols: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of class 1 (0 on a zero division)."""
    y, p = F.col(label), F.col(pred)
    g = _group(df, group_cols, False).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
        F.sum(((y != 1) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p != 1)).cast("long")).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return g.select(*group_cols, "n", "tp", "fp", "fn", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred", loss: str | None = None,
             group_cols: Sequence[str] = ()) -> DataFrame:
    """mean(label == pred) and, when given, the mean loss."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(pred)).cast("double")).alias("acc")]
    if loss:
        aggs.append(F.avg(loss).alias("eval_loss"))
    return _group(df, group_cols, False).agg(*aggs)


def perplexity(batch_losses: DataFrame, loss: str = "loss", group_cols: Sequence[str] = ()) -> DataFrame:
    """exp(mean of per-batch losses), per task when grouped."""
    return _group(batch_losses, group_cols, False).agg(F.count(F.lit(1)).alias("n_batches"),
                                                        F.exp(F.avg(loss)).alias("ppl"))


def masked_token_loss(df: DataFrame, logits: str, label: str, mask: Column) -> DataFrame:
    """Cross entropy over positions with mask != 0: (loss, loss * n, n); without such
    positions the loss is null."""
    nll = -logprob_of_label(F.col(logits), F.col(label))
    g = df.agg(F.sum(nll * mask).alias("_s"), F.sum(mask).alias("n_tokens"))
    return g.select(F.try_divide("_s", "n_tokens").alias("loss"), F.col("_s").alias("loss_x_n"), "n_tokens")


def sequence_token_loss(df: DataFrame, logits: str, targets: str, mask: str) -> DataFrame:
    """D17 over sequences: the logits at position t are scored against the target at t + 1 wherever the target mask there
    is not 0; ``logits`` is an array of logit arrays.  Returns (loss, loss * n, n) over all sequences."""
    def scored(row: Column) -> Column:
        steps = F.slice(row["l"], 1, F.greatest(F.size(row["l"]) - 1, F.lit(0)))
        nll = F.transform(steps, lambda x, t: F.when(F.get(row["m"], t + 1) != 0, -logprob_of_label(x, F.get(row["y"], t + 1))))
        kept = F.filter(nll, lambda x: x.isNotNull())
        return F.struct(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x).alias("s"), F.size(kept).alias("n"))

    row = F.struct(F.col(logits).alias("l"), F.col(targets).alias("y"), F.col(mask).alias("m"))
    g = df.select(bind(row, scored).alias("_x")).agg(F.sum("_x.s").alias("loss_x_n"), F.sum("_x.n").alias("n_tokens"))
    return g.select(F.try_divide("loss_x_n", "n_tokens").alias("loss"), "loss_x_n", "n_tokens")


def metric_row(*one_row_frames: DataFrame, decimals: int = 4) -> DataFrame:
    """Merge one-row metric frames into one row, every double rounded; a name may occur once."""
    names = [c for f in one_row_frames for c in f.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"metric names occur twice: {sorted({c for c in names if names.count(c) > 1})}")
    # union of the one-row frames (missing columns null) folded by one global aggregate
    out = one_row_frames[0]
    for f in one_row_frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    dtypes = dict(out.dtypes)
    out = out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns])
    return out.select(*[F.round(c, decimals).alias(c) if dtypes[c] == "double" else F.col(c) for c in out.columns])
