"""Evaluation-log analytics.

Running quantities (cumulative sums, running maxima, streak counters) are
prefix scans per run ordered by step.  A run may hold a large share of all
rows, so the scan is never one window over the whole run: rows are
range-partitioned on (run, step) - which splits a hot run across tasks - each
task scans its slice, the per-slice totals (one row per slice) are prefix-summed
per run, and each row adds the total of the slices before it.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Scan:
    name: str
    value: Column
    how: str = "sum"          # "sum" or "max"
    inclusive: bool = True    # include the current row


def _agg(how: str, c: Column) -> Column:
    return F.sum(c) if how == "sum" else F.max(c)


def _order_num(df: DataFrame, order: str) -> Column:
    """The order column as a number: microseconds, the integer itself, or a double (fractional steps keep their order)."""
    t = dict(df.dtypes)[order]
    if t.startswith(("timestamp", "date")):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.col(order).cast("long" if t in ("tinyint", "smallint", "int", "bigint") else "double")


def _cell(x: Column, bounds: Sequence[float], lo: int = 0, hi: int | None = None) -> Column:
    """Number of sorted ``bounds`` at or below x, as a binary search of comparisons."""
    hi = len(bounds) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(x < F.lit(bounds[mid]), _cell(x, bounds, lo, mid)).otherwise(_cell(x, bounds, mid + 1, hi))


@dataclass(frozen=True)
class Slices:
    """Cuts of the order axis: cells with about equally many rows (``bounds``), each cut again into equal widths."""
    bounds: tuple
    lo: float
    hi: float

    CELLS = 64
    PARTS = 64

    @staticmethod
    def of(df: DataFrame, order: str) -> Slices:
        """One aggregate job: a burst of rows gets as many cells as its share, whatever run it belongs to."""
        x = _order_num(df, order)
        shares = [i / Slices.CELLS for i in range(1, Slices.CELLS)]
        row = df.agg(F.percentile_approx(x, shares, 10_000).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        return Slices(tuple(sorted(set(row["q"] or ()))), row["lo"] or 0, row["hi"] or 0)

    def id(self, x: Column) -> Column:
        ends = [float(e) for e in (self.lo, *self.bounds, self.hi)]
        starts = F.array(*(F.lit(a) for a in ends[:-1]))
        widths = F.array(*(F.lit(max((b - a) / self.PARTS, 1e-12)) for a, b in zip(ends, ends[1:])))
        cell = _cell(x, self.bounds)
        part = F.floor((x.cast("double") - F.get(starts, cell)) / F.get(widths, cell))
        return (cell * self.PARTS + F.greatest(F.least(part, F.lit(self.PARTS - 1)), F.lit(0))).cast("long")


def running(df: DataFrame, key: str, order: str, scans: Sequence[Scan], slices: Slices | None = None) -> DataFrame:
    """Add one column per :class:`Scan`: the running sum / max over the run ``key``
    in ``order`` (unique within a run).

    Each run is cut into the given ``slices`` of the order axis (default: found by one
    small aggregate job over the table; callers that scan twice find them once).  Slices
    are scanned in parallel by a window over (run, slice); slice totals (one row per
    slice) are prefix-aggregated per run and joined back.  Slice ids come from the data,
    so every re-computation agrees.
    """
    onum = _order_num(df, order)
    slices = slices or Slices.of(df, order)
    base = df.select("*", slices.id(onum).alias("_slice"),
                     *[s.value.alias(f"_v{i}") for i, s in enumerate(scans)])
    local_cols = []
    for i, s in enumerate(scans):
        w = Window.partitionBy(key, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        local_cols.append(_agg(s.how, F.col(f"_v{i}")).over(w).alias(f"_l{i}"))
    local = base.select("*", *local_cols)
    tot = base.groupBy(key, "_slice").agg(*[_agg(s.how, F.col(f"_v{i}")).alias(f"_t{i}") for i, s in enumerate(scans)])
    wp = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(key, "_slice", *[_agg(s.how, F.col(f"_t{i}")).over(wp).alias(f"_o{i}") for i, s in enumerate(scans)])
    j = local.join(off, [key, "_slice"])
    outs = []
    for i, s in enumerate(scans):
        o, l_ = F.col(f"_o{i}"), F.col(f"_l{i}")
        outs.append((F.coalesce(o, F.lit(0)) + F.coalesce(l_, F.lit(0)) if s.how == "sum" else F.greatest(o, l_)).alias(s.name))
    drop = {"_slice"} | {f"_v{i}" for i in range(len(scans))} | {f"_l{i}" for i in range(len(scans))} | \
        {f"_o{i}" for i in range(len(scans))}
    return j.select(*[c for c in j.columns if c not in drop], *outs)


def running_error_rate(log: DataFrame, run: str, step: str, errors: Column, seen: Column, decimals: int = 5) -> DataFrame:
    """Cumulative errors / cumulative samples seen, per run and step (null while nothing was seen)."""
    out = running(log, run, step, [Scan("_err", errors), Scan("_seen", seen)])
    return out.withColumn("error_rate", F.round(F.try_divide("_err", "_seen"), decimals)).drop("_err", "_seen")


def best_checkpoint(log: DataFrame, run: str, step: str, metric: str, mode: str = "max") -> DataFrame:
    """Best metric per run with strict improvement (earliest step wins ties)."""
    s = _order_num(log, step)
    m = F.col(metric) if mode == "max" else -F.col(metric)
    g = log.groupBy(run).agg(F.count(F.lit(1)).alias("n_evals"), F.max(F.struct(m.alias("m"), (-s).alias("s"))).alias("_b"))
    best = F.col("_b.m") if mode == "max" else -F.col("_b.m")
    return g.select(run, "n_evals", best.alias("best_value"), (-F.col("_b.s")).alias("_bs"))


def _streaks(log: DataFrame, run: str, step: str, slices: Slices, metrics: dict[str, tuple[str, float]]) -> DataFrame:
    """For each ``out: (value, init)``: evaluations since the last strict improvement of ``value`` over the best so far
    (at first ``init``), added as ``out``.

    The best before a slice comes from an aggregate of one row per slice, so the rows are dealt and sorted once: both windows run over
    (run, slice), and the last improvement before a slice is again an aggregate of rows that lie together already."""
    cell = [run, "_slice"]
    base = log.withColumn("_slice", slices.id(_order_num(log, step)))
    slice_rows = Window.partitionBy(run).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tot = base.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), *[F.max(v).alias(f"_b_{o}") for o, (v, _) in metrics.items()])
    before = tot.select(*cell, F.coalesce(F.sum("_n").over(slice_rows), F.lit(0)).alias("_n"),
                        *[F.max(f"_b_{o}").over(slice_rows).alias(f"_b_{o}") for o in metrics])
    w = Window.partitionBy(*cell).orderBy(step)
    so_far, earlier = (w.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    d = base.join(before, cell).withColumns({"_idx": F.col("_n") + F.row_number().over(w),
                                             **{f"_p_{o}": F.max(v).over(earlier) for o, (v, _) in metrics.items()}})
    d = d.withColumns({f"_at_{o}": F.when(F.col(v) > F.greatest(f"_p_{o}", f"_b_{o}", F.lit(i)), F.col("_idx")) for o, (v, i) in metrics.items()})
    d = d.withColumns({f"_l_{o}": F.max(f"_at_{o}").over(so_far) for o in metrics})
    last = d.groupBy(*cell).agg(*[F.max(f"_at_{o}").alias(f"_o_{o}") for o in metrics])
    last = last.select(*cell, *[F.max(f"_o_{o}").over(slice_rows).alias(f"_o_{o}") for o in metrics])
    d = d.join(last, cell).withColumns({o: F.col("_idx") - F.coalesce(f"_l_{o}", f"_o_{o}", F.lit(0)) for o in metrics})
    return d.drop("_slice", "_n", "_idx", *(f"_{x}_{o}" for o in metrics for x in ("b", "p", "at", "l", "o")))


def joint_early_stop(log: DataFrame, run: str, step: str, loss: str, score: str, patience: int, init_loss: float = 1e6,
                     init_score: float = -1.0) -> DataFrame:
    """E4 for generation tasks: a run stops at the first step at which **both** counters, that of the loss
    (perplexity, lower is better) and that of the score (bleu + em, higher is better), exceed ``patience``.

    Returns ``run, n_evals, best_loss, best_score, stop_step`` (null when training would not stop)."""
    slices = Slices.of(log, step)
    d = _streaks(log.withColumn("_nl", -F.col(loss)), run, step, slices,
                 {"_bad_loss": ("_nl", -init_loss), "_bad_score": (score, init_score)})
    stop = (F.col("_bad_loss") > patience) & (F.col("_bad_score") > patience)
    return d.groupBy(run).agg(F.count(F.lit(1)).alias("n_evals"), F.min(loss).alias("best_loss"), F.max(score).alias("best_score"),
                              F.min(F.when(stop, F.col(step))).alias("stop_step"))


def early_stop(log: DataFrame, run: str, step: str, metric: str, patience: int, mode: str = "max",
               init: float | None = None) -> DataFrame:
    """Per run, the first step at which the no-improvement counter exceeds ``patience``.

    The counter resets on a strict improvement over the best so far (initial best
    ``init``: -1 for max mode, 1e6 for min mode by default) and grows by one otherwise.
    Returns ``run, n_evals, best_value, stop_step`` (null when training would not stop).
    """
    init = (-1.0 if mode == "max" else 1e6) if init is None else init
    m = F.col(metric) if mode == "max" else -F.col(metric)
    init_m = init if mode == "max" else -init
    slices = Slices.of(log, step)
    p2 = _streaks(log.withColumn("_m", m), run, step, slices, {"_streak": ("_m", init_m)}).withColumn("_stop", F.col("_streak") > patience)
    best = F.max(F.col("_m")) if mode == "max" else -F.max(F.col("_m"))
    return p2.groupBy(run).agg(F.count(F.lit(1)).alias("n_evals"), best.alias("best_value"),
                               F.min(F.when(F.col("_stop"), F.col(step))).alias("stop_step"))


def kl_coef_path(log: DataFrame, run: str, step: str, kl: str, init_coef: float = 100.0, target: float = 6.0,
                 horizon: float = 10000.0, n_steps: int = 48, adaptive: bool = True) -> DataFrame:
    """The KL coefficient used at each step: init times the product of the earlier
    steps' multipliers 1 + clip(kl / target - 1, -0.2, 0.2) * n_steps / horizon."""
    if not adaptive:
        return log.withColumn("kl_coef", F.lit(init_coef))
    err = F.greatest(F.least(F.col(kl) / target - 1.0, F.lit(0.2)), F.lit(-0.2))
    ln_mult = F.log(1.0 + err * n_steps / horizon)
    out = running(log, run, step, [Scan("_lm", ln_mult, "sum", inclusive=False)])
    return out.withColumn("kl_coef", init_coef * F.exp(F.col("_lm"))).drop("_lm")


def stopped_schedule(draws: DataFrame, draw: str, task: str, stops: DataFrame, max_skips: int = 50) -> DataFrame:
    """F7 with early stopping: draws (in the order of ``draw``) of a task from its ``stop_at`` on are skipped; more than
    ``max_skips`` skips in a row end the schedule.  Returns the steps that are taken: ``draw, task, step``.

    ``stops(task, stop_at)`` has a row per task; the counters are sliced prefix scans over the draws."""
    d = draws.join(stops.select(task, "stop_at"), task, "left") \
        .select(draw, task, F.coalesce(F.col(draw) >= F.col("stop_at"), F.lit(False)).alias("_skip"), F.lit(0).alias("_all"))
    slices = Slices.of(d, draw)
    d = running(d, "_all", draw, [Scan("_i", F.lit(1)), Scan("step", F.when(F.col("_skip"), 0).otherwise(1))], slices)
    d = running(d, "_all", draw, [Scan("_last", F.when(F.col("_skip"), 0).otherwise(F.col("_i")), "max")], slices)
    end = d.filter(F.col("_i") - F.col("_last") > max_skips).agg(F.min("_i")).first()[0]
    taken = d.filter(~F.col("_skip"))
    return (taken if end is None else taken.filter(F.col("_i") < end)).select(draw, task, "step")


def best_changes(log: DataFrame, run: str, step: str, metric: str, mode: str = "max", decimals: int = 4,
                 label: str | None = None) -> DataFrame:
    """The evaluations at which a run's best value changed (the first counts), with the line that is logged:
    ``run, step, criteria, metric, value, line``."""
    m = F.col(metric) if mode == "max" else -F.col(metric)
    d = running(log.withColumn("_m", m), run, step, [Scan("_prev", F.col("_m"), "max", inclusive=False)])
    d = d.filter(F.col("_prev").isNull() | (F.col("_m") > F.col("_prev")))
    name = label or metric
    line = F.format_string(f"[%s] Best {name} changed into %.{decimals}f", F.col(step).cast("string"), F.col(metric).cast("double"))
    return d.select(run, step, F.lit("best changed").alias("criteria"), F.lit(name).alias("metric"), F.col(metric).alias("value"), line.alias("line"))
