"""Column -> Column helpers over numeric / id arrays.

All are higher-order Catalyst expressions evaluated row by row; nothing is
gathered across rows.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- H16-H18
def clip(x, lo: float, hi: float) -> Column:
    """Clamp a scalar."""
    return F.greatest(F.least(_c(x), F.lit(hi)), F.lit(lo))


def bind(value, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row: Catalyst expands a plain reference wherever it stands,
    inside a lambda once per element."""
    return F.transform(F.array(_c(value)), fn)[0]


def _total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def logsumexp(a) -> Column:
    """log(sum(exp(x))) with the maximum subtracted first."""
    return bind(a, lambda v: bind(F.array_max(v), lambda m: m + F.log(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))))


def softmax(a) -> Column:
    return bind(a, lambda v: bind(logsumexp(v), lambda lse: F.transform(v, lambda x: F.exp(x - lse))))


def entropy_from_logits(a) -> Column:
    """H = logsumexp(logits) - sum(p * logits)."""
    return bind(a, lambda v: bind(logsumexp(v), lambda lse: lse - F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + F.exp(x - lse) * x)))


def logprob_of_label(a, label) -> Column:
    """Log-softmax gathered at ``label`` (0-based)."""
    a = _c(a)
    return F.get(a, _c(label)) - logsumexp(a)


def argmax(a) -> Column:
    """0-based index of the first maximum."""
    a = _c(a)
    return F.array_position(a, F.array_max(a)) - 1


# ---------------------------------------------------------------- H19
def whiten(a, shift_mean: bool = True) -> Column:
    """(x - mean) / sqrt(var + 1e-8) with the **sample** variance (NaN -> 1 for one
    element); the mean is added back unless ``shift_mean``."""
    def spread(v: Column, mean: Column) -> Column:
        n = F.size(v)
        squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        var = F.when(n > 1, squares / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(1.0))
        back = F.lit(0.0) if shift_mean else mean
        return bind(F.sqrt(var + 1e-8), lambda sd: F.transform(v, lambda x: (x - mean) / sd + back))

    return bind(a, lambda v: bind(F.try_divide(_total(v), F.size(v)), lambda mean: spread(v, mean)))


# ---------------------------------------------------------------- H10-H15
def pad_truncate(ids, max_len: int, pad_id: int = 0) -> Column:
    """H10 tail: cut to ``max_len`` and pad with ``pad_id``."""
    ids = F.slice(_c(ids), 1, max_len)
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))))


def mask_labels(ids, pad_id: int = 0, ignore: int = -100) -> Column:
    """Pad id -> -100."""
    return F.transform(_c(ids), lambda x: F.when(x == pad_id, F.lit(ignore)).otherwise(x))


def unmask_labels(ids, pad_id: int = 0, ignore: int = -100) -> Column:
    """H11 inverse: -100 -> pad id."""
    return F.transform(_c(ids), lambda x: F.when(x == ignore, F.lit(pad_id)).otherwise(x))


def attention_mask(ids, pad_id: int = 0) -> Column:
    """1 where id != pad."""
    return F.transform(_c(ids), lambda x: (x != pad_id).cast("int"))


def pad_to(ids, length, pad_id: int = 0) -> Column:
    """Pad to ``length`` (a column, e.g. a batch maximum)."""
    ids = _c(ids)
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(_c(length) - F.size(ids), F.lit(0))))


def concat_codes(a, b) -> Column:
    """Two encoded codes appended (clone pairs)."""
    return F.concat(_c(a), _c(b))


def decode_ids(ids, inv_vocab, special_ids: list[int]) -> Column:
    """Ids -> text through ``map<int,string>``, special ids skipped."""
    kept = F.filter(_c(ids), lambda x: ~x.isin(special_ids))
    return F.array_join(F.transform(kept, lambda x: F.coalesce(F.element_at(_c(inv_vocab), x), F.lit(""))), " ")


def gen_len(ids, pad_id: int = 0) -> Column:
    """D19 per row: number of ids different from pad."""
    return F.size(F.filter(_c(ids), lambda x: x != pad_id))


# ---------------------------------------------------------------- E5, B20, H20
def first_eos(ids, eos_id: int) -> Column:
    """0-based position of the first EOS, null when absent."""
    p = F.array_position(_c(ids), eos_id)
    return F.when(p > 0, p - 1)


def ppo_curr_len(ids, eos_id: int) -> Column:
    """E5 (PPO policy): argmax(ids == eos) + 1, hence 1 when EOS is missing."""
    return F.coalesce(first_eos(ids, eos_id), F.lit(0)) + 1


def reward_len(ids, eos_id: int) -> Column:
    """E5 (reward policy): position of the first EOS, full length when missing."""
    return F.coalesce(first_eos(ids, eos_id), F.size(_c(ids)))


def truncate_at(a, length) -> Column:
    """Keep the first ``length`` elements."""
    return F.slice(_c(a), 1, _c(length))


def one_hot_reward(length, pos, value) -> Column:
    """Zeros of ``length`` with ``value`` at ``min(pos, length - 1)`` (0-based)."""
    p = F.least(_c(pos), _c(length) - 1)
    return F.transform(F.sequence(F.lit(0), _c(length) - 1), lambda i: F.when(i == p, _c(value)).otherwise(F.lit(0.0)))


def scalarize(c) -> Column:
    """Numeric value as double."""
    return _c(c).cast("double")
