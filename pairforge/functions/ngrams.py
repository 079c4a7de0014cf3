"""N-gram helpers over token arrays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens never contain whitespace (they come from whitespace or \w splits),
# so a single space is an unambiguous separator inside a gram string.
SEP = " "


def ngram_array(tokens: Column, n: int) -> Column:
    """Sliding n-grams of ``tokens`` as space-joined strings; empty when too short.

    Elements are read by index (O(1)); ``slice`` inside a lambda runs in
    interpreted mode and copies the whole array per call, which is quadratic.
    """
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.concat_ws(SEP, *[tokens[i + j] for j in range(n)])),
    ).otherwise(F.array().cast("array<string>"))


def padded(tokens: Column, n: int, pad_left: bool = False, pad_right: bool = False,
           left_symbol: str | None = None, right_symbol: str | None = None) -> Column:
    """``pad_sequence``: n-1 pad symbols on either side (nulls when no symbol given)."""
    out = tokens
    if pad_left and n > 1:
        out = F.concat(F.array_repeat(F.lit(left_symbol).cast("string"), n - 1), out)
    if pad_right and n > 1:
        out = F.concat(out, F.array_repeat(F.lit(right_symbol).cast("string"), n - 1))
    return out


def ngram_tuples(tokens: Column, n: int, **pad) -> Column:
    """``ngrams``: array of n-element token arrays (optionally padded)."""
    t = padded(tokens, n, **pad)
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array(*[t[i + j] for j in range(n)]))).otherwise(
        F.array().cast("array<array<string>>")
    )
