"""Pieces of JSON documents between commas, walked split by split (the helpers of ``readers.read_catalog``).

Columns ``file, start`` name a piece's split; a task gets a split's pieces in order.  Whether a piece starts inside a string depends on
the quotes before it, its depth on the brackets outside strings; both are running sums over the bytes of a batch.  (No escape spans
a comma, and no byte of a longer character looks like a quote or a bracket.)  A piece that starts outside strings, at most one
bracket deep, begins a member of the document, and two deep an element of a member's array.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOTALS = "file bigint, start bigint, quotes bigint, outer bigint, inner bigint"
ENDS = "file bigint, start bigint, inside int, depth bigint, head string, tail string, opens boolean"
#: bytes looked at together (a longer piece stays whole)
RUN_BYTES = 4 << 20

_STEP = np.zeros(256, dtype=np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1
_LAST = re.compile(r"\s*\]\s*\}?\s*$")


def counts(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Before each piece and after the last one: quotes, and depth gained if the first piece starts outside or inside a string."""
    values = values.cast(pa.large_string())
    at = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    quote = data == 0x22
    slash = data == 0x5C
    if slash.any():
        i = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(slash, -1, i))  # the last byte that is no backslash
        quote[1:] &= ((i[:-1] - plain[:-1]) & 1) == 0
    quotes = np.concatenate([[0], np.cumsum(quote)])
    step, odd = _STEP[data], (quotes[:-1] & 1).astype(bool)
    outer, inner = (np.concatenate([[0], np.cumsum(np.where(odd == side, step, 0), dtype=np.int64)]) for side in (False, True))
    return quotes[at], outer[at], inner[at]


def _runs(batches) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Neighbouring pieces of one split, about ``RUN_BYTES`` at a time."""
    for b in batches:
        if not b.num_rows:
            continue
        file, start = b.column("file").to_numpy(), b.column("start").to_numpy()
        size = np.cumsum(pc.binary_length(b.column("value")).to_numpy().astype(np.int64))
        edge = (file[1:] != file[:-1]) | (start[1:] != start[:-1]) | (size[1:] // RUN_BYTES != size[:-1] // RUN_BYTES)
        ends = [*(np.flatnonzero(edge) + 1).tolist(), b.num_rows]
        for i, j in zip([0, *ends], ends):
            yield (int(file[i]), int(start[i])), b.slice(i, j - i)


def totals(batches):
    """Quotes and gained depth of each split, for both states it may start in."""
    found: dict[tuple[int, int], list[int]] = {}
    for key, b in _runs(batches):
        t = found.setdefault(key, [0, 0, 0])
        quotes, *depth = counts(b.column("value"))
        side = t[0] & 1
        t[0], t[1], t[2] = t[0] + int(quotes[-1]), t[1] + int(depth[side][-1]), t[2] + int(depth[1 - side][-1])
    rows = [(*k, *t) for k, t in found.items()]
    yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("file", "start", "quotes", "outer", "inner"))})


class _Split:
    """One split from its true state on: its whole elements, and the pieces of elements that its borders cut."""

    def __init__(self, inside: int, depth: int, opens: bool | None, head: re.Pattern):
        self.inside, self.depth, self.opens, self.pattern = inside, depth, opens, head
        self.head: list[str] | None = []  # pieces before the first border; None: they have been told apart
        self.open: list[str] = []
        self.began = False

    def walk(self, values: pa.Array) -> list[str]:
        quotes, *gained = counts(values)
        deep = self.depth + gained[self.inside]
        bare = (quotes[:-1] + self.inside) % 2 == 0
        text, done = values.to_pylist(), []
        for i in np.flatnonzero(deep[1:] < 2).tolist():
            text[i] = _LAST.sub("", text[i])
        member = bare & (deep[:-1] < 2)
        last = 0
        for i in np.flatnonzero(bare & (deep[:-1] <= 2)).tolist():
            self.open += text[last:i]
            done += self.close()
            last, self.began = i, True
            if member[i]:
                m = self.pattern.match(text[i])
                self.opens = m is not None
                text[i] = text[i][m.end():] if m else text[i]
        self.open += text[last:]
        self.inside, self.depth = (self.inside + int(quotes[-1])) % 2, int(deep[-1])
        return done

    def close(self) -> list[str]:
        pieces, self.open = self.open, []
        if not self.began:
            self.head = pieces
            return []
        return [",".join(pieces)] if self.opens else []


def _pattern(member: str) -> re.Pattern:
    return re.compile(r"[\s\ufeff]*\{?\s*" + re.escape(f'"{member}"') + r"\s*:\s*\[")


def _first(b: pa.RecordBatch, name: str):
    return b.column(name)[0].as_py()


def ends(member: str) -> Callable:
    """Per split: the pieces before its first border, those from its last border on, and whether the last member that opens in it is ``member``."""
    def run(batches):
        walks: dict[tuple[int, int], tuple[_Split, tuple]] = {}
        for key, b in _runs(batches):
            if key not in walks:
                state = _first(b, "inside"), _first(b, "depth")
                walks[key] = _Split(*state, None, _pattern(member)), state
            walks[key][0].walk(b.column("value"))
        rows = [(*key, *state, ",".join(w.head if w.began else w.open) if (w.head if w.began else w.open) else None,
                 ",".join(w.open) if w.began else None, w.opens) for key, (w, state) in walks.items()]
        kinds = [("file", pa.int64()), ("start", pa.int64()), ("inside", pa.int32()), ("depth", pa.int64()), ("head", pa.string()),
                 ("tail", pa.string()), ("opens", pa.bool_())]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})
    return run


def elements(member: str) -> Callable:
    """Texts of ``member``'s elements that lie whole in a split (of a file of one split: all)."""
    def run(batches):
        key, walk, single = None, None, False
        for k, b in _runs(batches):
            done = []
            if k != key:
                if walk and single:
                    done += walk.close()
                key, single = k, _first(b, "single")
                walk = _Split(_first(b, "inside") or 0, _first(b, "depth") or 0, _first(b, "opens"), _pattern(member))
            done += walk.walk(b.column("value"))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["text"])
        if walk and single:
            yield pa.RecordBatch.from_arrays([pa.array(walk.close(), pa.string())], ["text"])
    return run
