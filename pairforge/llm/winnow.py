"""Benchmark decontamination by winnowing (operator 10).

A text's k-grams of words are hashed; of every ``w`` neighbouring k-grams the
(leftmost) smallest hash is a fingerprint.  Two texts that share a run of
``w + k - 1`` words share all k-grams of a window there and so a fingerprint of
it.  With ``w + k - 1`` equal to the contract's window of words, joining the
fingerprints of documents and benchmark items and extending each meeting to the
windows around it therefore finds every shared window.  A window is looked up among
the items' distinct windows and compared word by word with one of them, so texts and
items that repeat themselves cost no more than others; neighbouring windows
make up the shared runs.  Items shorter than a
window are one window of their own length and are fingerprinted at that length.

The benchmark is read in shards of bounded text size; each shard's fingerprints
are broadcast and every shard is one further pass over the rows, so nothing is
shuffled and no broadcast grows with the benchmark.

Defined results: ties need no rule, as rows are judged one by one; texts of any length are read whole; an empty table gives no
rows; null, empty and wordless texts have no words and no hits, and
wordless items no windows; repeated items and rows count as often as distinct
ids (items) or rows (documents); items without id hit words but aren't listed;
an empty benchmark hits nothing; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import _words
from pairforge.llm._arrow import held, id_and_text, pieces, schema_of

#: bytes of benchmark text in a broadcast shard
SHARD_BYTES = 32 << 20
#: words of a k-gram (shorter items: their own length)
K = 5


def fingerprints(words: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the winnowed k-grams with guarantee ``length``: any shared run of so many words of
    one row has a fingerprint in common."""
    k = min(K, length)
    w = length - k + 1
    h = _words.grams(words, k)
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    best, at = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        less = h[j:n + j] < best
        at[less] = j
        np.minimum(best, h[j:n + j], out=best)
    whole = row[:n] == row[length - 1:n + length - 1]
    chosen = np.zeros(len(h), dtype=bool)
    chosen[(np.arange(n) + at)[whole]] = True
    places = np.flatnonzero(chosen)
    return places, h[places]


class Shard:
    """Fingerprints and distinct windows of some benchmark items, by window length."""

    def __init__(self, ids: list, texts: list, window: int):
        self.window = window
        self.ids = np.array([None if i is None else str(i) for i in ids], dtype=object)
        row, self.words, _, _, counts = _words.split(pa.array(texts, pa.string()), _words.ALNUM)
        self.by_length = []
        for length in sorted({min(int(c), window) for c in counts if c}):
            mine = counts >= window if length == window else counts == length
            here = np.flatnonzero(mine[row])
            words, of = self.words[here], row[here]
            _, prints = fingerprints(words, of, length)
            h = _words.grams(words, length)
            start = np.flatnonzero(of[:len(h)] == of[length - 1:length - 1 + len(h)])
            distinct, first, number = np.unique(h[start], return_index=True, return_inverse=True)
            # each window's items, every item once
            item = of[start]
            order = np.lexsort((item, number))
            number, item = number[order], item[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (number[1:] != number[:-1]) | (item[1:] != item[:-1])
            items = item[new].astype(np.int32)
            begin = np.searchsorted(number[new], np.arange(len(distinct) + 1))
            self.by_length.append((length, np.unique(prints), distinct, here[start[first]], begin, items))

    def hits(self, words: np.ndarray, row: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """(row, first word, end) of the runs covered by shared windows, and each row's items, (row, item).

        A meeting of fingerprints is extended to the windows around it; each of them is looked up once, however often the item or
        the text repeats it, so the work is linear in the text."""
        cover = np.zeros(len(words) + 1, dtype=np.int32)
        rows, items = [], []
        for length, prints, distinct, first, begin, of in self.by_length:
            places, hashes = fingerprints(words, row, length)
            places = places[_member(prints, hashes)[1]]
            if not len(places):
                continue
            k = min(K, length)
            near = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(near, np.maximum(places - (length - k), 0), 1)
            np.add.at(near, places + 1, -1)
            h = _words.grams(words, length)
            start = np.flatnonzero((np.cumsum(near)[:len(h)] > 0) & (row[:len(h)] == row[length - 1:length - 1 + len(h)]))
            at, met = _member(distinct, h[start])
            start, at = start[met], at[met]
            for j in range(length):  # the words themselves decide
                same = words[start + j] == self.words[first[at] + j]
                start, at = start[same], at[same]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length, -1)
            pair = np.unique(np.stack([row[start], at]), axis=1)  # a text's distinct windows
            n = begin[pair[1] + 1] - begin[pair[1]]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows.append(np.repeat(pair[0], n))
            items.append(of[np.repeat(begin[pair[1]], n) + nth])
        inside = np.cumsum(cover[:-1]) > 0
        edge = np.ones(len(words), dtype=bool)
        edge[1:] = (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])
        edge = np.flatnonzero(edge)
        end = np.append(edge[1:], len(words))
        hit = inside[edge]
        both = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1) if rows else np.empty((2, 0), np.int64)
        return (row[edge[hit]], edge[hit], end[hit]), (both[0], both[1])


def _member(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _shards(bench: DataFrame, item_col: str, text_col: str, shard_bytes: int) -> Iterator[tuple[list, list]]:
    b = id_and_text(bench, item_col, text_col).filter("text is not null")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // shard_bytes)
    for i in range(n):
        mine = b.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else b
        t = mine.toArrow()
        yield t.column("id").to_pylist(), t.column("text").to_pylist()


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 13,
                  share: int = 20, shard_bytes: int = SHARD_BYTES, keep_text: bool = False) -> DataFrame:
    """Per row: ``id``, ``n_words``, ``n_hit`` (words inside any shared window), ``spans`` (their word ranges, end
    exclusive), ``items`` (ids as sorted strings) and ``contaminated`` (hit, and ``share * n_hit >= n_words``)."""
    sc = docs.sparkSession.sparkContext
    state = "spans array<struct<a:bigint,b:bigint>>, items array<string>"
    out = id_and_text(docs, id_col, text_col).withColumns({
        "spans": F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"),
        "items": F.expr("cast(array() as array<string>)")})
    shards = [sc.broadcast((ids, texts, window)) for ids, texts in _shards(bench, item_col, item_text_col, shard_bytes)]
    for shard in shards[:-1]:
        out = out.mapInArrow(_pass(shard, None), schema_of(docs, id_col, f"text string, {state}"))
    return out.mapInArrow(_pass(shards[-1] if shards else None, share, keep_text),
                          schema_of(docs, id_col, "text string, " * keep_text + f"n_words bigint, n_hit bigint, {state}, contaminated boolean"))


def _pass(shard, share, keep_text=False):
    """One shard's hits added to the rows' spans and items; with ``share``, the last pass, which judges them."""
    pair, strings = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string())

    def run(batches):
        index = held("winnow", shard.value, lambda v: Shard(*v)) if shard is not None else None
        for b in pieces(batches, 1 << 20):
            row, words, _, _, counts = _words.split(b.column("text"), _words.ALNUM)
            spans, items = b.column("spans").to_pylist(), b.column("items").to_pylist()
            if index is not None:
                base = np.cumsum(counts) - counts
                runs, met = index.hits(words, row)
                new: dict[int, list] = {}
                for r, a, z in zip(*(x.tolist() for x in runs)):
                    new.setdefault(r, []).append((a - int(base[r]), z - int(base[r])))
                for r, found in new.items():
                    spans[r] = [{"a": a, "b": z} for a, z in _merge([(s["a"], s["b"]) for s in spans[r]] + found)]
                named: dict[int, set] = {}
                for r, i in zip(*(x.tolist() for x in met)):
                    if index.ids[i] is not None:
                        named.setdefault(r, set(items[r])).add(index.ids[i])
                for r, found in named.items():
                    items[r] = sorted(found)
            cols, names = [pa.array(spans, pair), pa.array(items, strings)], ["spans", "items"]
            if share is None:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), *cols], ["id", "text", *names])
            else:
                hit = np.array([sum(s["b"] - s["a"] for s in x) for x in spans], dtype=np.int64)
                judged = (hit > 0) & (share * hit >= counts)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), *([b.column("text")] * keep_text), pa.array(counts), pa.array(hit), *cols, pa.array(judged)],
                    ["id", *(["text"] * keep_text), "n_words", "n_hit", *names, "contaminated"])
    return run
