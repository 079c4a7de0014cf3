"""D27 at a whole vocabulary: byte-pair merges learned in rounds over chains of the leading pairs.

The distinct words stay distributed as rows of symbol numbers with a count.  A round

1. counts all neighbouring pairs (occurrences weighted by word count); a task sums them before the shuffle,
2. takes the leading pairs: all that occur more often than a bar, the count of the next one,
3. cuts the words into chains, the longest runs of symbols of which all neighbours are leading pairs, and sums equal
   chains: many words have few chains, so their number grows far slower than the words',
4. replays the merges on the chains: places of symbols make a merge touch only its chains, a heap keeps the order,
5. applies the round's merges, in order, to the distributed words, where they stand.

All occurrences of a leading pair lie in chains.  A pair of symbols made in the round stands at places that were
neighbours when the round began; if these were a leading pair, all its occurrences lie in chains and its count is exact, else
none does and it occurs no more often than the bar.  So every merge above the bar is the next one.  That holds as long as
a symbol is made in one way: after a merge into a symbol that was there already, the round ends.  Where the pairs
of the highest count alone have too many chains, the first of them is merged by itself.

How many leading pairs have as many chains as fit is estimated from some of the words; it decides on the length of a
round, not on its merges.  Words that fit the bound together are fetched at once; every pair is counted from them then.
"""
from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: chains (or words) and their characters fetched in a round (8 bytes a character on the driver), and pairs looked at
WORDS, CHARS, PAIRS = 3 << 19, 3 << 22, 300_000
#: characters whose pairs are sorted at once
_CHUNK = 1 << 20
#: symbols a task counts at once, characters whose words it merges at once, rows it holds before they are shuffled
_BLOCK, _PLACES, _HELD = 1 << 21, 1 << 22, 1 << 19
#: words from which the chains of a round are estimated
_SOME = 100_000
_GAP, _INSIDE = -1, -2
#: characters have their code points as numbers; symbols made of them come next
_MADE = 0x110000


class Names:
    """Numbers and lengths of symbols."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.made: list[str] = []
        self.length = np.ones(_MADE + (1 << 10), np.int32)

    def of(self, symbol: str) -> int:
        if len(symbol) == 1:
            return ord(symbol)
        i = self.number.setdefault(symbol, _MADE + len(self.made))
        if i == _MADE + len(self.made):
            self.made.append(symbol)
            if i == len(self.length):
                self.length = np.concatenate([self.length, np.zeros(len(self.made), np.int32)])
            self.length[i] = len(symbol)
        return i

    def text(self, i: int) -> str:
        return self.made[i - _MADE] if i >= _MADE else chr(i)

    def of_all(self, symbols: pa.Array) -> np.ndarray:
        if not len(symbols):
            return np.zeros(0, np.int32)
        if pa.types.is_integer(symbols.type):
            return symbols.to_numpy(zero_copy_only=False)
        d = symbols.dictionary_encode()
        return np.array([self.of(s) for s in d.dictionary.to_pylist()], np.int32)[d.indices.to_numpy(zero_copy_only=False)]


class Pairs:
    """Some pairs of numbers."""

    def __init__(self, left: np.ndarray, right: np.ndarray, numbers: int):
        self.keys = np.sort((left.astype(np.int64) << 32) | right)
        self.left, self.right = np.zeros(numbers, bool), np.zeros(numbers, bool)
        self.left[left], self.right[right] = True, True

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.left[a] & self.right[b]  # most others fail here
        at = np.flatnonzero(out)
        key = (a[at].astype(np.int64) << 32) | b[at]
        out[at] = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        return out


_BITS = 21


def _by_pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of pairs of numbers in order, and where they stand, equal ones in their order."""
    if len(a) < 1 << _BITS and int(max(a.max(initial=0), b.max(initial=0))) < 1 << _BITS:
        packed = (a.astype(np.int64) << 2 * _BITS) | (b.astype(np.int64) << _BITS) | np.arange(len(a))
        packed.sort()
        low = (1 << _BITS) - 1
        return (packed >> 2 * _BITS << 32) | (packed >> _BITS & low), packed & low
    key = (a.astype(np.int64) << 32) | b
    order = np.argsort(key, kind="stable")
    return key[order], order


class Words:
    """Words in one array of places, one a character: a symbol's number stands at its first and last place, a gap between words."""

    def __init__(self, lists: Iterable[pa.ListArray], names: Names, counts: np.ndarray | None = None, only: Pairs | None = None):
        self.names, self.counts = names, counts
        parts, starts, at = [np.array([_GAP], np.int32)], [], 1
        self.index, self.base, self.made = [], set(), {}
        for b in lists:
            size = np.diff(b.offsets.to_numpy())
            ids = names.of_all(b.flatten())
            self.base.update(np.flatnonzero(np.bincount(ids)).tolist())
            length = names.length[ids].astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            first = np.cumsum(length) - length + row  # a gap after each word
            total = int(length.sum()) + len(size)
            part = np.full(total, _INSIDE, np.int32)
            part[first], part[first + length - 1] = ids, ids
            chars = np.bincount(row, length, len(size)).astype(np.int64)
            end = np.cumsum(chars + 1) - 1
            part[end] = _GAP
            parts.append(part)
            starts.append((at + end - chars).astype(np.int32))
            two = np.flatnonzero(row[1:] == row[:-1])
            if only is not None:
                two = two[only.has(ids[two], ids[two + 1])]
            key, order = _by_pair(ids[two], ids[two + 1])
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
            self.index.append((key[cuts], np.append(cuts, len(order)), (at + first[two[order]]).astype(np.int32)))
            at += total
        self.sym = np.concatenate(parts)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int32)

    def weight(self, places: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.starts, places, side="right") - 1]

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys (sorted) and counts of the pairs that the words came with."""
        keys = [k for k, _, _ in self.index if len(k)]
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = [np.add.reduceat(self.weight(p), cuts[:-1]) for k, cuts, p in self.index if len(k)]
        return _summed(np.concatenate(keys), np.concatenate(n))

    def _made(self, x: int) -> np.ndarray:
        """Where a symbol that was made here stands now."""
        p = self.made.get(x)
        if p is None:
            return np.zeros(0, np.int32)
        p = np.sort(np.concatenate(p)) if len(p) > 1 else p[0]
        p = p[self.sym[p] == x]
        self.made[x] = [p]
        return p

    def places(self, a: int, b: int) -> np.ndarray:
        """First places of a pair, ascending (those of ``aaa`` overlap)."""
        sym, la = self.sym, int(self.names.length[a])
        only_a, only_b = a not in self.base, b not in self.base
        if (only_a and a not in self.made) or (only_b and b not in self.made):
            return np.zeros(0, np.int32)

        def from_a():
            p = self._made(a)
            return p[sym[p + la] == b]

        def from_b():
            p = self._made(b)
            return p[sym[p - 1] == a] - la

        if only_a and only_b:
            return from_a() if sum(map(len, self.made[a])) <= sum(map(len, self.made[b])) else from_b()
        if only_a or only_b:
            return from_a() if only_a else from_b()
        found, key = [], (a << 32) | b
        for keys, cuts, order in self.index:
            i = int(np.searchsorted(keys, key))
            if i < len(keys) and keys[i] == key:
                p = order[cuts[i]:cuts[i + 1]]
                found.append(p[(sym[p] == a) & (sym[p + la] == b)])
        if a in self.made or b in self.made:
            found = [np.unique(np.concatenate([*found, from_a(), from_b()]))]
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def merge(self, a: int, b: int, c: int, counted: bool = True):
        """Merge a pair, left to right, at all its places.  Returns keys and counts of the pairs that were lost, and of those gained."""
        p, sym = self.places(a, b), self.sym
        la, lb = int(self.names.length[a]), int(self.names.length[b])
        if a == b and len(p) > 1:
            at = np.arange(len(p))
            run = np.maximum.accumulate(np.where(np.append(True, p[1:] - p[:-1] != la), at, 0))
            p = p[(at - run) % 2 == 0]
        if not len(p):
            return None
        q, end = p + la, p + (la + lb)
        left, right = sym[p - 1], sym[end]
        sym[q - 1] = _INSIDE
        sym[q] = _INSIDE
        sym[p] = c
        sym[end - 1] = c
        self.made.setdefault(c, []).append(p)
        if not counted:
            return None
        w = self.weight(p)
        follows = np.append(False, p[1:] == end[:-1])  # the pair before it was merged as well
        ls, rs = np.flatnonzero((left >= 0) & ~follows), np.flatnonzero(right >= 0)
        l, r = left[ls].astype(np.int64) << 32, right[rs].astype(np.int64)
        new = np.where(np.append(follows[1:], False)[rs], c, r)
        n = np.concatenate([w[ls], w[rs]])
        lost = _summed(np.concatenate([l | a, (b << 32) | r, [(a << 32) | b]]), np.append(n, w.sum()))
        return lost, _summed(np.concatenate([l | c, (c << 32) | new]), n)

    def now(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins among the symbols of all, and their numbers, as they are now."""
        p = np.flatnonzero(self.sym >= 0)
        ids = self.sym[p]
        both = np.flatnonzero(self.names.length[ids] > 1)  # first place, last place, first place, ..
        keep = np.ones(len(p), bool)
        keep[both[1::2]] = False
        p, ids = p[keep], ids[keep]
        cuts = np.append(np.searchsorted(p, self.starts), len(p)).astype(np.int32)
        return cuts, ids

    def symbols(self) -> pa.ListArray:
        """The words' symbols as they are now."""
        cuts, ids = self.now()
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array([self.names.text(i) for i in ids.tolist()], pa.string()))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return (keys[first], np.add.reduceat(n, first)) if len(first) else (keys, n)


class Replay:
    """Merges over fetched words or chains; pairs that stand elsewhere occur ``bar`` times at most (None: there are none)."""

    def __init__(self, words: Words, symbols: set[str], bar: int | None = None):
        self.words, self.names, self.symbols, self.bar = words, words.names, symbols, bar

    def _pair(self, key: int) -> tuple[str, str]:
        return self.names.text(key >> 32), self.names.text(key & 0xFFFFFFFF)

    def _key(self, a: str, b: str) -> int:
        return (self.names.of(a) << 32) | self.names.of(b)

    def _best(self):
        while self.heap:
            n, a, b = self.heap[0]
            now = self.counts.get(self._key(a, b))
            if now == -n:
                return now, a, b
            if now is None:
                heapq.heappop(self.heap)
            else:
                heapq.heapreplace(self.heap, (-now, a, b))
        return None

    def run(self, most: int, least: int) -> list[tuple[str, str, int]]:
        # a pair that is not above the bar is not merged here, so its count is not kept
        self.least = least if self.bar is None else max(least, self.bar + 1)
        keys, n = self.words.pair_counts()
        there = n >= self.least
        self.counts = dict(zip(keys[there].tolist(), n[there].tolist()))
        self.heap = [(-n, *self._pair(k)) for k, n in self.counts.items()]
        heapq.heapify(self.heap)
        made = []
        while len(made) < most and (best := self._best()) is not None and best[0] >= least:
            n, a, b = best
            fresh = self._merge(a, b)
            made.append((a, b, n))
            if not fresh and self.bar is not None:
                break  # its pairs may stand in chains and elsewhere
        return made

    def _here(self, key: int) -> int:
        """Occurrences in the fetched words now."""
        p = self.words.places(key >> 32, key & 0xFFFFFFFF)
        return int(self.words.weight(p).sum())

    def _set(self, key: int, n: int) -> None:
        if n >= self.least:
            self.counts[key] = n
            heapq.heappush(self.heap, (-n, *self._pair(key)))
        else:
            self.counts.pop(key, None)

    def _merge(self, a: str, b: str) -> bool:
        """Was the symbol new?"""
        symbol = a + b
        fresh = symbol not in self.symbols
        self.symbols.add(symbol)
        c = self.names.of(symbol)
        moved = self.words.merge(self.names.of(a), self.names.of(b), c)
        if moved is None:
            self.counts.pop(self._key(a, b), None)
            return fresh
        counts, least = self.counts, self.least
        for key, d in zip(*(x.tolist() for x in moved[0])):
            n = counts.get(key)
            if n is not None:
                if n - d >= least:
                    counts[key] = n - d  # the heap learns it when the pair comes up
                else:
                    del counts[key]
        if fresh:
            keys, n = moved[1]
            there = n >= least
            for key, d in zip(keys[there].tolist(), n[there].tolist()):
                self._set(key, d)
        elif self.bar is None:
            for key, d in zip(*(x.tolist() for x in moved[1])):
                self._set(key, counts[key] + d if key in counts else self._here(key))
        return fresh


def _runs(columns: list[pa.Array]) -> Iterator[pa.Array]:
    """Lists put together up to a number of symbols."""
    held, size = [], 0
    for x in columns:
        held.append(x)
        size += len(x.values)
        if size >= _CHUNK:
            yield pa.concat_arrays(held)
            held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


# ---------------------------------------------------------------- distributed words: (ids binary, c bigint, chars bigint)
_TABLE = "ids binary, c bigint, chars bigint"


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the checkpoint folder and read again."""
    from pairforge.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bpe-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _numbers(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbol numbers of all rows of a binary column, and how many a row has."""
    if not len(x):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    x = x.cast(pa.binary())
    offs = np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1]
    data = x.buffers()[2]
    ids = np.frombuffer(data, np.int32, int(offs[-1] - offs[0]) // 4, int(offs[0])) if data is not None and offs[-1] > offs[0] else np.zeros(0, np.int32)
    return ids, np.diff(offs).astype(np.int64) // 4


def _binary(ids: np.ndarray, size: np.ndarray) -> pa.Array:
    offs = (np.concatenate([[0], np.cumsum(size)]) * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(ids, np.int32))])


def _blocks(batches, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols, sizes, counts and characters of rows, put together up to a number of characters."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append((*_numbers(b.column("ids")), b.column("c").to_numpy(), b.column("chars").to_numpy()))
            n += int(held[-1][3].sum())
            if n >= most:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _neighbours(size: np.ndarray) -> np.ndarray:
    """Is the next symbol of the same row?"""
    inside = np.ones(int(size.sum()), bool)
    inside[np.cumsum(size) - 1] = False
    return inside


def _spelled(word_counts: DataFrame, word: str, count: str) -> DataFrame:
    """Words as code points."""
    def run(batches):
        for b in batches:
            text = b.column("word")
            size = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.int32)
            yield pa.RecordBatch.from_arrays([_binary(ids, size), b.column("c"), pa.array(size)], ["ids", "c", "chars"])

    w = word_counts.select(F.col(word).alias("word"), F.coalesce(F.col(count).cast("long"), F.lit(0)).alias("c")).filter("word <> ''")
    return w.mapInArrow(run, _TABLE)


def _alphabet(table: DataFrame) -> set[str]:
    """All characters (as many as Unicode has at most)."""
    def run(batches):
        there = np.zeros(_MADE, bool)
        for b in batches:
            there[_numbers(b.column("ids"))[0]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(there).astype(np.int32))], ["s"])

    return {chr(r["s"]) for r in table.mapInArrow(run, "s int").distinct().collect()}


def _dense(names: Names, symbols: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all symbols in their order as texts, by number, and their numbers in that order."""
    order = np.array([names.of(x) for x in sorted(symbols)], np.int32)
    rank = np.zeros(_MADE + len(names.made), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank, order


def _pair_table(table: DataFrame, rank: np.ndarray, k: int) -> DataFrame:
    """Occurrences of all pairs; ``key`` is in the order of their texts."""
    sent = table.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        rank, held, n_held = sent.value, [], 0
        for ids, size, c, _ in _blocks(batches, _BLOCK):
            at = np.flatnonzero(_neighbours(size))
            w, ids = np.repeat(c, size)[at], rank[ids].astype(np.int64)
            if k * k <= 1 << 22:
                n = np.zeros(k * k, np.int64)
                flat = ids[at] * k + ids[at + 1]
                if int(np.abs(w).max(initial=0)) * max(1, len(w)) < 1 << 53:
                    n = np.bincount(flat, w, k * k).astype(np.int64)
                else:
                    np.add.at(n, flat, w)
                there = np.flatnonzero(np.bincount(flat, minlength=k * k))
                keys, n = (there // k << 32) | there % k, n[there]
            else:
                keys, at = _by_pair(ids[at], ids[at + 1])
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
                keys, n = keys[first], np.add.reduceat(w[at], first) if len(first) else w[:0]
            held.append((keys, n))
            n_held += len(keys)
            if n_held > _HELD:
                keys, n = _summed(*map(np.concatenate, zip(*held)))
                held, n_held = [(keys, n)], len(keys)
                if n_held > _HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])
                    held, n_held = [], 0
        if held:
            keys, n = _summed(*map(np.concatenate, zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    return table.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _chain_cuts(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last symbols of the runs of ``hit`` (is a symbol tied to the next one?)."""
    edge = np.diff(np.concatenate([[False], hit]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(np.concatenate([edge[1:], [-1 if len(hit) and hit[-1] else 0]]) == -1) + 1


def _chains(table: DataFrame, keys: np.ndarray, rank: np.ndarray, k: int, length: np.ndarray) -> DataFrame:
    """The chains of the pairs ``keys`` (sorted, places in the order of texts), equal ones summed."""
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast((keys, rank, length[_MADE:].copy()))

    def summed(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).combine_chunks().group_by(["ids", "chars"], use_threads=False).aggregate([("c", "sum")])
        return t.rename_columns([{"c_sum": "c"}.get(x, x) for x in t.column_names]).select(["ids", "c", "chars"])

    def run(batches):
        keys, rank, made = sent.value
        length = np.concatenate([np.ones(_MADE, np.int32), made])
        known = None
        if k * k <= 1 << 24:
            known = np.zeros(k * k, bool)
            known[(keys >> 32) * k + (keys & 0xFFFFFFFF)] = True
        held, n_held = [], 0
        for ids, size, c, _ in _blocks(batches, _BLOCK):
            inside = _neighbours(size)
            at = np.flatnonzero(inside)
            dense = rank[ids].astype(np.int64)
            if known is not None:
                hit = known[dense[at] * k + dense[at + 1]]
            else:
                key = (dense[at] << 32) | dense[at + 1]
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[i] == key
            inside[at] = hit
            first, last = _chain_cuts(inside)
            if not len(first):
                continue
            tied = inside.copy()
            tied[1:] |= inside[:-1]
            own, n = ids[tied], last - first + 1
            begin = np.cumsum(n) - n
            row = np.searchsorted(np.cumsum(size), first, side="right")
            t = pa.table({"ids": _binary(own, n), "c": c[row], "chars": np.add.reduceat(length[own].astype(np.int64), begin)})
            held.append(summed([t]))
            n_held += held[-1].num_rows
            if n_held > _HELD:
                held = [summed(held)]
                n_held = held[0].num_rows
                if n_held > _HELD // 2:
                    yield from held[0].to_batches()
                    held, n_held = [], 0
        if held:
            yield from summed(held).to_batches()

    return table.mapInArrow(run, _TABLE).groupBy("ids", "chars").agg(F.sum("c").alias("c")).select("ids", "c", "chars")


def _merged(table: DataFrame, merges: list[tuple[int, int, int]], length: np.ndarray) -> DataFrame:
    """The merges (left, right, made), one after the other, in every word; words of one symbol go."""
    sent = table.sparkSession.sparkContext.broadcast((merges, length[_MADE:].copy()))

    class Lengths:
        def __init__(self, length):
            self.length = length

        def of_all(self, ids):
            return ids.to_numpy(zero_copy_only=False)

    def run(batches):
        merges, made = sent.value
        names = Lengths(np.concatenate([np.ones(_MADE, np.int32), made]))
        only = Pairs(*(np.array(x, np.int32) for x in list(zip(*merges))[:2]), len(names.length))
        for ids, size, c, chars in _blocks(batches, _PLACES):
            words = Words(_cut_lists(ids, size), names, only=only)
            for a, b, to in merges:
                words.merge(a, b, to, counted=False)
            cuts, ids = words.now()
            size = np.diff(cuts).astype(np.int64)
            left = size > 1
            b = pa.RecordBatch.from_arrays([_binary(ids[np.repeat(left, size)], size[left]), pa.array(c[left]), pa.array(chars[left])], ["ids", "c", "chars"])
            yield from (b.slice(i, 1 << 16) for i in range(0, b.num_rows, 1 << 16))

    return table.mapInArrow(run, _TABLE)


def _cut_lists(ids: np.ndarray, size: np.ndarray) -> Iterator[pa.ListArray]:
    """Rows as lists of numbers, about ``_CHUNK`` symbols at once."""
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        base = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
        offs = np.concatenate([[base], ends[start:end]]) - base
        yield pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids[base:int(ends[end - 1])]))
        start = end


def _fetched(df: DataFrame, names: Names) -> Words:
    """Words or chains on the driver."""
    got = df.select("ids", "c").toArrow()
    parts = [_numbers(x) for x in got.column("ids").chunks if len(x)]
    lists = (x for ids, size in parts for x in _cut_lists(ids, size))
    return Words(lists, names, got.column("c").to_numpy().astype(np.int64))


class _Some:
    """Chains of some of the words, to tell how many all of them have."""

    def __init__(self, table: DataFrame, total: int, top: np.ndarray, rank: np.ndarray, length: np.ndarray):
        self.share = max(1, total // _SOME)
        got = table.filter(F.pmod(F.xxhash64("ids"), F.lit(self.share)) == 0).select("ids", "c", "chars").toArrow().combine_chunks()
        ids, size = _numbers(got.column("ids").chunk(0)) if got.num_rows else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.length, self.inside = length[ids].astype(np.int64), _neighbours(size)
        self.row = np.repeat(np.arange(len(size)), size)
        self.n = len(size)
        at, dense = np.flatnonzero(self.inside), rank[ids].astype(np.int64)
        key = (dense[at] << 32) | dense[at + 1]
        order = np.argsort(top)
        i = np.minimum(np.searchsorted(top[order], key), len(top) - 1)
        self.place = np.full(len(ids), len(top))  # of a symbol's pair with the next among the leading ones
        self.place[at] = np.where(top[order][i] == key, order[i], len(top))
        self.code = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def _distinct(self, tied: np.ndarray) -> tuple[int, int]:
        first, last = _chain_cuts(tied)
        if not len(first):
            return 0, 0
        n = last - first + 1
        begin = np.cumsum(n) - n
        own = tied.copy()
        own[1:] |= tied[:-1]
        at = (np.arange(int(n.sum())) - np.repeat(begin, n)).astype(np.uint64)
        h = self.code[own] * (np.uint64(2) * at + np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        _, one = np.unique(np.add.reduceat(h * np.uint64(0xBF58476D1CE4E5B9), begin), return_index=True)
        return len(one), int(np.add.reduceat(self.length[own], begin)[one].sum())

    def share_of(self, k: int, words: int, chars: int) -> float:
        """About which share of a bound of chains and their characters the first ``k`` pairs take in all words."""
        found, length = self._chains(k)
        return max(found / words, length / chars)

    def _chains(self, k: int) -> tuple[float, float]:
        tied = self.place < k
        found, chars = self._distinct(tied)
        if self.share == 1 or not found:
            return found, chars
        part, _ = self._distinct(tied & (self.row < self.n // 4))
        more = self.share ** min(1.0, math.log(found / max(1, part)) / math.log(4))
        return found * more, chars * more


def learn(word_counts: DataFrame, num_merges: int, word: str = "token", count: str = "count", min_frequency: int = 3,
          words: int = WORDS, pairs: int = PAIRS, log: list | None = None, chars: int = CHARS) -> DataFrame:
    """Up to ``num_merges`` merges of a (word, count) table, the most frequent pair first (ties: the smallest), while
    it occurs at least ``min_frequency`` times.  Returns ``rank, left, right, count``.

    ``words`` (or chains), their ``chars`` and ``pairs`` bound what a round brings to the driver; the result does not depend on them
    (tests run with a few words a round).  Every round's table is written to the checkpoint folder.  ``log`` gets
    (merges, words or chains fetched) of every round."""
    spark = word_counts.sparkSession
    return _learn(_written(spark, _spelled(word_counts, word, count), "words"), num_merges, min_frequency, words, pairs, log, chars)


def _learn(table: DataFrame, num_merges: int, min_frequency: int, words: int = WORDS, pairs: int = PAIRS, log: list | None = None,
           chars: int = CHARS, symbols: set[str] | None = None) -> DataFrame:
    spark = table.sparkSession
    names, symbols = Names(), _alphabet(table) if symbols is None else set(symbols)
    table, least = table.filter("chars > 1"), max(1, min_frequency)
    merges: list[tuple[str, str, int]] = []
    off = 1.0  # chains found in the last round, of those that were estimated
    while len(merges) < num_merges:
        total, total_chars = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("chars"), F.lit(0))).first()
        left, fetched = num_merges - len(merges), 0
        if total <= words and total_chars <= chars:
            new = Replay(_fetched(table, names), symbols).run(left, least)
            merges += new
            if log is not None:
                log.append((len(new), total))
            break
        rank, order = _dense(names, symbols)
        look = max(1, min(pairs, 2 * left + 1000))
        t = _pair_table(table, rank, len(order)).filter(F.col("n") >= least).orderBy(F.col("n").desc(), "key").limit(look + 1).toArrow()
        key, n = t.column("key").to_numpy(), t.column("n").to_numpy()
        if not len(key):
            break
        # as many pairs as end where the count falls
        cuts = np.flatnonzero(n[1:] < n[:-1]) + 1
        if len(n) <= look:
            cuts = np.append(cuts, len(n))  # all pairs that can be merged at all
        some, low, high = _Some(table, total, key, rank, names.length), 0, len(cuts)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if off * some.share_of(int(cuts[mid - 1]), words, chars) <= 0.9 else (low, mid - 1)
        new = []
        while low and not new:
            k = int(cuts[low - 1])
            bar = int(n[k]) if k < len(n) else least - 1
            found = _written(spark, _chains(table, np.sort(key[:k]), rank, len(order), names.length), "chains")
            fetched, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("chars"), F.lit(0))).first()
            off = min(2.0, max(fetched / words, length / chars) / max(1e-9, some.share_of(k, words, chars)))
            if fetched <= words and length <= chars:
                new = Replay(_fetched(found, names), symbols, bar).run(left, least)
                break
            low, fetched = low // 2, 0
        if not new:
            a, b = (names.text(int(order[x])) for x in (key[0] >> 32, key[0] & 0xFFFFFFFF))
            new, fetched = [(a, b, int(n[0]))], 0
            symbols.add(a + b)
        if log is not None:
            log.append((len(new), fetched))
        merges += new
        if len(merges) < num_merges:
            table = _written(spark, _merged(table, [(names.of(a), names.of(b), names.of(a + b)) for a, b, _ in new], names.length), "words")
    return spark.createDataFrame([(i, a, b, n) for i, (a, b, n) in enumerate(merges)], "rank int, left string, right string, count long")


def vocabulary(word_counts: DataFrame, vocab_size: int = 32_000, min_frequency: int = 3, special: int = 5, word: str = "token",
               count: str = "count", **bounds) -> DataFrame:
    """Merges up to a vocabulary of ``vocab_size``: special tokens, the characters, then the merges."""
    table = _written(word_counts.sparkSession, _spelled(word_counts, word, count), "words")  # counted once, read for the characters and for the words
    letters = _alphabet(table)
    return _learn(table, max(0, vocab_size - special - len(letters)), min_frequency, symbols=letters, **bounds)
