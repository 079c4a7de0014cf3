"""Vocabulary and id encoding.

The most frequent tokens' ids (a stated number) travel to the tasks as a lookup and
are found in place; the vocabulary grows with the corpus, so beyond that number the
rest of it is joined, by tokens none of which is frequent.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from pairforge.operators.sampling import with_row_index

# fixed values: special token ids
PAD, BOS, EOS, UNK = 0, 1, 2, 3
N_SPECIAL = 4


#: counts a task holds before they are shuffled
_HELD_COUNTS = 1 << 19


def vocab_counts(texts: DataFrame, tokens: str, min_freq: int = 3) -> DataFrame:
    """Corpus token frequencies kept from ``min_freq`` occurrences.

    A task counts its tokens batch by batch, so no occurrence is a row; it holds ``_HELD_COUNTS`` counts at most."""
    kind = texts.select(tokens).schema[0].dataType.elementType

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("count", "sum")]).rename_columns(["token", "count"])

    def run(batches):
        held, n_held = [], 0
        for b in batches:
            found = b.column("tokens").flatten().value_counts()
            held.append(pa.table({"token": found.field("values"), "count": found.field("counts")}))
            n_held += len(found)
            if n_held > _HELD_COUNTS:
                held = [summed(held)]
                n_held = held[0].num_rows
                if n_held > _HELD_COUNTS // 2:
                    yield from held[0].to_batches()
                    held, n_held = [], 0
        if held:
            yield from summed(held).to_batches()

    t = texts.select(F.col(tokens).alias("tokens")).mapInArrow(run, StructType([StructField("token", kind), StructField("count", LongType())]))
    return t.groupBy("token").agg(F.sum("count").alias("count")).filter(F.col("count") >= min_freq)


def build_vocab(counts: DataFrame, first_id: int = N_SPECIAL) -> DataFrame:
    """Ids by descending frequency then token, after the special ids."""
    v = with_row_index(counts, [F.col("count").desc(), F.col("token")], "_i")
    return v.select("token", "count", (F.col("_i") + first_id).alias("id"))


#: leading tokens (the most frequent ones have the smallest ids) whose ids travel to the tasks as a lookup; the rest is joined
LEADING = 1 << 18


#: tokens looked up at once in a task (or one longer text): a worker's memory doesn't grow with its batch
_RUN_TOKENS = 1 << 17
#: words whose pieces a task keeps
_KEPT_WORDS = 1 << 17


def _token_runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with a bounded number of tokens, or one longer text."""
    total = np.cumsum(pc.fill_null(pc.list_value_length(b.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < b.num_rows:
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _RUN_TOKENS, side="right")))
        yield b.slice(start, end - start)
        start = end


def _looked_up(batches, sent, max_len: int | None, add_eos: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Ids of token lists from the leading tokens; others are UNK or, unless these are all tokens (``last``), -1 and listed."""
    known, ids = sent.value
    number = dict(zip(known.to_pylist()[::-1], ids.tolist()[::-1]))  # of a repeated token the first id counts
    for whole in batches:
        for b in _token_runs(whole):
            yield _ids_of(b, number, max_len, add_eos, last)


def _ids_of(b: pa.RecordBatch, number: dict, max_len: int | None, add_eos: bool, last: bool) -> pa.RecordBatch:
    lists = b.column("tokens")
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    words = flat.dictionary_encode()
    of_word = np.array([*(number.get(w, -1) for w in words.dictionary.to_pylist()), -1], np.int32)  # the last: null tokens
    at = of_word[pc.fill_null(words.indices, len(words.dictionary)).to_numpy(zero_copy_only=False)]
    found = np.where(at >= 0, at, UNK if last else -1).astype(np.int32)
    row = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    full = size + (1 if add_eos else 0)
    width = np.full(len(size), max_len) if max_len is not None else full
    first = np.cumsum(width) - width
    out = np.full(int(width.sum()), PAD, np.int32)
    out[first[row] + pos] = found
    if add_eos:
        out[first + size] = EOS
    offs = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    cols = [b.column("key"), pa.ListArray.from_arrays(pa.array(offs), pa.array(out))]
    if not last:
        rare = np.flatnonzero((at < 0) & pc.is_valid(flat).to_numpy(zero_copy_only=False))
        items = pa.StructArray.from_arrays([pa.array(pos[rare].astype(np.int32)), flat.take(pa.array(rare))], ["pos", "token"])
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=len(size)))]).astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(cuts), items))
    return pa.RecordBatch.from_arrays(cols, ["key", "ids", "rare"][:len(cols)])


def encode(texts: DataFrame, key: str, tokens: str, vocab: DataFrame, max_len: int | None = 512, add_eos: bool = True,
           leading: int = LEADING) -> DataFrame:
    """Ids (unknown -> UNK), cut to leave room for EOS, EOS appended, PAD to ``max_len`` (None: neither cut nor pad).

    Tokens beyond the room are not looked at.  The ``leading`` tokens of the vocabulary (``build_vocab`` numbers them by frequency)
    are looked up in place from a table of that many rows, so no frequent token is ever a join key.  Only if the vocabulary has more, the
    rest of the tokens are exploded and joined with the rest of it, and put in place by their positions."""
    spark = texts.sparkSession
    room = None if max_len is None else max_len - (1 if add_eos else 0)
    d = texts.select(F.col(key).alias("key"), (F.col(tokens) if room is None else F.slice(tokens, 1, room)).alias("tokens"))
    first = F.col("id") < N_SPECIAL + leading
    lead = vocab.filter(first).select("token", "id").toArrow()
    rest = vocab.filter(~first).select("token", F.col("id").alias("_vid"))
    last = rest.isEmpty()
    tokens_sent = lead.column("token").combine_chunks() if lead.num_rows else pa.array([], pa.string())
    sent = spark.sparkContext.broadcast((tokens_sent, lead.column("id").to_numpy().astype(np.int64)))
    fields = [StructField("key", texts.schema[key].dataType), StructField("ids", ArrayType(IntegerType()))]
    if not last:
        fields.append(StructField("rare", ArrayType(StructType.fromDDL("pos int, token string"))))
    out = d.mapInArrow(lambda batches: _looked_up(batches, sent, max_len, add_eos, last), StructType(fields))
    if last:
        return out.select(F.col("key").alias(key), "ids")
    rare = out.select("key", F.explode("rare").alias("r")).select("key", "r.pos", "r.token").join(rest, "token", "left") \
        .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.coalesce("_vid", F.lit(UNK)).cast("int").alias("id")))).alias("found"))
    out = out.select("key", "ids").join(rare.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left")
    put = F.transform("ids", lambda x, i: F.when(x >= 0, x).otherwise(F.coalesce(F.col("found")[i], F.lit(UNK))))
    return out.select(F.col("key").alias(key), put.alias("ids"))


# ---------------------------------------------------------------- D27 / D28 (re-aimed BPE)
def _merge_pairs(syms, pairs: Sequence[tuple[str, str]]):
    """Merge every non-overlapping occurrence of the pairs, left to right, in one pass (the pairs share no symbol)."""
    n = F.size(syms)

    def step(st, i):
        here, after = F.get(syms, i), F.get(syms, i + 1)
        found = F.lit(False)
        for a, b in pairs:
            found = found | ((here == a) & (after == b))
        hit = (~st["skip"]) & (i < n - 1) & found
        out = F.when(st["skip"], st["out"]).when(hit, F.concat(st["out"], F.array(F.concat(here, after)))).otherwise(
            F.concat(st["out"], F.array(here)))
        return F.struct(out.alias("out"), hit.alias("skip"))

    init = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), init, step)["out"]


#: most frequent pairs looked at in a round
_LOOK = 200
#: merges taken in one round at most
_PER_ROUND = 32


def _independent(top: list, min_frequency: int) -> list:
    """The leading pairs of a frequency list that can be merged together with the same result as one after the other.

    A merge changes only counts of pairs that hold one of its symbols, and pairs that it creates are no more frequent than
    those.  So pairs without a common symbol stay in order as long as they are more frequent than every pair that does
    share a symbol with one of them."""
    chosen, used, bar = [], set(), top[-1]["n"] if len(top) == _LOOK else 0
    for r in top:
        if {r["a"], r["b"]} & used:
            bar = r["n"]
            break
        chosen.append(r)
        used |= {r["a"], r["b"]}
    return chosen[:1] + [r for r in chosen[1:_PER_ROUND] if r["n"] > bar and r["n"] >= min_frequency]


def bpe_train(word_counts: DataFrame, num_merges: int, word: str = "token", count: str = "count",
              checkpoint_every: int = 10, min_frequency: int = 3) -> DataFrame:
    """Learn up to ``num_merges`` merges from a (word, count) table of all words; training ends when the best
    pair occurs fewer than ``min_frequency`` times.

    Each round is one distributed aggregation over the distinct words: adjacent symbol pairs weighted by word
    frequency (ties: smallest pair).  All leading pairs that don't influence each other are merged in one round; the
    result is that of one merge at a time.  Only the leading pairs (at most 200 rows) reach the driver.  The word table is
    cached per round and checkpointed into the shared checkpoint folder every ``checkpoint_every`` rounds to cut
    lineage.  Returns ``rank, left, right, count``.
    """
    spark = word_counts.sparkSession
    from pairforge.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    sym = word_counts.select(F.filter(F.split(F.col(word), ""), lambda x: x != "").alias("syms"), F.col(count).alias("c"))
    sym = sym.filter(F.size("syms") > 0).persist()
    prev, rounds = None, 0
    merges: list[tuple] = []
    while len(merges) < num_merges:
        pairs = sym.select(F.explode(F.zip_with(F.slice("syms", 1, F.greatest(F.size("syms") - 1, F.lit(0))),
                                                F.slice("syms", 2, F.size("syms")),
                                                lambda x, y: F.struct(x.alias("a"), y.alias("b")))).alias("p"), "c")
        top = (pairs.groupBy("p.a", "p.b").agg(F.sum("c").alias("n"))
               .orderBy(F.col("n").desc(), "a", "b").limit(_LOOK).collect())
        if not top or top[0]["n"] < min_frequency:
            break
        chosen = _independent(top, min_frequency)[:num_merges - len(merges)]
        if len(chosen) > 1:
            # a merge into a symbol that exists already adds to that symbol's pairs: nothing may follow it in the round
            made = [r["a"] + r["b"] for r in chosen]
            there = {x["s"] for x in sym.select(F.explode(F.array_distinct("syms")).alias("s")).filter(F.col("s").isin(made)).distinct().collect()}
            ends = next((i + 1 for i, m in enumerate(made) if m in there or m in made[i + 1:]), len(made))
            chosen = chosen[:ends]
        picked = [(r["a"], r["b"]) for r in chosen]
        merges += [(len(merges) + i, r["a"], r["b"], int(r["n"])) for i, r in enumerate(chosen)]
        rounds += 1
        contains = F.exists(F.zip_with(F.slice("syms", 1, F.greatest(F.size("syms") - 1, F.lit(0))), F.slice("syms", 2, F.size("syms")),
                                       lambda x, y: F.struct(x.alias("a"), y.alias("b"))),
                            lambda z: F.array_contains(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in picked)), z))
        nxt = sym.select(F.when(contains, _merge_pairs(F.col("syms"), picked)).otherwise(F.col("syms")).alias("syms"), "c")
        if rounds % checkpoint_every == 0:
            nxt = nxt.checkpoint()  # reliable: written to the shared checkpoint folder
        else:
            nxt = nxt.persist()  # filled by the next round's aggregation
        if prev is not None:
            prev.unpersist()  # nxt's parent (sym) stays cached until nxt is built
        prev, sym = sym, nxt
    if prev is not None:
        prev.unpersist()
    sym.unpersist()
    return spark.createDataFrame(merges, "rank int, left string, right string, count long")


#: characters up to which a word's ranks are searched in a plain list
_SHORT = 48


def _bpe_short(word: str, ranks: dict) -> list[str]:
    """``bpe_word`` of a short word: the ranks of its neighbouring pairs stand in a list."""
    syms, none = list(word), 1 << 62
    here = [ranks.get(p, none) for p in zip(syms, syms[1:])]
    while here and (least := min(here)) != none:
        i = 0
        while least in here:
            i = here.index(least, i)
            syms[i:i + 2] = [syms[i] + syms[i + 1]]
            del here[i]
            if i:
                here[i - 1] = ranks.get((syms[i - 1], syms[i]), none)
            if i < len(here):
                here[i] = ranks.get((syms[i], syms[i + 1]), none)
    return syms


def bpe_word(word: str, ranks: dict) -> list[str]:
    """Apply merges (lowest rank first, all its places from left to right) to one word.

    Symbols are linked and candidate merges wait in a heap, so a word of n characters takes n log n steps."""
    if len(word) <= _SHORT:
        return _bpe_short(word, ranks)
    syms: list = list(word)
    n = len(syms)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rk, i) for i, p in enumerate(zip(syms, syms[1:])) if (rk := ranks.get(p)) is not None]
    heapq.heapify(heap)

    def rank(i: int):
        j = after[i] if i >= 0 else n
        return ranks.get((syms[i], syms[j])) if j < n else None

    while heap:
        rk, here = heap[0][0], []
        while heap and heap[0][0] == rk:
            here.append(heapq.heappop(heap)[1])
        touched = []
        for i in here:  # places rise; one that an earlier merge has used up no longer has this rank
            if syms[i] is None or rank(i) != rk:
                continue
            j = after[i]
            syms[i], syms[j] = syms[i] + syms[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            touched += [before[i], i]
        for i in touched:
            if i >= 0 and syms[i] is not None and (r := rank(i)) is not None:
                heapq.heappush(heap, (r, i))
    return [x for x in syms if x is not None]


class _Merges:
    """Merges as arrays, to apply them to many short words at once.

    Characters have their code points as numbers, other symbols come next.  Pairs stand in a hash table with open addressing."""

    MADE, MIX = 0x110000, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict):
        pairs = sorted(ranks, key=ranks.__getitem__)
        names: dict[str, int] = {}

        def of(x: str) -> int:
            return ord(x) if len(x) == 1 else names.setdefault(x, self.MADE + len(names))

        ids = np.array([(of(a), of(b), of(a + b)) for a, b in pairs], np.int64).reshape(-1, 3)
        self.names, self.made, self.none = list(names), ids[:, 2].astype(np.int32), len(pairs)
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1), np.zeros(1 << bits, np.int32)
        keys = (ids[:, 0] << 21) | ids[:, 1]
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ranks[slot] = key, rank

    @staticmethod
    def fit(ranks: dict) -> bool:
        """Has each pair a rank of its own (and two symbols)?"""
        return len(set(ranks.values())) == len(ranks) and all(a and b for a, b in ranks)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * self.MIX) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 21) | b
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.ranks[slot], self.none).astype(np.int32)
        rest = np.flatnonzero((got != key) & (got >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            got = self.keys[slot[rest]]
            hit = got == key[rest]
            out[rest[hit]] = self.ranks[slot[rest[hit]]]
            rest = rest[~hit & (got >= 0)]
        return out

    def pieces(self, words: pa.Array) -> pa.ListArray:
        """``bpe_word`` of many words, none empty: a step takes the lowest rank of each word, at all its places from left to right."""
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        sym = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.int32).copy()
        end = np.zeros(len(sym), bool)
        end[np.cumsum(size) - 1] = True
        rank, inner = np.full(len(sym), self.none, np.int32), np.flatnonzero(~end)
        rank[inner] = self._rank(sym[inner], sym[inner + 1])
        word, over = np.arange(len(size)), []
        while len(size):
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            live = least < self.none
            if 8 * int(live.sum()) <= 7 * len(live):  # words that are done leave
                of = np.repeat(live, size)
                over.append((word[~live], size[~live], sym[~of]))
                word, size, sym, rank, end, least = word[live], size[live], sym[of], rank[of], end[of], least[live]
                if not len(size):
                    break
            p = np.flatnonzero((rank == np.repeat(least, size)) & (rank < self.none))
            near = p[1:] == p[:-1] + 1
            if near.any():
                at = np.arange(len(p))
                run = np.maximum.accumulate(np.where(np.append(True, ~near), at, 0))
                p = p[(at - run) % 2 == 0]
            sym[p] = self.made[rank[p]]
            end[p] |= end[p + 1]
            left = np.ones(len(sym), bool)
            left[p + 1] = False
            size = np.add.reduceat(left.astype(np.int64), np.cumsum(size) - size)
            q = p - np.arange(len(p))  # one symbol less for each merge before
            sym, rank, end = sym[left], rank[left], end[left]
            touched = np.concatenate([q, q[q > 0] - 1])
            rank[touched] = self.none
            touched = touched[~end[touched]]
            rank[touched] = self._rank(sym[touched], sym[touched + 1])
        word, size, sym = map(np.concatenate, zip(*over)) if over else (np.zeros(0, np.int64), np.zeros(0, np.int64), sym)
        order = np.argsort(word)
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        offs = np.concatenate([[0], np.cumsum(size)])
        sym = sym[np.repeat(begin - offs[:-1], size) + np.arange(int(offs[-1]))]
        known, which = np.unique(sym, return_inverse=True)
        texts = pa.array([self.names[i - self.MADE] if i >= self.MADE else chr(i) for i in known.tolist()], pa.string())
        return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), texts.take(pa.array(which)))


def _pieces(words: pa.Array, merges: _Merges | None, ranks: dict, keep: frozenset) -> pa.Array:
    """Pieces of distinct words."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    short = (size > 0) & (size <= _SHORT) & (merges is not None)
    if keep:
        short &= ~pc.is_in(words, pa.array(sorted(keep), pa.string())).to_numpy(zero_copy_only=False)
    some, others = np.flatnonzero(short), np.flatnonzero(~short)
    one = merges.pieces(words.take(pa.array(some))) if len(some) else pa.array([], pa.list_(pa.string()))
    if not len(others):
        return one
    two = pa.array([[w] if w in keep else bpe_word(w, ranks) for w in words.take(pa.array(others)).to_pylist()], pa.list_(pa.string()))
    at = np.empty(len(words), np.int64)
    at[np.concatenate([some, others])] = np.arange(len(words))
    return pa.concat_arrays([one, two]).take(pa.array(at))


class _Known:
    """Distinct words of the last runs with their pieces, up to ``_KEPT_WORDS`` (or those of one run)."""

    def __init__(self):
        self.words, self.lists = pa.array([], pa.string()), pa.array([], pa.list_(pa.string()))

    def pieces(self, words: pa.DictionaryArray, encoded) -> pa.Array:
        """The pieces of all ``words``; ``encoded`` gives those of distinct new ones."""
        distinct = words.dictionary
        at = pc.index_in(distinct, value_set=self.words)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        at[new] = len(self.words) + np.arange(int(new.sum()))
        some = distinct.filter(pa.array(new))
        if len(some):
            self.words, self.lists = pa.concat_arrays([self.words, some]), pa.concat_arrays([self.lists, encoded(some)])
        out = self.lists.take(pa.array(at[words.indices.to_numpy()]))
        if len(self.words) > _KEPT_WORDS:
            self.words, self.lists = distinct, self.lists.take(pa.array(at))
        return out


def bpe_encode(texts: DataFrame, key: str, tokens: str, merges: DataFrame, special: Sequence[str] = ()) -> DataFrame:
    """BPE pieces of every token, found where the token stands: no occurrence is shuffled.

    A task holds the merge table (as long as the vocabulary that training was asked for) and encodes the **distinct** words of a run of
    tokens, short ones all at once, unless they are among the last ``_KEPT_WORDS``.  ``special`` tokens stay whole.  Returns ``token, key, pos, pieces``."""
    t = merges.select("rank", "left", "right").toArrow().to_pydict()
    ranks = {}
    for rank, pair in sorted(zip(t["rank"], zip(t["left"], t["right"])), reverse=True):
        ranks[pair] = rank  # of a repeated pair the first rank counts
    keep = frozenset(special)
    sent = texts.sparkSession.sparkContext.broadcast((ranks, _Merges(ranks) if _Merges.fit(ranks) else None))

    def run(batches):
        (ranks, table), known = sent.value, _Known()
        for whole in batches:
            for b in _token_runs(whole):
                size = pc.fill_null(pc.list_value_length(b.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = b.column("tokens").flatten()
                row = np.repeat(np.arange(len(size)), size)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                there = np.flatnonzero(pc.is_valid(flat).to_numpy(zero_copy_only=False))
                words = flat.take(pa.array(there)).dictionary_encode()
                pieces = known.pieces(words, lambda some: _pieces(some, table, ranks, keep))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), b.column("key").take(pa.array(row[there])),
                                                  pa.array(pos[there].astype(np.int32)), pieces], names=["token", key, "pos", "pieces"])

    schema = StructType([StructField("token", StringType()), StructField(key, texts.schema[key].dataType), StructField("pos", IntegerType()),
                         StructField("pieces", ArrayType(StringType()))])
    return texts.select(F.col(key).alias("key"), F.col(tokens).alias("tokens")).mapInArrow(run, schema)
