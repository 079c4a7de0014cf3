"""Set-similarity join on word shingles over grouped count vectors (operator 3).

A document is the set of its distinct k-word shingles.  Shingles are hashed
into groups and a document becomes a point of group counts.  For two sets
``|A & B| <= sum(min(a_i, b_i))`` over the groups, and the L1 distance of any
two parts of the points is at most ``|A ^ B|``.  A pair that reaches the
threshold differs in at most ``D`` shingles, so of ``D + 1`` or more disjoint
parts of the coordinates at least one has the *same* counts in both points.  One
tree over the whole points can't prune (hundreds of evenly filled
coordinates), therefore the index has one leaf per (size band, part, counts of
the part): a leaf is a hash key, looking a document up is an equi-join, and
long passages that many documents share don't fill a leaf, because a leaf holds
whole parts.  Of a document's parts all but ``D`` are equal in a linked one, so
its ``D + 1`` first ones suffice, in any order that is the same for all documents
(``D`` follows from the document's own size).  The order puts parts of many
shingles first: parts of one shingle, and empty ones, are those that unrelated
documents have in common, in numbers that grow with the table.  Then:

1. each leaf's smallest class is tested against its other members: the bound on
   the points first, then the exact intersection of the shingle sets,
2. leaves that still hold several components are searched in blocks of bounded
   size: members of different components whose summed coordinate minima allow
   the threshold are tied to clusters (a block gives no more rows than it has;
   clusters that several leaves give are one),
3. each cluster's sets are met in one task, all its pairs of different components
   are tested exactly, and of the links those that join two parts are given.

Links inside a known component are not enumerated (a group of g
copies would have g*g of them); every link between different components is
found, so the components are exact.  Documents with equal sets are one class
from the start; the class is represented by its smallest id.

Defined results: null, empty and wordless texts have no shingles and are linked
with nothing (their own component); a text of fewer than k words is one
shingle; texts of any length are read whole; repeated rows belong to one class, and
ties need no rule, as a component's name is its smallest id; rows without id
get the component of their class and link others; an empty table gives no rows;
further columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import _words
from pairforge.llm._arrow import held, id_and_text, pieces, schema_of, written
from pairforge.llm._components import components

#: coordinates of a document's whole point (larger sets: one for PER_GROUP shingles), and of one part of it (a part holds few shingles, so its leaves
#: tell documents apart only with many coordinates; they are never laid out, only the filled ones are hashed)
GROUPS, PER_GROUP, PART_GROUPS = 256, 4, 1 << 32
#: rows of one leaf that are compared at once; larger leaves are cut into blocks of this size
BLOCK = 512
#: sets that clusters tie together are met in one task up to this number; beyond it, cluster by cluster
FAMILY = 2048
#: rows of points (about 300 bytes) and of pairs (16 bytes) that are sent to all tasks; larger tables are shuffled
SENT_POINTS, SENT_PAIRS = 50_000, 250_000
#: shingles of a part from which on more of them don't put it before others
LOADS = 15
#: ratio of the sizes in one band
BAND = 1.5


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, row offsets)."""
    row, words, _, _, counts = _words.split(texts, _words.SPACED)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    offs = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(offs[-1]), np.uint64)
    base = np.cumsum(counts) - counts
    short = np.zeros(len(out), dtype=bool)
    for c in range(1, k):
        rows = np.flatnonzero(counts == c)
        if len(rows):
            short[offs[rows]] = True
            out[offs[rows]] = _words.grams(words[(base[rows][:, None] + np.arange(c)).ravel()], c)[::c]
    g = _words.grams(words, k)
    out[~short] = g[row[:len(g)] == row[k - 1:k - 1 + len(g)]] if len(g) else g
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    keep[offs[:-1][sizes > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def set_ids(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's set."""
    one = _words.mix(_sums(_words.mix(h ^ np.uint64(0x243F6A8885A308D3)), offs))
    return one, _words.mix(_sums(_words.mix(h ^ np.uint64(0x13198A2E03707344)), offs))


class Bands:
    """Size bands with the number of parts for each, for a threshold of ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        tops = [max(2, -(-num // (den - num)))]  # below this size only equal sets can be linked
        while tops[-1] < 1 << 40:
            tops.append(max(tops[-1] + 1, int(tops[-1] * max(BAND, den / num))))
        self.tops = np.array(tops, dtype=np.int64)
        # |A ^ B| <= (den - num) / (den + num) * (|A| + |B|)
        self.most = 2 * self.tops * (den - num) // (den + num)
        self.parts = self.most + 2 + self.most // 4

    def of(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, band) for each band in which rows of these sizes are entered: their own and, where a linked
        set can be larger than the band, the next."""
        some = np.flatnonzero(n * self.den // self.num > n)  # others are linked with equal sets only
        band = np.searchsorted(self.tops, n[some])
        over = n[some] * self.den // self.num > self.tops[band]
        return [(some, band), (some[over], band[over] + 1)]

    def differing(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The most shingles in which a set of ``n`` shingles can differ from a linked one of this band."""
        return (self.den - self.num) * (n + np.minimum(n * self.den // self.num, self.tops[band])) // (self.den + self.num)


def _first(key: np.ndarray, of: np.ndarray, load: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which of the rows' parts are among the first ``need`` of their row: those with more shingles (up to ``LOADS``) first, then by key."""
    load = np.minimum(load, LOADS)
    above = np.bincount(of * (LOADS + 2) + load, minlength=len(need) * (LOADS + 2)).reshape(-1, LOADS + 2)[:, ::-1].cumsum(axis=1)[:, ::-1]
    last = (above >= need[:, None]).sum(axis=1) - 1  # the load of which some parts stay out; -1: all are in
    kept = load > last[of]
    some = np.flatnonzero(load == last[of])
    some = some[np.lexsort((key[some], of[some]))]
    row = of[some]
    nth = np.arange(len(some)) - np.searchsorted(row, row)
    kept[some[nth < (need - above[np.arange(len(need)), last + 1])[row]]] = True
    return kept


def leaves(h: np.ndarray, offs: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every leaf in which a row is entered."""
    n = np.diff(offs)
    rows_out, keys_out = [], []
    for rows, band in bands.of(n):
        if not len(rows):
            continue
        size = n[rows]
        at = np.repeat(offs[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        x, r = h[at], np.repeat(np.arange(len(rows)), size)
        parts = bands.parts[band]
        part = ((x >> np.uint64(32)) * np.repeat(parts, size).astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(x), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (r[1:] != r[:-1])
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(_words.mix((x & np.uint64(PART_GROUPS - 1)) + np.uint64(0x452821E638D01377)), starts)
        place = _words.mix((band[r[starts]].astype(np.uint64) << np.uint64(40)) + part[starts] + np.uint64(1))
        key, of, load = _words.mix(counts + place), r[starts], np.diff(np.append(starts, len(x)))
        need = bands.differing(size, band) + 1
        kept = _first(key, of, load, need)
        rows_out.append(rows[of[kept]])
        keys_out.append(key[kept])
        # empty parts are equal too; they come last, where filled parts don't suffice for the guarantee
        filled = np.bincount(of, minlength=len(rows))
        for i in np.flatnonzero(filled < need).tolist():
            empty = np.setdiff1d(np.arange(parts[i]), part[starts][of == i].astype(np.int64))
            place = _words.mix(np.uint64(int(band[i]) << 40) + empty.astype(np.uint64) + np.uint64(1))
            empty = np.sort(_words.mix(place))[:need[i] - filled[i]]
            rows_out.append(np.full(len(empty), rows[i]))
            keys_out.append(empty)
    if not rows_out:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(keys_out)


def points(h: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Group counts of each row: the bytes of a count (0 for half a byte, 1, 2 or 4, the fewest that hold them all), then the counts.

    Larger sets have more groups (a power of two, so that points of two sizes can be met), or the bound would see few differences."""
    g, out = (h >> np.uint64(8)).astype(np.int64), []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        groups = max(GROUPS, 1 << ((b - a) // PER_GROUP).bit_length())
        c = np.bincount(g[a:b] & (groups - 1), minlength=groups)
        top = int(c.max())
        if top < 16:
            out.append(b"\0" + (c[::2] | c[1::2] << 4).astype(np.uint8).tobytes())
            continue
        size = 1 if top < 256 else 2 if top < 65536 else 4
        out.append(bytes([size]) + c.astype(f"<u{size}").tobytes())
    return out


def _point(b: bytes) -> np.ndarray:
    if not b[0]:
        half = np.frombuffer(b, dtype=np.uint8, offset=1)
        return np.stack([half & 15, half >> 4], axis=1).ravel().astype(np.int32)
    return np.frombuffer(b, dtype=f"<u{b[0]}", offset=1).astype(np.int32)


def _folded(p: np.ndarray, groups: int) -> np.ndarray:
    return p if len(p) == groups else p.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Summed coordinate minima of two points, at the coarser one's groups."""
    groups = min(len(x), len(y))
    return int(np.minimum(_folded(x, groups), _folded(y, groups)).sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _maps(docs: DataFrame, k: int, bands: Bands):
    """The passes over texts: set identities, leaf keys, points and sets."""
    def identities(batches):
        held("jaccard", None, lambda _: None)
        for b in pieces(batches, 1 << 20):
            h, offs = shingle_sets(b.column("text"), k)
            s1, s2 = set_ids(h, offs)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offs)), _signed(s1), _signed(s2)],
                                             ["id", "n", "s1", "s2"])

    def keys(batches):
        held("jaccard", None, lambda _: None)  # nothing but this task's own
        seen: set[int] = set()  # copies in one task enter once
        for b in pieces(batches, 1 << 20):
            h, offs = shingle_sets(b.column("text"), k)
            s1 = set_ids(h, offs)[0]
            row, key = leaves(h, offs, bands)
            fresh = np.zeros(len(s1), dtype=bool)
            for i, s in enumerate(s1.tolist()):
                if s not in seen:
                    seen.add(s)
                    fresh[i] = True
            mine = fresh[row]
            yield pa.RecordBatch.from_arrays([_signed(key[mine]), _signed(s1[row[mine]])], ["key", "s1"])

    def located(batches):
        for b in pieces(batches, 1 << 20):
            h, offs = shingle_sets(b.column("text"), k)
            s1, _ = set_ids(h, offs)
            yield pa.RecordBatch.from_arrays([_signed(s1), pa.array(np.diff(offs)), pa.array(points(h, offs), pa.binary())], ["s", "n", "point"])

    def sets(batches):
        for b in pieces(batches, 1 << 20):
            h, offs = shingle_sets(b.column("text"), k)
            s1, _ = set_ids(h, offs)
            yield pa.RecordBatch.from_arrays([_signed(s1), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), _signed(h))], ["s", "shingles"])

    return identities, keys, located, sets


def _enough(bound: np.ndarray, na, nb, num: int, den: int) -> np.ndarray:
    """Could (or does) an overlap of ``bound`` reach the threshold?  den * o >= num * (na + nb - o)."""
    return (den + num) * bound >= num * (na + nb)


def _bounded(num: int, den: int):
    def run(batches):
        for b in batches:
            a, c, na, nc = (b.column(x).to_pylist() for x in ("pa", "pb", "na", "nb"))
            o = [_overlap(_point(x), _point(y)) for x, y in zip(a, c)]
            keep = _enough(np.array(o, dtype=np.int64), np.array(na, dtype=np.int64), np.array(nc, dtype=np.int64), num, den)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _exact(num: int, den: int):
    def run(batches):
        for b in batches:
            x, y = b.column("xa"), b.column("xb")
            keep = []
            for i in range(b.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                o = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(bool(_enough(o, len(p), len(q), num, den)))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _runs(batches, keys: tuple[str, ...], columns: tuple[str, ...]):
    """Lists of neighbouring rows of equal keys."""
    held, of = [], None
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in keys), *(b.column(c) if c == "shingles" else b.column(c).to_pylist() for c in columns)):
            if r[:len(keys)] != of:
                if len(held) > 1:
                    yield of, held
                held, of = [], r[:len(keys)]
            held.append(r[len(keys):])
    if len(held) > 1:
        yield of, held


def _search(num: int, den: int):
    """Clusters of each block (rows sorted by block): rows of different components are tied where the bound allows a link.

    A row is in one cluster at most, so a block gives no more rows than it has; clusters of equal rows get one name."""
    def block(rows) -> np.ndarray:
        s, n, comp, side = (np.array(x) for x in zip(*(r[:4] for r in rows)))
        point = [_point(r[4]) for r in rows]
        least = min(len(p) for p in point)
        point = np.stack([_folded(p, least) for p in point])
        # side 0: the block is compared with itself; -1 and 1: two blocks of one leaf
        two = bool(side.any())
        left, right = (np.flatnonzero(side == -1), np.flatnonzero(side == 1)) if two else (np.arange(len(s)), np.arange(len(s)))
        tied = np.arange(len(s))
        for i in left.tolist():
            js = right[(comp[right] != comp[i]) & (tied[right] != tied[i]) & (two | (right > i))
                       & (den * np.minimum(n[right], n[i]) >= num * np.maximum(n[right], n[i]))]
            if len(js):
                js = js[_enough(np.minimum(point[js], point[i]).sum(axis=1), n[i], n[js], num, den)]
                if len(js):
                    tied[np.isin(tied, tied[js])] = tied[i]
        return tied

    def run(batches):
        for _, rows in _runs(batches, ("key", "i", "j"), ("s", "n", "comp", "side", "point")):
            tied = block(rows)
            s = np.array([r[0] for r in rows])
            names, members = [], []
            for t in np.unique(tied):
                mine = np.sort(s[tied == t])
                if len(mine) > 1:
                    name = _words.mix(np.bitwise_xor.reduce(_words.mix(mine.view(np.uint64))) + _words.mix(np.uint64(len(mine)) + mine[:1].view(np.uint64)))
                    names.append(np.full(len(mine), name.view(np.int64)))
                    members.append(mine)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(members))], ["cluster", "s"])
    return run


def _joined(num: int, den: int):
    """Links within each cluster (rows sorted by cluster) that join two of its components, by exact tests: fewer than it has rows."""
    def links(rows):
        s, comp, sets = zip(*rows)
        values = [x.values.to_numpy() for x in sets]
        n = np.array([len(v) for v in values])
        offs = np.concatenate([[0], np.cumsum(n)])
        _, ids = np.unique(np.concatenate(values), return_inverse=True)
        part = np.unique(comp, return_inverse=True)[1]
        mark = np.zeros(int(ids.max()) + 1, np.int64)
        for i in range(len(s) - 1):
            js = np.arange(i + 1, len(s))
            js = js[(part[js] != part[i]) & (den * np.minimum(n[js], n[i]) >= num * np.maximum(n[js], n[i]))]
            if not len(js):
                continue
            mark[ids[offs[i]:offs[i + 1]]] = 1
            shared = np.array([mark[ids[offs[j]:offs[j + 1]]].sum() for j in js.tolist()])
            mark[ids[offs[i]:offs[i + 1]]] = 0
            for j in js[_enough(shared, n[i], n[js], num, den)].tolist():
                if part[j] != part[i]:
                    part[part == part[j]] = part[i]
                    yield s[i], s[j]

    def run(batches):
        for _, rows in _runs(batches, ("cluster",), ("s", "comp", "shingles")):
            found = list(links(rows))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                    threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` (smallest id reachable by links, its own included) per row.

    Two rows link when their sets' intersection over union is at least ``threshold`` (numerator, denominator)."""
    spark = docs.sparkSession
    num, den = threshold
    bands = Bands(num, den)
    identities, keys, located, sets = _maps(docs, k, bands)
    text = id_and_text(docs, id_col, text_col)

    ids = written(spark, text.mapInArrow(identities, schema_of(docs, id_col, "n bigint, s1 bigint, s2 bigint")), "sets")
    classes = ids.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))

    entered = text.mapInArrow(keys, "key bigint, s1 bigint").repartition("key").dropDuplicates(["key", "s1"])
    hits = written(spark, spark.sql(
        "SELECT key, s1 AS s, lead, c FROM (SELECT key, s1, min(s1) OVER w AS lead, count(*) OVER w AS c FROM {e} "
        "WINDOW w AS (PARTITION BY key)) WHERE c > 1", e=entered), "leaves")

    def sent(d: DataFrame, n: int, most: int) -> DataFrame:
        """A table of counted size goes to all tasks while it is small; else the join shuffles it."""
        return F.broadcast(d) if n <= most else d

    def stored(wanted: DataFrame, found, kinds: str, name: str) -> DataFrame:
        """What ``found`` gives for the wanted classes ``s``, from a text of each."""
        of = written(spark, classes.join(wanted, classes.s1 == wanted.s, "left_semi").select(F.col("rep").alias("id"), F.col("s1").alias("s")), "reps")
        out = text.join(sent(of.select("id"), of.count(), SENT_PAIRS), "id", "left_semi").mapInArrow(found, kinds)
        # classes whose rows all lack an id
        nameless = text.filter("id IS NULL").mapInArrow(found, kinds).join(of.filter("id IS NULL").select("s"), "s", "left_semi")
        out = written(spark, out.unionByName(nameless), name)
        if out.count() > out.select("s").distinct().count():  # repeated rows
            out = written(spark, out.dropDuplicates(["s"]), name)
        return out

    placed = stored(hits.select("s").distinct(), located, "s bigint, n bigint, point binary", "points")
    few_placed = placed.count() <= SENT_POINTS
    kinds = "s bigint, shingles array<bigint>"

    def points_of(x: str) -> DataFrame:
        d = placed.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
        return F.broadcast(d) if few_placed else d

    def within(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that the bound on the points allows."""
        return pairs.join(points_of("a"), "a").join(points_of("b"), "b").mapInArrow(_bounded(num, den), "a bigint, b bigint")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of written pairs (a, b) those that link: their sets are met and intersected."""
        known = stored(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct(), sets, kinds, "sets")
        one = known.select(F.col("s").alias("a"), F.col("shingles").alias("xa")).join(sent(pairs, pairs.count(), SENT_PAIRS), "a")
        two = known.select(F.col("s").alias("b"), F.col("shingles").alias("xb"))
        return one.join(two, "b").mapInArrow(_exact(num, den), "a bigint, b bigint")

    stars = written(spark, hits.filter("s <> lead").select(F.col("lead").alias("a"), F.col("s").alias("b")).distinct(), "stars")
    close = written(spark, within(stars), "close")
    comp = written(spark, components(spark, linked(close)), "components")
    n_comp = comp.count()

    def labels(x: str) -> DataFrame:
        return sent(comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")), n_comp, SENT_PAIRS)

    labelled = hits.filter("c > 2").join(labels("s"), "s", "left").select("key", "s", "c", F.coalesce("cs", "s").alias("comp"))
    mixed = spark.sql("SELECT key, s, c, comp FROM (SELECT *, min(comp) OVER w AS x, max(comp) OVER w AS y FROM {l} "
                      "WINDOW w AS (PARTITION BY key)) WHERE x <> y", l=labelled)
    blocks = mixed.join(points_of("s"), "s") \
        .withColumn("m", F.ceil(F.col("c") / BLOCK).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("s"), F.col("m")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1))) \
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "s", F.col("ns").alias("n"), "comp",
                F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), F.col("ps").alias("point"))
    clusters = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "s") \
        .mapInArrow(_search(num, den), "cluster bigint, s bigint").distinct()
    clusters = written(spark, clusters, "clusters")
    # leaves give many clusters of the same few sets: where all sets that clusters tie together are few, they are one cluster
    least = clusters.groupBy("cluster").agg(F.min("s").alias("b"))
    family = components(spark, clusters.join(least, "cluster").select(F.col("s").alias("a"), "b"))
    few = family.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") <= FAMILY).select("comp")
    one = written(spark, family.join(few, "comp", "left_semi").select(F.col("comp").alias("cluster"), F.col("node").alias("s")), "families")
    clusters = one.union(clusters.join(one.select("s"), "s", "left_anti").select("cluster", "s"))
    members = clusters.join(labels("s"), "s", "left").select("cluster", "s", F.coalesce("cs", "s").alias("comp"))
    known = stored(clusters.select("s").distinct(), sets, kinds, "sets")
    links = members.join(known, "s").repartition("cluster").sortWithinPartitions("cluster", "s") \
        .mapInArrow(_joined(num, den), "a bigint, b bigint")
    merged = links.join(labels("a"), "a", "left").join(labels("b"), "b", "left") \
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = written(spark, components(spark, merged), "merged").select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    # nodes that are new, and old ones whose component has grown
    grown = comp.join(sent(up, up.count(), SENT_PAIRS), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")) \
        .union(up.select(F.col("comp").alias("node"), F.col("top").alias("comp")).join(labels("node").select("node"), "node", "left_anti"))
    comp = written(spark, grown, "components")

    grouped = classes.join(comp.withColumnRenamed("node", "s1"), "s1", "left") \
        .select("n", "s1", "s2", "rep", F.coalesce("comp", "s1").alias("comp"), F.col("comp").isNotNull().alias("linked"))
    grouped = written(spark, grouped, "classes")
    least = grouped.filter("linked").groupBy("comp").agg(F.min("rep").alias("least"))
    named = grouped.join(least, "comp", "left").select("n", "s1", "s2", F.coalesce("least", "rep").alias("component_id"))
    return ids.join(named, ["n", "s1", "s2"], "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
