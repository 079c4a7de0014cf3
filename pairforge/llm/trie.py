"""Prefix trie of conversations by digests of prefixes (operator 12).

A sequence is cut into blocks of 64 turns, blocks into blocks of 64, and so on; a block's content is compared by
the digest of its parts.  Downwards, a prefix's digest is that of the prefix before its block and of the block's parts
up to it, so all prefixes of H turns take log H (to the base 64) rounds and no step holds more of a sequence than a
block.  A prefix is named by its smallest member: a node is a length and a name.

A node's names along a sequence rise with the depth, so a sequence names the nodes from some depth to its end; the
parent of the first of them has the next smaller name.  Totals over subtrees are sums, over the sequences that pass a
node, of what the sequence names from there on; these are running sums within blocks and over blocks.

Equal sequences are one row from the start.  No step holds a subtree: rows are turns, blocks and nodes, sums are
combined before they are shuffled, and a name that very many sequences share is one row of a join.

Defined results: see ``rebuild`` for nulls, ties and repeated rows; texts of any
length are read whole and compared by SHA-256; sequences without turns are
members of the root alone; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm._arrow import written

#: turns or blocks in a block, as a power of two
BLOCK = 6


def numbered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``id, pos`` (from 0 in the order of turn, role, text; nulls first), ``sym`` (digest of role and text) and ``n`` (code points).

    Rows are dealt by ranges, so that a long conversation spreads over tasks; its places then follow from its rows in earlier ranges."""
    spark = turns.sparkSession
    empty = F.lit("")
    rows = turns.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), empty).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), empty).alias("text"))
    rows = rows.groupBy("id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("id", "turn", "role", "text")
    sym = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    dealt = dealt.select("id", sym.alias("sym"), F.length("text").cast("bigint").alias("n"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")) \
        .select("id", "sym", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    dealt = written(spark, dealt, "turns")
    runs = dealt.groupBy("id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    # a conversation has a row for each range it meets
    before = F.sum("rows").over(Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("id", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return dealt.join(runs, ["id", "part"]).select("id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "sym", "n")


def rebuild(turns: DataFrame, every: int = 100, most: int = 6, **columns) -> tuple[DataFrame, DataFrame]:
    """(``id, len`` of every conversation, its turns ``id, pos, sym, n``) after the heads are exchanged.

    A conversation's first h turns (h: the checksum of its id modulo ``most``) are those of the first conversation of
    its hundred (``every``): all if there are fewer, none if it is absent; its own turns after its first h follow.
    Rows without id belong to no conversation; null roles and texts are empty; turns are ordered by (turn, role, text),
    nulls first, so ties and repeated rows have one order and all stay."""
    spark = turns.sparkSession
    own = written(spark, numbered(turns, **columns), "numbered")
    heads = F.crc32(F.col("id").cast("string").cast("binary")) % most
    ids = own.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).withColumn("h", heads).withColumn("base", F.col("id") - F.col("id") % every)
    bases = ids.filter("id = base").select(F.col("id").alias("_base"), F.col("rows").alias("_rows"))
    ids = ids.join(bases, F.col("base") == F.col("_base"), "left") \
        .select("id", "base", "h", F.least("h", F.coalesce("_rows", F.lit(0))).alias("k"), F.col("rows"))
    ids = written(spark, ids.withColumn("len", F.col("k") + F.greatest(F.col("rows") - F.col("h"), F.lit(0))), "ids")
    tails = own.filter(F.col("pos") >= heads).join(ids.select("id", "h", "k"), "id") \
        .select("id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "sym", "n")
    first = own.filter((F.col("id") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("id", "base")
    front = ids.filter("k > 0").select("id", "base", "k").join(first, "base").filter("pos < k").select("id", "pos", "sym", "n")
    return ids.select("id", "len"), written(spark, tails.unionByName(front), "rebuilt")


def _classes(top: DataFrame) -> DataFrame:
    """One row for each distinct sequence: smallest member, length, members, digest of the member ids; ids pass as a stream."""
    schema = pa.schema([("id", pa.int64()), ("len", pa.int64()), ("m", pa.int64()), ("ends", pa.string())])

    def run(batches):
        of, least, n, h = None, None, 0, None
        for b in batches:
            done = []
            for i, size, d in zip(*(b.column(c).to_pylist() for c in ("id", "len", "d"))):
                if of != (size, d):
                    if of is not None:
                        done.append({"id": least, "len": of[0], "m": n, "ends": h.hexdigest()})
                    of, least, n, h = (size, d), i, 0, hashlib.sha256()
                h.update((f",{i}" if n else str(i)).encode())
                n += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if of is not None:
            yield pa.RecordBatch.from_pylist([{"id": least, "len": of[0], "m": n, "ends": h.hexdigest()}], schema=schema)

    return top.select("id", "len", "d").repartition("len", "d").sortWithinPartitions("len", "d", "id") \
        .mapInArrow(run, "id bigint, len bigint, m bigint, ends string")


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """Every node of the trie of ``turns(id, pos, sym, n)`` over ``ids(id, len)``.

    ``id`` (smallest member), ``depth``, ``parent`` (the parent's id, null for the root), ``n_convs``, ``n_children``, ``n_leaves``
    and ``saved`` (over the subtree), ``ends`` (SHA-256 of the comma-joined ids that end here, null if none)."""
    spark = ids.sparkSession
    total = ids.agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("root"), F.max("len").alias("len")).first()
    size, zero = 1 << BLOCK, F.lit(0).cast("bigint")
    rounds = 1
    while (1 << (BLOCK * rounds)) < (total["len"] or 0):
        rounds += 1

    # blocks of 64 turns, of 64 blocks, ..: their parts' digests, 64 digits each, in order
    blocks, parts = [], turns.select("id", F.col("pos").alias("j"), F.col("sym").alias("d"), "n")
    for k in range(rounds):
        items = F.array_sort(F.collect_list(F.struct("j", F.lower(F.hex("d")).alias("d"), "n")))
        up = parts.groupBy("id", F.shiftright("j", BLOCK).alias("j")).agg(items.alias("x")) \
            .select("id", "j", F.array_join(F.col("x")["d"], "").alias("s"), F.col("x")["n"].alias("ns"))
        blocks.append(written(spark, up if not k else up.drop("ns"), "blocks"))
        parts = blocks[-1].select("id", "j", F.unhex(F.sha2("s", 256)).alias("d"), zero.alias("n"))
    top = ids.join(parts.select("id", "d"), "id", "left").withColumn("d", F.coalesce("d", F.lit("").cast("binary")))
    classes = written(spark, _classes(top), "classes")

    # a digest for every prefix of every distinct sequence
    rows = classes.filter("len > 0").select("id", "len", "m", "ends", zero.alias("j"), F.lit("").alias("seed"))
    for k in range(rounds - 1, -1, -1):
        after = F.transform(F.sequence(F.lit(1), (F.length("s") / 64).cast("int")), lambda i: F.sha2(F.concat(F.col("seed"), F.substring("s", F.lit(1), i * 64)), 256))
        rows = rows.join(blocks[k], ["id", "j"]).withColumn("after", after)
        if k:
            seeds = F.concat(F.array("seed"), F.slice("after", F.lit(1), F.size("after") - 1))
            rows = rows.select("id", "len", "m", "ends", "j", F.posexplode(seeds).alias("i", "seed")) \
                .select("id", "len", "m", "ends", (F.col("j") * size + F.col("i")).alias("j"), "seed")
    rows = rows.select("id", "len", "m", "ends", "j", F.posexplode(F.arrays_zip("after", "ns")).alias("i", "x")) \
        .withColumn("depth", F.col("j") * size + F.col("i") + 1).select(
            "id", "depth", F.unhex(F.col("x.after")).alias("d"), F.col("x.ns").alias("n"), "m",
            (F.col("depth") == F.col("len")).alias("last"), F.when(F.col("depth") == F.col("len"), F.col("ends")).alias("ends"))
    rows = written(spark, rows, "prefixes")
    # dealt anew, so that the join has a shuffle of its own on both sides and a hot name's rows can be split
    names = rows.groupBy("depth", "d").agg(F.min("id").alias("name"), F.sum("m").alias("members")).repartition("name")
    named = rows.join(names, ["depth", "d"]).select("id", "depth", "name", "members", "n", "m", "last", "ends")
    root = classes.select("id", zero.alias("depth"), F.lit(total["root"]).cast("bigint").alias("name"), F.lit(total["m"]).cast("bigint").alias("members"),
                          zero.alias("n"), "m", (F.col("len") == 0).alias("last"), F.when(F.col("len") == 0, F.col("ends")).alias("ends"))
    named = named.unionByName(root).withColumns({
        "block": F.shiftright("depth", BLOCK), "saved": F.when(F.col("id") == F.col("name"), (F.col("members") - 1) * F.col("n")).otherwise(0),
        "leaves": (F.col("last") & (F.col("members") == F.col("m"))).cast("bigint")}).drop("n", "m", "last")
    named = written(spark, named, "named")

    # what a sequence names from a depth on: within the block, and in later blocks
    both = ("saved", "leaves")
    here = Window.partitionBy("id", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a sequence has a row for each block
    after = Window.partitionBy("id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = named.groupBy("id", "block").agg(*(F.sum(c).alias(c) for c in both)) \
        .select("id", "block", *(F.sum(c).over(after).alias(f"_{c}") for c in both)).filter("_saved > 0 or _leaves > 0")
    sums = named.select("id", "block", "depth", "name", "members", "ends", *(F.sum(c).over(here).alias(c) for c in both)) \
        .join(later, ["id", "block"], "left").groupBy("depth", "name") \
        .agg(F.max("members").alias("n_convs"), F.max("ends").alias("ends"), *(F.sum(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in both))
    firsts = named.groupBy("id").agg(F.min(F.when(F.col("name") == F.col("id"), F.col("depth"))).alias("first"),
                                     F.max(F.when(F.col("name") < F.col("id"), F.col("name"))).alias("above"))
    parent = F.when(F.col("depth") > F.col("first"), F.col("id")).otherwise(F.col("above"))
    nodes = sums.withColumnRenamed("name", "id").join(firsts, "id").select("id", "depth", parent.alias("parent"), "n_convs", "leaves", "saved", "ends")
    nodes = written(spark, nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(children, ["depth", "id"], "left").select(
        "id", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"), "saved", "ends")
