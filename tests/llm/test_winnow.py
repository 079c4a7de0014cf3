import random
import re

import pytest
from pyspark.sql import functions as F

from pairforge.llm import winnow

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items, window=13):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[p:p + n]), set()).add(i)
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p:p + n])) in grams:
                    hit.update(range(p, p + n))
                    met |= grams[g]
        out.append((d, len(w), len(hit), sorted(str(i) for i in met if i is not None),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def ran(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, spans int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, words string")
    rows = winnow.decontaminate(d, b, **kw).collect()
    return sorted(((r.id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows), key=repr)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 600])
def test_matches_brute_force(spark, shard_bytes):
    r = random.Random(3)
    voc = ["a", "B", "c1", "Éé", "the", "x"]
    text = lambda n: " ".join(r.choice(voc) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 7, 12, 13, 14, 30, 60]) if i > 3 else 40)) for i in range(25)]
    items += [(None, items[1][1]), (3, items[3][1]), (90, None), (91, " .,"), (92, "")]
    items = [x for x in items if len(words(x[1])) != 1]
    docs = [(i, text(r.randint(0, 40))) for i in range(30)]
    for i in range(30):
        w = r.choice([x for x in items if x[1]])[1].split(" ")
        a = r.randint(0, max(0, len(w) - 14))
        docs.append((100 + i, " ".join([text(r.randint(0, 20)).lower(), " ".join(w[a:a + r.randint(5, 30)]), text(5)])))
    docs += [(1, None), (2, ""), (3, "..."), (100, docs[30][1]), (None, docs[31][1]), (7, text(30000))]
    assert ran(spark, docs, items, shard_bytes=shard_bytes) == brute(docs, items)


def test_long_documents_and_shared_spans(spark):
    r = random.Random(5)
    voc = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(voc) for _ in range(r.choice([13, 20, 70])))) for i in range(40)]
    docs = []
    for i in range(60):
        w = r.choice(items)[1].split()
        n = r.randint(10, 20)
        a = r.randint(0, max(0, len(w) - n))
        docs.append((i, " ".join([*(r.choice(voc) for _ in range(r.randint(0, 300))), *w[a:a + n],
                                  *(r.choice(voc) for _ in range(r.randint(0, 300)))])))
    docs.append((99, " ".join(r.choice(voc) for _ in range(200_000)) + " " + items[0][1]))
    got = ran(spark, docs, items)
    assert got == brute(docs, items) and any(x[4] for x in got) and not all(x[2] for x in got)


def test_empty_tables(spark):
    assert ran(spark, [], [(1, "a b")]) == []
    assert ran(spark, [(1, "a b")], []) == [(1, 2, 0, [], False)]
    assert ran(spark, [(1, "a b")], [(1, None)]) == [(1, 2, 0, [], False)]


def test_spans_are_word_ranges(spark):
    d = spark.createDataFrame([(1, "x y a b c z a b c")], "doc_id bigint, text string")
    b = spark.createDataFrame([(5, "A b C")], "item_id bigint, text string")
    row = winnow.decontaminate(d, b).select(F.transform("spans", lambda s: F.concat_ws("-", s.a, s.b)).alias("s")).first()
    assert row.s == ["2-5", "6-9"]


def test_items_of_one_word_and_repeated_items(spark):
    r = random.Random(8)
    voc = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(voc) for _ in range(n))
    items = [(1, "v7"), (2, "V7."), (3, "v8 v9"), (4, text(13)), (None, "v11"), (5, "v8"), (6, "zz zz"), (7, "zz " * 20)]
    docs = [(i, text(r.randint(0, 80))) for i in range(40)] + [(50, "v8 v9 v7"), (51, "zz " * 30), (52, "zz"), (53, items[3][1] + " " + items[3][1])]
    for size in (1 << 20, 60):
        assert ran(spark, docs, items, shard_bytes=size) == brute(docs, items)


def test_texts_that_repeat_themselves_take_linear_time():
    import time

    import numpy as np
    import pyarrow as pa

    period = " ".join(f"p{i % 7}" for i in range(20_000))
    shard = winnow.Shard([1, 2], [period, "one two"], 13)
    row, words_, _, _, _ = winnow._words.split(pa.array([" ".join(f"p{i % 7}" for i in range(200_000)), "x one two", None]), winnow._words.ALNUM)
    t = time.time()
    (r, a, z), (rows, items) = shard.hits(words_, row)
    assert time.time() - t < 10
    assert list(zip(r.tolist(), a.tolist(), z.tolist())) == [(0, 0, 200_000), (1, 200_001, 200_003)]
    assert list(zip(rows.tolist(), items.tolist())) == [(0, 0), (1, 1)] and np.all(shard.ids == np.array(["1", "2"], dtype=object))
