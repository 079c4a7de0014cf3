import math
import random

import numpy as np

from pairforge.llm import vectors


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        held = lambda x: max(-2 ** 63, min(2 ** 63 - 1, x))
        s = sorted((-held(sum(a * b for a, b in zip(v, w))), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


def ran(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id bigint, embedding array<double>, score int").repartition(3)
    got = vectors.top_k(df, df.filter("vec_id % 50 = 0"), **kw).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.1) for _ in range(8)]) for i in range(600)]
    rows += [(600 + i, rows[i % 7][1]) for i in range(80)]  # copies: ties
    rows += [(1000, None), (1050, [1.0, None] * 4), (1100, [float("nan")] * 8), (1101, [float("inf")] * 8), (1150, []), (1151, []),
             (1200, [0.5, 0.25]), (1201, [0.1, 0.1]), (None, rows[0][1]), (50, rows[50][1]), (50, [0.0] * 8), (3, rows[3][1])]
    want = brute(rows)
    assert ran(spark, rows) == want and len(want) > 70
    assert ran(spark, rows, shard_bytes=500) == want


def test_large_numbers_and_few_rows(spark):
    rows = [(0, [1e30, -1e30]), (1, [1e30, 1.0]), (2, [3e37, -1e36]), (50, [1.0, 1.0]), (51, [-1e300, 0.5])]
    assert ran(spark, rows) == brute(rows)
    assert ran(spark, [(0, [1.0])]) == []
    assert ran(spark, []) == []


def test_bounds_spare_most_exact_reads():
    r = np.random.default_rng(3)
    m = np.floor(256 * r.normal(0, 0.12, (4000, 64)))
    s = vectors.Search(np.arange(20), m[:20], 5)
    s.block(np.arange(4000), m)
    assert s.read < 20 * 4000 * 0.2
    for i in range(20):
        x = (m @ m[i]).astype(np.int64)
        x[i] = -(1 << 60)
        o = np.lexsort((np.arange(4000), -x))[:5]
        assert list(s.found[i]) == list(o) and list(s.scores[i]) == list(x[o])
