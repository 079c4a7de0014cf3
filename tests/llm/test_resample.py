import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairforge.llm import resample


def words(t):
    return re.findall(r"[a-z0-9_\x80-\U0010ffff]+|[^a-z0-9_\x80-\U0010ffff\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def grams(t):
    w = words(t)
    return [*w, *zip(w, w[1:])]


def frames(spark, docs, good):
    return (spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id bigint, text string, log_weight double"),
            spark.createDataFrame([(i,) for i in good], "doc_id bigint"))


def test_weights_match_brute_force(spark):
    """With many buckets the models are those of the n-grams themselves."""
    r = random.Random(2)
    voc = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(r.choice(voc[:20] if i % 2 else voc) for _ in range(r.randint(0, 30)))) for i in range(80)]
    docs += [(500, None), (501, ""), (502, "?!"), (7, docs[7][1]), (None, "w1 w2"), (600, "W1, w2 " * 20000)]
    good = [i for i in range(1, 60, 2)] + [500, None, 9999]
    b = 1 << 20
    raw = collections.Counter(g for _, t in docs for g in grams(t))
    target = collections.Counter(g for i, t in docs if i in good and i is not None for g in grams(t))
    nr, nt = sum(raw.values()) + b, sum(target.values()) + b
    d, g = frames(spark, docs, good)
    out = resample.resample(d, g, buckets=b).collect()
    assert len(out) == len(docs)
    want = sorted(sum(math.log((target[x] + 1) / nt / ((raw[x] + 1) / nr)) for x in grams(t)) for _, t in docs)
    assert np.allclose(sorted(x.log_weight for x in out), want, atol=1e-6)
    assert sorted(x.n_grams for x in out) == sorted(len(grams(t)) for _, t in docs)


def test_selects_exactly_the_largest_keys(spark):
    docs = [(i, f"a{i % 5} b{i % 3}") for i in range(400)]
    d, g = frames(spark, docs, range(0, 400, 5))
    out = resample.resample(d, g, k=37).collect()
    cut = sorted((x.gumbel_key for x in out), reverse=True)[36]
    assert sum(x.selected for x in out) == 37 and all(x.selected == (x.gumbel_key >= cut) for x in out)
    again = resample.resample(d, g, k=37).filter("selected").select("id").collect()
    assert {x.id for x in again} == {x.id for x in out if x.selected}
    share = np.mean([x.id % 5 == 0 for x in out if x.selected])
    assert share > 0.2  # rows like the target are drawn more often


def test_gumbel_draw_is_in_proportion_to_the_weights():
    keys = resample._descending(np.array([3.5, -1.0, 0.0, 1e300, -np.inf, np.inf, -0.0]))
    order = sorted(range(7), key=lambda i: keys[i])
    assert order[:3] == [5, 3, 0] and order[-1] == 4 and keys[2] == keys[6]


def test_no_targets_and_empty_tables(spark):
    d, g = frames(spark, [(1, "a b"), (2, None)], [])
    assert {x.log_weight for x in resample.resample(d, g).collect()} == {0.0}
    assert resample.resample(d.limit(0), g).count() == 0


def test_bag_of_words_and_pairs():
    row, bucket, n = resample.bag(pa.array(["a b", None, "A b c", ""]), 1 << 40)
    assert n == 4 and list(np.bincount(row, minlength=4)) == [3, 0, 5, 0] and len(set(bucket.tolist())) == 5


def test_query_covers_every_document(spark):
    from pairforge.llm.queries import op2_resample
    sf = "/root/testdata/sf0.001"
    out = op2_resample(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.filter("selected").count() == out.count() // 2
    assert out.filter(F.isnan("log_weight")).count() == 0


def test_exactly_k_where_repeated_rows_share_the_last_key(spark):
    docs = [(i, f"a{i % 5} b{i % 3}") for i in range(60)] + [(77, "a1 b1")] * 40 + [(None, "a2 b2")] * 20
    d, g = frames(spark, docs, range(0, 60, 5))
    d = d.repartition(5)
    rows = resample.resample(d, g, k=1).collect()
    above = sum(x.gumbel_key > next(y.gumbel_key for y in rows if y.id == 77) for x in rows)
    for k in (0, above, above + 1, above + 17, above + 40, above + 41, len(docs), 1000):
        got = resample.resample(d, g, k=k).collect()
        chosen = [x for x in got if x.selected]
        assert len(got) == len(docs) and len(chosen) == min(k, len(docs)), k
        if chosen and len(chosen) < len(got):
            assert min(x.gumbel_key for x in chosen) >= max(x.gumbel_key for x in got if not x.selected)
