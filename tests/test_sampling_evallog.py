import random

from pyspark.sql import functions as F

from pairforge.operators import evallog as EV
from pairforge.operators import sampling as S


def test_exact_split_sizes(spark):
    df = spark.range(1003).withColumnRenamed("id", "doc_id")
    out = S.exact_split(df, "doc_id", (0.7, 0.1), seed="1").groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in out}
    assert got == {"train": 702, "valid": 100, "test": 201}


def test_sample_n_and_frac(spark):
    df = spark.range(250).withColumnRenamed("id", "k")
    assert S.sample_n(df, "k", 40).count() == 40
    assert S.sample_n(df, "k", 5000).count() == 250
    assert S.sample_frac(df, "k", 0.1).count() == 25


def test_row_index_dense(spark):
    df = spark.range(500).select(F.col("id"), S.hash_key("s", "id").alias("k"))
    rows = S.with_row_index(df, ["k"]).orderBy("k").collect()
    assert [r.idx for r in rows] == list(range(500))


def _log(spark, n=300, runs=3, seed=1):
    rnd = random.Random(seed)
    data = [(r, s, float(rnd.randint(0, 20))) for r in range(runs) for s in range(n)]
    return spark.createDataFrame(data, "run int, step long, v double"), data


def test_sliced_running_sum_and_max(spark):
    df, data = _log(spark)
    out = EV.running(df, "run", "step", [EV.Scan("s", F.col("v")), EV.Scan("m", F.col("v"), "max", inclusive=False)],
                     EV.Slices((20, 21, 200), 0, 299)).collect()
    got = {(r.run, r.step): (r.s, r.m) for r in out}
    for run in range(3):
        acc, mx = 0.0, None
        for (r, s, v) in [d for d in data if d[0] == run]:
            acc += v
            assert got[(r, s)] == (acc, mx)
            mx = v if mx is None else max(mx, v)


def test_early_stop_matches_loop(spark):
    df, data = _log(spark, n=60)
    res = {r.run: r.stop_step for r in EV.early_stop(df, "run", "step", "v", patience=3).collect()}
    for run in range(3):
        best, counter, stop = -1.0, 0, None
        for (_, s, v) in [d for d in data if d[0] == run]:
            if v > best:
                best, counter = v, 0
            else:
                counter += 1
            if counter > 3:
                stop = s
                break
        assert res[run] == stop


def test_kl_coef_matches_loop(spark):
    df, data = _log(spark, n=40, runs=1)
    got = [r.kl_coef for r in EV.kl_coef_path(df, "run", "step", "v").orderBy("step").collect()]
    coef = 100.0
    for (_, _, v), g in zip(data, got):
        assert abs(g - coef) < 1e-9 * coef
        err = min(max(v / 6.0 - 1, -0.2), 0.2)
        coef *= 1 + err * 48 / 10000.0


def test_split_sizes_property(spark):
    import random
    rnd = random.Random(9)
    for n in [rnd.randint(1, 400) for _ in range(4)] + [1, 7]:
        df = spark.range(n).withColumnRenamed("id", "doc_id")
        got = {r["split"]: r["count"] for r in S.exact_split(df, "doc_id", (0.7, 0.1), seed="s").groupBy("split").count().collect()}
        exp = {"train": int(0.7 * n), "valid": int(0.1 * n), "test": n - int(0.7 * n) - int(0.1 * n)}
        assert {k: got.get(k, 0) for k in exp} == exp, n


def test_elapsed_text_boundaries(spark):
    from pairforge.functions.text import elapsed_text
    df = spark.createDataFrame([(59.0,), (3600.0,), (3661.0,), (7325.0,)], "s double")
    assert [r.t for r in df.select(elapsed_text("s").alias("t")).collect()] == ["0m", "0m", "1h1m", "2h2m"]


def test_head_by_threshold_equals_the_sorted_rows(spark):
    vals = [5, -3, None, 5, 0, 5, -(1 << 62), 1 << 62, None, 5, 7]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "k long, i int").repartition(3)
    ordered = sorted(vals, key=lambda v: (v is not None, v or 0))
    for n in (-1, 0, 1, 2, 3, 6, 8, 10, 11, 50):
        got = sorted([r.k for r in S.head(df, "k", n).collect()], key=lambda v: (v is not None, v or 0))
        assert got == (ordered if n < 0 else ordered[:n]), n
    assert S.head(df.limit(0), "k", 4).count() == 0
    assert [r.s for r in S.head(df.select(F.col("i").cast("string").alias("s")), "s", 3).orderBy("s").collect()] == ["0", "1", "10"]


def test_early_stops_of_random_runs_equal_a_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(f"r{rng.choice([0, 0, 0, 0, 1, 2, 3])}", i, float(rng.randint(0, 12 + i // 40)), float(rng.randint(1, 30))) for i in range(600)]
    rows += [("flat", i, 1.0, 2.0) for i in range(9)] + [("worse", i, -2.0, 2e6) for i in range(6)]
    log = spark.createDataFrame(rows, "run string, step long, score double, loss double").repartition(5)
    for patience in (2, 6, 11):
        want, joint = {}, {}
        for run in {r[0] for r in rows}:
            mine = sorted((r for r in rows if r[0] == run), key=lambda r: r[1])
            best, low, bad, bad_low, stop, both = -1.0, 1e6, 0, 0, None, None
            for _, step, score, loss in mine:
                best, bad = (score, 0) if score > best else (best, bad + 1)
                low, bad_low = (loss, 0) if loss < low else (low, bad_low + 1)
                stop = step if stop is None and bad > patience else stop
                both = step if both is None and bad > patience and bad_low > patience else both
            want[run], joint[run] = (len(mine), max(r[2] for r in mine), stop), (len(mine), min(r[3] for r in mine), max(r[2] for r in mine), both)
        assert {r.run: tuple(r)[1:] for r in EV.early_stop(log, "run", "step", "score", patience).collect()} == want
        assert {r.run: tuple(r)[1:] for r in EV.joint_early_stop(log, "run", "step", "loss", "score", patience).collect()} == joint
