import math
import random

from pyspark.sql import functions as F

from pairforge.functions.arrays import whiten
from pairforge.operators import rollout as RL


def test_gae_matches_reverse_loop(spark):
    rnd = random.Random(3)
    r = [rnd.uniform(-1, 1) for _ in range(12)]
    v = [rnd.uniform(-1, 1) for _ in range(12)]
    df = spark.createDataFrame([(r, v)], "r array<double>, v array<double>")
    out = df.select(RL.gae("r", "v", 1.0, 0.95).alias("g")).first().g
    last, adv = 0.0, []
    for t in reversed(range(12)):
        nv = v[t + 1] if t < 11 else 0.0
        delta = r[t] + nv - v[t]
        last = delta + 0.95 * last
        adv.append(last)
    adv = adv[::-1]
    assert all(abs(a - b) < 1e-12 for a, b in zip(out.advantages, adv))
    assert all(abs(a - (b + c)) < 1e-12 for a, b, c in zip(out.returns, adv, v))


def test_whiten_sample_variance(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([3.0],)], "a array<double>")
    rows = df.select(whiten("a").alias("w")).collect()
    m, var = 7 / 3, ((1 - 7 / 3) ** 2 + (2 - 7 / 3) ** 2 + (4 - 7 / 3) ** 2) / 2
    assert abs(rows[0].w[0] - (1 - m) / math.sqrt(var + 1e-8)) < 1e-12
    assert rows[1].w == [0.0]
