"""Edge rows and orderings: part files, one-token texts, long sequences, repeated and negative ids, fractional steps."""
import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions import arrays as A
from pairforge.functions import text as T
from pairforge.operators import bleu as B
from pairforge.operators import classify as C
from pairforge.operators import codebleu as CB
from pairforge.operators import evallog as EV
from pairforge.operators import overlap as OV
from pairforge.operators import prepare as P
from pairforge.operators import rollout as RL
from pairforge.sources import readers as R
from pairforge.sources import sinks as W


def parts(folder, sizes, tag):
    os.makedirs(folder)
    n = 0
    for i, size in enumerate(sizes):
        with open(os.path.join(folder, f"part-{i:05d}.txt"), "w") as f:
            for _ in range(size):
                f.write(f"{tag}{n}" + "x" * (50 * ((i * 7) % 5)) + "\n")
                n += 1
    return n


def test_folders_of_unequal_part_files_pair_by_line(spark, tmp):
    a, b = os.path.join(tmp, "a"), os.path.join(tmp, "b")
    n = parts(a, [1, 40, 3, 200, 0, 17], "s")
    assert parts(b, [90, 5, 100, 66], "t") == n
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = R.read_parallel(spark, a, b).collect()
        few = R.read_parallel(spark, a, b, 7).count()
        m = R.merge(spark, a, b).orderBy("file_no", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n and few == 7
    for r in rows:
        assert r.source.rstrip("x") == f"s{r.idx}" and r.target.rstrip("x") == f"t{r.idx}"
    assert [x.line.rstrip("x") for x in m] == [f"s{i}" for i in range(n)] + [f"t{i}" for i in range(n)]


def test_predictions_round_trip_over_several_parts(spark, tmp):
    df = spark.range(300).select(F.col("id").alias("idx"), F.concat(F.lit("p"), "id").alias("pred"),
                                 F.concat(F.lit("g"), F.repeat(F.lit("y"), (F.col("id") % 50).cast("int")), "id").alias("gold"),
                                 F.lit("s").alias("source")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        W.write_predictions(df, os.path.join(tmp, "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(f.startswith("part-") for f in os.listdir(os.path.join(tmp, "out.gold"))) >= 3
    rows = R.read_parallel(spark, os.path.join(tmp, "out.output"), os.path.join(tmp, "out.gold")).collect()
    assert sorted((r.idx, r.source, r.target.lstrip("gy")) for r in rows) == [(i, f"p{i}", str(i)) for i in range(300)]


def test_clone_reader_collapses_last_wins_and_line_order(spark, tmp):
    with open(os.path.join(tmp, "train.txt"), "w") as f:
        f.write("9\t10\t1\n2\t9\t0\n10\t2\t1\n9\t77\t1\n")
    with open(os.path.join(tmp, "data.jsonl"), "w") as f:
        for i, t in (("9", "old"), ("10", 'a  "b"\n c'), ("2", "x"), ("9", " new  text ")):
            f.write(json.dumps({"idx": i, "func": t}) + "\n")
    rows = R.reader_for("clone")(spark, os.path.join(tmp, "train.txt"), 2).collect()
    assert sorted((r.url1, r.url2, r.source, r.target, r.label) for r in rows) == [
        ("2", "9", "x", "new text", 0), ("9", "10", "new text", 'a "b" c', 1)]


def test_task_files_are_the_fixed_names():
    assert R.task_files("d", "refactoring", split="dev") == "d/refactoring/context/val.jsonl"
    assert R.task_files("d", "translate", "java-cs", "train") == "d/translate/train.java-cs.txt.java,d/translate/train.java-cs.txt.cs"
    assert R.task_files("d", "translate", split="train") == "d/translate/train.java-cs.txt.java,d/translate/train.java-cs.txt.cs"
    assert R.task_files("d", "translate", "cs-java", "test") == "d/translate/test.java-cs.txt.cs,d/translate/test.java-cs.txt.java"
    assert R.task_files("d", "refine", "small", "dev") == "d/refine/small/valid.buggy-fixed.buggy,d/refine/small/valid.buggy-fixed.fixed"


def test_data_num_on_every_reader(spark, tmp):
    p = os.path.join(tmp, "x.jsonl")
    with open(p, "w") as f:
        for i in range(9):
            f.write(json.dumps({"nl": f"n{i}", "code": f"c{i}", "code_tokens": ["a", str(i)], "docstring_tokens": ["d"], "idx": 100 - i,
                                "func": f"f{i}", "target": i % 2, "Smelly Sample": "s", "Extracted Method": "e"}) + "\n")
    for task in ("concode", "summarize", "defect", "refactoring"):
        assert R.reader_for(task)(spark, p, 4).count() == 4 and R.reader_for(task)(spark, p).count() == 9
    assert sorted(r.idx for r in R.read_defect(spark, p, 2).collect()) == [99, 100]


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def test_array_helpers_match_numpy(spark):
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 300):
        x = r.normal(size=n)
        df = spark.createDataFrame([(x.tolist(),)], "a array<double>")
        got = df.select(A.logsumexp("a").alias("l"), A.softmax("a").alias("s"), A.entropy_from_logits("a").alias("h"),
                        A.whiten("a").alias("w"), A.whiten("a", False).alias("v")).first()
        p = softmax(x)
        var = x.var(ddof=1) if n > 1 else 1.0
        w = (x - x.mean()) / np.sqrt(var + 1e-8)
        assert np.allclose(got.l, np.log(np.exp(x).sum())) and np.allclose(got.s, p) and np.allclose(got.h, -(p * np.log(p)).sum())
        assert np.allclose(got.w, w) and np.allclose(got.v, w + x.mean())


def test_array_helpers_are_linear(spark):
    def seconds(n):
        df = spark.range(0, 40, 1, 2).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i.cast("double"))).alias("a"))
        t = time.perf_counter()
        df.select(A.whiten(A.softmax("a")).alias("w"), A.entropy_from_logits("a").alias("h")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t
    seconds(256)
    assert seconds(4096) < 8 * max(seconds(1024), 0.5)


def gae(r, v, gamma, lam):
    adv, last = [], 0.0
    for t in reversed(range(len(r))):
        nxt = v[t + 1] if t + 1 < len(r) else 0.0
        last = r[t] + gamma * nxt - v[t] + gamma * lam * last
        adv.append(last)
    return adv[::-1]


def test_gae_matches_reverse_loop(spark):
    rnd = random.Random(1)
    rows = [([rnd.gauss(0, 1) for _ in range(n)], [rnd.gauss(0, 1) for _ in range(n)]) for n in (1, 3, 512, 0, 20)] + [(None, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, r array<double>, v array<double>")
    for x in df.select("i", "r", "v", RL.gae("r", "v", 0.99, 0.9).alias("g")).collect():
        if x.r is None:
            assert x.g.advantages is None
            continue
        want = gae(x.r, x.v, 0.99, 0.9)
        assert np.allclose(x.g.advantages, want) and np.allclose(x.g.returns, np.array(want) + np.array(x.v))


def test_one_token_and_empty_rollouts_do_not_abort(spark):
    df = spark.createDataFrame([([0.1], [0.5]), ([], [])], "a array<double>, v array<double>")
    rows = df.select(RL.ppo_losses("a", "a", "v", "v", "a", "v", logits=F.array(F.array(F.lit(0.0), F.lit(0.0)))).alias("s")).collect()
    assert rows[0].s.return_var == 1.0 and abs(rows[0].s.entropy - np.log(2)) < 1e-9 and rows[1].s.pg_loss is None
    assert spark.range(1).select(RL.var_explained(F.lit(1.0), F.lit(0.0)).alias("x")).first().x is None
    none = C.masked_token_loss(spark.createDataFrame([([0.1, 0.2], 1)], "l array<double>, y int"), "l", "y", F.lit(0)).first()
    assert none.loss is None
    log = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 1, 4)], "run int, step int, e int, n int")
    got = {x.step: x.error_rate for x in EV.running_error_rate(log, "run", "step", F.col("e"), F.col("n")).collect()}
    assert got == {1: None, 2: 0.25}


def test_one_token_hypothesis_in_every_smoothing(spark):
    df = spark.createDataFrame([(1, ["a"], [["a"]]), (2, ["a"], [["b", "c"]]), (3, [], [["x"]]), (4, ["a"], [[]])],
                               "pair_id int, hyp array<string>, refs array<array<string>>")
    st = OV.ngram_stats(df, max_n=5)
    for m in range(8):
        rows = B.sentence_bleu(st, smoothing=m).collect()
        assert len(rows) == 4 and all(x.score is not None for x in rows), m


def test_single_reference_counts_equal_the_general_form(spark):
    r = random.Random(4)
    text = lambda: [r.choice("abcde") for _ in range(r.randint(0, 12))]
    rows = [(i, text(), [text()]) for i in range(60)] + [(99, ["a b", "c"], [["a", "b c"]])]
    df = spark.createDataFrame(rows, "pair_id int, hyp array<string>, refs array<array<string>>")
    one = {x.pair_id: x for x in OV.ngram_stats(df, keywords=["a"], single_ref=True).collect()}
    many = {x.pair_id: x for x in OV.ngram_stats(df, keywords=["a"]).collect()}
    assert one.keys() == many.keys()
    for i, x in one.items():
        a, b = x.asDict(), many[i].asDict()
        assert all(a[c] == pytest.approx(b[c]) for c in b), (a, b)
    assert one[99].m2 == 0 and many[99].m2 == 0
    plain = [(i, None if i == 7 else " ".join(h), [" ".join(x) for x in r] + ["\u2003a\x1fb a", None]) for i, h, r in rows[:-1]]
    t = spark.createDataFrame(plain, "pair_id int, hyp string, refs array<string>")
    split = t.select("pair_id", T.py_split("hyp").alias("hyp"), F.transform("refs", T.py_split).alias("refs"))
    a = sorted(map(tuple, OV.ngram_stats(t, texts=True).collect()))
    assert a == sorted(map(tuple, OV.ngram_stats(split).collect())) and a[0][-1] >= 0
    with pytest.raises(Exception, match="one reference"):
        OV.ngram_stats(spark.createDataFrame([(1, ["a"], [["b"], ["a"]])], df.schema), single_ref=True).collect()


def test_reference_ids_of_any_value(spark):
    h = spark.createDataFrame([("k", ["a", "b"])], "pair_id string, hyp array<string>")
    for ids, kind in (([-5, 1 << 40], "bigint"), (["x", "y"], "string")):
        refs = spark.createDataFrame([("k", ids[0], ["a", "b"]), ("k", ids[1], ["b"])], f"pair_id string, ref_id {kind}, ref array<string>")
        x = OV.ngram_stats_long(h, refs).first()
        assert (x.m1, x.m2, x.n_refs, x.rm1) == (2, 1, 2, 3)


def test_fractional_steps_and_bursts(spark):
    log = spark.createDataFrame([(1, i / 10, float(v)) for i, v in enumerate([3, 9, 9, 1, 0, 0, 0, 0, 0])], "run int, step double, v double")
    assert EV.best_checkpoint(log, "run", "step", "v").first()["_bs"] == pytest.approx(0.1)
    assert EV.early_stop(log, "run", "step", "v", 3).first().stop_step == pytest.approx(0.5)
    burst = spark.range(20000).select(F.lit(7).alias("run"), F.when(F.col("id") < 19990, F.col("id")).otherwise(F.col("id") * 10 ** 9).alias("step"),
                                      F.lit(1.0).alias("v"))
    s = EV.Slices.of(burst, "step")
    counts = burst.groupBy(s.id(F.col("step")).alias("s")).count().agg(F.max("count")).first()[0]
    assert counts < 2000  # one run's burst is cut into many slices
    out = EV.running(burst, "run", "step", [EV.Scan("c", F.col("v"))]).agg(F.max("c"), F.sum("c")).first()
    assert out[0] == 20000 and out[1] == 20000 * 20001 / 2


def test_joint_early_stop_needs_both_counters(spark):
    loss = [5, 4, 3, 2, 1, 1, 1, 1, 1, 1, 1]
    score = [1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2]
    log = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(loss, score))], "run int, step int, l double, s double")
    out = EV.joint_early_stop(log, "run", "step", "l", "s", patience=1).first()
    best_l, best_s, cl, cs, want = 1e6, -1.0, 0, 0, None
    for i, (a, b) in enumerate(zip(loss, score)):
        best_l, cl = (a, 0) if a < best_l else (best_l, cl + 1)
        best_s, cs = (b, 0) if b > best_s else (best_s, cs + 1)
        if cl > 1 and cs > 1 and want is None:
            want = i
    assert out.stop_step == want and out.best_loss == 1 and out.best_score == 2


def test_structure_of_code_with_comments_and_literals(spark):
    cases = [('x = "(\\" ";', True), ("// it's\nf(x // that's\n", False), ("// it's\nf(x) // that's\n", True), ("c = '('; g[0]", True),
             ("a(b[c)d]", False), ("/* ( don't */ {}", True), ("", True), ("'\\''( )", True)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {x.i: x.ok for x in df.select("i", CB.structure_check(P.replace_literals(T.strip_comments(F.col("c")))).alias("ok")).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(cases)}


def test_comments_by_language(spark):
    py = '"""doc"""\nimport os  # c\n\ndef f(a):\n    """d\n    e"""\n    x = "# no"  # yes\n    return x\n'
    want = 'import os  \ndef f(a):\n    x = "# no"  \n    return x'
    df = spark.createDataFrame([(py,), (None,), ("def (:\n  '",)], "c string")
    got = [x.c for x in df.select(T.strip_comments("c", "python").alias("c")).collect()]
    assert got == [want, None, "def (:\n  '"]
    assert df.select(T.strip_comments("c", "ruby").alias("c")).first().c == py


def test_metric_names_may_not_repeat(spark):
    one = spark.range(1).select(F.lit(1).alias("n"))
    with pytest.raises(ValueError, match="twice"):
        C.metric_row(one, one)


def test_feature_cache_lets_errors_out(spark, tmp):
    df = spark.range(3).select(F.col("id").alias("x"))
    path = os.path.join(tmp, "cache")
    assert W.materialize_features(df, path).count() == 3
    assert W.materialize_features(df.limit(0), path).count() == 3
    os.makedirs(os.path.join(tmp, "broken"))
    with pytest.raises(Exception):
        W.materialize_features(df, os.path.join(tmp, "broken")).count()
    assert os.listdir(os.path.join(tmp, "broken")) == []
