from pyspark.sql import functions as F

from pairforge.functions import arrays as A
from pairforge.functions import text as T
from pairforge.functions.keywords import JAVA
from pairforge.operators import codebleu as CB
from pairforge.operators import mining as M
from pairforge.operators import rollout as RL
from pairforge import registry as K


def test_token_at(spark):
    df = spark.createDataFrame([("abcd\nefgh\nijkl",)], "c string")
    r = df.select(T.token_at("c", F.lit(0), F.lit(1), F.lit(0), F.lit(3)).alias("a"),
                  T.token_at("c", F.lit(0), F.lit(2), F.lit(2), F.lit(1)).alias("b")).first()
    assert (r.a, r.b) == ("bc", "cdefghi")


def test_abstract_identifiers_column_and_window_forms(spark):
    code = "int x = 10 ; if ( x > y ) return foo ( x , 0 ) ;"
    df = spark.createDataFrame([(1, code)], "k int, c string")
    col = df.select(T.abstract_identifiers(F.col("c"), JAVA).alias("s")).first().s
    win = M.abstract_identifiers_df(df, "k", "c", JAVA).first()
    assert col.tokens == win.tokens
    assert col.tokens[:4] == ["int", "IDENTIFIER_1", "=", "DECIMALINTEGER_2"]
    assert dict(col.token_map)["IDENTIFIER_1"] == "x"
    back = df.select(T.decode_tokens(F.lit(col.tokens), F.create_map(*[F.lit(x) for kv in col.token_map.items() for x in kv])).alias("d")).first().d
    assert back == code


def test_pick_roles_and_ranges(spark):
    r = "struct<filePath:string,startLine:int,endLine:int,description:string,codeElementType:string>"
    left = [("A.java", 1, 9, "original", "METHOD_DECLARATION"), ("A.java", 2, 3, "x", "BLOCK")]
    right = [("A.java", 1, 5, "source method declaration before extraction", "METHOD_DECLARATION"),
             ("A.java", 7, 9, "extracted", "METHOD_DECLARATION")]
    df = spark.createDataFrame([(left, right)], f"l array<{r}>, r array<{r}>")
    out = df.select(M.pick_roles(M.filter_ranges("l"), M.filter_ranges("r")).alias("p")).first().p
    assert (out.before.startLine, out.extracted.startLine, out.after.startLine) == (1, 7, 1)


def test_first_parent_and_slice_lines(spark):
    commits = spark.createDataFrame([("r", "c1", [], "a"), ("r", "c2", ["c1"], "b")], "repo string, sha string, parents array<string>, kind string")
    rows = {r.sha: (r.parent_sha, r.parent_kind) for r in M.first_parent(commits).collect()}
    assert rows == {"c1": (None, None), "c2": ("c1", "a")}
    df = spark.createDataFrame([("l1\r\nl2\rl3\nl4\n",)], "c string")
    s = df.select(M.slice_lines("c", F.lit(2), F.lit(3)).alias("s")).first().s
    assert (s.method, s.class_text) == ("l2\nl3\n", "l1\nl4\n")


def test_dataflow_normalize_and_match(spark):
    items = [(1, "ref", 0, "x", 0, "comesFrom", [], []), (1, "ref", 1, "y", 1, "comesFrom", ["x"], [0]),
             (1, "cand", 0, "a", 0, "comesFrom", [], []), (1, "cand", 1, "b", 1, "comesFrom", ["a"], [0]),
             (1, "cand", 2, "c", 5, "comesFrom", [], [])]
    df = spark.createDataFrame(items, "pair_id int, side string, item_no int, var string, pos int, rel string, par_vars array<string>, par_pos array<int>")
    pruned = CB.prune_merge_dataflow(df)
    assert pruned.filter("side = 'cand'").count() == 2  # item at pos 5: no parents, never a parent
    r = CB.dataflow_match(CB.normalize_dataflow(pruned)).first()
    assert (r.matched, r.total) == (2, 2)


def test_structure_check(spark):
    df = spark.createDataFrame([("f(a[1]){}",), ("f(a[1)]",), ("((",), ("x",)], "c string")
    assert [r.v for r in df.select(CB.structure_check("c").alias("v")).collect()] == [True, False, False, True]


def test_dense_reward_and_ids(spark):
    df = spark.createDataFrame([([5, 7, 2, 0], True, 0.5, 0.25)], "ids array<int>, ok boolean, ast double, dfg double")
    r = df.select(RL.dense_reward(F.size("ids"), A.reward_len("ids", 2), F.col("ok"), F.col("ast"), F.col("dfg")).alias("r"),
                  A.ppo_curr_len("ids", 2).alias("n"), A.attention_mask("ids").alias("m"), A.mask_labels("ids").alias("l"),
                  A.decode_ids("ids", F.create_map(F.lit(5), F.lit("a"), F.lit(7), F.lit("b")), [0, 2]).alias("d")).first()
    assert r.r == [0.0, 0.0, 1.75, 0.0] and r.n == 3 and r.m == [1, 1, 1, 0] and r.l == [5, 7, 2, -100] and r.d == "a b"


def test_registry_callbacks(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 1)], "label int, pred int")
    from pairforge.operators.classify import accuracy, binary_prf
    K.register_metric("acc", lambda d: accuracy(d).select("acc"))
    K.register_metric("prf", lambda d: binary_prf(d).select("f1"))
    row = K.compute_metrics(df, ["acc", "prf"]).first()
    assert (row.acc, row.f1) == (0.6667, 0.6667)
    out = K.batched_map(df, lambda b: b.assign(s=b.label + b.pred), "label int, pred int, s long").agg(F.sum("s")).first()[0]
    assert out == 3


def test_task_helpers(spark):
    from pairforge.operators import prepare as P
    df = spark.createDataFrame([("refine_small",), ("translate_java-cs",), ("defect_none",)], "t string")
    s = P.split_task("t")
    rows = df.select(s["task"].alias("task"), s["sub_task"].alias("sub"),
                     P.max_target_length(s["task"], s["sub_task"]).alias("mx"),
                     P.batch_size_for(s["task"], s["sub_task"], small_model=True).alias("bs")).collect()
    assert [(r.task, r.sub, r.mx, r.bs) for r in rows] == [("refine", "small", 120, 64), ("translate", "java-cs", 256, 64),
                                                           ("defect", "none", 3, 32)]


def test_small_joins_and_lookups(spark, tmp_path):
    from pairforge.functions.arrays import concat_codes
    from pairforge.operators.textmetrics import post_process
    from pairforge.sources.readers import task_files
    ranges = spark.createDataFrame([("r", "s1", "A.java", 3)], "repo string, sha string, path string, line int")
    versions = spark.createDataFrame([("r", "s1", "A.java", "class A {}")], "repo string, sha string, path string, content string")
    assert M.file_versions_for(ranges, versions).first().content == "class A {}"
    df = spark.createDataFrame([([1, 2], [3], " p ", " g ")], "a array<int>, b array<int>, p string, g string")
    r = df.select(concat_codes("a", "b").alias("c"), post_process(F.col("p"), F.col("g")).alias("pp")).first()
    assert r.c == [1, 2, 3] and (r.pp.pred, r.pp.refs) == ("p", ["g"])
    files = task_files("/data", "translate", "java-cs")
    assert files["train"] == "/data/translate/train.java-cs.txt.java,/data/translate/train.java-cs.txt.cs"


def test_a_hot_commit_is_handled_in_parts(spark):
    import pandas as pd

    rows = [(None if i % 10 == 9 else "hot" if i % 2 else f"c{i % 7}", f"k{i % 4}", i) for i in range(1000)]
    events = spark.createDataFrame(rows, "sha string, kind string, n long").repartition(8)
    handler = M.Handler(init=lambda: {}, update=lambda s, part: {**s, **{k: s.get(k, 0) + int(v) for k, v in part.groupby("kind")["n"].sum().items()}},
                        merge=lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()},
                        finish=lambda s: (sum(s.values()), sorted(s)))
    want = {k: (int(g["n"].sum()), sorted(set(g["kind"]))) for k, g in pd.DataFrame(rows, columns=["sha", "kind", "n"]).fillna({"sha": ""}).groupby("sha")}
    for salts in (1, 3, 64):
        got = M.handle_commits(events, "sha", handler, "total long, kinds array<string>", salts)
        assert got.columns == ["sha", "total", "kinds"]
        assert {r.sha or "": (r.total, r.kinds) for r in got.collect()} == want
    assert M.handle_commits(events.limit(0), "sha", handler, "total long, kinds array<string>").count() == 0
    old, M.STATES_HELD = M.STATES_HELD, 1
    try:
        assert M.handle_commits(events, "sha", handler, "total long, kinds array<string>").count() == len(want)
    finally:
        M.STATES_HELD = old
