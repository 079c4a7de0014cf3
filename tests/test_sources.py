import json
import os
import time

from pyspark.sql import functions as F

from pairforge.sources import readers as R
from pairforge.sources import sinks as W
from pairforge.streaming import streams as ST


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_jsonl_triples_and_corrupt(spark, tmp):
    p = os.path.join(tmp, "t.jsonl")
    _write(p, [json.dumps({"Smelly Sample": "a  b\n c", "Method after Refactoring": "x", "Extracted Method": " e  f "}),
               "[not json"])
    tr = R.read_triples(spark, p).collect()
    assert len(tr) == 2 and tr[1]["_corrupt_record"] == "[not json"
    ref = R.read_refactoring(spark, p).filter(F.col("source").isNotNull()).first()
    assert (ref.source, ref.target) == ("a b c", "e f")


def test_catalog(spark, tmp):
    p = os.path.join(tmp, "c.json")
    with open(p, "w") as f:
        json.dump({"items": [{"name": "o/a", "defaultBranch": "main"}, {"name": "o/b", "defaultBranch": "dev"}]}, f, indent=2)
    assert sorted(r.name for r in R.read_catalog(spark, p).collect()) == ["o/a", "o/b"]


def _catalog_rows(spark, path, size="64"):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        return R.read_catalog(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_large_catalog_is_read_by_many_tasks(spark, tmp):
    p = os.path.join(tmp, "large.json")
    hard = ['plain', 'a,b', '{"x": [1, 2]}', '\\\\', '"', '\\\\"],{', ']}', '', 'é ü,', '\\n\\t,\\u2028', ',,,', '[[[[{{{{']
    items = [{"name": f"o/{i},{hard[i % len(hard)]}", "labels": [{"k": hard[i % 5], "v": [i, [i]]}], "defaultBranch": hard[i % len(hard)] * (i % 7)}
             for i in range(300)]
    doc = {"total": 300, "before": [{"items": [{"name": "no"}]}, [1, 2]], "it}ems": "\"items\": [", "items": items, "after": [{"name": "no"}, "x,y"]}
    with open(p, "w") as f:
        json.dump(doc, f)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert spark.read.option("lineSep", ",").text(p).rdd.getNumPartitions() > 20
        got = [(r.name, r.defaultBranch, r._corrupt_record) for r in R.read_catalog(spark, p).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted((x["name"], x["defaultBranch"], None) for x in items)


def test_catalog_edges(spark, tmp):
    cases = {
        '{"items": []}': [], '{"count": 0}': [], '{"items": null, "x": [{"name": "n"}]}': [], "{}": [], "": [],
        '{"items": [{"name": "a"}], "n": 1}\n': [("a", False)], ' {\n "n" : {"items": [{"name": "n"}]},\n "items" : [ {"name" : "a"} ,\n {"name": "b"} ]\n}\n': [("a", False), ("b", False)],
        '{"items": [{"name": "a"}, {"name": oops}, null, {"name": "c"}]}': [("a", False), (None, True), (None, True), ("c", False)],
    }
    for i, (text, want) in enumerate(cases.items()):
        p = os.path.join(tmp, f"c{i}.json")
        with open(p, "w") as f:
            f.write(text)
        for size in ("16", "1m") if want else ("16",):
            got = [(r.name, r._corrupt_record is not None) for r in _catalog_rows(spark, p, size)]
            assert sorted(got, key=str) == sorted(want, key=str), (text, size)


def test_parallel_and_merge(spark, tmp):
    a, b = os.path.join(tmp, "a.txt"), os.path.join(tmp, "b.txt")
    _write(a, [f" src {i} " for i in range(10)])
    _write(b, [f"trg {i}" for i in range(8)])
    rows = R.read_parallel(spark, a, b, limit=5).orderBy("idx").collect()
    assert [(r.idx, r.source, r.target) for r in rows] == [(i, f"src {i}", f"trg {i}") for i in range(5)]
    m = R.merge(spark, a, b).orderBy("file_no", "line_no").collect()
    assert len(m) == 18 and m[10].line == "trg 0"


def test_pred_gold_maps(spark, tmp):
    p, g = os.path.join(tmp, "p.txt"), os.path.join(tmp, "g.txt")
    _write(p, ["1\tfirst", "2", "1\tsecond"])
    _write(g, ["1\tgold a", "1\tgold b", "3\tgold c"])
    preds, golds = R.read_pred_gold(spark, p, g)
    assert {r.id: r.pred for r in preds.collect()} == {"1": "second", "2": ""}
    assert sorted(r.gold for r in golds.collect()) == ["gold a", "gold b"]


def test_clone_pairs(spark, tmp):
    idx, data = os.path.join(tmp, "i.txt"), os.path.join(tmp, "d.jsonl")
    _write(idx, ["1\t2\t0", "1\t9\t1", "2\t1\t1"])
    _write(data, [json.dumps({"idx": "1", "func": "f1"}), json.dumps({"idx": "2", "func": "f2"})])
    rows = R.read_clone_pairs(spark, idx, data).orderBy("url1").collect()
    assert [(r.url1, r.url2, r.label) for r in rows] == [("1", "2", 0), ("2", "1", 1)]


def test_sinks_roundtrip(spark, tmp):
    df = spark.createDataFrame([(1, " p1 ", "g1", "s1"), (2, "p2", "g2", "s2")], "idx int, pred string, gold string, source string")
    W.write_predictions(df, os.path.join(tmp, "out"), with_id=True)
    lines = sorted(r.value for r in spark.read.text(os.path.join(tmp, "out.output")).collect())
    assert lines == ["1\tp1", "2\tp2"]
    W.write_jsonl(df, os.path.join(tmp, "j"), partition_by="idx")
    assert spark.read.json(os.path.join(tmp, "j")).count() == 2
    first = W.materialize_features(df, os.path.join(tmp, "feat"))
    assert first.count() == 2 and W.materialize_features(df.limit(0), os.path.join(tmp, "feat")).count() == 2


def test_stream_collate_exactly_once(spark, tmp):
    src, out, ck = (os.path.join(tmp, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    _write(os.path.join(src, "r1.jsonl"), [json.dumps({"Smelly Sample": "a", "Method after Refactoring": "b", "Extracted Method": "c"})])
    ST.stream_collate(spark, src, out, ck).awaitTermination(120)
    _write(os.path.join(src, "r2.jsonl"), [json.dumps({"Smelly Sample": "d", "Method after Refactoring": "e", "Extracted Method": "f"})])
    ST.stream_collate(spark, src, out, ck).awaitTermination(120)
    ST.stream_collate(spark, src, out, ck).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2


def test_running_error_stream(spark, tmp):
    src, ck = os.path.join(tmp, "logs"), os.path.join(tmp, "ck2")
    spark.createDataFrame([("r1", 2, 10), ("r2", 0, 5)], "run string, errors long, seen long").write.parquet(os.path.join(src, "b1"))
    out = os.path.join(tmp, "rates")
    q = ST.start_running_error(spark, os.path.join(src, "*"), "run string, errors long, seen long", out, ck)
    q.awaitTermination(120)
    got = {r.run: r.error_rate for r in ST.latest_error_rates(spark, out).collect()}
    assert got == {"r1": 0.2, "r2": 0.0}


def test_running_errors_read_one_snapshot_after_a_restart(spark, tmp):
    src, ck, out = (os.path.join(tmp, x) for x in ("logs", "ck", "rates"))
    schema, want = "run string, errors long, seen long", {}

    def feed(first, last):
        for i in range(first, last):
            spark.createDataFrame([(f"r{i % 3}", i, 10)], schema).coalesce(1).write.parquet(os.path.join(src, f"b{i:02d}"))
            e, n = want.get(f"r{i % 3}", (0, 0))
            want[f"r{i % 3}"] = (e + i, n + 10)
        q = ST.start_running_error(spark, os.path.join(src, "*"), schema, out, ck, snapshot_every=3, max_files_per_trigger=1)
        assert q.awaitTermination(300)

    for first, last in ((0, 4), (4, 11)):
        feed(first, last)
        got = {r.run: (r.total_errors, r.total_seen) for r in ST.latest_error_rates(spark, out).collect()}
        assert got == want
    names = sorted(x for x in os.listdir(out) if "=" in x)
    assert len([x for x in names if x.startswith("snapshot")]) <= 2 and len([x for x in names if x.startswith("batch_id")]) <= 6
    snapshots, batches = ST._written(spark, out)
    # a batch that was being written when the stream stopped is passed over, a repeated one changes nothing
    os.makedirs(os.path.join(out, "batch_id=999"))
    assert {r.run: (r.total_errors, r.total_seen) for r in ST.latest_error_rates(spark, out).collect()} == want
    assert len([n for n in batches if n > max(snapshots)]) < 3


def test_other_sinks(spark, tmp):
    df = spark.createDataFrame([("a\tb", "g", "f"), ("x", "y", "z")], "ss string, gt string, ft string")
    W.write_comparison_csv(df, os.path.join(tmp, "cmp"))
    back = spark.read.option("header", True).csv(os.path.join(tmp, "cmp")).orderBy("gt").collect()
    assert back[0].ss == "a b"
    log = spark.createDataFrame([(1, 0.5)], "step long, reward double")
    W.append_table(log, os.path.join(tmp, "log"))
    W.append_table(log, os.path.join(tmp, "log"))
    assert spark.read.parquet(os.path.join(tmp, "log")).count() == 2
    res = spark.createDataFrame([(0, "o/a"), (1, "o/b"), (0, "o/c")], "result int, name string")
    summary = {r.result: r.n for r in W.write_job_results(res, os.path.join(tmp, "jobs")).collect()}
    assert summary == {0: 2, 1: 1}
    assert W.feature_cache_key("train", only_src=True, all_data=False, n=100) == "train_src_100"


def test_row_function_udf(spark):
    from pairforge.registry import row_function
    f = row_function(lambda a, b: f"{a}-{b}", "string")
    df = spark.createDataFrame([("x", 1), ("y", 2)], "a string, b int")
    assert sorted(r.o for r in df.select(f("a", "b").alias("o")).collect()) == ["x-1", "y-2"]


def test_line_numbers_across_file_splits(spark, tmp):
    p = os.path.join(tmp, "big.txt")
    _write(p, [f"line {i:05d}" for i in range(5000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = R.read_lines(spark, p)
        assert df.rdd.getNumPartitions() > 1
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r.line == f"line {r.line_no:05d}" for r in rows) and len(rows) == 5000


def test_a_repeated_batch_is_appended_once(spark, tmp):
    from pairforge.sources import sinks as W
    path = f"{tmp}/log"
    first, second = spark.range(5).withColumnRenamed("id", "step"), spark.range(5, 7).withColumnRenamed("id", "step")
    W.append_table(first, path, batch="run 1/0")
    W.append_table(second, path, batch="run 1/1")
    W.append_table(first, path, batch="run 1/0")  # a retried batch
    got = sorted((r.step, r.batch) for r in spark.read.parquet(path).collect())
    assert [x[0] for x in got] == list(range(7)) and {x[1] for x in got} == {"run 1/0", "run 1/1"}


def test_two_writers_of_one_folder_leave_its_rows_once(spark, tmp, monkeypatch):
    from pairforge.sources import sinks as W
    path = f"{tmp}/features"
    W.materialize_features(spark.range(4), path)
    monkeypatch.setattr(W, "_exists", lambda *_: False)  # the second writer has looked before the first was done
    try:
        W._publish(spark.range(4), path)
    except OSError:
        pass  # or the rename is refused
    assert spark.read.parquet(path).count() == 4
