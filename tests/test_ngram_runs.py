"""n-grams are counted in bounded runs of rows, whatever the size of a batch."""
import pyarrow as pa

from pairforge.operators import overlap as OV


def test_ngram_runs_are_bounded():
    texts = ["a b c " * 30_000, "", None, "x " * 2_000_000, "y z"] + ["d e " * 1000] * 900
    refs = pa.array([[t] for t in texts[:3]] + [None, []] + [["d e"]] * 900, pa.list_(pa.string()))
    b = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), refs], names=["_hyp", "_refs"])
    runs = list(OV._runs(b, True))
    assert pa.Table.from_batches(runs).to_pylist() == b.to_pylist()
    for r in runs:
        held = sum(len(t or "") for t in r.column("_hyp").to_pylist()) + sum(len(x or "") for t in r.column("_refs").to_pylist() for x in t or [])
        assert held <= OV._RUN_BYTES or r.num_rows == 1


def test_ngram_counts_do_not_depend_on_runs(spark, monkeypatch):
    rows = [(i, "the cat the cat sat on a mat " * (i % 5), ["the cat sat on the mat the cat " * (i % 3)]) for i in range(40)] + [(40, None, [None]), (41, "x", [""])]
    d = spark.createDataFrame(rows, "pair_id int, hyp string, refs array<string>").coalesce(1)
    want = [r.asDict() for r in OV.ngram_stats(d, texts=True).orderBy("pair_id").collect()]
    count = lambda part: OV.ngram_stats(d.filter(f"pair_id = {part}"), texts=True).collect()
    assert all(count(i)[0].asDict() == want[i] for i in (2, 7, 40, 41))
