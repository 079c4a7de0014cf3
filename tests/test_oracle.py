"""Every registered query against its DuckDB twin on the smallest tables."""
import os

from tools.check import compare

SF = "/root/testdata/sf0.001"


def test_registered_queries_match_sql(spark):
    if not os.path.isdir(SF):
        return
    msgs = []
    bad = compare(spark, SF, log=msgs.append)
    assert bad == 0, "\n".join(m for m in msgs if not m.startswith(("OK", "ROWS-ONLY")))


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["lang", "n_pairs", "bleu"]
