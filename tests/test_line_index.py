"""Lines are numbered without a shuffle of their texts."""
import json

from pairforge.sources import readers as R


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_index_does_not_shuffle_lines(spark, tmp):
    for f, n in (("a", 5), ("b", 3)):
        with open(f"{tmp}/{f}.json", "w") as out:
            out.writelines(json.dumps({"nl": f"{f}{i}", "code": "c"}) + "\n" for i in range(n))
    d = R.read_concode(spark, tmp)
    assert [r["source"] for r in d.orderBy("idx").collect()] == [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(3)]
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in _plan(R.read_concode(spark, tmp))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
