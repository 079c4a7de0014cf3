import random

from pyspark.sql import functions as F

from pairforge.llm import chat

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "/INST]", "\\s>", "é😀", " ok ", "\n", "a"]


def test_reversible_on_random_control_strings(spark):
    r = random.Random(1)
    text = lambda: "".join(r.choice(PARTS) for _ in range(r.randint(0, 9)))
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", text()]), r.choice([text(), text(), None]), "x")
            for c in range(60) for t in range(r.randint(1, 9))]
    rows += [(None, 1, None, "q", "x"), (None, 2, "assistant", "<s>", "x"), (7, None, "assistant", "tie", "x"),
             (7, None, "assistant", "tie", "x"), (500, 1, "user", "no answer", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, id string")
    out = chat.format_chat(df).withColumns({"turns": chat.parse(F.col("formatted")),
                                            "loss": chat.under_mask(F.col("formatted"), F.col("loss_spans"))})
    got = {x.id: x for x in out.collect()}
    want = {}
    for c, t, role, tx, _ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", tx or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        x = got[c]
        assert [(y.role, y.text) for y in x.turns] == [y[1:] for y in turns]
        assert x.loss == "".join(y[2] for y in turns if y[1] == "assistant")
        marks = [i for i in range(len(x.formatted)) if x.formatted.startswith("<s>", i)]
        assert len(marks) == 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))  # merged blocks
        assert len(x.loss_spans) == sum(y[1] == "assistant" for y in turns)


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_chat(df).count() == 0
    df = spark.range(2000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"),
                                  F.lit("[INST]" * 50).alias("text"))
    x = chat.format_chat(df).select(F.size(chat.parse(F.col("formatted"))).alias("n"), F.size("loss_spans").alias("m")).first()
    assert (x.n, x.m) == (2000, 2000)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.format_chat(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
