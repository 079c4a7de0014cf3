"""Registered queries over the readers, writers, role picking, id helpers and callbacks."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge import registry as K
from pairforge.functions import arrays as A
from pairforge.functions import text as T
from pairforge.operators import classify as C
from pairforge.operators import jsonops as J
from pairforge.operators import mining as M
from pairforge.operators import prepare as P
from pairforge.operators import rollout as RL
from pairforge.operators import textmetrics as TM
from pairforge.plans import oracle as O
from pairforge.plans.catalog import query
from pairforge.plans.pairs import turn_pairs
from pairforge.session import ensure_checkpoint_dir
from pairforge.sources import readers as R
from pairforge.sources import sinks as W
from pairforge.sources.tables import table


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _one_line(c):
    return F.translate(c, "\n\r", "  ")


_LINES_SQL = f"""WITH c AS (SELECT conv_id, turn, role, translate(text, chr(10) || chr(13), '  ') AS t FROM conversations),
p AS (SELECT u.conv_id, u.turn, {O.strip('u.t')} AS gold, {O.strip('a.t')} AS pred
      FROM c u JOIN c a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')
SELECT row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS idx, md5(pred) AS source_digest, md5(gold) AS target_digest FROM p"""


@query("parallel_lines_turns", "A14 A5 C1", _LINES_SQL)
def parallel_lines_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn pairs written as aligned prediction and gold files (folders of part files) and zipped back by line number."""
    p = turn_pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), _one_line(F.col("pred")).alias("pred"),
                                         _one_line(F.col("gold")).alias("gold"), F.lit("").alias("source"))
    path = _scratch(spark, "lines")
    W.write_predictions(p, path)
    back = R.read_parallel(spark, f"{path}.output", f"{path}.gold")
    return back.select("idx", F.md5("source").alias("source_digest"), F.md5("target").alias("target_digest"))


_MERGE_SQL = """WITH u AS (SELECT 0 AS file_no, item_id AS k, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents)
SELECT file_no, row_number() OVER (PARTITION BY file_no ORDER BY k) - 1 AS line_no, md5(translate(text, chr(10) || chr(13), '  ')) AS digest FROM u"""


@query("merged_files", "A4 G1", _MERGE_SQL)
def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two line files written in id order and merged by (file, line)."""
    paths = []
    for name, key in (("benchmark", "item_id"), ("documents", "doc_id")):
        paths.append(_scratch(spark, name))
        table(spark, sf_dir, name).orderBy(key).select(_one_line(F.col("text")).alias("value")).write.text(paths[-1])
    return R.merge(spark, *paths).select("file_no", "line_no", F.md5("line").alias("digest"))


_ROLES_SQL = f"""WITH g AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS l, list(text ORDER BY turn) FILTER (role = 'assistant') AS r
  FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(l[1]) AS before_digest, md5(CASE WHEN conv_id % 2 = 0 AND len(r) > 0 THEN r[2] ELSE r[1] END) AS extracted_digest,
       md5(CASE WHEN conv_id % 2 = 0 AND len(r) > 0 THEN r[1] ELSE r[2] END) AS after_digest FROM g"""


@query("pick_roles_conversations", "B3 B4", _ROLES_SQL)
def pick_roles_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as code ranges: user turns are the left side, assistant turns the right, swapped in every second conversation."""
    c = table(spark, sf_dir, "conversations")
    item = F.struct("turn", F.col("role").alias("codeElementType"),
                    F.when(F.col("conv_id") % 2 == 0, F.lit(M.SOURCE_BEFORE)).otherwise(F.lit("extracted method")).alias("description"), "text")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("ranges"))  # one conversation's turns
    roles = M.pick_roles(M.filter_ranges("ranges", "user"), M.filter_ranges("ranges", "assistant"))
    return g.select("conv_id", roles.alias("x")).select(
        "conv_id", *(F.md5(F.col(f"x.{n}.text")).alias(f"{n}_digest") for n in ("before", "extracted", "after")))


_VERSIONS_SQL = """SELECT l.doc_id, l.quality, md5('class ' || d.source || chr(10) || d.text) AS smelly_digest, md5('class ' || d.source || d.text) AS after_digest
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id"""


@query("file_versions_labels", "C5 B5", _VERSIONS_SQL)
def file_versions_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File text attached to labelled ranges by an equi-join, laid out with its class as smelly and as refactored sample."""
    ranges = table(spark, sf_dir, "labels").select("doc_id", "quality")
    versions = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("class "), "source").alias("cls"))
    d = M.file_versions_for(ranges, versions, ("doc_id",))
    return d.select("doc_id", "quality", F.md5(P.triple_layout(F.col("text"), F.col("cls"), True, True)).alias("smelly_digest"),
                    F.md5(P.triple_layout(F.col("text"), F.col("cls"), True, False)).alias("after_digest"))


_HELP_SQL = f"""SELECT doc_id AS doc_id_x, substring(string_split(text, chr(10))[1], 3, 7) AS token_x,
  md5(array_to_string(list_transform({O.split('text')}, lambda t: CASE t WHEN 'the' THEN 'THE' WHEN 'de' THEN 'DE' ELSE t END), ' ')) AS decoded_x,
  greatest(least(n_chars, 2000), 100)::BIGINT AS clipped_x, md5({O.strip('text')}) AS pred_x, {O.strip('source')} AS ref_x,
  [doc_id, n_chars, n_chars, doc_id] AS codes_x, CASE doc_id % 5 WHEN 3 THEN 'three' WHEN 4 THEN 'four' ELSE '' END AS ids_x,
  lang AS task_x, source AS sub_x, lang || '-' || n_chars::VARCHAR AS row_x, length(text) AS batch_x FROM documents"""


@query("code_helpers_docs", "H8 H9 H14 H15 H16 B16 B19 H24 K1 K2", _HELP_SQL)
def code_helpers_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token at a position, mapped tokens, clipped numbers, post-processing, id arrays, task names and Python callbacks."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    post = TM.post_process(F.col("text"), F.col("source"))
    names = F.create_map(*(F.lit(x) for x in (3, "three", 4, "four")))
    both = F.array("doc_id", "n_chars")
    named = K.row_function(lambda lang, n: f"{lang}-{n}", "string")
    task = P.split_task(F.concat_ws("_", "lang", "source"))
    out = d.select(
        "doc_id", T.token_at(F.col("text"), F.lit(0), F.lit(2), F.lit(0), F.lit(9)).alias("token"),
        F.md5(T.decode_tokens(T.py_split("text"), F.create_map(*(F.lit(x) for x in ("the", "THE", "de", "DE"))))).alias("decoded"),
        A.clip(F.col("n_chars"), 100, 2000).alias("clipped"), F.md5(post["pred"]).alias("pred"), F.get(post["refs"], 0).alias("ref"),
        A.concat_codes(both, F.reverse(both)).alias("codes"),
        A.decode_ids(F.array((F.col("doc_id") % 5).cast("int")), names, [0, 1, 2]).alias("ids"),
        task["task"].alias("task"), task["sub_task"].alias("sub"), named("lang", "n_chars").alias("row"), "text")
    schema = ", ".join(f"{n} {t}" for n, t in out.dtypes if n != "text") + ", batch bigint"
    out = K.batched_map(out, lambda b: b.assign(batch=b["text"].str.len()).drop(columns="text"), schema)
    return J.add_suffix(out, "_x")


_DENSE_SQL = """SELECT doc_id, list_transform(range(16), lambda i: CASE WHEN i = least(doc_id % 20, 15)
  THEN CASE WHEN quality = 1 THEN 1.0 ELSE -1.0 END + toxic + 0.5 ELSE 0.0 END::DOUBLE) AS reward FROM labels"""


@query("dense_reward_labels", "I8 H20", _DENSE_SQL)
def dense_reward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compile, syntax and data-flow signals placed at the end of a 16-token sequence."""
    d = table(spark, sf_dir, "labels")
    reward = RL.dense_reward(F.lit(16), (F.col("doc_id") % 20).cast("int"), F.col("quality") == 1, F.col("toxic").cast("double"), F.lit(0.5))
    return d.select("doc_id", reward.alias("reward"))


_CALLBACK_SQL = """SELECT count(*) AS n, round(avg(CASE WHEN l.quality = l.toxic THEN 1.0 ELSE 0.0 END), 4) AS acc,
  round(avg(length(d.text)), 4) AS mean_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""


@query("metric_callbacks_labels", "K4 C11", _CALLBACK_SQL)
def metric_callbacks_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined to their examples by id, scored by two registered metric callbacks."""
    examples = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), "text")
    preds = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("example_id"), F.col("quality").alias("label"), F.col("toxic").alias("pred"))
    K.register_metric("accuracy", lambda d: C.accuracy(d))
    K.register_metric("mean_chars", lambda d: d.agg(F.avg(F.length("text")).alias("mean_chars")))
    return K.compute_metrics(R.join_predictions(examples, preds), ["accuracy", "mean_chars"])


_TRAIN_SQL = """WITH s AS (SELECT doc_id // 32 AS run, doc_id // 8 AS step, quality + toxic AS reward, doc_id % 3 AS errors, doc_id % 2 AS errors_ref,
         doc_id % 11 AS nodes, doc_id % 13 AS nodes_ref FROM labels),
m AS (SELECT run, step, round(avg(reward), 4) AS reward, round(avg(errors), 4) AS errors, round(avg(errors_ref), 4) AS errors_ref,
        round(avg(nodes), 4) AS nodes, round(avg(nodes_ref), 4) AS nodes_ref, count(*) AS n FROM s GROUP BY run, step)
SELECT 't' || step AS time, run, 8 AS train_batch_size, 512 AS max_source_length, 256 AS max_target_length, 0.001::DOUBLE AS lr, 1 AS epoch, step, reward,
  errors, errors_ref, nodes, nodes_ref, n / 2 AS kl, n / 4 AS entropy, n * 1.0::DOUBLE AS loss, n * 0.5::DOUBLE AS pg_loss, n * 0.25::DOUBLE AS vf_loss,
  0.0::DOUBLE AS advantage_mean, 0.0::DOUBLE AS return_mean, 0.0::DOUBLE AS value_mean, 1.0::DOUBLE AS compile_rate, 0.5::DOUBLE AS ast_match,
  0.5::DOUBLE AS dfg_match FROM m"""


@query("training_rows_labels", "A16", _TRAIN_SQL)
def training_rows_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24-field training log: labelled documents as generated samples, eight to a step; appended and read back."""
    d = F.col("doc_id")
    s = table(spark, sf_dir, "labels").select(
        F.floor(d / 32).alias("run"), F.floor(d / 8).alias("step"), (F.col("quality") + F.col("toxic")).alias("reward"), (d % 3).alias("errors"),
        (d % 2).alias("errors_ref"), (d % 11).alias("nodes"), (d % 13).alias("nodes_ref"))
    steps = s.groupBy("run", "step").agg(F.count(F.lit(1)).alias("n"))
    fixed = {"train_batch_size": F.lit(8), "max_source_length": F.lit(512), "max_target_length": F.lit(256), "lr": F.lit(0.001), "epoch": F.lit(1),
             "kl": F.col("n") / 2, "entropy": F.col("n") / 4, "loss": F.col("n") * 1.0, "pg_loss": F.col("n") * 0.5, "vf_loss": F.col("n") * 0.25,
             "advantage_mean": F.lit(0.0), "return_mean": F.lit(0.0), "value_mean": F.lit(0.0), "compile_rate": F.lit(1.0),
             "ast_match": F.lit(0.5), "dfg_match": F.lit(0.5), "time": F.concat(F.lit("t"), F.col("step").cast("string"))}
    path = _scratch(spark, "training-log")
    W.append_table(RL.training_rows(s, steps.withColumns(fixed)), path)
    return spark.read.parquet(path)


_HANDLER_SQL = """SELECT CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id // 32 END AS commit, count(*) AS n, count(DISTINCT lang) AS n_langs,
  sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ALL"""


@query("commit_handler_docs", "K5", _HANDLER_SQL)
def commit_handler_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's handler over commits of at most 32 documents and one that holds a third of all: counts and sums of a commit's rows."""
    handler = M.Handler(
        init=lambda: (0, frozenset(), 0),
        update=lambda s, rows: (s[0] + len(rows), s[1] | set(rows["lang"].dropna()), s[2] + int(rows["n_chars"].sum())),
        merge=lambda a, b: (a[0] + b[0], a[1] | b[1], a[2] + b[2]),
        finish=lambda s: (s[0], len(s[1]), s[2]))
    commit = F.when(F.col("doc_id") % 3 == 0, F.lit(-1)).otherwise(F.floor(F.col("doc_id") / 32)).cast("bigint")
    d = table(spark, sf_dir, "documents").select(commit.alias("commit"), "lang", "n_chars")
    return M.handle_commits(d, "commit", handler, "n bigint, n_langs bigint, n_chars bigint")


_BLOCKS_SQL = """WITH p AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS r, length(a.text) % 4 AS w FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, md5(chr(10) || 'Smelly Code:' || chr(10) || q || chr(10) || 'Refactored Code:' || chr(10) || r || chr(10) || 'Reward:' || chr(10) || w
  || CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 THEN chr(10) || '============End of batch================' || chr(10) ELSE '' END) AS digest
FROM p"""


@query("reward_blocks_turns", "A18", _BLOCKS_SQL)
def reward_blocks_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward-log blocks of turn pairs (a conversation is a batch), appended to a table and read back."""
    p = turn_pairs(spark, sf_dir).select("conv_id", "turn", F.col("gold").alias("query"), F.col("pred").alias("response"),
                                         (F.length("pred") % 4).alias("reward"))
    path = _scratch(spark, "reward-log")
    W.append_table(W.reward_blocks(p, "conv_id", "turn"), path)
    return spark.read.parquet(path).select("conv_id", "turn", F.md5("block").alias("digest"))
