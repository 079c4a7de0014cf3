"""Given tables written in the reference's file formats and read back by its readers (A2, A6-A11, A13, A15, A17, A19), and data flow
whose items share positions and have several parents (E10, G4)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators import codebleu as CB
from pairforge.plans import oracle as O
from pairforge.plans.catalog import query
from pairforge.plans.pairs import turn_pairs
from pairforge.plans.q_codebleu import LINK_RE, PAGE_PAIRS, page_pairs
from pairforge.plans.q_helpers import _one_line, _scratch
from pairforge.session import ensure_checkpoint_dir
from pairforge.sources import readers as R
from pairforge.sources import sinks as W
from pairforge.sources.tables import table

_TASKS_SQL = f"""WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents),
r AS (SELECT 'concode' AS task, n AS idx, {O.strip('text')} AS s, {O.strip("lang || ' '")} AS t FROM d
      UNION ALL SELECT 'summarize', n, {O.collapse("replace(text, chr(10), ' ')")}, {O.collapse("lang || ' ' || source")} FROM d
      UNION ALL SELECT 'refactoring', n, {O.collapse('text')}, {O.collapse("source || ' ' || lang || ' '")} FROM d
      UNION ALL SELECT 'defect', doc_id, {O.collapse('text')}, (doc_id % 2)::VARCHAR FROM d)
SELECT task, idx, md5(s) AS source_digest, md5(t) AS target_digest FROM r"""


@query("task_readers_docs", "A2 A6 A7 A8 A9 A13", _TASKS_SQL)
def task_readers_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as the JSON lines of four tasks, in id order, and read back by their readers."""
    ensure_checkpoint_dir(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").orderBy("doc_id").checkpoint()  # sorted once for the four
    made = {
        "concode": d.select(F.col("text").alias("nl"), F.concat("lang", F.lit(" ")).alias("code")),
        "summarize": d.select(F.split("text", " ").alias("code_tokens"), F.array("lang", "source").alias("docstring_tokens")),
        "refactoring": d.select(F.col("text").alias("Smelly Sample"), F.lit("").alias("Method after Refactoring"),
                                F.concat_ws(" ", "source", "lang", F.lit("")).alias("Extracted Method")),
        "defect": d.select(F.col("doc_id").alias("idx"), F.col("text").alias("func"), (F.col("doc_id") % 2).cast("int").alias("target")),
    }
    readers = {"concode": R.read_concode, "summarize": R.read_summarize, "refactoring": R.read_refactoring, "defect": R.read_defect}
    out = None
    for task, rows in made.items():
        path = _scratch(spark, task)
        W.write_jsonl(rows, path)
        back = readers[task](spark, path).select(F.lit(task).alias("task"), F.col("idx").cast("bigint").alias("idx"), F.md5("source").alias("source_digest"),
                                                 F.md5(F.col("target").cast("string")).alias("target_digest"))
        out = back if out is None else out.unionByName(back)
    return out


_CATALOG_SQL = """SELECT doc_id::VARCHAR AS name, md5(text) AS branch_digest, count(*) AS n FROM documents GROUP BY ALL"""


@query("catalog_docs", "A1", _CATALOG_SQL)
def catalog_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as catalogs (one JSON document of at most 512 elements a file, whole texts in them) and read back piece by piece."""
    path = _scratch(spark, "catalogs")
    d = table(spark, sf_dir, "documents").select(
        F.shiftright(F.monotonically_increasing_id(), 9).alias("catalog"),
        F.struct(F.col("doc_id").cast("string").alias("name"), F.array("lang", "source").alias("topics"), F.col("text").alias("defaultBranch")).alias("item"))
    docs = d.groupBy("catalog").agg(F.collect_list("item").alias("items"))
    docs.select("catalog", F.to_json(F.struct(F.size("items").alias("count"), "items")).alias("value")) \
        .write.partitionBy("catalog").text(path)
    back = R.read_catalog(spark, f"{path}/*")
    return back.groupBy("name", F.md5("defaultBranch").alias("branch_digest")).agg(F.count(F.lit(1)).alias("n"))


_CLONES_SQL = f"""SELECT a.doc_id::VARCHAR AS url1, b.doc_id::VARCHAR AS url2, l.quality AS label, md5({O.collapse('a.text')}) AS source_digest,
  md5({O.collapse('b.text')}) AS target_digest
FROM labels l JOIN documents a ON a.doc_id = l.doc_id JOIN documents b ON b.doc_id = l.doc_id + 3"""


@query("clone_files_labels", "A10 A14 C2", _CLONES_SQL)
def clone_files_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone pairs written as an index file with its ``data.jsonl`` and read back."""
    path = _scratch(spark, "clones")
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") + 3).alias("other"), "quality")
    W.write_labels(lab, f"{path}/index.txt", ["doc_id", "other", "quality"])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("idx"), F.col("text").alias("func"))
    W.write_jsonl(docs, f"{path}/data.jsonl")
    back = R.read_clone_pairs(spark, f"{path}/index.txt")
    return back.select("url1", "url2", "label", F.md5("source").alias("source_digest"), F.md5("target").alias("target_digest"))


_PRED_GOLD_SQL = f"""WITH c AS (SELECT conv_id, turn, role, translate(text, chr(9) || chr(10) || chr(13), '   ') AS t FROM conversations),
p AS (SELECT u.conv_id, u.turn, u.t AS gold, a.t AS pred FROM c u JOIN c a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
b AS (SELECT conv_id, {O.strip('arg_max(pred, turn)')} AS pred FROM p GROUP BY conv_id)
SELECT b.conv_id::VARCHAR AS id, md5(b.pred) AS pred_digest, count(*) AS n_refs, md5(string_agg(md5(c.t), ',' ORDER BY md5(c.t))) AS refs_digest
FROM b JOIN c ON c.conv_id = b.conv_id AND c.role = 'user' GROUP BY b.conv_id, b.pred"""


@query("pred_gold_files_turns", "A11 C3", _PRED_GOLD_SQL)
def pred_gold_files_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction and gold files keyed by conversation: of several predictions the last line counts, every user turn is a reference."""
    def line(key, text):
        return F.concat_ws("\t", F.col(key).cast("string"), F.translate(text, "\t\n\r", "   ")).alias("value")

    pred, gold = _scratch(spark, "pred"), _scratch(spark, "gold")
    turn_pairs(spark, sf_dir).orderBy("conv_id", "turn").select(line("conv_id", "pred")).write.text(pred)
    table(spark, sf_dir, "conversations").filter("role = 'user'").select(line("conv_id", "text")).write.text(gold)
    preds, golds = R.read_pred_gold(spark, pred, gold)
    refs = golds.groupBy("id").agg(F.count(F.lit(1)).alias("n_refs"), F.array_sort(F.collect_list(F.md5("gold"))).alias("refs"))
    return preds.join(refs, "id").select("id", F.md5("pred").alias("pred_digest"), "n_refs", F.md5(F.array_join("refs", ",")).alias("refs_digest"))


_OUTPUTS_SQL = """SELECT 'comparison' AS kind, md5(lang) || md5(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), chr(9), ' ')) AS key, count(*) AS n
FROM documents GROUP BY ALL
UNION ALL SELECT 'result', CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END, count(*) FROM labels GROUP BY ALL
UNION ALL SELECT 'features', toxic::VARCHAR, count(*) FROM labels GROUP BY ALL"""


@query("written_outputs_labels", "A15 A17 A19", _OUTPUTS_SQL)
def written_outputs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison table, job results and a feature cache, written and read back."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    csv = _scratch(spark, "comparison")
    W.write_comparison_csv(docs.select(F.col("lang").alias("ss"), _one_line(F.col("text")).alias("gt"), F.col("lang").alias("ft")), csv)
    back = spark.read.option("header", True).schema("ss string, gt string, ft string").csv(csv)
    rows = back.groupBy(F.concat(F.md5("ss"), F.md5("gt")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("comparison").alias("kind"), "key", "n")
    jobs = _scratch(spark, "jobs")
    W.write_job_results(labels.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("result"), F.col("doc_id").cast("string").alias("name")), jobs)
    done = spark.read.schema("result string, name string").json(jobs).groupBy(F.col("result").alias("key")).agg(F.countDistinct("name").alias("n"))
    cache = f"{_scratch(spark, 'features')}/{W.feature_cache_key('train')}"
    W.materialize_features(labels.select("doc_id", "toxic"), cache)
    kept = W.materialize_features(labels.limit(0).select("doc_id", "toxic"), cache)  # the cache is there, so it is read
    kept = kept.groupBy(F.col("toxic").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(done.select(F.lit("result").alias("kind"), "key", "n")).unionByName(kept.select(F.lit("features").alias("kind"), "key", "n"))


_FLOW_SQL = f"""WITH {PAGE_PAIRS},
lk AS (SELECT pair_id, regexp_extract_all(ref_html, '{LINK_RE}', 1) AS l FROM page_pairs),
it AS (SELECT pair_id, unnest(list_transform(range(1, len(l) + 1), lambda i: {{'no': i - 1, 'pos': (i - 1) // 3, 'var': l[i],
         'rel': CASE WHEN i % 2 = 0 THEN 'comesFrom' ELSE 'computedFrom' END,
         'pv': CASE WHEN i > 2 AND i % 4 <> 0 THEN [l[i - 1], l[i - 2]] ELSE []::VARCHAR[] END,
         'pp': CASE WHEN i > 2 AND i % 4 <> 0 THEN [(i - 2) // 3 - 1, (i - 3) // 3 - 1] ELSE []::BIGINT[] END}})) AS x FROM lk),
q AS (SELECT DISTINCT pair_id, unnest(x.pp) AS pos FROM it),
k AS (SELECT it.pair_id, x.* FROM it LEFT JOIN q ON q.pair_id = it.pair_id AND q.pos = x.pos WHERE len(x.pv) > 0 OR q.pos IS NOT NULL),
f AS (SELECT pair_id, pos, list_sort(list_distinct(flatten(list(pv)))) AS pv FROM k GROUP BY pair_id, pos)
SELECT k.pair_id, k.pos, arg_max(var, no) AS var, arg_max(rel, no) AS rel, min(no) AS item_no, array_to_string(any_value(f.pv), ',') AS parents
FROM k JOIN f ON f.pair_id = k.pair_id AND f.pos = k.pos GROUP BY k.pair_id, k.pos"""


@query("dataflow_merge_pages", "E10 G4", _FLOW_SQL)
def dataflow_merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data flow of a page's links, three to a position, with two parents or none: items nobody refers to go, those of one position are merged."""
    links = F.regexp_extract_all("ref_html", F.lit(LINK_RE), 1)

    def item(v, i):
        parents = (i >= 2) & ((i + 1) % 4 != 0)
        return F.struct(i.cast("bigint").alias("item_no"), F.floor(i / 3).alias("pos"), v.alias("var"),
                        F.when(i % 2 == 1, "comesFrom").otherwise("computedFrom").alias("rel"),
                        F.when(parents, F.array(F.get("l", i - 1), F.get("l", i - 2))).otherwise(F.array().cast("array<string>")).alias("par_vars"),
                        F.when(parents, F.array(F.floor((i - 1) / 3) - 1, F.floor((i - 2) / 3) - 1)).otherwise(F.array().cast("array<bigint>")).alias("par_pos"))

    items = page_pairs(spark, sf_dir).select("pair_id", F.lit("ref").alias("side"), links.alias("l")) \
        .select("pair_id", "side", F.explode(F.transform("l", item)).alias("x")).select("pair_id", "side", "x.*")
    out = CB.prune_merge_dataflow(items)
    return out.select("pair_id", "pos", "var", "rel", "item_no", F.array_join("par_vars", ",").alias("parents"))
