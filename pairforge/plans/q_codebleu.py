"""Registered CodeBLEU queries over ``pages``: page k is the reference and page
k+1 the candidate; opening tags stand in for parse subtrees and the link chain
of a page (each link's parent is the previous link) for its data flow."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import text as T
from pairforge.functions.keywords import JAVA
from pairforge.operators import bleu as B
from pairforge.operators import codebleu as CB
from pairforge.operators import prepare as P
from pairforge.operators.overlap import ngram_stats
from pairforge.plans import oracle as O
from pairforge.plans.catalog import query
from pairforge.sources.tables import table

R6 = 6
TAG_RE = r"<([a-zA-Z][a-zA-Z0-9]*)"
LINK_RE = r'<a href="/([^"]*)">'


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, ref_html, cand_html``: page k against page k+1."""
    p = table(spark, sf_dir, "pages")
    r = p.select(F.col("page_id").alias("pair_id"), F.col("html").alias("ref_html"))
    c = p.select((F.col("page_id") - 1).alias("pair_id"), F.col("html").alias("cand_html"))
    return r.join(c, "pair_id")


def page_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pp = page_pairs(spark, sf_dir)
    tags = lambda c: F.explode(F.regexp_extract_all(F.col(c), F.lit(TAG_RE), 1))
    return pp.select("pair_id", F.lit("ref").alias("side"), tags("ref_html").alias("sexp")).unionByName(
        pp.select("pair_id", F.lit("cand").alias("side"), tags("cand_html").alias("sexp")))


def page_dataflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    pp = page_pairs(spark, sf_dir)

    def items(c, side):
        links = F.regexp_extract_all(F.col(c), F.lit(LINK_RE), 1)
        arr = F.transform(links, lambda v, i: F.struct(
            i.alias("item_no"), v.alias("var"), i.alias("pos"), F.lit("comesFrom").alias("rel"),
            F.when(i > 0, F.array(F.get(links, i - 1))).otherwise(F.array().cast("array<string>")).alias("par_vars"),
            F.when(i > 0, F.array(i - 1)).otherwise(F.array().cast("array<int>")).alias("par_pos")))
        return pp.select("pair_id", F.lit(side).alias("side"), F.explode(arr).alias("x")).select("pair_id", "side", "x.*")

    return items("ref_html", "ref").unionByName(items("cand_html", "cand"))


PAGE_PAIRS = """page_pairs AS (SELECT p.page_id AS pair_id, p.html AS ref_html, q.html AS cand_html
  FROM pages p JOIN pages q ON q.page_id = p.page_id + 1)"""

SYNTAX_CTES = f"""{PAGE_PAIRS},
st AS (SELECT pair_id, 'ref' AS side, unnest(regexp_extract_all(ref_html, '{TAG_RE}', 1)) AS sexp FROM page_pairs
       UNION ALL SELECT pair_id, 'cand', unnest(regexp_extract_all(cand_html, '{TAG_RE}', 1)) FROM page_pairs),
sref AS (SELECT pair_id, sexp, count(*) AS n FROM st WHERE side = 'ref' GROUP BY pair_id, sexp),
scand AS (SELECT DISTINCT pair_id, sexp FROM st WHERE side = 'cand'),
syn AS (SELECT sum(CASE WHEN c.sexp IS NOT NULL THEN r.n ELSE 0 END)::BIGINT AS matched, sum(r.n)::BIGINT AS total
        FROM sref r LEFT JOIN scand c ON c.pair_id = r.pair_id AND c.sexp = r.sexp)"""

_SYN_SQL = f"""WITH {SYNTAX_CTES}
SELECT matched, total, round(CASE WHEN total > 0 THEN matched / total END, 6) AS score FROM syn"""


@query("syntax_match_pages", "C8", _SYN_SQL)
def syntax_match_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of reference subtrees (opening tags) found among the candidate page's subtrees."""
    out = CB.syntax_match(page_subtrees(spark, sf_dir))
    return out.select("matched", "total", F.round("score", R6).alias("score"))


_LINKS = f"regexp_extract_all({{h}}, '{LINK_RE}', 1)"
DATAFLOW_CTES = f"""{PAGE_PAIRS},
lk AS (SELECT pair_id, 'ref' AS side, {_LINKS.format(h='ref_html')} AS l FROM page_pairs
       UNION ALL SELECT pair_id, 'cand', {_LINKS.format(h='cand_html')} FROM page_pairs),
it AS (SELECT pair_id, side, unnest(list_transform(range(1, len(l) + 1), lambda i: {{'item_no': i - 1, 'var': l[i],
         'par_vars': CASE WHEN i > 1 THEN [l[i - 1]] ELSE []::VARCHAR[] END}})) AS x FROM lk),
items AS (SELECT pair_id, side, x.item_no AS item_no, x.var AS var, 'comesFrom' AS rel, x.par_vars AS par_vars FROM it),
sl AS (SELECT pair_id, side, item_no, unnest(par_vars || [var]) AS name, generate_subscripts(par_vars || [var], 1) - 1 AS slot,
              len(par_vars) AS np, rel FROM items),
fo AS (SELECT pair_id, side, name, min(item_no * 1000000 + slot) AS o FROM sl GROUP BY pair_id, side, name),
nm AS (SELECT pair_id, side, name, 'var_' || (row_number() OVER (PARTITION BY pair_id, side ORDER BY o) - 1)::VARCHAR AS vid FROM fo),
ni AS (SELECT s.pair_id, s.side, s.item_no,
              max(CASE WHEN s.slot = s.np THEN n.vid END) || '|' || max(s.rel) || '|' ||
              coalesce(string_agg(CASE WHEN s.slot < s.np THEN n.vid END, ',' ORDER BY s.slot), '') AS norm
       FROM sl s JOIN nm n ON n.pair_id = s.pair_id AND n.side = s.side AND n.name = s.name
       GROUP BY s.pair_id, s.side, s.item_no),
dc AS (SELECT pair_id, norm, count(*) FILTER (WHERE side = 'ref') AS r, count(*) FILTER (WHERE side = 'cand') AS c FROM ni GROUP BY pair_id, norm),
dfm AS (SELECT sum(least(r, c))::BIGINT AS matched, sum(r)::BIGINT AS total FROM dc)"""

_DF_SQL = f"""WITH {DATAFLOW_CTES}
SELECT matched, total, round(CASE WHEN total > 0 THEN matched / total ELSE 0.0 END, 6) AS score FROM dfm"""


@query("dataflow_match_pages", "E8 E10 F8 G4 C9", _DF_SQL)
def dataflow_match_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-flow match of link chains after pruning/merging and variable normalisation."""
    items = CB.prune_merge_dataflow(page_dataflow(spark, sf_dir))
    out = CB.dataflow_match(CB.normalize_dataflow(items))
    return out.select("matched", "total", F.round("score", R6).alias("score"))


_CB_SQL = f"""WITH {DATAFLOW_CTES},
{SYNTAX_CTES.replace(PAGE_PAIRS + ',', '')},
{O.ngram_stats('page_pairs', O.split('cand_html'), O.split('ref_html'), keywords=JAVA)},
ng AS ({O.ngram_match_select('stats', None)}),
wt AS ({O.weighted_match_select('stats', None)}),
r AS (SELECT round(ng.score, 6) AS ngram_match, round(wt.score, 6) AS weighted_ngram_match,
       round(syn.matched / syn.total, 6) AS syntax_match, round(CASE WHEN dfm.total > 0 THEN dfm.matched / dfm.total ELSE 0.0 END, 6) AS dataflow_match
FROM ng, wt, syn, dfm)
SELECT *, round(0.25 * ngram_match + 0.25 * weighted_ngram_match + 0.25 * syntax_match + 0.25 * dataflow_match, 6) AS codebleu FROM r"""


@query("codebleu_pages", "D9 D5 D6 C8 C9", _CB_SQL)
def codebleu_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CodeBLEU = 0.25 each of n-gram match, keyword-weighted match, syntax match and data-flow match."""
    pp = page_pairs(spark, sf_dir).select("pair_id", F.col("cand_html").alias("hyp"), F.array("ref_html").alias("refs"))
    st = ngram_stats(pp, keywords=JAVA, single_ref=True, texts=True)
    both = B.pair_scores(st, weighted=True).select("ngram_match", "weighted_ngram_match")
    sy = CB.syntax_match(page_subtrees(spark, sf_dir)).select(F.col("score").alias("syntax_match"))
    df_ = CB.dataflow_match(CB.normalize_dataflow(CB.prune_merge_dataflow(page_dataflow(spark, sf_dir)))).select(
        F.col("score").alias("dataflow_match"))
    # three one-row results folded by a union and one global aggregate
    u = both.unionByName(sy, allowMissingColumns=True).unionByName(df_, allowMissingColumns=True)
    cols = ["ngram_match", "weighted_ngram_match", "syntax_match", "dataflow_match"]
    # the combined score is taken from the four reported (rounded) components
    row = u.agg(*[F.round(F.first(c, ignorenulls=True), R6).alias(c) for c in cols])
    row = row.withColumn("codebleu", F.round(CB.codebleu(*[F.col(c) for c in cols]), R6))
    return row.select(*cols, "codebleu")


_ERR_SQL = f"""WITH o AS (SELECT page_id, unnest(regexp_extract_all(html, '{TAG_RE}', 1)) AS tag FROM pages),
c AS (SELECT page_id, unnest(regexp_extract_all(html, '</([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages),
closed AS (SELECT DISTINCT page_id, tag FROM c)
SELECT o.page_id, count(*) FILTER (WHERE closed.tag IS NULL) AS errors, count(*) FILTER (WHERE closed.tag IS NOT NULL) AS nodes
FROM o LEFT JOIN closed ON closed.page_id = o.page_id AND closed.tag = o.tag GROUP BY o.page_id"""


@query("parse_error_counts_pages", "D25", _ERR_SQL)
def parse_error_counts_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ERROR vs other nodes per page: an opening tag whose name is never closed is an ERROR node."""
    p = table(spark, sf_dir, "pages")
    opened = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(TAG_RE), 1)).alias("tag"))
    closed = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("</([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("tag")).distinct()
    nodes = opened.join(closed.withColumn("_c", F.lit(1)), ["page_id", "tag"], "left").select(
        "page_id", F.when(F.col("_c").isNull(), F.lit("ERROR")).otherwise(F.col("tag")).alias("type"))
    return CB.parse_error_counts(nodes, "page_id")


#: code put before every fourth document: literals with brackets and escaped quotes, comments with apostrophes,
#: an unclosed and a crossed bracket
PLANTS = ['x = "(\\" "; // it\'s\nf(y); // that\'s\n', "// it's\nf(x // that's\n", "m = '{'; g[0] = h(1); /* don't */\n", "a(b[c)d];\n"]


def _sql_text(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


_CASES = " ".join(f"WHEN {i} THEN {_sql_text(t)}" for i, t in enumerate(PLANTS))
_CODE_PIECES = r"""(?sm)//.*?$|/\*.*?\*/|'(?:\\.|[^\\'])*'|"(?:\\.|[^\\"])*"|[^/'"]+|.""".replace("'", "''")
_LITERAL = r"""\"(?:\\.|[^\\"])*"|'(?:\\.|[^\\'])*'""".replace("'", "''")
_STRUCT_SQL = f"""WITH p AS (SELECT doc_id, (CASE doc_id % 4 {_CASES} END) || text AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(regexp_extract_all(t, '{_CODE_PIECES}'),
        lambda x: CASE WHEN length(x) > 1 AND starts_with(x, '/') THEN ' ' ELSE x END), ''), '{_LITERAL}', '""', 'g') AS code FROM p),
b AS (SELECT doc_id, unnest(regexp_extract_all(code, '[(){{}}\\[\\]]')) AS ch, generate_subscripts(regexp_extract_all(code, '[(){{}}\\[\\]]'), 1) AS pos FROM s),
d AS (SELECT *, CASE WHEN ch IN ('(', '{{', '[') THEN 1 ELSE -1 END AS up FROM b),
e AS (SELECT *, sum(up) OVER (PARTITION BY doc_id ORDER BY pos) AS depth FROM d),
f AS (SELECT *, lag(ch) OVER (PARTITION BY doc_id, CASE WHEN up = 1 THEN depth ELSE depth + 1 END ORDER BY pos) AS opener FROM e),
g AS (SELECT doc_id, min(depth) >= 0 AND sum(up) = 0
             AND bool_and(up = 1 OR coalesce(opener || ch, '') IN ('()', '{{}}', '[]')) AS ok FROM f GROUP BY doc_id)
SELECT s.doc_id, coalesce(g.ok, true) AS valid FROM s LEFT JOIN g USING (doc_id)"""


@query("structure_check_docs", "I10 H7", _STRUCT_SQL)
def structure_check_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracket balance of every document (with planted code before it) after comments, then literals, are blanked."""
    plant = F.lit(None).cast("string")
    for i, t in enumerate(PLANTS):
        plant = F.when(F.col("doc_id") % 4 == i, F.lit(t)).otherwise(plant)
    code = P.replace_literals(T.strip_comments(F.concat(plant, F.col("text"))))
    d = table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))
    return d.select("doc_id", CB.structure_check("code").alias("valid"))


_REWARD_SQL = """WITH s AS (SELECT l.doc_id, l.doc_id // 8 AS batch, (l.quality = 1) AS compiled, l.toxic AS ast_match,
       CASE WHEN l.toxic = 1 THEN 'true' ELSE 'false' END AS detected FROM labels l)
SELECT batch, count(*) AS n, sum(doc_id % 3)::BIGINT AS errors, sum(doc_id % 2)::BIGINT AS errors_ref, sum(doc_id % 11)::BIGINT AS nodes,
       round(avg(ast_match), 6) AS dfg_match, round(avg(CASE WHEN compiled THEN 1.0 ELSE -1.0 END), 6) AS compile_rate, round(avg(ast_match), 6) AS ast_match,
       round(avg((CASE WHEN compiled THEN 1 ELSE 0 END) + (CASE WHEN detected = 'true' THEN 1 ELSE 0 END) + 1), 6) AS mean_reward
FROM s GROUP BY batch"""


@query("reward_stats_labels", "I7 D24", _REWARD_SQL)
def reward_stats_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite 0-3 rewards and per-batch reward statistics from boolean signals of ``labels``."""
    from pairforge.operators import rollout as RL
    lab = table(spark, sf_dir, "labels")
    s = lab.select("doc_id", (F.col("doc_id") / 8).cast("long").alias("batch"), (F.col("quality") == 1).alias("compiled"),
                   F.col("toxic").cast("double").alias("ast_match"), F.col("toxic").cast("double").alias("dfg_match"),
                   F.when(F.col("toxic") == 1, "true").otherwise("false").alias("detected"))
    s = s.withColumns({"reward": RL.composite_reward(F.lit(True), F.col("compiled"), F.col("detected")),
                       "errors": F.col("doc_id") % 3, "errors_ref": F.col("doc_id") % 2, "nodes": F.col("doc_id") % 11})
    st = RL.batch_reward_stats(s, "batch", "compiled", "ast_match", "dfg_match", "reward", ["errors", "errors_ref", "nodes"])
    return st.select("batch", "n", "errors", "errors_ref", "nodes",
                     *[F.round(c, R6).alias(c) for c in ("compile_rate", "ast_match", "dfg_match", "mean_reward")])
