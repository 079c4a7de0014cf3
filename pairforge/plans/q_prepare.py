"""Registered preparation queries: pair building, filters, text normalisation,
exact sampling and splitting over the supplied tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.functions import text as T
from pairforge.functions.keywords import JAVA
from pairforge.operators import evallog as EV
from pairforge.operators import prepare as P
from pairforge.operators import sampling as S
from pairforge.plans import oracle as O
from pairforge.plans.catalog import query
from pairforge.plans.pairs import doc_pairs
from pairforge.sources.tables import table

R6 = 6


def turn_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, smelly, after, extracted``: user turn t, assistant t+1, user t+2."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user")
    s = u.select("conv_id", "turn", F.col("text").alias("smelly"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    e = u.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("extracted"))
    return s.join(a, ["conv_id", "turn"]).join(e, ["conv_id", "turn"])


TRIPLES = """triples AS (
  SELECT s.conv_id, s.turn, s.text AS smelly, a.text AS after, e.text AS extracted
  FROM conversations s
  JOIN conversations a ON a.conv_id = s.conv_id AND a.turn - 1 = s.turn AND a.role = 'assistant'
  JOIN conversations e ON e.conv_id = s.conv_id AND e.turn - 2 = s.turn AND e.role = 'user'
  WHERE s.role = 'user')"""

_INSTR_HEAD, _INSTR_TAIL = P.INSTRUCTION_PROMPT.split("{src}")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_STYLES_SQL = f"""WITH {TRIPLES},
styles AS (
  SELECT conv_id, turn, 'a' AS style, coalesce(smelly, 'None') AS source, coalesce(after, 'None') || chr(10) || coalesce(extracted, 'None') AS target FROM triples
  UNION ALL SELECT conv_id, turn, 'b', smelly, after || extracted FROM triples
  UNION ALL SELECT conv_id, turn, 'c', smelly, extracted FROM triples
  UNION ALL SELECT conv_id, turn, 'd', 'Refactor this method: ' || smelly || chr(10) || ' Refactored code: ' || after || extracted, '' FROM triples
  UNION ALL SELECT conv_id, turn, 'e', {_sql_str(_INSTR_HEAD)} || smelly || {_sql_str(_INSTR_TAIL)}, '' FROM triples
  UNION ALL SELECT conv_id, turn, 'f', {_sql_str(P.PERFORM_PROMPT)} || replace(smelly, chr(9), ' '), '' FROM triples)
SELECT conv_id, turn, style, length(source) AS source_len, length(target) AS target_len,
       md5(source || chr(1) || target) AS digest FROM styles"""


@query("pair_styles_turns", "B6 H22 K3", _STYLES_SQL)
def pair_styles_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six (source, target) formatting styles over (user, assistant, user) turn triples."""
    p = P.build_pairs(turn_triples(spark, sf_dir), "abcdef")
    return p.select("conv_id", "turn", "style", F.length("source").cast("long").alias("source_len"),
                    F.length("target").cast("long").alias("target_len"), F.md5(F.concat("source", F.lit("\u0001"), "target")).alias("digest"))


_FILTER_SQL = f"""WITH {TRIPLES}
SELECT conv_id, turn FROM triples
WHERE len({O.split('smelly')}) <= 512 AND len({O.split("coalesce(after, 'None') || coalesce(extracted, 'None')")}) <= 512"""


@query("length_filter_turns", "B7", _FILTER_SQL)
def length_filter_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples kept when both the smelly side and after||extracted have at most 512 tokens."""
    return P.length_filter(turn_triples(spark, sf_dir)).select("conv_id", "turn")


_D1_SQL = f"""WITH {O.DOC_PAIRS}
SELECT lang, count(*) AS n, round(avg(len({O.split('gold')})), 6) AS avg_src_len, round(avg(len({O.split('pred')})), 6) AS avg_trg_len,
       max(len({O.split('gold')})) AS max_src_len, max(len({O.split('pred')})) AS max_trg_len
FROM doc_pairs GROUP BY ROLLUP(lang)"""


@query("length_stats_by_lang", "D1", _D1_SQL)
def length_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example count, mean and max whitespace lengths of source (gold doc) and target (next doc)."""
    p = doc_pairs(spark, sf_dir).select("lang", F.col("gold").alias("source"), F.col("pred").alias("target"))
    out = P.length_stats(p, group_cols=["lang"], rollup=True)
    return out.select("lang", "n", F.round("avg_src_len", R6).alias("avg_src_len"), F.round("avg_trg_len", R6).alias("avg_trg_len"),
                      F.col("max_src_len").cast("long").alias("max_src_len"), F.col("max_trg_len").cast("long").alias("max_trg_len"))


def punct_tokens(c):
    """A stand-in sub-word tokenizer: word runs and single punctuation marks."""
    return F.regexp_extract_all(c, F.lit(T.WORD + "+|[^" + T.WS_CHARS + T.WORD_CHARS + "]"), 0)


def _sql_punct(expr: str) -> str:
    return f"regexp_extract_all({expr}, '[\\pL\\pN_]+|[^{O.WS_SQL[1:-1]}\\pL\\pN_]')"


_D2_SQL = f"""WITH {TRIPLES},
l AS (SELECT len({O.split('smelly')}) AS ws_s, len({O.split('after')}) AS ws_a, len({O.split('after')}) + len({O.split('extracted')}) AS ws_c,
             len({_sql_punct('smelly')}) AS tk_s, len({_sql_punct('after')}) AS tk_a, len({_sql_punct('after || extracted')}) AS tk_c FROM triples)
SELECT count(*) AS n, round(avg(ws_s), 6) AS avg_src_len, round(avg(ws_a), 6) AS avg_trg_len, round(avg(ws_c), 6) AS avg_trg_col_len,
       max(ws_s) AS max_src_len, max(ws_a) AS max_trg_len, max(ws_c) AS max_trg_col_len,
       round(avg(tk_s), 6) AS avg_src_tok, round(avg(tk_a), 6) AS avg_trg_tok, round(avg(tk_c), 6) AS avg_trg_col_tok,
       max(tk_s) AS max_src_tok, max(tk_a) AS max_trg_tok, max(tk_c) AS max_trg_col_tok,
       count(*) FILTER (WHERE tk_s > 512) AS src_over, count(*) FILTER (WHERE tk_a > 512) AS trg_over,
       count(*) FILTER (WHERE tk_c > 512) AS trg_col_over FROM l"""


@query("length_stats_collated_turns", "D2 K7", _D2_SQL)
def length_stats_collated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collated length statistics of turn triples with a pluggable tokenizer."""
    out = P.length_stats_collated(turn_triples(spark, sf_dir), punct_tokens)
    fl = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[F.round(c, R6).alias(c) if c in fl else F.col(c).cast("long").alias(c) if c.startswith("max") else F.col(c)
                        for c in out.columns])


_SEQ_SQL = """SELECT d.doc_id, md5('defect: ' || replace(d.text, '</s>', '<unk>')) AS source_digest,
       CASE l.quality WHEN 0 THEN 'false' WHEN 1 THEN 'true' END AS target,
       '<java> ' || CASE l.toxic WHEN 0 THEN 'false' WHEN 1 THEN 'true' END AS tagged_target
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""


@query("seq2seq_fields_labels", "B8 B9 B10 B11", _SEQ_SQL)
def seq2seq_fields_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-to-text fields for labelled documents: task prefix, special-token escape,
    label as text and a language tag."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id")
    return j.select("doc_id", F.md5(P.apply_task_prefix(P.escape_special(F.col("text")), "defect")).alias("source_digest"),
                    P.label_to_text(F.col("quality")).alias("target"),
                    P.apply_lang_tag(P.label_to_text(F.col("toxic")), "refine").alias("tagged_target"))


_TOX_SQL = f"""SELECT d.doc_id, array_to_string({O.split('d.text')}[1:5 + (('0x' || substr(md5('42:' || d.doc_id::VARCHAR), 1, 8))::BIGINT % 5)], ' ') AS query
FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic IS NOT NULL AND l.toxic > 0.3"""


@query("toxicity_prompts", "B12", _TOX_SQL)
def toxicity_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (halved into prompt and continuation) whose toxicity exceeds 0.3, joined and cut to a sampled 5-9 tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("toxicity"))
    cut = F.floor(F.length("text") / 2).cast("int")
    d = d.select("doc_id", F.substring("text", F.lit(1), cut).alias("prompt"), F.substring("text", cut + 1, F.length("text")).alias("continuation"))
    return P.toxicity_queries(d.join(lab, "doc_id"), "doc_id", "prompt", "continuation", "toxicity")


def _nist_sql(expr):
    return O.nist_normalize(O.split_puncts(f"lower({O.strip(expr)})"))


_NORM_SQL = f"""SELECT doc_id, len({O.split('text')}) AS n_ws_tokens, md5({O.collapse('text')}) AS collapsed_digest,
       length({O.strip('text')}) AS stripped_len, len({_nist_sql('text')}) AS n_nist_tokens,
       md5(array_to_string({_nist_sql('text')}, ' ')) AS nist_digest FROM documents"""


@query("text_normalization_docs", "H1 H2 H3 H4", _NORM_SQL)
def text_normalization_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace split / collapse / strip and the NIST tokenisation of every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    nist = T.nist_normalize(T.split_puncts(F.lower(T.py_strip(F.col("text")))))
    return d.select("doc_id", F.size(T.py_split(F.col("text"))).cast("long").alias("n_ws_tokens"),
                    F.md5(T.collapse_ws(F.col("text"))).alias("collapsed_digest"),
                    F.length(T.py_strip(F.col("text"))).cast("long").alias("stripped_len"),
                    F.size(nist).cast("long").alias("n_nist_tokens"),
                    F.md5(F.array_join(nist, " ")).alias("nist_digest"))


def plant_comments(c):
    """Turn prose into C-like text: sentence tails become line comments, questions block comments."""
    return F.replace(F.replace(c, F.lit(". "), F.lit("; // ")), F.lit("? "), F.lit("? /* q */ "))


_CLIKE_RE2 = r"""(?sm)//.*?$|/\*.*?\*/|'(?:\\.|[^\\'])*'|"(?:\\.|[^\\"])*"|[^/'"]+|."""
_STRIP_SQL = f"""WITH p AS (SELECT doc_id, replace(replace(text, '. ', '; // '), '? ', '? /* q */ ') AS t FROM documents),
s AS (SELECT doc_id, array_to_string(list_filter(string_split(array_to_string(list_transform(
        regexp_extract_all(t, '{_CLIKE_RE2.replace("'", "''")}'),
        lambda x: CASE WHEN length(x) > 1 AND starts_with(x, '/') THEN ' ' ELSE x END), ''), chr(10)),
        lambda l: {O.strip('l')} <> ''), chr(10)) AS code FROM p)
SELECT doc_id, length(code) AS code_len, md5(code) AS code_digest FROM s"""


@query("strip_comments_docs", "H7", _STRIP_SQL)
def strip_comments_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-like comment removal over documents with planted line and block comments."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.strip_comments(plant_comments(F.col("text"))).alias("code"))
    return d.select("doc_id", F.length("code").cast("long").alias("code_len"), F.md5("code").alias("code_digest"))


def plant_indent_markers(c):
    """Newlines become ``NEW_LINE INDENT`` and question marks close two levels."""
    return F.replace(F.replace(c, F.lit("\n"), F.lit(" NEW_LINE INDENT ")), F.lit("? "), F.lit("? DEDENT DEDENT "))


_WSQ = O.WS_SQL
_E1_SQL = f"""WITH p AS (SELECT doc_id, list_transform(string_split(replace(replace(text, chr(10), ' NEW_LINE INDENT '), '? ', '? DEDENT DEDENT '), 'NEW_LINE'),
                 lambda l: {O.strip('l')}) AS ls FROM documents),
d AS (SELECT doc_id, ls, list_transform(ls, lambda l: (length(l) - length(replace(l, 'INDENT', ''))) // 6 - (length(l) - length(replace(l, 'DEDENT', ''))) // 6) AS delta FROM p),
r AS (SELECT doc_id, array_to_string(list_transform(range(1, len(ls) + 1), lambda i:
        repeat(chr(9), greatest(list_sum(delta[1:i])::BIGINT, 0)) ||
        regexp_replace(regexp_replace(ls[i], 'INDENT{_WSQ}?', '', 'g'), 'DEDENT{_WSQ}?', '', 'g')), chr(10)) AS code FROM d)
SELECT doc_id, length(code) AS code_len, md5(code) AS code_digest FROM r"""


@query("restore_indentation_docs", "E1", _E1_SQL)
def restore_indentation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indentation restored from NEW_LINE / INDENT / DEDENT markers planted in documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", plant_indent_markers(F.col("text")).alias("t"))
    d = P.restore_indentation_df(d, "doc_id", "t")
    return d.select("doc_id", F.length("code").cast("long").alias("code_len"), F.md5("code").alias("code_digest"))


# ------------------------------------------------------------------ F4 / F5 / F2 / F3 / F1
_SPLIT_SQL = """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('1234:' || doc_id::VARCHAR)) - 1 AS rk,
                     count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rk < floor(0.7 * n) THEN 'train' WHEN rk < floor(0.7 * n) + floor(0.1 * n) THEN 'valid' ELSE 'test' END AS split
FROM r"""


@query("exact_split_docs", "F4", _SPLIT_SQL)
def exact_split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded shuffle split with exact sizes int(0.7 n) / int(0.1 n) / rest."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return S.exact_split(d, "doc_id", (0.7, 0.1), seed="1234").select("doc_id", "split")


_OSPLIT_SQL = """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rk, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rk < floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM r"""


@query("ordered_split_docs", "F5", _OSPLIT_SQL)
def ordered_split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 80 % of documents in id order, no shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return S.ordered_split(d, "doc_id", 0.8).select("doc_id", "split")


_SAMPLE_SQL = """SELECT doc_id, lang FROM documents ORDER BY md5('1234:' || doc_id::VARCHAR) LIMIT 5000"""


@query("sample_docs", "F2", _SAMPLE_SQL)
def sample_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min(5000, n) documents without replacement (seeded)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.sample_n(d, "doc_id", 5000, seed="1234")


_FRAC_SQL = """SELECT doc_id, lang FROM documents ORDER BY md5('1234:' || doc_id::VARCHAR)
LIMIT (SELECT floor(0.1 * count(*))::BIGINT FROM documents)"""


@query("sample_frac_docs", "F3", _FRAC_SQL)
def sample_frac_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly int(0.1 n) documents (seeded)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.sample_frac(d, "doc_id", 0.1, seed="1234")


_HEAD_SQL = "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100"


@query("head_docs", "F1", _HEAD_SQL)
def head_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first data_num = 100 examples (the limit is the operator)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.head(d, "doc_id", 100)


_BATCH_SQL = """SELECT doc_id, row_number() OVER (ORDER BY md5('1234:' || doc_id::VARCHAR)) - 1 AS idx,
       (row_number() OVER (ORDER BY md5('1234:' || doc_id::VARCHAR)) - 1) // 8 AS batch FROM documents"""


@query("batches_docs", "E6 E11", _BATCH_SQL)
def batches_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense row index in seeded shuffled order and fixed batches of 8."""
    d = table(spark, sf_dir, "documents").select("doc_id", S.hash_key("1234", "doc_id").alias("_k"))
    out = S.batch_assign(d, ["_k"], 8)
    return out.select("doc_id", F.col("_idx").alias("idx"), "batch")


_PROBS_SQL = """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
q AS (SELECT lang, n, pow(n / sum(n) OVER (), 0.7) AS q FROM c)
SELECT lang, n, round(q / sum(q) OVER (), 6) AS prob FROM q"""


@query("task_probs_docs", "F6", _PROBS_SQL)
def task_probs_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-task sampling probabilities, p proportional to (n_i / N)^0.7, language as task."""
    d = table(spark, sf_dir, "documents").select("lang")
    out = S.task_sampling_probs(d, "lang")
    return out.select("lang", "n", F.round("prob", R6).alias("prob"))


_SCHED_SQL = """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
q AS (SELECT lang, pow(n / sum(n) OVER (), 0.7) AS q FROM c),
p AS (SELECT lang, q / sum(q) OVER () AS prob FROM q),
b AS (SELECT lang, sum(prob) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
             row_number() OVER (ORDER BY lang DESC) AS last_rank FROM p),
u AS (SELECT event_id, ('0x' || substr(md5('1234:' || event_id::VARCHAR), 1, 13))::BIGINT / pow(16, 13) AS u FROM events)
SELECT u.event_id, coalesce((SELECT lang FROM b WHERE u.u < b.hi ORDER BY b.hi LIMIT 1), (SELECT lang FROM b WHERE last_rank = 1)) AS task
FROM u"""


@query("task_schedule_events", "F7", _SCHED_SQL)
def task_schedule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per step (each event is a step) drawn with the language sampling probabilities."""
    probs = S.task_sampling_probs(table(spark, sf_dir, "documents").select("lang"), "lang")
    steps = table(spark, sf_dir, "events").select("event_id")
    return S.task_schedule(steps, "event_id", probs, "lang", seed="1234")


_STOPPED_SQL = f"""WITH d AS ({_SCHED_SQL}),
s AS (SELECT task, max(event_id) FILTER (WHERE event_id % 3 = 0) * (1 + length(task) % 2) // 4 AS stop_at FROM d GROUP BY task),
k AS (SELECT d.event_id, d.task, CASE WHEN s.stop_at IS NOT NULL AND d.event_id >= s.stop_at THEN 1 ELSE 0 END AS skip FROM d JOIN s USING (task)),
r AS (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM k),
l AS (SELECT *, max(CASE WHEN skip = 0 THEN i ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM r),
e AS (SELECT min(i) AS stop FROM l WHERE i - last > 50)
SELECT event_id, task, row_number() OVER (ORDER BY event_id) AS step FROM l, e WHERE skip = 0 AND i < coalesce(stop, 1e18)"""


@query("stopped_schedule_events", "F7", _STOPPED_SQL)
def stopped_schedule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn schedule when tasks stop early: draws of stopped tasks are skipped, over 50 skips in a row end training."""
    probs = S.task_sampling_probs(table(spark, sf_dir, "documents").select("lang"), "lang")
    drawn = S.task_schedule(table(spark, sf_dir, "events").select("event_id"), "event_id", probs, "lang", seed="1234")
    stops = drawn.groupBy("task").agg(F.max(F.when(F.col("event_id") % 3 == 0, F.col("event_id"))).alias("m")) \
        .select("task", F.floor(F.col("m") * (1 + F.length("task") % 2) / 4).alias("stop_at"))
    return EV.stopped_schedule(drawn, "event_id", "task", stops)


# ------------------------------------------------------------------ B1
_REPO_SQL = """SELECT page_id, split_part(string_split(url, '/')[-1], '.', 1) AS repo_name,
       'https://github.com/' || split_part(string_split(url, '/')[-1], '.', 1) || '.git' AS repo_url FROM pages"""


@query("repo_names_pages", "B1", _REPO_SQL)
def repo_names_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository name from a URL (last path segment before the first dot) and the clone URL."""
    from pairforge.operators.mining import repo_name, repo_url
    p = table(spark, sf_dir, "pages").select("page_id", repo_name(F.col("url")).alias("repo_name"))
    return p.select("page_id", "repo_name", repo_url(F.col("repo_name")).alias("repo_url"))


# ------------------------------------------------------------------ E9
_LEX_RE2 = T._JAVA_LEX.replace("*+", "*").replace("++", "+").replace("'", "''")
_KW_SQL = ", ".join("'" + k + "'" for k in JAVA + ["true", "false", "null"])
_E9_SQL = f"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '{_LEX_RE2}') AS toks FROM documents),
t AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM l),
k AS (SELECT doc_id, pos, tok, CASE WHEN tok IN ({_KW_SQL}) THEN ''
             WHEN regexp_full_match(tok, '0|[1-9][0-9_]*[lL]?') THEN 'DECIMALINTEGER'
             WHEN regexp_full_match(tok, '[\\pL_$][\\pL\\pN_$]*') THEN 'IDENTIFIER' ELSE '' END AS kind FROM t),
c AS (SELECT *, sum(CASE WHEN kind <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS cnt FROM k)
SELECT doc_id, count(*) AS n_tokens, sum(CASE WHEN kind <> '' THEN 1 ELSE 0 END)::BIGINT AS n_abstracted,
       md5(string_agg(CASE WHEN kind <> '' THEN kind || '_' || cnt::VARCHAR ELSE tok END, ' ' ORDER BY pos)) AS digest
FROM c GROUP BY doc_id"""


@query("abstract_identifiers_docs", "E9 H9", _E9_SQL)
def abstract_identifiers_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier / integer abstraction with one running counter per document (window form)."""
    from pairforge.operators.mining import abstract_identifiers_df
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return abstract_identifiers_df(d, "doc_id", "text", JAVA).select("doc_id", "n_tokens", "n_abstracted", "digest")
