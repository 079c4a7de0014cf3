"""Registered queries for nested records, mining tables and id encoding."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import arrays as A
from pairforge.functions import text as T
from pairforge.operators import bpe_rounds as BR
from pairforge.operators import encode as EN
from pairforge.operators import evallog as EV
from pairforge.operators import jsonops as J
from pairforge.operators import mining as M
from pairforge.plans import oracle as O
from pairforge.plans.catalog import query
from pairforge.sources.tables import table

R6 = 6

_FLAT_SQL = """SELECT event_id, json_extract(props, '$.k')::BIGINT AS "stats/k", value AS "stats/value",
       event_type AS "meta/type", user_id AS "meta/run" FROM events"""


@query("flatten_stats_events", "B15", _FLAT_SQL)
def flatten_stats_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested step statistics (parsed JSON props + value) flattened to ``a/b`` columns."""
    e = table(spark, sf_dir, "events")
    nested = e.select(F.col("event_id"), F.struct(F.from_json("props", "k long")["k"].alias("k"), F.col("value").alias("value")).alias("stats"),
                      F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("run")).alias("meta"))
    return J.flatten_struct(nested)


# fixed values: the messages of a unit-test request
SYSTEM = ("You are a helpful software engineer assistant. Your task is to create test cases for given methods. "
          "Don't forget to include edge cases. Don't output anything else than the test cases. ")
METHOD, CLASS = "Write Unit Test case for the following method:\n\n", "\n\n. The method is in the following class:\n\n"
STRICT = "Make sure to output STRICTLY the test cases. Do not output anything else."


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_REQ_SQL = f"""WITH r AS (SELECT doc_id, to_json({{'custom_id': 'request-' || doc_id::VARCHAR, 'method': 'POST', 'url': '/v1/chat/completions',
    'body': {{'model': 'chat-model', 'messages': [{{'role': 'system', 'content': {_quoted(SYSTEM)}}},
        {{'role': 'user', 'content': {_quoted(METHOD)} || text || {_quoted(CLASS)} || 'public class Template {{' || chr(10) || text || chr(10) || '}}'}},
        {{'role': 'user', 'content': {_quoted(STRICT)}}}]}}}}) AS request FROM documents)
SELECT doc_id, length(request) AS request_len, md5(request) AS request_digest FROM r"""


@query("batch_requests_docs", "B17 H23", _REQ_SQL)
def batch_requests_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit-test request per document (JSON text): system, method with its class, and a last reminder."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    user = F.concat(F.lit(METHOD), F.col("text"), F.lit(CLASS), T.wrap_class(F.col("text")))
    messages = [("system", F.lit(SYSTEM)), ("user", user), ("user", F.lit(STRICT))]
    r = J.build_batch_requests(d, "doc_id", messages, "chat-model")
    return r.select("doc_id", F.length("request").cast("long").alias("request_len"), F.md5("request").alias("request_digest"))


_RES_SQL = """SELECT 'request-' || conv_id::VARCHAR || '-' || turn::VARCHAR AS custom_id, md5(text) AS content_digest
FROM conversations WHERE role = 'assistant'"""


@query("batch_results_conversations", "B18", _RES_SQL)
def batch_results_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch results (assistant turns serialised as API responses) parsed back to id and content."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    resp = F.to_json(F.struct(
        F.concat(F.lit("request-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("custom_id"),
        F.struct(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    parsed = J.parse_batch_results(c.select(resp.alias("j")), "j")
    return parsed.select("custom_id", F.md5("content").alias("content_digest"))


_PARENT_SQL = """WITH c AS (SELECT user_id AS repo, event_id AS sha, event_type,
       lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS parent_sha FROM events)
SELECT c.repo, c.sha, c.parent_sha, p.event_type AS parent_event_type FROM c LEFT JOIN c p ON p.repo = c.repo AND p.sha = c.parent_sha"""


def commits_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, sha, parents, event_type``: each event is a commit whose parent is the
    user's previous event (found with the sliced prefix scan, not a per-user window)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), F.col("event_id").alias("sha"), "ts", "event_type")
    s = EV.running(e, "repo", "ts", [EV.Scan("_prev", F.struct("ts", "sha"), "max", inclusive=False)])
    return s.select("repo", "sha", F.when(F.col("_prev").isNotNull(), F.array(F.col("_prev.sha"))).otherwise(
        F.array().cast("array<bigint>")).alias("parents"), "event_type")


@query("first_parent_events", "C4", _PARENT_SQL)
def first_parent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit -> first parent self-join; root commits keep a null parent."""
    fp = M.first_parent(commits_from_events(spark, sf_dir))
    return fp.select("repo", "sha", "parent_sha", F.col("parent_event_type"))


_D18_SQL = """SELECT user_id AS repo, count(*) AS n_refactorings, count(*) > 0 AS has_refactoring
FROM events WHERE event_type = 'purchase' GROUP BY user_id"""


@query("refactorings_per_repo_events", "B2 D18 K5", _D18_SQL)
def refactorings_per_repo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type counted per repository (user)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), F.col("event_type").alias("type"))
    return M.refactorings_per_commit(M.filter_refactorings(e, "purchase"), "repo")


_LINES = "list_filter(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: true)"
_SLICE_SQL = """WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS parts FROM documents),
l AS (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS ls FROM p)
SELECT doc_id,
  md5(coalesce(array_to_string(list_transform(list_filter(list_transform(ls, lambda x, i: {'n': i, 'l': x}), lambda s: s.n >= 2 AND s.n <= 3), lambda s: s.l || chr(10)), ''), '')) AS method_digest,
  md5(coalesce(array_to_string(list_transform(list_filter(list_transform(ls, lambda x, i: {'n': i, 'l': x}), lambda s: s.n < 2 OR s.n > 3), lambda s: s.l || chr(10)), ''), '')) AS class_digest
FROM l"""


@query("slice_lines_docs", "C6", _SLICE_SQL)
def slice_lines_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2-3 of each document as the method, the rest as its class text."""
    d = table(spark, sf_dir, "documents").select("doc_id", M.slice_lines(F.col("text"), F.lit(2), F.lit(3)).alias("s"))
    return d.select("doc_id", F.md5("s.method").alias("method_digest"), F.md5("s.class_text").alias("class_digest"))


_VOCAB_SQL = f"""SELECT token, count(*) AS count FROM (SELECT unnest({O.split('text')}) AS token FROM documents)
GROUP BY token HAVING count(*) >= 3"""


@query("vocab_counts_docs", "D26", _VOCAB_SQL)
def vocab_counts_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace-token frequencies of the corpus, kept from three occurrences."""
    d = table(spark, sf_dir, "documents").select(T.py_split(F.col("text")).alias("t"))
    return EN.vocab_counts(d, "t", 3)


_ENC_SQL = f"""WITH v AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) - 1 + 4 AS id FROM (
    SELECT token, count(*) AS c FROM (SELECT unnest({O.split('text')}) AS token FROM documents) GROUP BY token HAVING count(*) >= 3)),
t AS (SELECT doc_id, unnest({O.split('text')}) AS token, generate_subscripts({O.split('text')}, 1) AS pos FROM documents),
e AS (SELECT t.doc_id, list(coalesce(v.id, 3)::INTEGER ORDER BY t.pos) AS ids FROM t LEFT JOIN v ON v.token = t.token GROUP BY t.doc_id),
f AS (SELECT d.doc_id, coalesce(e.ids, []::INTEGER[])[1:511] || [2] AS x FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id),
g AS (SELECT doc_id, x || list_transform(range(512 - len(x)), lambda i: 0) AS ids FROM f)
SELECT doc_id, len(list_filter(ids, lambda i: i <> 0)) AS gen_len, list_sum(ids)::BIGINT AS id_sum,
       len(list_filter(ids, lambda i: i = 0)) AS n_masked, md5(array_to_string(ids, ',')) AS ids_digest FROM g"""


@query("encode_docs", "D26 E6 H10 H11 H12 D19", _ENC_SQL)
def encode_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded with the corpus vocabulary to 512 ids (EOS, padding, masks)."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.py_split(F.col("text")).alias("t"))
    vocab = EN.build_vocab(EN.vocab_counts(d, "t", 3))
    enc = EN.encode(d, "doc_id", "t", vocab, 512)
    labels = A.mask_labels("ids")
    return enc.select("doc_id", A.gen_len("ids").cast("long").alias("gen_len"),
                      F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
                      F.size(F.filter(labels, lambda x: x == -100)).cast("long").alias("n_masked"),
                      F.md5(F.array_join("ids", ",")).alias("ids_digest"))


NUM_MERGES = 20


def _bpe_ctes(rounds: int) -> str:
    """Training as one pair of CTEs a round: the most frequent neighbouring pair, and the words with it merged.
    A word is a string of symbols between the marks chr(1) and chr(2), so replacing merges left to right."""
    out = [f"""w0 AS MATERIALIZED (SELECT token, count(*) AS c,
      array_to_string(list_transform(regexp_extract_all(token, '(?s).'), lambda x: chr(1) || x || chr(2)), '') AS s
    FROM (SELECT unnest({O.split('text')}) AS token FROM documents) GROUP BY token)"""]
    for r in range(rounds):
        out.append(f"""y{r} AS (SELECT c, string_split(s[2:length(s) - 1], chr(2) || chr(1)) AS l FROM w{r}),
p{r} AS MATERIALIZED (SELECT a, b, sum(c) AS n FROM (SELECT c, unnest(l[1:len(l) - 1]) AS a, unnest(l[2:len(l)]) AS b FROM y{r} WHERE len(l) > 1)
      GROUP BY a, b ORDER BY n DESC, a, b LIMIT 1),
w{r + 1} AS MATERIALIZED (SELECT token, c, coalesce(replace(s, chr(1) || a || chr(2) || chr(1) || b || chr(2), chr(1) || a || b || chr(2)), s) AS s
      FROM w{r} LEFT JOIN (SELECT * FROM p{r} WHERE n >= 3) ON true)""")
    return "WITH " + ",\n".join(out)


_MERGES_SQL = _bpe_ctes(NUM_MERGES) + " " + " UNION ALL ".join(
    f"SELECT {r}::INTEGER AS rank, a AS \"left\", b AS \"right\", n::BIGINT AS count FROM p{r} WHERE n >= 3" for r in range(NUM_MERGES))


def _bpe_merges(spark: SparkSession, sf_dir: str, num_merges: int = NUM_MERGES) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(T.py_split(F.col("text")).alias("t"))
    return EN.bpe_train(EN.vocab_counts(d, "t", 1), num_merges)


@query("bpe_merges_docs", "D26 D27", _MERGES_SQL)
def bpe_merges_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 byte-pair merges learned from all words of the corpus."""
    return _bpe_merges(spark, sf_dir)


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(T.py_split(F.col("text")).alias("t"))
    return BR.vocabulary(EN.vocab_counts(d, "t", 1), vocab_size=32_000, min_frequency=3)


@query("bpe_encode_docs", "D27 D28")
def bpe_encode_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded with the merges that the corpus's words have down to three occurrences or a full vocabulary: tokens and
    pieces per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.py_split(F.col("text")).alias("t"))
    enc = EN.bpe_encode(d, "doc_id", "t", _vocabulary(spark, sf_dir))
    return enc.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.size("pieces")).alias("n_pieces"))


@query("bpe_vocabulary_docs", "D26 D27")
def bpe_vocabulary_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merges of a whole vocabulary (32,000 entries, pairs from three occurrences on) learned from all words of the corpus."""
    return _vocabulary(spark, sf_dir)


@query("bpe_pieces_docs", "D27 D28")
def bpe_pieces_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded with the whole vocabulary: tokens and pieces per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.py_split(F.col("text")).alias("t"))
    enc = EN.bpe_encode(d, "doc_id", "t", _vocabulary(spark, sf_dir))
    return enc.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.size("pieces")).alias("n_pieces"))


_ELAPSED_SQL = """WITH s AS (SELECT user_id AS run, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs FROM events GROUP BY user_id)
SELECT run, CASE WHEN secs > 3600 THEN floor(secs / 3600)::BIGINT::VARCHAR || 'h' || floor((secs % 3600) / 60)::BIGINT::VARCHAR || 'm'
                 ELSE floor((secs % 3600) / 60)::BIGINT::VARCHAR || 'm' END AS elapsed FROM s"""


@query("elapsed_text_events", "H21", _ELAPSED_SQL)
def elapsed_text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run time of every user's event stream as ``{h}h{m}m`` text."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(
        ((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6).alias("secs"))
    return e.select("run", T.elapsed_text(F.col("secs")).alias("elapsed"))


_WRAP_SQL = """SELECT conv_id, turn, md5('public class Template {' || chr(10) || replace(text, chr(9), ' ') || chr(10) || '}') AS digest
FROM conversations WHERE role = 'assistant'"""


@query("wrap_class_turns", "H22 H23", _WRAP_SQL)
def wrap_class_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns, tabs as spaces, wrapped in a template class."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", F.md5(T.wrap_class(T.tabs_to_spaces(F.col("text")))).alias("digest"))


_COLLATE_SQL = f"""WITH v AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) - 1 + 4 AS id FROM (
    SELECT token, count(*) AS c FROM (SELECT unnest({O.split('text')}) AS token FROM documents) GROUP BY token HAVING count(*) >= 3)),
t AS (SELECT doc_id, unnest({O.split('text')}) AS token FROM documents),
e AS (SELECT t.doc_id, count(*) AS n FROM t GROUP BY t.doc_id),
b AS (SELECT d.doc_id, d.doc_id // 8 AS batch, coalesce(e.n, 0) AS n FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id),
m AS (SELECT batch, max(n) AS mx FROM b GROUP BY batch)
SELECT b.doc_id, b.batch, m.mx::BIGINT AS padded_len, b.n::BIGINT AS attention FROM b JOIN m USING (batch)"""


@query("collate_batches_docs", "K8 H13 H12", _COLLATE_SQL)
def collate_batches_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id arrays of whole texts padded to the longest of their batch of 8, with attention masks."""
    from pairforge.registry import collate_batch
    d = table(spark, sf_dir, "documents").select("doc_id", T.py_split(F.col("text")).alias("t"))
    vocab = EN.build_vocab(EN.vocab_counts(table(spark, sf_dir, "documents").select(T.py_split(F.col("text")).alias("t")), "t", 3))
    enc = EN.encode(d, "doc_id", "t", vocab, None, add_eos=False)
    enc = enc.select("doc_id", "ids", (F.col("doc_id") / 8).cast("long").alias("batch"))
    out = collate_batch(enc, "batch", "ids", EN.PAD)
    return out.select("doc_id", "batch", F.size("ids").cast("long").alias("padded_len"),
                      F.aggregate(A.attention_mask("ids"), F.lit(0).cast("long"), lambda a, x: a + x).alias("attention"))


_CLONE_SQL = f"""WITH i AS (SELECT doc_id AS url1, doc_id + 1 AS url2, quality AS label FROM labels)
SELECT i.url1, i.url2, md5({O.collapse('a.text')}) AS source_digest, md5({O.collapse('b.text')}) AS target_digest, i.label
FROM i JOIN documents a ON a.doc_id = i.url1 JOIN documents b ON b.doc_id = i.url2"""


@query("clone_pairs_labels", "A10 C2", _CLONE_SQL)
def clone_pairs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone-detection pairs: each labelled document against the next id, both looked up
    in the code table and kept only when both exist."""
    from pairforge.sources.readers import clone_pairs
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("url1"), (F.col("doc_id") + 1).alias("url2"),
                                                 F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("func"))
    out = clone_pairs(lab, docs)
    return out.select("url1", "url2", F.md5("source").alias("source_digest"), F.md5("target").alias("target_digest"), "label")


_UNION_SQL = """WITH u AS (SELECT 0 AS file_no, text FROM documents UNION ALL SELECT 1, text FROM benchmark
                  UNION ALL SELECT 2, text FROM conversations)
SELECT file_no, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM u GROUP BY file_no"""


@query("merged_corpus", "G1", _UNION_SQL)
def merged_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three text sources concatenated (UNION ALL, source number kept) and summarised."""
    parts = [table(spark, sf_dir, t).select(F.lit(i).alias("file_no"), "text")
             for i, t in enumerate(("documents", "benchmark", "conversations"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("file_no").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).cast("long").alias("n_chars"))
