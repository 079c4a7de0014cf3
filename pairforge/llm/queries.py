"""Registered queries of the operators (thin: each derives its digest columns from its operator)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import bpe, chat, extract, jaccard, langid, licenses, pii, repair, resample, secrets, trie, vectors, winnow
from pairforge.sources.tables import table


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), digests=True, keep=False)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(same).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_chat(turns).withColumns({"turns": chat.parse(F.col("formatted")),
                                               "loss": chat.under_mask(F.col("formatted"), F.col("loss_spans"))})
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(F.col("id").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
                      F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                      F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("bigint").alias("formatted_chars"))


def op2_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND coalesce(toxic, 0) = 0")
    return resample.resample(table(spark, sf_dir, "documents"), good).withColumnRenamed("id", "doc_id")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


def _span_digests(out: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Counts of the fixed kinds, the digest of their spans and all spans, as kind:start:end."""
    def text(s):
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & s["base"])).cast("bigint")

    return out.select(
        F.col("id").alias("doc_id"),
        *(count(kind).alias(column) for column, kind in kinds.items()),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["base"]), text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(secrets.find_secrets(table(spark, sf_dir, "documents")),
                         {"n_assign": "assign", "n_access": "access", "n_hex": "hex"})


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.transform("base", lambda x: x["label"])
    words = F.transform("base", lambda x: x["word"])
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.transform("found", lambda x: x["label"]))), ",").alias("labels"),
        "score")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    field = langid.fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), field, shares=False, spans=True) \
        .select(F.col("id").alias("doc_id"), "lang", "score", F.size("spans").cast("bigint").alias("n_spans")).withColumnRenamed("lang", "lang_pred") \
        .withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))) \
        .select("doc_id", "held_out", "lang_pred", "score", "n_spans")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(pii.find_personal(table(spark, sf_dir, "documents")), {f"n_{k}": k for k in pii.KINDS})


def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = repair.damage(table(spark, sf_dir, "conversations"))
    found, turns = repair.repair(turns, copies=F.col("copies"))
    return found.join(repair.digests(turns).withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id"))).select(
        F.col("id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("sha256").alias("repaired_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.prefix_trie(*trie.rebuild(table(spark, sf_dir, "conversations")))
    return nodes.select(F.col("id").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("page"), "html")
    return extract.extract(pages, id_col="page").select("id.page_id", "id.url", "text", "n_chars")


SQL_OP1 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + len(regexp_extract_all(role, '<\\*/?s>')) + len(regexp_extract_all(role, '\[\\*/?INST\]')) AS r,
             length(text) + len(regexp_extract_all(text, '<\\*/?s>')) + len(regexp_extract_all(text, '\[\\*/?INST\]')) AS t,
             coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS opens FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(13 + t + CASE WHEN opens THEN 7 + r ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

#: windows of 13 words of items and documents as lists of words, met by equality
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
         r"'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"
SQL_OP10 = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: distinct 4-word shingles as lists; pairs met on a shingle, all intersections counted; components by recursion
SQL_OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 3] AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""



def _sql_crc32(key: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    return ("xor(4294967295, list_reduce(list_transform(string_split(" + key + ", ''), lambda x: ascii(x)::BIGINT), lambda acc, b: "
            "list_reduce(range(8), lambda a, i: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END), xor(acc, b)), 4294967295::BIGINT))")


def _sql_best(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _sql_way(state: str, cost: str, edit: str, line: str, when: str = "") -> str:
    way = f"{{'c': {state}.c + {cost}, 'e': {state}.e || '{edit}', 'r': {line}}}"
    return f"CASE WHEN {state} IS NOT NULL{' AND ' + when if when else ''} THEN {way} END"


def _sql_inserted(acc: str) -> str:
    """States (before all, after s, u, a) once turns may have been inserted."""
    def put(state, role):
        return _sql_way(state, "3", "I", f"list_append({state}.r, '{role}:')")
    user = f"list_transform({acc}, lambda a: [a[1], a[2], {_sql_best('a[3]', *(put(f'a[{k}]', 'user') for k in (1, 2, 4)))}, a[4]])"
    return f"list_transform({user}, lambda a: [a[1], a[2], a[3], {_sql_best('a[4]', put('a[3]', 'assistant'))}])"


def _sql_op11() -> str:
    """The cheapest edits as a fold over the turns that keeps the least (cost, edits) for each role reached."""
    def stay(state, kind):  # keep, or give the role that must follow
        more = "CASE WHEN t.f = 2 THEN 3 ELSE 0 END"
        if kind in ("s", "u", "a"):
            return _sql_way(state, more, "K", f"list_append({state}.r, t.role || ':' || t.text)", f"t.f <> 1 AND t.q = '{kind}'")
        return _sql_way(state, f"3 + {more}", "R", f"list_append({state}.r, '{kind}:' || t.text)", "t.f <> 1")

    def gone(state):
        return _sql_way(state, "4", "D", f"{state}.r")
    after_user = [x for k in (1, 2, 4) for x in (stay(f"b[{k}]", "u"), stay(f"b[{k}]", "user"))]
    step = ", ".join([_sql_best(gone("b[1]")), _sql_best(gone("b[2]"), stay("b[1]", "s")), _sql_best(gone("b[3]"), *after_user),
                      _sql_best(gone("b[4]"), stay("b[3]", "a"), stay("b[3]", "assistant"))])
    none = "NULL::STRUCT(c BIGINT, e VARCHAR, r VARCHAR[])"
    start = f"[{{'c': 0::BIGINT, 'e': '', 'r': []::VARCHAR[]}}, {none}, {none}, {none}]"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE k <> 0),
o AS (SELECT *, coalesce(nullif(left(role, 1), ''), ' ') AS q,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth,
             regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM d),
t AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS kind,
             lag(q) OVER (PARTITION BY conv_id ORDER BY i) || q AS pair FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
             count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate, count(*) FILTER (kind = 't') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM t GROUP BY conv_id),
s AS (SELECT conv_id, 0::BIGINT AS i, {_sql_inserted(f'[{start}]')}[1] AS st FROM c
      UNION ALL
      SELECT s.conv_id, t.i, {_sql_inserted(f"list_transform([s.st], lambda b: [{step}])")}[1]
      FROM s JOIN (SELECT *, CASE kind WHEN '' THEN 0 WHEN 't' THEN 2 ELSE 1 END AS f FROM t) t
        ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = s.i + 1),
e AS (SELECT c.*, {_sql_best('st[1]', 'st[4]')} AS b FROM c JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.e, '') AS audit,
       sha256(coalesce(array_to_string(b.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _sql_op12() -> str:
    """Prefixes as lists of turns; a node's ancestors are the nodes of its smallest member at smaller depths."""
    return f"""
WITH t AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                  ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {_sql_crc32("c::VARCHAR")} % 6 AS h FROM t),
r AS (SELECT h.c, list_concat(coalesce(t.l[1:h], []), h.l[h + 1:]) AS l FROM h LEFT JOIN t ON t.c = h.c - h.c % 100),
p AS (SELECT c, d, len(l) AS n, l[1:d] AS prefix FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM r)),
g AS MATERIALIZED (
  SELECT prefix, d, min(c) AS node, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends
  FROM p GROUP BY prefix, d),
m AS MATERIALIZED (SELECT p.c, p.d, g.node FROM p JOIN g ON p.d = g.d AND p.prefix = g.prefix),
k AS (SELECT g.*, m.node AS parent, CASE WHEN g.d = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[g.d].text) END AS w
      FROM g LEFT JOIN m ON m.c = g.node AND m.d = g.d - 1),
n AS (SELECT parent, d - 1 AS d, count(*) AS n FROM k WHERE d > 0 GROUP BY ALL),
f AS (SELECT k.*, coalesce(n.n, 0) AS n_children FROM k LEFT JOIN n ON n.parent = k.node AND n.d = k.d),
s AS (SELECT m.node, m.d, sum(w)::BIGINT AS saved, count(*) FILTER (n_children = 0) AS leaves
      FROM f JOIN m ON m.c = f.node AND m.d <= f.d GROUP BY ALL)
SELECT f.node AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.leaves AS n_leaves,
       s.saved AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s ON s.node = f.node AND s.d = f.d
"""


QUERIES = {
    "op1_chat": op1_chat,
    "op2_resample": op2_resample,
    "op3_jaccard": op3_jaccard,
    "op4_secrets": op4_secrets,
    "op5_vectors": op5_vectors,
    "op6_licenses": op6_licenses,
    "op7_langid": op7_langid,
    "op9_pii": op9_pii,
    "op10_winnow": op10_winnow,
    "op8_bpe": op8_bpe,
    "op11_repair": op11_repair,
    "op12_trie": op12_trie,
    "op13_extract": op13_extract,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat": SQL_OP1,
    "op3_jaccard": SQL_OP3,
    "op5_vectors": SQL_OP5,
    "op10_winnow": SQL_OP10,
    "op11_repair": _sql_op11(),
    "op12_trie": _sql_op12(),
}
