"""Corpus pipeline: language identification, near-duplicate removal, benchmark decontamination, redaction, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all of ``docs`` and returns
a DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.  Every stage accepts nulls in any column, repeated rows, empty tables (an empty result), texts of
any length (read whole) and further columns (which it passes on).  Ties between near copies go to the smallest id, then to the
smallest digest of the text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import bpe, jaccard, langid, pii, winnow
from pairforge.llm._arrow import scratch
from pairforge.sources.tables import table

#: a document whose best language has a smaller mean word probability is no text of one language
MIN_LANGUAGE_SCORE = 0.5
#: near copies share four fifths or more of their runs of five words (op3's own contract has 4 words and 0.85)
NEAR_WORDS, NEAR_THRESHOLD = 5, (80, 100)


#: bytes of rows that cross into Python at once, unless the session has a setting of its own (Spark's default is 64 MB a task)
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH, "64m") in ("64m", "64MB", "67108864b"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def _rest(docs: DataFrame) -> Column:
    """All columns but the text, as one."""
    return F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row")


def _back(c: str) -> Column:
    return F.col("text") if c == "text" else F.col(f"id.`{c}`").alias(c)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those in which no language prevails; a missing ``lang`` is filled in.

    Where no language could be learned, all documents with letters stay as they are."""
    _small_batches(spark)
    field = langid.fit(docs.select("doc_id", "text", "lang"))
    if not field.learned():
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs.select(_rest(docs), "text"), field, id_col="_row", shares=False, keep_text=True)
    kept = found.filter((F.col("lang") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*(F.coalesce(F.col("id.lang"), F.col("lang")).alias(c) if c == "lang" else _back(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id (then the smallest digest of its text) stays, once.

    A row without id comes after all that have one, so it stays only where no near copy has an id."""
    _small_batches(spark)
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
                   F.md5(F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit(""))).alias("text"))
    keyed = docs.withColumn("_key", key)
    found = jaccard.near_duplicates(keyed.select("_key", "text"), id_col="_key", k=NEAR_WORDS, threshold=NEAR_THRESHOLD)
    kept = found.filter("id = component_id").select(F.col("id").alias("_key")).distinct()
    # a repeated row is its own copy
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages are a twentieth of the words or more."""
    _small_batches(spark)
    found = winnow.decontaminate(docs.select(_rest(docs), "text"), table(spark, sf_dir, "benchmark"), id_col="_row", keep_text=True)
    return found.filter("NOT contaminated").select(*(_back(c) for c in docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` counts the new text."""
    _small_batches(spark)
    trees = pii.fit(docs.select("doc_id", "text"))
    rest = [c for c in docs.columns if c != "text"]
    keyed = docs.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in rest)))
    found = pii.find_personal(keyed.select("_row", "text"), id_col="_row", trees=trees, redact=True)

    def column(c: str):
        if c == "text":
            return F.col("redacted").alias("text")
        if c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            return F.when(F.col("redacted").isNull(), F.col("id.n_chars")).otherwise(F.length("redacted")).cast(kind).alias(c)
        return F.col(f"id.`{c}`").alias(c)

    return found.select(*(column(c) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the text decoded from them."""
    _small_batches(spark)
    out = bpe.encode(docs.select("doc_id", "text"), digests=True)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("redact", redact), ("tokens", tokens)]

#: learned stages have no SQL; tests hold the pipeline against its operators' brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
