"""Readers for the reference's file formats.

All are lazy DataFrame readers with explicit schemas (column pruning and
permissive parsing: a malformed record lands in ``_corrupt_record`` instead of
failing the job).  Line numbers, where a format is positional, follow the files'
paths and offsets: rows are numbered within their file split and the splits' row
counts (one row per split) give the offsets.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.functions.text import collapse_ws, py_strip
from pairforge.operators.prepare import text_to_label
from pairforge.session import ensure_checkpoint_dir
from pairforge.sources import catalog

CORRUPT = "_corrupt_record"

ITEM_SCHEMA = "name string, defaultBranch string"
TRIPLE_SCHEMA = "`Smelly Sample` string, `Method after Refactoring` string, `Extracted Method` string"
CONCODE_SCHEMA = "nl string, code string"
SUMMARIZE_SCHEMA = "idx long, code_tokens array<string>, docstring_tokens array<string>"
DEFECT_SCHEMA = "idx long, func string, target int"
CLONE_DATA_SCHEMA = "idx string, func string"


def read_jsonl(spark: SparkSession, path: str, schema: str, keep_corrupt: bool = True) -> DataFrame:
    """A2: one JSON object per line; malformed lines go to ``_corrupt_record``."""
    s = schema + (f", {CORRUPT} string" if keep_corrupt else "")
    return (spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path))


def read_catalog(spark: SparkSession, path: str, member: str = "items", schema: str = ITEM_SCHEMA) -> DataFrame:
    """A1: JSON documents ``{items: [...]}``, one per file -> one row per element (a missing or empty array gives none).

    A document of any size is read by many tasks, and its text is never shuffled.  It is cut at its commas, so its pieces follow the file
    splits (``catalog.py``).  Files of several splits take two passes more: one counts quotes and brackets of each split for both
    states it may start in, and one row per split, summed up in order, gives the state it does start in; the other takes the pieces
    of elements that a split's border cuts, at most two a split, which are put together by a join of neighbours.

    An element that isn't JSON of ``schema`` lands in ``_corrupt_record``; one without text (between two commas) is left out.  Where an
    element's quotes or brackets don't balance, the rest of its document can't be told apart and lands in its elements as it is cut."""
    ensure_checkpoint_dir(spark)
    pieces = spark.read.option("lineSep", ",").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("single"))
    cut, key = pieces.filter("NOT single"), ["file", "start"]
    before, upto = (Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, x) for x in (-1, 0))

    def total(c):
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    # one row per split, as all tables that are sent to the tasks here
    t = cut.select(*key, "value").mapInArrow(catalog.totals, catalog.TOTALS).withColumn("inside", (total("quotes") % 2).cast("int"))
    t = t.withColumn("depth", total(F.when(F.col("inside") == 0, F.col("outer")).otherwise(F.col("inner"))))
    known = cut.join(F.broadcast(t.select(*key, "inside", "depth")), key)
    ends = known.select(*key, "value", "inside", "depth").mapInArrow(catalog.ends(member), catalog.ENDS).checkpoint()
    runs = ends.select(*key, "inside", "depth", F.last("opens", ignorenulls=True).over(before).alias("opens"),
                       F.last("opens", ignorenulls=True).over(upto).alias("kept"),
                       F.last(F.when(F.col("tail").isNotNull(), F.col("start")), ignorenulls=True).over(before).alias("origin"))
    whole = pieces.join(F.broadcast(runs.select(*key, "inside", "depth", "opens")), key, "left") \
        .select(*key, "value", "single", "inside", "depth", "opens").mapInArrow(catalog.elements(member), "text string")

    parts = ends.select(*key, "head", "tail").join(runs.select(*key, "origin", "kept"), key)
    parts = parts.select("file", F.explode(F.array(
        F.struct(F.col("start").alias("origin"), F.col("start").alias("part"), F.col("tail").alias("text"), F.col("kept").alias("kept")),
        F.struct(F.col("origin").alias("origin"), F.col("start").alias("part"), F.col("head").alias("text"), F.lit(None).cast("boolean").alias("kept")))).alias("x"))
    parts = parts.select("file", "x.*").filter("text IS NOT NULL").groupBy("file", "origin") \
        .agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"), F.max("kept").alias("kept"))  # one element
    joined = parts.filter("kept").select(F.array_join(F.transform("p", lambda x: x["text"]), ",").alias("text"))
    out = whole.unionByName(joined).filter(F.trim(F.translate("text", "\t\r\n", "")) != "")
    return out.select(F.from_json("text", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}).alias("it")).select("it.*")


def with_line_index(df: DataFrame, name: str = "line_no") -> DataFrame:
    """0-based line number of a freshly read file table: files in path order, lines in file order.

    Spark deals file splits out by size, so partition order is not line order.  Rows are numbered within their split
    (file path, block start) and the splits' row counts, one row per split, give each split its offset.
    """
    split = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    d = df.select("*", *split, F.monotonically_increasing_id().alias("_mid"))
    counts = d.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    before = F.sum("_n").over(Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1))
    off = counts.select("_path", "_start", "_base", F.coalesce(before, F.lit(0)).alias("_off"))
    out = d.join(F.broadcast(off), ["_path", "_start"])  # one row per split: the rows aren't shuffled
    return out.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_base")).drop("_path", "_start", "_mid", "_off", "_base")


def first_n(df: DataFrame, data_num: int, index: str = "idx") -> DataFrame:
    """The first ``data_num`` examples by line number (-1: all)."""
    return df.filter(F.col(index) < data_num) if data_num >= 0 else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their 0-based line number."""
    return with_line_index(spark.read.text(path)).withColumnRenamed("value", "line")


def collate(spark: SparkSession, folder: str, out: str | None = None) -> DataFrame:
    """A3: every file of a folder (not recursive) as lines with their source file;
    written as one text dataset when ``out`` is given."""
    df = spark.read.option("recursiveFileLookup", False).text(folder).select("value", F.col("_metadata.file_path").alias("file_path"))
    if out:
        df.select("value").write.mode("overwrite").text(out)
    return df


def merge(spark: SparkSession, *paths: str) -> DataFrame:
    """A4: files concatenated line by line, ordered by (file_no, line_no)."""
    parts = [read_lines(spark, p).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("file_no", "line_no", "line")


def read_parallel(spark: SparkSession, src: str, trg: str, limit: int = -1) -> DataFrame:
    """Two files (or folders of part files) zipped by line number (shorter wins), stripped, first ``limit``."""
    a = read_lines(spark, src).select(F.col("line_no").alias("idx"), py_strip(F.col("line")).alias("source"))
    b = read_lines(spark, trg).select(F.col("line_no").alias("idx"), py_strip(F.col("line")).alias("target"))
    return first_n(a, limit).join(first_n(b, limit), "idx")


def read_concode(spark: SparkSession, path: str, data_num: int = -1) -> DataFrame:
    """``nl`` and ``code`` stripped; idx = line number."""
    d = with_line_index(read_jsonl(spark, path, CONCODE_SCHEMA, keep_corrupt=False), "idx")
    return first_n(d.select("idx", py_strip(F.col("nl")).alias("source"), py_strip(F.col("code")).alias("target")), data_num)


def read_summarize(spark: SparkSession, path: str, data_num: int = -1) -> DataFrame:
    """Code tokens joined (newlines -> space), docstring tokens joined (newlines removed), both collapsed;
    idx = line number."""
    d = with_line_index(read_jsonl(spark, path, SUMMARIZE_SCHEMA, keep_corrupt=False).drop("idx"), "idx")
    code = collapse_ws(F.replace(F.array_join("code_tokens", " "), F.lit("\n"), F.lit(" ")))
    nl = collapse_ws(F.replace(F.array_join("docstring_tokens", " "), F.lit("\n"), F.lit("")))
    return first_n(d.select("idx", code.alias("source"), nl.alias("target")), data_num)


def read_refactoring(spark: SparkSession, path: str, data_num: int = -1) -> DataFrame:
    """source = collapsed smelly sample, target = collapsed **extracted method** only."""
    d = with_line_index(read_jsonl(spark, path, TRIPLE_SCHEMA, keep_corrupt=False), "idx")
    d = d.select("idx", collapse_ws(F.col("`Smelly Sample`")).alias("source"), collapse_ws(F.col("`Extracted Method`")).alias("target"))
    return first_n(d, data_num)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Refactoring triples with snake-case columns."""
    d = read_jsonl(spark, path, TRIPLE_SCHEMA)
    return d.select(F.col("`Smelly Sample`").alias("smelly"), F.col("`Method after Refactoring`").alias("after"),
                    F.col("`Extracted Method`").alias("extracted"), CORRUPT)


def read_defect(spark: SparkSession, path: str, data_num: int = -1) -> DataFrame:
    """Collapsed function text with its id and 0/1 target (the first ``data_num`` lines)."""
    d = with_line_index(read_jsonl(spark, path, DEFECT_SCHEMA, keep_corrupt=False))
    return first_n(d, data_num, "line_no").select("idx", collapse_ws(F.col("func")).alias("source"), F.col("target"))


def read_clone_pairs(spark: SparkSession, index_path: str, data_path: str | None = None, data_num: int = -1) -> DataFrame:
    """Lines ``url1 \\t url2 \\t label`` looked up twice in the code table (``data.jsonl`` beside the index
    unless named); a pair is kept only if both ids exist; ``data_num`` counts kept pairs in line order."""
    c = F.split(py_strip(F.col("line")), "\t")
    idx = read_lines(spark, index_path).select("line_no", F.get(c, 0).alias("url1"), F.get(c, 1).alias("url2"),
                                               text_to_label(F.get(c, 2)).alias("label"))
    data_path = data_path or index_path.rpartition("/")[0] + "/data.jsonl"
    data = with_line_index(read_jsonl(spark, data_path, CLONE_DATA_SCHEMA, keep_corrupt=False), "data_line")
    return clone_pairs(idx, data, data_num, order="line_no", data_order="data_line")


def read_pred_gold(spark: SparkSession, pred_path: str, gold_path: str) -> tuple[DataFrame, DataFrame]:
    """``id \\t text`` files.  A prediction without text is ''; the last
    prediction of an id wins; gold ids may repeat (several references) and only ids
    that have a prediction are kept."""
    p = read_lines(spark, pred_path).select("line_no", F.split(py_strip(F.col("line")), "\t").alias("c"))
    p = p.select("line_no", F.get("c", 0).alias("id"), F.coalesce(F.get("c", 1), F.lit("")).alias("text"))
    preds = p.groupBy("id").agg(F.max_by("text", "line_no").alias("pred"))
    g = spark.read.text(gold_path).select(F.split("value", "\t").alias("c"))
    golds = g.select(F.get("c", 0).alias("id"), F.get("c", 1).alias("gold"))
    golds = golds.join(preds.select("id"), "id", "left_semi")
    return preds, golds


def join_predictions(examples: DataFrame, predictions: DataFrame, key: str = "example_id") -> DataFrame:
    """C11: predictions attached to their examples by an explicit id (never by position)."""
    return examples.join(predictions, key)


# ---------------------------------------------------------------- A12
# fixed values: folder and file names of each task's splits (train, dev, test)
TASK_FILES = {
    "concode": ("{root}/concode", "train.json", "dev.json", "test.json"),
    "refactoring": ("{root}/refactoring/{context}", "train.jsonl", "val.jsonl", "test.jsonl"),
    "summarize": ("{root}/summarize/{sub}", "train.jsonl", "valid.jsonl", "test.jsonl"),
    "refine": ("{root}/refine/{sub}", "train.buggy-fixed.buggy,train.buggy-fixed.fixed",
               "valid.buggy-fixed.buggy,valid.buggy-fixed.fixed", "test.buggy-fixed.buggy,test.buggy-fixed.fixed"),
    "translate cs-java": ("{root}/translate", "train.java-cs.txt.cs,train.java-cs.txt.java",
                          "valid.java-cs.txt.cs,valid.java-cs.txt.java", "test.java-cs.txt.cs,test.java-cs.txt.java"),
    "translate": ("{root}/translate", "train.java-cs.txt.java,train.java-cs.txt.cs",
                  "valid.java-cs.txt.java,valid.java-cs.txt.cs", "test.java-cs.txt.java,test.java-cs.txt.cs"),
    "clone": ("{root}/clone", "train.txt", "valid.txt", "test.txt"),
    "defect": ("{root}/defect", "train.jsonl", "valid.jsonl", "test.jsonl"),
}


def task_files(root: str, task: str, sub_task: str = "none", split: str = "", context: str = "context") -> dict[str, str] | str:
    """File names of a task's splits (one split when ``split`` is given); two files are joined by a comma."""
    key = f"{task} {sub_task}"
    folder, *names = TASK_FILES[key if key in TASK_FILES else task]
    d = folder.format(root=root, sub=sub_task, context=context)
    files = {s: ",".join(f"{d}/{x}" for x in n.split(",")) for s, n in zip(("train", "dev", "test"), names)}
    return files[split] if split else files


def reader_for(task: str) -> Callable[..., DataFrame]:
    """Reader dispatch by task; every reader takes (spark, files, data_num)."""
    def parallel(spark, files, data_num=-1):
        src, trg = files.split(",")
        return read_parallel(spark, src, trg, data_num)

    def clone(spark, files, data_num=-1):
        return read_clone_pairs(spark, files, None, data_num)
    return {"summarize": read_summarize, "refine": parallel, "translate": parallel, "concode": read_concode,
            "clone": clone, "defect": read_defect, "refactoring": read_refactoring}[task]


def clone_pairs(index: DataFrame, data: DataFrame, limit: int = -1, id_col: str = "idx", code: str = "func",
                order: str | None = None, data_order: str | None = None) -> DataFrame:
    """C2 on DataFrames: (url1, url2, label) looked up twice in (id, code) with the code's white space collapsed; kept
    only when both ids exist.  Of a repeated id the last row by ``data_order`` counts (without one, the largest text);
    the first ``limit`` kept pairs in the order of ``order`` (without one, of the ids)."""
    text = collapse_ws(F.col(code))
    last = F.max_by(text, F.col(data_order)) if data_order else F.max(text)
    table = data.groupBy(F.col(id_col).alias("id")).agg(last.alias("text"))
    a = table.select(F.col("id").alias("url1"), F.col("text").alias("source"))
    b = table.select(F.col("id").alias("url2"), F.col("text").alias("target"))
    j = index.join(a, "url1").join(b, "url2")
    if limit >= 0:
        j = j.orderBy(order, "url1", "url2") if order else j.orderBy("url1", "url2")
        j = j.limit(limit)
    return j.select("url1", "url2", "source", "target", "label")
