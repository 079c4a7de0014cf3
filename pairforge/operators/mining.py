"""Refactoring-event mining tables.

The reference walks Git histories; here commits, file versions and detected
refactoring events are tables, and every step is a join, filter or window.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from pairforge.functions.text import java_tokens


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repo_name(url) -> Column:
    """B1: last ``/`` segment, text before its first ``.``."""
    return F.substring_index(F.element_at(F.split(_c(url), "/"), -1), ".", 1)


def repo_url(name) -> Column:
    """B1: clone URL of ``owner/name`` or ``name``."""
    return F.concat(F.lit("https://github.com/"), _c(name), F.lit(".git"))


def abstract_identifiers_df(df: DataFrame, key: str, text: str, keywords: Sequence[str]) -> DataFrame:
    """E9 over whole texts: tokens exploded with their position, the shared running
    counter as a window over the text's own tokens (bounded by one text), and the
    abstracted sequence reassembled in order.  Returns ``key, n_tokens,
    n_abstracted, tokens, token_map, digest``."""
    kw = list(keywords) + ["true", "false", "null"]
    t = df.select(key, F.posexplode(java_tokens(F.col(text))).alias("pos", "tok"))
    kind = (F.when(F.col("tok").isin(kw), F.lit(""))
            .when(F.col("tok").rlike(r"^(0|[1-9][0-9_]*[lL]?)$"), F.lit("DECIMALINTEGER"))
            .when(F.col("tok").rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*$"), F.lit("IDENTIFIER"))
            .otherwise(F.lit("")))
    t = t.withColumn("kind", kind)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("cnt", F.sum((F.col("kind") != "").cast("int")).over(w))
    t = t.withColumn("rep", F.when(F.col("kind") != "", F.concat("kind", F.lit("_"), F.col("cnt").cast("string"))).otherwise(F.col("tok")))
    g = t.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum((F.col("kind") != "").cast("long")).alias("n_abstracted"),
        F.array_sort(F.collect_list(F.struct("pos", "rep", "tok", "kind"))).alias("_s"))
    toks = F.transform("_s", lambda x: x["rep"])
    kept = F.filter("_s", lambda x: x["kind"] != "")
    return g.select(key, "n_tokens", "n_abstracted", toks.alias("tokens"),
                    F.map_from_arrays(F.transform(kept, lambda x: x["rep"]), F.transform(kept, lambda x: x["tok"])).alias("token_map"),
                    F.md5(F.array_join(toks, " ")).alias("digest"))


# ---------------------------------------------------------------- B2-B5
RANGE_FIELDS = "filePath string, startLine int, endLine int, description string, codeElementType string"


def filter_refactorings(events: DataFrame, kind: str = "EXTRACT_OPERATION", type_col: str = "type") -> DataFrame:
    """B2: keep refactoring events of one type."""
    return events.filter(F.col(type_col) == kind)


def filter_ranges(ranges, element_type: str = "METHOD_DECLARATION") -> Column:
    """Keep the code ranges of one element type inside a side array."""
    return F.filter(_c(ranges), lambda r: r["codeElementType"] == element_type)


# fixed value: description marking a swapped right side
SOURCE_BEFORE = "source method declaration before extraction"


def pick_roles(left, right) -> Column:
    """before = left[0]; extracted = right[0] and after = right[1], swapped when
    right[0] is described as the source method before extraction."""
    r0, r1 = F.get(_c(right), 0), F.get(_c(right), 1)
    swapped = r0["description"] == SOURCE_BEFORE
    return F.struct(F.get(_c(left), 0).alias("before"),
                    F.when(swapped, r1).otherwise(r0).alias("extracted"),
                    F.when(swapped, r0).otherwise(r1).alias("after"))


# ---------------------------------------------------------------- C4-C6, D18
def first_parent(commits: DataFrame, repo: str = "repo", sha: str = "sha", parents: str = "parents") -> DataFrame:
    """C4: every commit with its first parent's row (null for a root commit, which the
    reference mishandled by reusing the previous commit's parent)."""
    c = commits.select(repo, sha, F.get(F.col(parents), 0).alias("parent_sha"), *[x for x in commits.columns if x not in (repo, sha, parents)])
    p = commits.select(F.col(repo).alias("_r"), F.col(sha).alias("parent_sha"), *[F.col(x).alias("parent_" + x) for x in commits.columns
                                                                                 if x not in (repo, sha, parents)])
    return c.join(p, (c[repo] == p["_r"]) & (c["parent_sha"] == p["parent_sha"]), "left").drop("_r").drop(p["parent_sha"])


def file_versions_for(ranges: DataFrame, versions: DataFrame, keys=("repo", "sha", "path")) -> DataFrame:
    """Attach file text at (repo, sha, path) - an equi-join, no checkout."""
    return ranges.join(versions, list(keys), "left")


def split_lines(content) -> Column:
    """Lines as a line reader yields them: split on CRLF/CR/LF, no trailing empty piece."""
    parts = F.split(_c(content), "\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def slice_lines(content, start_line, end_line) -> Column:
    """Lines start..end (1-based, inclusive) form the method, the others the class
    text; every line is re-terminated by a newline.  Returns ``struct(method, class_text)``."""
    lines = split_lines(content)
    idx = F.transform(lines, lambda ln, i: F.struct((i + 1).alias("n"), ln.alias("l")))
    inside = F.filter(idx, lambda x: (x["n"] >= _c(start_line)) & (x["n"] <= _c(end_line)))
    outside = F.filter(idx, lambda x: (x["n"] < _c(start_line)) | (x["n"] > _c(end_line)))
    join = lambda arr: F.array_join(F.transform(arr, lambda x: F.concat(x["l"], F.lit("\n"))), "")
    return F.struct(join(inside).alias("method"), join(outside).alias("class_text"))


def refactorings_per_commit(events: DataFrame, commit: str) -> DataFrame:
    """Refactorings per commit and whether a commit has any."""
    return events.groupBy(commit).agg(F.count(F.lit(1)).alias("n_refactorings")).withColumn(
        "has_refactoring", F.col("n_refactorings") > 0)


@dataclass(frozen=True)
class Handler:
    """A commit handler whose states can be merged, so that a commit's rows may lie in any number of tasks.

    ``init() -> state``; ``update(state, rows) -> state`` with some of a commit's rows as a pandas frame; ``merge(state, state) -> state``;
    ``finish(state)`` -> the values of a result row.  States are pickled between tasks; results must not depend on how rows are dealt."""
    init: Callable[[], object]
    update: Callable[[object, pd.DataFrame], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], Sequence]


STATES_HELD = 10_000  # commits of one task whose states are open at a time; the rest are closed early and merged later


def _partial_states(handler: Handler):
    def run(batches):
        held, salt = {}, TaskContext.get().partitionId()

        def close():
            return pa.RecordBatch.from_pydict({"_k": list(held), "_salt": [salt] * len(held), "_state": [pickle.dumps(s) for s in held.values()]},
                                              schema=_STATE)
        for b in batches:
            rows = b.to_pandas()
            for k, part in rows.groupby("_k", sort=False):
                held[k] = handler.update(held[k] if k in held else handler.init(), part.drop(columns="_k"))
            if len(held) > STATES_HELD:
                yield close()
                held.clear()
        yield close()
    return run


def _merge_states(handler: Handler):
    """States of one commit lie together: one is held at a time."""
    def run(batches):
        key, state = None, None
        for b in batches:
            done = []
            for k, x in zip(b.column("_k").to_pylist(), b.column("_state").to_pylist()):
                if k == key:
                    state = handler.merge(state, pickle.loads(x))
                else:
                    if key is not None:
                        done.append((key, state))
                    key, state = k, pickle.loads(x)
            yield _states(done)
        if key is not None:
            yield _states([(key, state)])
    return run


_STATE = pa.schema([("_k", pa.string()), ("_salt", pa.int32()), ("_state", pa.binary())])
_STATE_SQL = "_k string, _salt int, _state binary"


def _states(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"_k": [k for k, _ in done], "_salt": [0] * len(done), "_state": [pickle.dumps(s) for _, s in done]}, schema=_STATE)


def handle_commits(events: DataFrame, commit: str, handler: Handler, schema: str, salts: int = 64) -> DataFrame:
    """K5: a user's handler over each commit's refactorings (rows without a commit are one commit more).

    A task folds its rows into a state per commit before anything is shuffled; states of a commit are merged in up to ``salts`` tasks and
    then in one, which reads at most ``salts`` states, so no task sees all rows of a commit.  Returns ``commit`` and the columns of
    ``schema``, one row per commit."""
    key = F.to_json(F.struct(commit))
    states = events.select(key.alias("_k"), *events.columns).mapInArrow(_partial_states(handler), _STATE_SQL)
    few = states.withColumn("_salt", F.col("_salt") % salts)
    for deal in (["_k", "_salt"], ["_k"]):
        few = few.repartition(*deal).sortWithinPartitions(*deal)
        few = few.mapInArrow(_merge_states(handler), _STATE_SQL)
    kind = StructType([StructField("_k", StringType()), *StructType.fromDDL(schema)])

    def finish(batches):
        out = to_arrow_schema(kind)
        for b in batches:
            rows = [(k, *handler.finish(pickle.loads(x))) for k, x in zip(b.column("_k").to_pylist(), b.column("_state").to_pylist())]
            yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(out)}, schema=out)

    back = F.from_json("_k", StructType([StructField(commit, events.schema[commit].dataType)]))
    out = few.mapInArrow(finish, kind)
    return out.select(back[commit].alias(commit), *[c for c in out.columns if c != "_k"])
