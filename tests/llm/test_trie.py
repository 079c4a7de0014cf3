import hashlib
import random
import zlib

import pytest

from pairforge.llm import trie
from pairforge.llm.queries import ORACLE_SQL, op12_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    return out


def brute(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        sub = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])),
                    sum(q not in children for q in sub), sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table_of(spark, tmp, rows):
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "conv_id bigint, turn bigint, role string, text string, id int, depth string")
    df.write.mode("overwrite").parquet(f"{tmp}/conversations.parquet")
    return sorted((tuple(x) for x in op12_trie(spark, tmp).select(*COLUMNS).collect()), key=str)


def some(seed, convs, longest):
    r = random.Random(seed)
    rows, made = [], []
    for c in range(convs):
        like = r.choice(made) if made and r.random() < 0.7 else []
        n = r.choice([1, 2, 3, 5, 8, longest])
        turns = (like[:r.randint(0, len(like))] + [(r.choice(["user", "assistant", None, ""]), r.choice(["a", "b", "é😀", None, "", "long " * 9])) for _ in range(n)])[:longest]
        made.append(turns)
        rows += [(c * r.choice([1, 1, 37]), t, *x) for t, x in enumerate(turns)]
    rows += [(None, 1, "user", "a"), (-5, 1, "user", "a"), (-150, None, "user", "b"), (-150, None, "user", "a"), (90001, None, None, "x" * 500000)]
    return rows + r.sample(rows, min(20, len(rows)))


@pytest.mark.parametrize("seed,convs,longest", [(2, 40, 33), (4, 90, 4)])
def test_matches_brute_force(spark, tmp, seed, convs, longest):
    rows = some(seed, convs, longest)
    assert table_of(spark, tmp, rows) == brute(rebuilt(rows))


def test_sql_twin_on_hard_rows(spark, tmp):
    import duckdb
    got = table_of(spark, tmp, some(7, 80, 12))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp}/conversations.parquet/*.parquet'")
    assert sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op12_trie']})").fetchall(), key=str) == got


def test_empty_and_turnless(spark, tmp):
    assert table_of(spark, tmp, []) == []
    turnless = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1][:5]
    rows = [(c, 0, "user", "a") for c in turnless]
    want = (turnless[0], 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, turnless)).encode()).hexdigest())
    assert table_of(spark, tmp, rows) == [want] == brute(rebuilt(rows))


def test_places_of_a_conversation_over_several_tasks(spark):
    df = spark.range(2000).selectExpr("1L as conv_id", "1999 - id as turn", "'user' as role", "cast(1999 - id as string) as text").repartition(7)
    got = {x.pos: x.n for x in trie.numbered(df).collect()}
    assert got == {i: len(str(i)) for i in range(2000)}
