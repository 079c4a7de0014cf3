import random
import re

import corpus_pipeline as cp
from pairforge.llm import winnow  # noqa: F401
from tests.llm import test_jaccard, test_pii, test_winnow

VOC = {"en": ["the", "and", "with", "from", "water", "thing", "river", "stone", "under", "light"],
       "de": ["und", "nicht", "wasser", "über", "schön", "mit", "fluss", "stein", "unter", "licht"]}


def say(r, lang, n):
    return " ".join(r.choice(VOC[lang]) + str(r.choice(["", "s", "en", "er"])) for _ in range(n))


def staged(spark, tmp, docs):
    out = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, tmp).write.mode("overwrite").parquet(f"{tmp}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp}/{name}")
    return out


def make(spark, tmp):
    r = random.Random(3)
    items = [(i, say(r, "en", 30)) for i in range(3)]
    rows = []
    for i in range(60):
        lang = r.choice(["en", "de"])
        rows.append((i, say(r, lang, r.randint(30, 90)), lang if i % 7 else None, f"s{i % 3}"))
    rows += [(100 + i, rows[i][1] + " more", rows[i][2], "copy") for i in range(10)]
    rows += [(200, say(r, "en", 20) + " " + items[0][1] + " " + say(r, "en", 20), "en", "bench"), (201, items[1][1], "en", "bench")]
    rows += [(300, say(r, "de", 40) + " a.b@c.de and +1 (269) 555-3296 ok", "de", "pii"), (301, None, "en", None), (302, "12 34", "en", None),
             (303, "", None, None), (None, say(r, "de", 40), "de", "noid"), (5, rows[5][1], rows[5][2], "again"), (304, say(r, "en", 6000), "en", None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, _row int, spans string"
    docs = spark.createDataFrame([(*x, None if x[1] is None else len(x[1]), 1, 2, "x") for x in rows], schema)
    spark.createDataFrame(items, "item_id bigint, text string").write.mode("overwrite").parquet(f"{tmp}/benchmark.parquet")
    return rows, items, docs


def test_every_stage_decides_as_brute_force(spark, tmp):
    rows, items, docs = make(spark, tmp)
    out = staged(spark, tmp, docs)
    for name in ("language", "near_duplicates", "decontaminate", "redact"):
        assert out[name].columns == docs.columns, name
    got = {n: [(x.doc_id, x.text, x.lang, x.n_chars) for x in d.collect()] for n, d in out.items() if n != "tokens"}
    # texts without a letter go, all others are clear
    assert sorted(str(x[:2]) for x in got["language"]) == sorted(str(x[:2]) for x in rows if x[1] and re.search("[a-z]", x[1]))
    truth = {x[0]: x[2] for x in rows}
    assert all(x[2] == (truth[x[0]] or x[2]) and x[2] in VOC for x in got["language"])
    # one of each group of near copies
    named = [x[:2] for x in got["language"] if x[0] is not None]
    least = {(d, c) for d, _, c in test_jaccard.brute(named)}
    want = sorted({(d, t) for d, t in named if (d, d) in least})
    assert sorted(x[:2] for x in got["near_duplicates"] if x[0] is not None) == want and len(want) < len(named)
    # no contaminated document
    judged = test_winnow.brute([x[:2] for x in got["near_duplicates"]], items)
    clean = sorted(str(x[0]) for x in judged if not x[4])
    assert sorted(str(x[0]) for x in got["decontaminate"]) == clean and len(clean) == len(judged) - 2
    # no personal data, nothing else changed
    before = {x[0]: x[1] for x in got["decontaminate"]}
    for d, t, _, n in got["redact"]:
        assert test_pii.brute(t) == [] and n == len(t)
        assert t == before[d] or d == 300
    assert "<EMAIL>" in {x[0]: x[1] for x in got["redact"]}[300]
    # tokens give the texts back
    texts = {x[0]: x[1] for x in got["redact"]}
    import hashlib
    tok = out["tokens"].collect()
    assert len(tok) == len(texts)
    assert all(x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest() and x.n_tokens == len(x.ids) for x in tok)


def test_empty_documents(spark, tmp):
    _, _, docs = make(spark, tmp)
    out = staged(spark, tmp, docs.limit(0))
    assert out["tokens"].count() == 0 and out["redact"].columns == docs.columns


def test_near_duplicates_stage_links_from_five_words_and_four_fifths(spark, tmp):
    def runs(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    r = random.Random(8)
    texts = []
    for g, n in enumerate([8, 20, 40, 80, 150, 300, 300, 600]):
        base = [f"w{g}x{i}" for i in range(n)]
        texts.append(" ".join(base))
        texts += [" ".join(base + [f"a{g}x{len(texts)}x{i}" for i in range(round(n * x))]) for x in (0.12, 0.18, 0.22, 0.3)]
        for edits in (n // 50, n // 46, n // 40):
            w = list(base)
            for p in r.sample(range(5, n - 5, 5), edits) if edits else []:
                w[p] = f"e{len(texts)}x{p}"
            texts.append(" ".join(w))
    texts.append(" ".join(f"w5x{i}" for i in range(300)) + " " + " ".join(f"m{i}" for i in range(55)))
    sets = [runs(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o) and group[i] != group[j]:
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    assert sorted(x.doc_id for x in cp.near_duplicates(spark, docs, tmp).collect()) == sorted(set(group))
    least = {d for d, _, c in test_jaccard.brute(list(enumerate(texts))) if d == c}
    assert set(group) < least  # four words and 0.85 leave near copies


def test_language_stage_keeps_lettered_documents_when_nothing_was_learned(spark, tmp):
    rows = [(1, "the river and the stone", None), (2, "12 34", None), (3, None, None), (4, "日本", None), (None, "été", None), (1, "the river and the stone", None)]
    schema = "doc_id bigint, text string, lang string"
    got = cp.language(spark, spark.createDataFrame(rows, schema), tmp).collect()
    assert sorted(str(tuple(x)) for x in got) == sorted(str(x) for x in rows if x[1] in ("the river and the stone", "日本", "été"))
    # labels without a word teach nothing either
    named = rows + [(9, "1 2 3", x) for x in ("de", "en", "fr")]
    assert sorted(str(tuple(x)) for x in cp.language(spark, spark.createDataFrame(named, schema), tmp).collect()) == sorted(str(tuple(x)) for x in got)
