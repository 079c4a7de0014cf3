import itertools
import random
import zlib

import numpy as np
import pytest

from pairforge.llm import langid


def brute_marginals(e, start, a):
    """All label paths of one short text."""
    n, k = e.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = start[path[0]] * np.prod([e[t, y] for t, y in enumerate(path)]) * np.prod([a[x, y] for x, y in zip(path, path[1:])])
        for t, y in enumerate(path):
            out[t, y] += p
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("segment", [1, 2, 3, 100])
def test_marginals_match_all_paths_at_any_segment(segment):
    r = np.random.default_rng(1)
    a, start = r.random((3, 3)) + 0.01, r.random(3) + 0.01
    counts = np.array([4, 0, 7, 1, 2, 0, 6])
    e = r.random((int(counts.sum()), 3)) + 1e-3
    got = langid.marginals(e, counts, start, a, segment)
    at = 0
    for c in counts:
        if c:
            assert np.allclose(got[at:at + c], brute_marginals(e[at:at + c], start, a))
        at += c


def test_long_texts_do_not_underflow():
    r = np.random.default_rng(2)
    e = np.exp(-60 * r.random((50_000, 4)))
    a, start = np.exp(r.normal(size=(4, 4)) * 5), np.ones(4)
    one = langid.marginals(e, np.array([50_000]), start, a, 60_000)
    assert np.isfinite(one).all() and np.allclose(one, langid.marginals(e, np.array([50_000]), start, a), atol=1e-8)


VOC = {"en": ["the", "and", "with", "from", "water", "thing"], "de": ["und", "nicht", "wasser", "über", "schön", "mit"],
       "fr": ["le", "être", "avec", "eau", "dans", "où"]}


def say(r, lang, n):
    return " ".join(r.choice(VOC[lang]) + r.choice(["", "s", "en"]) for _ in range(n))


def test_words_of_a_switched_text_get_their_language():
    r = random.Random(4)
    field = langid.fit_field([(say(r, x, 80), x) for x in VOC for _ in range(40)])
    assert field.labels == ["de", "en", "fr"] and field.transitions.diagonal().min() > field.transitions[0, 1]
    words = langid.words_of(say(r, "en", 30) + " " + say(r, "fr", 30))
    raw = field.emissions(words)
    p = langid.marginals(np.exp(raw - raw.max(axis=1, keepdims=True)), np.array([60]), np.exp(field.start), np.exp(field.transitions))
    assert (p[:30].argmax(axis=1) == 1).mean() > 0.9 and (p[30:].argmax(axis=1) == 2).mean() > 0.9


def test_operator_edges(spark):
    r = random.Random(5)
    rows = [(i, say(r, x, 60), x, 1) for i, x in enumerate(list(VOC) * 30)]
    df = spark.createDataFrame(rows + [(900, None, "de", 1), (901, "le eau", None, 1)], "doc_id bigint, text string, lang string, score int")
    field = langid.fit(df)
    docs = [(1, None), (2, ""), (3, "123 -- !"), (4, "— … “”"), (5, say(r, "de", 30000)), (5, say(r, "de", 30000)), (None, say(r, "fr", 40)),
            (7, "日本"), (8, say(r, "en", 3))]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, lang string")
    got = langid.identify(d, field).collect()
    assert len(got) == len(docs)
    by = {x.id: x for x in got}
    assert [by[i].lang for i in (1, 2, 3, 4)] == ["und"] * 4 and by[1].score == 0
    assert (by[5].lang, by[None].lang, by[8].lang) == ("de", "fr", "en") and by[7].lang in VOC and by[5].score > 0.9
    assert abs(sum(by[5].shares.values()) - 1) < 1e-6
    nothing = langid.fit(df.limit(0))
    assert {x.lang for x in langid.identify(d, nothing).collect()} == {"und"}
    assert langid.identify(d.limit(0), field).count() == 0


def test_held_out_accuracy(spark):
    from pairforge.llm.queries import op7_langid
    sf = "/root/testdata/sf0.01"
    lang = {x.doc_id: x.lang for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op7_langid(spark, sf).collect()
    assert len(rows) == len(lang) and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in rows)
    held = [x for x in rows if x.held_out]
    assert len(held) > 200 and np.mean([x.lang_pred == lang[x.doc_id] for x in held]) > 0.96


def test_a_language_of_long_rows_only_is_learned(spark):
    r = random.Random(6)
    rows = [(i, say(r, x, 60 if x != "fr" else 9000), x) for i, x in enumerate(["en", "de"] * 20 + ["fr"] * 6)]
    assert all((len(t) > langid.MAX_CHARS) == (x == "fr") for _, t, x in rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    d = spark.createDataFrame([(i, say(r, x, 40), x) for i, x in enumerate(list(VOC) * 5)], "doc_id bigint, text string, lang string")
    want = {x.doc_id: x.lang for x in d.collect()}
    for field in (langid.fit(df), langid.fit(df, max_chars=500), langid.fit(df, total_chars=200_000)):
        assert {x.id: x.lang for x in langid.identify(d, field).collect()} == want


def test_spans_of_switched_texts_are_those_they_were_made_of(spark):
    r = random.Random(9)
    field = langid.fit_field([(say(r, x, 80), x) for x in VOC for _ in range(40)])
    rows, want = [], {}
    for i in range(60):
        text, spans, last = "", [], None
        for _ in range(r.randint(1, 4)):
            last = r.choice([x for x in VOC if x != last])
            part = say(r, last, r.randint(12, 40))
            text += r.choice([" ", "\n", " 😀 ", " -- 7 "])
            spans.append((last, len(text), len(text) + len(part), len(part.split())))
            text += part
        rows.append((i, text, "x"))
        want[i] = spans
    got = {x.id: x.spans for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, spans string"), field, spans=True).collect()}
    words = right = same = 0
    for i, spans in want.items():
        starts, ends = langid.word_places(rows[i][1])
        labels = {}
        for s in got[i]:
            assert 0 < s.probability <= 1
            labels.update({a: s.lang for a in starts[(starts >= s.start) & (starts < s.end)].tolist()})
            assert s.start in starts and s.end in ends
        assert sum(s.words for s in got[i]) == len(starts) == len(labels)
        truth = {a: x for x, lo, hi, _ in spans for a in starts[(starts >= lo) & (starts < hi)].tolist()}
        words += len(starts)
        right += sum(labels[a] == truth.get(a) for a in labels)
        same += [s.lang for s in got[i]] == [x for x, *_ in spans]
    assert right / words > 0.95 and same / len(want) > 0.9
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string")
    assert [x.spans for x in langid.identify(empty, field, spans=True).collect()] == [[], [], []]


def test_places_of_words():
    for t in ("", "a", " Ab-c, d", "İİ x İ", "日本 ab 😀 c", "ΣΑΣ, ß", "İstanbul'da İ", "A" * 5000 + " b"):
        starts, ends = langid.word_places(t)
        assert [t[a:b].lower().encode() for a, b in zip(starts, ends)] == [w for w in langid.words_of(t)] or "Σ" in t or "İ" in t
        assert len(starts) == len(langid.words_of(t)) and (starts < ends).all()
