import random
import re
from re import _parser as parser

from pairforge.llm import licenses
from pairforge.llm.license_rules import build

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(t):
    w = words(t)
    out = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), sorted(out)


def sample(r, items):
    """A random string that the parsed pattern matches."""
    out = ""
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "BRANCH":
            out += sample(r, r.choice(arg[1]))
        elif op == "SUBPATTERN":
            out += sample(r, arg[3])
        elif op == "MAX_REPEAT":
            out += "".join(sample(r, arg[2]) for _ in range(r.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
        elif op == "IN":
            kind, v = r.choice(arg)
            out += chr(v) if str(kind) == "LITERAL" else chr(r.randint(*v)) if str(kind) == "RANGE" else "e"
    return out


def test_prefilters_lose_nothing():
    s, r = licenses.Scanner(), random.Random(3)
    assert len(s.rules) > 200
    for rule in build():
        for _ in range(4):
            text = sample(r, parser.parse(rule.regex.pattern.decode()))
            _, joined = s.words(f"foo {text} bar {r.choice(['', text])}")
            assert rule.regex.search(joined), (rule, text)
            assert any(a in joined for a in licenses.ANCHORS), (rule, text)
            assert s.detections(joined) == s.detections(joined, gated=False)
            assert s.detections(joined)


def test_base_matches_definition():
    s, r = licenses.Scanner(), random.Random(5)
    parts = [*" ".join(PHRASES).split(), "GNU", "MIT license mit License", ",", ".", "-", "é", "\n", "by", "CC", "2", "\x7f"]
    for _ in range(5000):
        t = " ".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        got = s.scan(t)
        assert (got["n_words"], [(x["word"], x["label"]) for x in got["base"]]) == brute(t)


def test_priority_and_containment():
    s = licenses.Scanner()
    labels = lambda t: [x["label"] for x in s.scan(t)["found"]]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("MIT License ... All rights reserved") == ["mit", "all-rights-reserved"]
    assert labels("geh mit ihm unter die Apache") == [] and s.scan("nothing here")["score"] == 0


def test_operator_edges(spark):
    docs = [(1, None, 1), (2, "", 1), (3, " ., ", 1), (4, "The MIT License", 1), (4, "The MIT License", 2), (None, "cc by", 1),
            (5, "word " * 300_000 + "cc by", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_words int")
    got = {x.id: x for x in licenses.scan_licenses(df).collect()}
    assert [got[i].n_words for i in (1, 2, 3)] == [0, 0, 0] and got[1].score == 0 and got[4].score > 0.5
    assert got[5].base[0].word == 300_000 and got[None].base[0].label == "cc-by"
    assert licenses.scan_licenses(df).count() == 7 and licenses.scan_licenses(df.limit(0)).count() == 0


def test_query_matches_definition_on_whole_table(spark):
    from pairforge.llm.queries import op6_licenses
    sf = "/root/testdata/sf0.01"
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op6_licenses(spark, sf).collect()
    assert len(rows) == len(texts)
    for x in rows:
        n, base = brute(texts[x.doc_id])
        assert (x.n_words, x.n_base) == (n, len(base))
        assert (x.first_word, x.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert x.base_labels == ",".join(sorted({b for _, b in base}))
        assert {b for _, b in base} <= set(x.labels.split(",")) and 0 <= x.score <= 1
