import hashlib
import random
import re

import numpy as np

from pairforge.llm import pii


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(t):
    """The fixed kinds as their definition states them."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_fixed_kinds_match_definition():
    r = random.Random(8)
    parts = ["4111111111111111", "1", "23", "255", "256", "0099", ".", ".", "-", " ", "  ", "+", "+1", "(", ")", "@", "@", "a", "b.c", "-x.de",
             "+49 30 123456", "é", "😀", "\n", "٣", "%", "_", "378282246310005", "1.2.3.4", "user@mail.example.com", "3530 1113 3330 0000"]
    for _ in range(40000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t)[0] == brute(t), t


def model():
    both = pii.made_up(12_000)
    x = np.array([list(map(int, f)) for f, _ in both])
    y = np.array([v for _, v in both])
    return pii.Trees().fit(x, y, np.arange(len(x)) % 4 == 3), x, y


def test_trees_on_held_out_examples():
    trees, _, _ = model()
    both = pii.made_up(3000, seed=99)
    x, y = np.array([list(map(int, f)) for f, _ in both]), np.array([v for _, v in both])
    p = trees.probability(x)
    assert ((p >= pii.THRESHOLD) == y).mean() > 0.97
    assert (p[~y] >= pii.THRESHOLD).mean() < 0.02


def test_method_adds_spans_in_dropped_runs():
    trees, _, _ = model()
    t = "thed +1 (269) 555-3296 4524132264652876 ernt (030) 555-1234 on 2024-10-12 version 2.0"
    assert pii.base_spans(t)[0] == []
    got = {(t[a:b], k) for a, b, k, f in pii.select(t, trees)}
    assert ("+1 (269) 555-3296", "phone") in got and ("4524132264652876", "card") in got
    assert not any("2024" in s or "2.0" in s for s, _ in got)
    assert pii.redacted(t, pii.select(t, trees)).startswith("thed <PHONE> <CARD> ernt")


def test_recall_of_every_kind_on_planted_spans():
    """Spans of all formats put into running text: the fixed kinds and the trees together find at least 0.9 of each kind."""
    trees, _, _ = model()
    r = random.Random(31)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card():
        s = r.choice("3456") + d(14)
        s += next(c for c in "0123456789" if luhn(s + c))
        return r.choice([s, " ".join(s[i:i + 4] for i in range(0, 16, 4)), "-".join(s[i:i + 4] for i in range(0, 16, 4))])

    made = {"email": lambda: f"{'x' * r.choice([3, 9, 300])}.{d(2)}@mail{d(1)}.example.{r.choice(['com', 'org'])}", "card": card,
            "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
            "phone": lambda: r.choice([f"+{d(2)} {d(3)} {d(7)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+49{d(9)}", f"({d(3)}) {d(3)}-{d(4)}"])}
    hit, n = dict.fromkeys(made, 0), dict.fromkeys(made, 0)
    for i in range(800):
        kind = list(made)[i % 4]
        span, head = made[kind](), r.choice(["thed ernt ", "call me: ", "", "two words, ", "line\n"])
        text = head + span + r.choice([" ernt", ", and so on", ".", "", "\n"])
        n[kind] += 1
        hit[kind] += any(k == kind and a <= len(head) and b >= len(head) + len(span) for a, b, k, _ in pii.select(text, trees))
    assert all(hit[k] >= 0.9 * n[k] for k in made), (hit, n)


def test_operator_edges(spark):
    docs = [(1, None), (2, ""), (3, "é😀 a.b@c.de 1.2.3.4"), (3, "é😀 a.b@c.de 1.2.3.4"), (None, "x@y.zz"),
            (5, "9" * 400_000), (6, "a" * 400_000 + "@"), (7, "+1 2 " * 60_000), (8, "1.2.3." * 60_000), (9, "@a." * 60_000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, redacted int")
    trees, _, _ = model()
    rows = pii.find_personal(df, trees=trees, redact=True).collect()
    got = {x.id: x for x in rows}
    assert len(rows) == len(docs) and got[1].redacted is None and got[2].spans == []
    assert got[3].redacted == "é😀 <EMAIL> <IP>" and [(s.kind, s.start, s.end) for s in got[3].spans] == [("email", 3, 11), ("ip", 12, 19)]
    assert got[None].redacted == "<EMAIL>" and got[5].redacted == "9" * 400_000
    assert pii.find_personal(df.limit(0)).count() == 0


def test_query_matches_definition_on_whole_table(spark):
    from pairforge.llm.queries import op9_pii
    sf = "/root/testdata/sf0.01"
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op9_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for x in rows:
        want = brute(texts[x.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert x.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in want) for k in pii.KINDS]
        assert set(said.split(",")) - {""} <= set(x.spans.split(","))
