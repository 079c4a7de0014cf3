r"""Licence scan by ordered signature rules (operator 6).

A text becomes its lower-case words with single spaces between.  A prefilter
first looks for any of a few anchors; only texts that hold one go on.  There an
Aho-Corasick pass finds the rules' keywords, the rules whose keyword occurs are
matched, and the detections are put in order of priority, then length: one that lies
within an earlier one is suppressed.  What is left gives the labels, and the
best priority the score.

Fixed phrases (``PHRASES``) are all reported, whatever the rules say.

Defined results: texts of any length are read whole; an empty table gives no
rows; null, empty and wordless texts have no words, no labels and
score 0; rows are independent (ties, repeated rows, further columns don't matter).
"""
from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from pairforge.llm._arrow import held, map_texts
from pairforge.llm.license_rules import Rule, build

#: phrases and their labels (fixed values)
PHRASES = {b"gnu general public license": "gpl", b"apache license": "apache", b"cc by": "cc-by", b"mit license": "mit"}
#: every rule and phrase holds one of these
ANCHORS = (b" licen", b" cc", b" gnu", b"gpl ", b" spdx", b" copyright", b" public domain", b" permission",
           b" redistribut", b" creative", b" creativecommons", b" apache", b" bsd ", b" mpl ", b"reserved ", b" mozilla",
           b" opensource org", b" warranty", b" wtfpl", b" proprietary", b" commercial use", b" advertising materials",
           b" endorse", b" unencumbered", b"license ", b" boost org", b" notice shall", b" under ",
           b" 1 ", b" 2 ", b" 3 ", b" 0 ", b" pl ", b" rl ", b" clause ", b" 01 ")


def _table() -> bytes:
    t = bytearray(b" " * 256)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        t[b] = b
    for b in range(0x41, 0x5B):
        t[b] = b + 0x20
    return bytes(t)


TABLE = _table()


class Scanner:
    def __init__(self, rules: list[Rule] | None = None):
        self.rules = build() if rules is None else rules
        self.by_keyword: dict[str, list[Rule]] = {}
        for r in self.rules:
            self.by_keyword.setdefault(r.keyword.decode(), []).append(r)
        self.automaton = ahocorasick.Automaton()
        for k in self.by_keyword:
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()

    def words(self, text: str) -> tuple[int, bytes]:
        """(number of words, the words with single spaces around)."""
        w = text.encode().translate(TABLE).split()
        return len(w), b" %b " % b" ".join(w)

    def phrases(self, joined: bytes) -> list[tuple[int, str]]:
        """(first word, label) of every place of every fixed phrase."""
        out = []
        for phrase, label in PHRASES.items():
            key, at = b" %b " % phrase, 0
            while (at := joined.find(key, at)) >= 0:
                out.append((joined.count(b" ", 0, at), label))
                at += 1
        return sorted(out)

    def detections(self, joined: bytes, gated: bool = True) -> list[tuple[int, int, str, int]]:
        """(first word, end, label, priority) of the detections that nothing suppresses, best first."""
        if gated:
            seen = {k for _, k in self.automaton.iter(joined.decode("latin-1"))}
            rules = [r for k in seen for r in self.by_keyword[k]]
        else:
            rules = self.rules
        found = []
        for r in rules:
            for m in r.regex.finditer(joined):
                a = joined.count(b" ", 0, m.start())
                found.append((-r.priority, a - (a + m.group().count(b" ")), a, r.order, r.label))
        kept: list[tuple[int, int, str, int]] = []
        for minus, short, a, _, label in sorted(found):
            b = a - short
            if not any(x <= a and b <= y for x, y, _, _ in kept):
                kept.append((a, b, label, -minus))
        return kept

    def scan(self, text: str) -> dict:
        n, joined = self.words(text)
        out = {"n_words": n, "base": [], "found": [], "score": 0.0}
        if n and any(a in joined for a in ANCHORS):
            out["base"] = [{"word": w, "label": label} for w, label in self.phrases(joined)]
            kept = self.detections(joined)
            out["found"] = [{"start": a, "end": b, "label": label, "priority": p} for a, b, label, p in sorted(kept)]
            out["score"] = max([p for *_, p in kept], default=50 if out["base"] else 0) / 100
        return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``base array<struct<word,label>>`` (places of the fixed phrases), ``found
    array<struct<start,end,label,priority>>`` (detections, in words) and ``score`` per row."""
    base = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))

    def run(texts: pa.Array) -> list[pa.Array]:
        scanner = held("licenses", None, lambda _: Scanner())
        rows = [scanner.scan(t or "") for t in texts.to_pylist()]
        return [pa.array([r[c] for r in rows], kind) for c, kind in
                (("n_words", pa.int64()), ("base", base), ("found", found), ("score", pa.float64()))]

    return map_texts(df, run, "n_words bigint, "
                     "base array<struct<word:bigint,label:string>>, "
                     "found array<struct<start:bigint,end:bigint,label:string,priority:int>>, score double", id_col, text_col)
