r"""Personal data: candidate spans judged by boosted trees (operator 9).

Fixed kinds (leftmost, non-overlapping, failing matches dropped): ``email``,
``ip`` (parts at most 255), ``card`` (14 to 19 digits that pass the Luhn sum)
and ``phone`` (``+``, 10 to 15 digits).  They are always reported.

The method looks further.  High-recall generators propose overlapping spans:
everything around an ``@``, dotted quads and every run of neighbouring digit
groups that could be a number of 7 to 19 digits, also inside longer digit runs that
the fixed kinds drop.  Boosted trees judge each span by its format and its
context; their scores are calibrated on held-out rows (isotonic), and of
overlapping spans above the threshold the most probable is taken.

The trees are fitted on a bounded sample: the candidates of at most
``sample_rows`` documents by a hash of their id and text, labelled by the
fixed kinds (candidates inside dropped matches have no label and are left out),
and a fixed number of made-up examples of formats that the sample may lack.
Statistics of nothing else enter, and finding runs over all rows and whole texts.

All generators are linear in the text: an ``@`` looks back no further than the
last match, a digit run is read once, and windows end at 6 groups or 19 digits.

Defined results: null and empty texts have no spans; places count code points,
ends are exclusive; rows are independent (ties, repeated rows and further
columns don't matter); without any row the trees know the made-up examples only.
"""
from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm._arrow import id_and_text, map_texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 4000
SAMPLE_SPANS = 20_000
THRESHOLD = 0.9
#: digit groups of a proposed number (phone and card numbers have up to 6)
GROUPS = 6

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: all that a number can consist of; no number crosses the border of such a run
RUN = re.compile(r"\+?[0-9][0-9 ().+-]*")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GROUP = re.compile(r"[0-9]+")
WORDS = [re.compile(p, re.I) for p in (
    r"phone|call|tel\b|mobile|fax|contact", r"card|visa|credit|payment|account", r"mail|write|contact|address",
    r"version|order|isbn|date|page|chapter|serial|release|section|build")]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(GROUP.findall(s))


def _parts_fit(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        # nothing before this @ can be part of a later address's local part but what a match didn't use
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def _runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Spans of the fixed kinds (start, end, kind), by start, then kind as listed; and the dropped matches."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    dropped: list[tuple[int, int]] = []
    for lo, hi in _runs(text) if runs is None else runs:
        if hi - lo < 7:
            continue
        run = text[lo:hi]
        for kind, pattern, fits in (
                (1, IP, _parts_fit),
                (2, CARD, lambda s: 14 <= len(d := _only_digits(s)) <= 19 and luhn(d)),
                (3, PHONE, lambda s: 10 <= len(_only_digits(s)) <= 15)):
            for m in pattern.finditer(run):
                if fits(m.group()):
                    out.append((lo + m.start(), lo + m.end(), kind))
                elif kind > 1:
                    dropped.append((lo + m.start(), lo + m.end()))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))], dropped


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: str
    features: tuple


def _char_class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def _features(text: str, a: int, b: int, code: int, lo: int, hi: int) -> tuple:
    s, digits = text[a:b], _only_digits(text[a:b])
    groups = GROUP.findall(s)
    dots = s.split(".")
    around = text[max(0, a - 30):a] + " " + text[b:b + 15]
    left, _, right = s.partition("@")
    return (code, min(len(digits), 24), min(len(groups), 9), s[0] == "+", 12 <= len(digits) <= 19 and luhn(digits),
            "(" in s, "-" in s, "." in s, " " in s, min(len(dots), 6), code == 1 and _parts_fit(s),
            min(len(groups[0]), 12) if groups else 0, min(len(groups[-1]), 12) if groups else 0, min(b - a, 40),
            _char_class(text[a - 1:a]), _char_class(text[b:b + 1]),
            any("0" <= c <= "9" for c in text[max(lo, a - 3):a]), any("0" <= c <= "9" for c in text[b:min(hi, b + 3)]),
            *(bool(w.search(around)) for w in WORDS),
            min(len(left), 20) if code == 0 else 0, min(len(right.rpartition(".")[2]), 10) if code == 0 else 0,
            min(right.count("."), 4) if code == 0 else 0, len(set(digits)))


def _kind(s: str) -> str:
    digits = _only_digits(s)
    if len(digits) >= 14 and luhn(digits) and not set(s) & set("+()."):
        return "card"
    return "phone" if len(digits) < 16 else "card"


def candidates(text: str, runs: list[tuple[int, int]] | None = None) -> list[Candidate]:
    """All proposed spans with their features."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # an address with anything that could be a host after it
        a, b = at, at + 1
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        while b < len(text) and (text[b] in LOCAL and text[b] not in "%+_"):
            b += 1
        b -= text[b - 1] == "."
        if a < at < b - 1:
            out.append(Candidate(a, b, "email", _features(text, a, b, 0, a, b)))
        done = at + 1
        at = text.find("@", done)
    for lo, hi in _runs(text) if runs is None else runs:
        if hi - lo < 7:
            continue
        groups = [(lo + m.start(), lo + m.end()) for m in GROUP.finditer(text[lo:hi])]
        for i, (a, e) in enumerate(groups):
            if i + 3 < len(groups) and all(text[groups[k][1]:groups[k + 1][0]] == "." for k in range(i, i + 3)):
                z = groups[i + 3][1]
                if z - a < 16:
                    out.append(Candidate(a, z, "ip", _features(text, a, z, 1, lo, hi)))
            digits = 0
            start = a - 1 if text[a - 1:a] in ("+", "(") else a
            start -= start < a and text[start] == "(" and text[start - 1:start] == "+"
            for j in range(i, min(i + GROUPS, len(groups))):
                digits += groups[j][1] - groups[j][0]
                if digits > 19 or (j > i and groups[j][0] - groups[j - 1][1] > 3):
                    break
                if digits >= 7:
                    z = groups[j][1]
                    s = text[start:z]
                    if s.count("(") == s.count(")"):
                        out.append(Candidate(start, z, _kind(s), _features(text, start, z, 2, lo, hi)))
    return out


# -- examples -----------------------------------------------------------------------------------------------------


def made_up(n: int, seed: int = 17) -> list[tuple[tuple, bool]]:
    """Features and labels of ``n`` invented places: formats of personal data, and numbers that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))

    def card() -> str:
        s = r.choice("3456") + d(14)
        s += next(c for c in "0123456789" if luhn(s + c))
        return r.choice([s, " ".join(s[i:i + 4] for i in range(0, 16, 4)), "-".join(s[i:i + 4] for i in range(0, 16, 4))])

    def wrong_card() -> str:
        while luhn(s := r.choice("123456789") + d(15)):
            pass
        return s

    good = [lambda: f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}",
            lambda: f"+{r.randint(10, 99)}{d(10)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", card, card,
            lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)),
            lambda: f"{w()}.{w()}@{w()}.{r.choice(['com', 'org', 'de', 'co.uk'])}", lambda: f"{w()}{d(2)}@{w()}.{w()}.net"]
    bad = [lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"version {r.randint(1, 20)}.{d(1)}.{d(2)}.{d(3)}",
           lambda: f"order {wrong_card()}", wrong_card, lambda: f"{d(4)}.{d(3)}.{d(3)}.{d(4)}", lambda: f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
           lambda: d(r.randint(7, 13)), lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{w()}@{w()}", lambda: " ".join(d(2) for _ in range(8)),
           lambda: f"{d(2)}.{d(2)}.{d(4)} - {d(2)}.{d(2)}.{d(4)}"]
    out: list[tuple[tuple, bool]] = []
    while len(out) < n:
        text, places = r.choice(["", w() + " ", f"{w()} {w()}, "]), set()
        for _ in range(r.choice([1, 1, 1, 2])):  # sometimes two stand side by side
            want = r.random() < 0.5
            s = r.choice(good if want else bad)()
            if want:
                places.add((len(text), len(text) + len(s)))
            text += s + r.choice([" ", " ", ", "])
        text = text.rstrip(", ") + r.choice(["", " " + w(), ". " + w(), ", " + w()])
        out += [(c.features, (c.start, c.end) in places) for c in candidates(text)]
    return out[:n]


def labelled(text: str) -> list[tuple[tuple, bool]]:
    """Candidates of a text labelled by the fixed kinds."""
    runs = _runs(text)
    if not runs and "@" not in text:
        return []
    base, dropped = base_spans(text, runs)
    sure = {(a, b) for a, b, _ in base}
    found = candidates(text, runs)
    free = {(c.start, c.end) for c in _apart(found, dropped)}
    return [(c.features, (c.start, c.end) in sure) for c in found if (c.start, c.end) in sure or (c.start, c.end) in free]


# -- boosted trees ------------------------------------------------------------------------------------------------


class Trees:
    """Logistic boosting of depth-limited trees over small integer features, with isotonic calibration."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.trees: list[list[tuple[int, int, float]]] = []  # heap order: (feature or -1, cut, value)
        self.base = 0.0
        self.steps = (np.zeros(1), np.zeros(1))

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        nodes: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
        place = np.zeros(len(x), dtype=np.int64)
        for k in range(len(nodes)):
            here = np.flatnonzero(place == k)
            if not len(here):
                continue
            gs, hs = g[here].sum(), h[here].sum()
            best = (1e-6, -1, 0)
            if k < 2 ** self.depth - 1 and len(here) > 1:
                for f in range(x.shape[1]):
                    v = x[here, f]
                    gc, hc = np.cumsum(np.bincount(v, g[here]))[:-1], np.cumsum(np.bincount(v, h[here]))[:-1]
                    if len(gc):
                        gain = gc ** 2 / (hc + self.ridge) + (gs - gc) ** 2 / (hs - hc + self.ridge) - gs ** 2 / (hs + self.ridge)
                        i = int(np.argmax(gain))
                        if gain[i] > best[0]:
                            best = (float(gain[i]), f, i)
            nodes[k] = (best[1], best[2], float(-self.rate * gs / (hs + self.ridge)))
            if best[1] >= 0:
                place[here] = 2 * k + 1 + (x[here, best[1]] > best[2])
        return nodes

    def _value(self, nodes, x: np.ndarray) -> np.ndarray:
        place, out = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        feature, cut, value = (np.array(c) for c in zip(*nodes))
        for _ in range(self.depth + 1):
            f = feature[place]
            leaf = f < 0
            out[leaf] = value[place[leaf]]
            go = np.flatnonzero(~leaf)
            place[go] = 2 * place[go] + 1 + (x[go, f[go]] > cut[place[go]])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Trees:
        xt, yt = x[~held], y[~held].astype(float)
        mean = np.clip(yt.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        m = np.full(len(xt), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-m))
            self.trees.append(self._grow(xt, p - yt, p * (1 - p)))
            m += self._value(self.trees[-1], xt)
        self._calibrate(self.margin(x[held]), y[held].astype(float))
        return self

    def _calibrate(self, m: np.ndarray, y: np.ndarray) -> None:
        """Rising steps of the share of positives by margin (pooling neighbours that fall)."""
        order = np.argsort(m, kind="stable")
        pools: list[list[float]] = []
        for a, b in zip(m[order], y[order]):
            pools.append([a, b, 1.0])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, s, n = pools.pop()
                pools[-1][1] += s
                pools[-1][2] += n
        self.steps = (np.array([p[0] for p in pools]), np.array([(p[1] + 0.02) / (p[2] + 0.04) for p in pools]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.steps[0], self.margin(x), side="right") - 1
        return self.steps[1][np.maximum(at, 0)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
        sample_spans: int = SAMPLE_SPANS) -> Trees:
    """Trees fitted on the labelled candidates of a bounded sample of rows and on made-up examples."""
    rows = id_and_text(docs, id_col, text_col)
    total = rows.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = rows.filter((F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))) & F.col("text").isNotNull())

    def run(batches):
        for b in batches:
            found = [x for t in b.column("text").to_pylist() for x in labelled(t)]
            yield pa.RecordBatch.from_arrays([pa.array([[int(v) for v in f] for f, _ in found], pa.list_(pa.int32())),
                                              pa.array([y for _, y in found], pa.bool_())], ["x", "y"])

    got = sample.mapInArrow(run, "x array<int>, y boolean") \
        .orderBy(F.xxhash64("x", "y"), "x", "y").limit(sample_spans).toArrow().to_pydict()
    both = [*zip(got["x"], got["y"]), *made_up(12_000)]
    x = np.array([list(f) for f, _ in both], dtype=np.int64)
    y = np.array([bool(v) for _, v in both])
    return Trees().fit(x, y, np.arange(len(x)) % 4 == 3)


# -- the operator -------------------------------------------------------------------------------------------------


def select(text: str, trees: Trees, threshold: float = THRESHOLD) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, fixed) of all spans of a text, by start, then kind as listed."""
    runs = _runs(text)
    if not runs and "@" not in text:
        return []
    base, _ = base_spans(text, runs)
    out = [(a, b, k, True) for a, b, k in base]
    proposed = _apart(candidates(text, runs), [(a, b) for a, b, _ in base])
    if proposed:
        p = trees.probability(np.array([[int(v) for v in c.features] for c in proposed], dtype=np.int64))
        taken = bytearray(max(c.end for c in proposed) + 1)
        for i in sorted(np.flatnonzero(p >= threshold), key=lambda i: (-p[i], proposed[i].start - proposed[i].end, proposed[i].start)):
            c = proposed[i]
            if taken.find(1, c.start, c.end) < 0:
                taken[c.start:c.end] = b"\1" * (c.end - c.start)
                out.append((c.start, c.end, c.kind, False))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _apart(proposed: list[Candidate], spans: list[tuple[int, int]]) -> list[Candidate]:
    """Candidates that touch none of the spans (one look at the spans' places, however many there are)."""
    if not spans or not proposed:
        return proposed
    used = bytearray(max(*(c.end for c in proposed), *(b for _, b in spans), 1) + 1)
    for a, b in spans:
        used[a:b] = b"\1" * (b - a)
    return [c for c in proposed if used.find(1, c.start, c.end) < 0]


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None,
                  threshold: float = THRESHOLD, redact: bool = False) -> DataFrame:
    """``id`` and ``spans array<struct<kind,start,end,base>>`` per row; with ``redact`` also ``redacted``, the text
    with each (merged) span replaced by its kind in angle brackets."""
    model = df.sparkSession.sparkContext.broadcast(trees or fit(df, id_col, text_col))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(texts: pa.Array) -> list[pa.Array]:
        texts = texts.to_pylist()
        found = [select(t or "", model.value, threshold) for t in texts]
        cols = [pa.array([[{"kind": k, "start": a, "end": b, "base": f} for a, b, k, f in s] for s in found], span)]
        if redact:
            cols.append(pa.array([None if t is None else redacted(t, s) for t, s in zip(texts, found)], pa.string()))
        return cols

    return map_texts(df, run, ""
                     "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>" + ", redacted string" * redact,
                     id_col, text_col)


def redacted(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, kind, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:  # overlapping spans are one
            b = max(b, spans[i][1])
            i += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]]) if out else text
