r"""Secret scan: fixed patterns plus a token-efficiency test (operator 4).

Fixed kinds (leftmost, non-overlapping; failing matches are dropped):
``assign`` a keyword, ``:`` or ``=`` and a value of 6 or more characters,
``access`` ``AKIA`` keys of 20 or more characters, ``hex`` runs of 24 or more.

The method adds ``opaque``: a run of 16 or more key characters that a
subword vocabulary can hardly shorten.  Words, names and paths are made of long
tokens; random strings are not, so few characters per token expose them.  Runs
that are known digests (hex of a digest's length) or identifiers (UUIDs, plain numbers),
and runs inside a fixed span, are left out.  Tokens are counted in pieces of
256 characters, so a long run costs linear time.  A run whose mean is inconspicuous as a whole (a key
in a path, a URL or a dashed name) is tested part by part between ``/``, ``_``, ``+``
and ``-``: neighbouring parts that each fail are reported together from 16 characters on,
if one of them has 8 or more (dates and versions are made of shorter ones).

Defined results: texts of any length are read whole; an empty table gives no
rows; null and empty texts have no spans; places count code points,
ends are exclusive; rows are independent (ties, repeated rows and further
columns don't matter).
"""
from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from pairforge.llm._arrow import held, map_texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
IDENTIFIER = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9_/+-]+", re.I)
KINDS = ("assign", "access", "hex", "opaque")
#: below so many characters a token a run is opaque (random base64: 1.2 to 1.6); runs that could be a word
#: (letters, at most the first one a capital) must be below the second figure, as rare words reach 1.6
RATIO, WORD_RATIO = 1.9, 1.4
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
PIECE = 256
PART = re.compile(r"[A-Za-z0-9]+={0,2}")
UUID = re.compile(r"(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])", re.I)
#: characters of an opaque span at least, and of its longest part where it is not a whole run
LEAST, LEAST_PART = 16, 8


def _vocabulary(ranks: bytes, pattern: str):
    import tiktoken
    table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed kinds, ordered by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def opaque_spans(text: str, base: list[tuple[int, int, str]], vocabulary, ratio: float = RATIO,
                 word_ratio: float = WORD_RATIO) -> list[tuple[int, int, str]]:
    def opaque(run: str) -> bool:
        tokens = sum(len(vocabulary.encode_ordinary(run[i:i + PIECE])) for i in range(0, len(run), PIECE))
        return len(run) < (word_ratio if WORD.fullmatch(run) else ratio) * tokens

    out = []
    for m in RUN.finditer(text):
        run, (a, b) = m.group(), m.span()
        if DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run) or any(x <= a and b <= y for x, y, _ in base):
            continue
        spans = [(a, b)] if opaque(run) else [(a + x, a + y) for x, y in _opaque_parts(run, opaque)]
        out += [(x, y, "opaque") for x, y in spans if not any(p <= x and y <= q for p, q, _ in base)]
    return out


def _opaque_parts(run: str, opaque) -> list[tuple[int, int]]:
    """Neighbouring parts of a run that are opaque each, from ``LEAST`` characters on."""
    uuids = [m.span() for m in UUID.finditer(run)]
    groups: list[list[int]] = []  # start, end, longest part
    at = 0
    for m in PART.finditer(run):
        part, (a, b) = m.group(), m.span()
        while at < len(uuids) and uuids[at][1] <= a:
            at += 1
        if (at < len(uuids) and uuids[at][0] <= a) or DIGEST.fullmatch(part) or IDENTIFIER.fullmatch(part) or not opaque(part):
            continue
        if groups and a == groups[-1][1] + 1:
            groups[-1][1:] = [b, max(groups[-1][2], b - a)]
        else:
            groups.append([a, b, b - a])
    return [(a, b) for a, b, longest in groups if b - a >= LEAST and longest >= LEAST_PART]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 ratio: float = RATIO, word_ratio: float = WORD_RATIO) -> DataFrame:
    """``id`` and ``spans array<struct<kind,start,end,base>>`` (all kinds, by start, then kind as listed).

    The vocabulary file (bounded by its format) is read on the driver and broadcast."""
    import public_tokenizers
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(texts: pa.Array) -> list[pa.Array]:
        vocabulary = held("secrets", ranks.value, lambda v: _vocabulary(*v))
        rows = []
        for t in texts.to_pylist():
            t = t or ""
            base = base_spans(t)
            more = opaque_spans(t, base, vocabulary, ratio, word_ratio)
            both = sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))
            rows.append([{"kind": k, "start": a, "end": b, "base": k != "opaque"} for a, b, k in both])
        return [pa.array(rows, span)]

    return map_texts(df, run, ""
                     "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>", id_col, text_col)
