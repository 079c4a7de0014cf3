r"""Language identification by a linear-chain conditional random field (operator 7).

Every word is labelled: its features are its byte 2- and 3-grams with word
borders, its affixes of 3 and 4 letters and the language whose lexicon holds it;
learned transitions say how rarely a text switches its language.  The
forward-backward recursion gives each word's label probabilities, and a
text's language is the one with the largest mean, which is also its score.

The field is fitted on a bounded sample of labelled rows (``rows_per_lang`` of
each language and ``MAX_SAMPLE`` in all, in the order of a hash; of longer texts a
piece of ``max_chars`` at a hashed place, or less where ``total_chars`` would be
passed), from which code-switched sequences are put together: pieces of
texts of random languages in a row, every word labelled with its text's
language.  Prediction reads the text alone.

Long texts are cut into segments that are recursed side by side: each
segment's transfer matrix is taken first, the segments' border vectors follow
from the matrices, and then all segments run with their true borders, so the result is
that of one long recursion and no loop is longer than a segment.

Defined results: texts of any length are read whole; an empty table gives no
rows; null texts and texts without a letter are ``und`` with score 0;
ties go to the smaller name; rows are independent (repeated rows and further columns
don't matter); without labelled rows every text is ``und``.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm._arrow import held, id_and_text, map_texts
from pairforge.llm._words import mix

ROWS_PER_LANG = 300
MAX_SAMPLE = 6000
#: characters taken of a sampled row, and of all sampled rows
MAX_CHARS, TOTAL_CHARS = 20_000, 30_000_000
SEGMENT = 512
#: words whose emissions a worker holds between texts; full, they are dropped
CACHE_WORDS = 200_000
BITS = 15

_KEEP = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of lower-case letters (bytes beyond ASCII count as letters)."""
    return text.lower().encode().translate(_KEEP).split()


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last code point of each of a text's words (as ``words_of`` cuts them)."""
    low = text.lower()
    data = np.frombuffer(low.encode(), dtype=np.uint8)
    letter = np.concatenate([[False], (data >= 0x80) | (data >= 0x61) & (data <= 0x7A), [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before a byte
    first, last = place[edge[::2]], place[edge[1::2]]
    if len(low) == len(text):
        return first, last
    of = np.repeat(np.arange(len(text) + 1), [*(len(c.lower()) for c in text), 1])  # some letters are longer in lower case
    return of[first], of[last - 1] + 1


def has_letter(text: str | None, words: list[bytes]) -> bool:
    """Words with an ASCII letter decide at once; others are looked at letter by letter."""
    return any(w[0] < 0x80 or w[-1] < 0x80 for w in words[:50]) or any(c.isalpha() for c in text or "")


def word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(w) for w in words], dtype=np.int64)
    at = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix((data + np.uint64(1)) * np.uint64(0x100000001B3) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
    ends = np.cumsum(size)
    return mix(total[ends] - total[ends - size])


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, hashed feature) of all n-gram and affix features."""
    data = np.frombuffer(b"".join(b"^%b$" % w for w in words), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    out_w, out_f = [], []
    acc = data
    for n in range(2, 6):
        acc = acc[:-1] * np.uint64(0x100000001B3) + data[n - 1:]
        inside = word[:len(acc)] == word[n - 1:]
        if n > 3:  # affixes: only the grams at the borders
            border = np.zeros(len(acc), dtype=bool)
            long = size >= n
            border[first[long]] = True
            border[(first + size - n)[long]] = True
            inside = inside & border
        out_w.append(word[:len(acc)][inside])
        out_f.append((mix(acc[inside] + np.uint64(n << 56)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out_w), np.concatenate(out_f)


class Field:
    """Weights of the features, lexicon, transitions and start of a fitted field."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.weights = np.zeros(((1 << BITS) + k + 1, k))
        self.transitions = np.zeros((k, k))
        self.start = np.zeros(k)
        self.lexicon = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def learned(self) -> bool:
        """Can languages be told apart (or is there a single one)?"""
        return len(self.labels) == 1 or bool(self.weights.any())

    def _lexicon_feature(self, words: list[bytes]) -> np.ndarray:
        known, label = self.lexicon
        h = word_hashes(words)
        if not len(known):
            return np.full(len(words), (1 << BITS) + len(self.labels))
        i = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return (1 << BITS) + np.where(known[i] == h, label[i], len(self.labels))

    def all_features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        w, f = features(words)
        return np.concatenate([w, np.arange(len(words))]), np.concatenate([f, self._lexicon_feature(words)])

    def emissions(self, words: list[bytes]) -> np.ndarray:
        w, f = self.all_features(words)
        return np.stack([np.bincount(w, self.weights[f, k], minlength=len(words)) for k in range(len(self.labels))], axis=1)


def _forward(e, a, base, active, state, keep=None):
    """Run segments (longest first) from their entering vectors; fills ``keep`` and gives each one's last vector."""
    state = state.copy()
    shape = (-1,) + (1,) * (state.ndim - 2) + (e.shape[1],)
    for t, n in enumerate(active):
        cur = state[:n] if t == 0 else state[:n] @ a
        cur = cur * e[base[:n] + t].reshape(shape)
        cur /= cur.sum(axis=tuple(range(1, cur.ndim)), keepdims=True)
        state[:n] = cur
        if keep is not None:
            keep[base[:n] + t] = cur
    return state


def marginals(e: np.ndarray, counts: np.ndarray, start: np.ndarray, a: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Label probabilities of every word; ``e`` has the positive emission factors of all texts' words in a row,
    ``counts`` the words of each text."""
    k = e.shape[1]
    if not len(e):
        return e
    pieces = np.maximum(-(-counts // segment), 0)
    doc = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    base = (np.cumsum(counts) - counts)[doc] + nth * segment
    size = np.minimum(counts[doc] - nth * segment, segment)
    enter = np.tile(start, (len(doc), 1))
    dual = np.ones((len(doc), k))
    if (many := np.flatnonzero(pieces[doc] > 1)).size:
        o = many[np.argsort(-size[many], kind="stable")]
        moved = np.empty((len(doc), k, k))
        moved[o] = _forward(e, a, base[o], _active(size[o]), np.tile(np.eye(k), (len(o), 1, 1)))
        first = np.cumsum(pieces) - pieces
        for j in range(1, int(pieces.max())):  # borders, of all texts that have a j-th segment at once
            s = first[pieces > j] + j
            v = np.einsum("nk,nkl->nl", enter[s - 1], moved[s - 1]) @ a
            enter[s] = v / v.sum(axis=1, keepdims=True)
        for j in range(int(pieces.max()) - 1, 0, -1):
            s = first[pieces > j] + j
            d = np.einsum("nkl,nl->nk", moved[s], dual[s]) @ a.T
            dual[s - 1] = d / d.sum(axis=1, keepdims=True)
    o = np.argsort(-size, kind="stable")
    base, active, back = base[o], _active(size[o]), dual[o]
    out = np.empty_like(e)
    _forward(e, a, base, active, enter[o], out)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = base[:n] + t
        p = out[at] * back[:n]
        out[at] = p / p.sum(axis=1, keepdims=True)
        if t:
            b = (e[at] * back[:n]) @ a.T
            back[:n] = b / b.sum(axis=1, keepdims=True)
    return out


def _active(size: np.ndarray) -> list[int]:
    """How many segments (longest first) are longer than t, for each t."""
    return (len(size) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")).tolist() if len(size) else []


def fit_field(rows: list[tuple[str, str]], rounds: int = 25, sequences: int = 1500, length: int = 64, seed: int = 5) -> Field:
    """Maximum-likelihood fit (Adam, full batch) on code-switched sequences made from (text, language) rows."""
    field = Field(sorted({lang for _, lang in rows}))
    k = len(field.labels)
    number = {lang: i for i, lang in enumerate(field.labels)}
    texts = [(w, number[lang]) for t, lang in sorted(rows) if (w := words_of(t))]
    if not texts or k < 2:
        return field
    # lexicon: words of two or more rows whose rows are mostly of one language
    vocabulary: dict[bytes, np.ndarray] = {}
    for w, y in texts:
        for x in set(w):
            vocabulary.setdefault(x, np.zeros(k))[y] += 1
    kept = [(x, int(c.argmax())) for x, c in vocabulary.items() if c.sum() >= 2 and c.max() >= 0.8 * c.sum()]
    if kept:
        h = word_hashes([x for x, _ in kept])
        o = np.argsort(h)
        field.lexicon = (h[o], np.array([y for _, y in kept], dtype=np.int64)[o])
    r = np.random.default_rng(seed)
    by_lang = [[w for w, y in texts if y == i] for i in range(k)]
    langs = [i for i in range(k) if by_lang[i]]
    flat: list[bytes] = []
    labels: list[int] = []
    y = -1
    while len(flat) < sequences * length:
        if len(flat) % length == 0 or y < 0 or r.random() < 0.3:
            y = int(r.choice(langs))
        w = by_lang[y][int(r.integers(len(by_lang[y])))]
        n = int(r.integers(5, 40))
        at = int(r.integers(max(1, len(w) - n + 1)))
        flat += w[at:at + n]
        labels += [y] * len(w[at:at + n])
    flat, lab = flat[:sequences * length], np.array(labels[:sequences * length])
    distinct = sorted(set(flat))
    place = {x: i for i, x in enumerate(distinct)}
    word = np.array([place[x] for x in flat])
    fw, ff = field.all_features(distinct)
    one = np.eye(k)[lab]
    pairs = np.zeros((k, k))
    grid = lab.reshape(sequences, length)
    np.add.at(pairs, (grid[:, :-1].ravel(), grid[:, 1:].ravel()), 1)
    params = [field.weights, field.transitions, field.start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    counts = np.full(sequences, length)
    base = np.arange(sequences) * length
    for step in range(1, rounds + 1):
        raw = field.emissions(distinct)[word]
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        a = np.exp(field.transitions)
        p = marginals(e, counts, np.exp(field.start), a)
        # expected transitions from forward and backward vectors of neighbouring words
        fwd = np.empty_like(e)
        _forward(e, a, base, [sequences] * length, np.tile(np.exp(field.start), (sequences, 1)), fwd)
        bwd = (p / np.maximum(fwd, 1e-300)).reshape(sequences, length, k)
        left, right = fwd.reshape(sequences, length, k)[:, :-1], bwd[:, 1:] * e.reshape(sequences, length, k)[:, 1:]
        joint = np.einsum("stk,kl,stl->stkl", left, a, right)
        joint = (joint / joint.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
        rest = one - p
        by_word = np.stack([np.bincount(word, rest[:, j], minlength=len(distinct)) for j in range(k)], axis=1)
        gw = np.stack([np.bincount(ff, by_word[fw, j], minlength=len(field.weights)) for j in range(k)], axis=1)
        grads = [gw - 0.5 * field.weights, pairs - joint - 0.5 * field.transitions,
                 rest.reshape(sequences, length, k)[:, 0].sum(axis=0) - 0.5 * field.start]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] += 0.1 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    field.weights = field.weights.astype(np.float32)
    return field


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_lang: int = ROWS_PER_LANG, max_chars: int = MAX_CHARS, total_chars: int = TOTAL_CHARS) -> Field:
    """Fit on a bounded sample of the labelled rows (see the module's text for the bounds)."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")) \
        .filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {x["lang"]: x["count"] for x in rows.groupBy("lang").count().collect()}
    names = list(counts)
    each = max(1, min(rows_per_lang, MAX_SAMPLE // max(1, len(names))))
    top = 1 << 40
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, int(min(1.0, each / n) * top)).otherwise(share)
    size = max(1, min(max_chars, total_chars // max(1, each * len(names))))
    # a longer text gives the piece that starts at a hashed place
    first = F.pmod(F.xxhash64("lang", "id", F.length("text")), F.greatest(F.length("text") - size, F.lit(0)) + 1) + 1
    piece = F.col("text").substr(first.cast("int"), F.lit(size)).alias("text")
    sample = rows.filter(F.pmod(F.xxhash64("id", "lang", "text"), F.lit(top)) < share).select(piece, "lang")
    got = sample.orderBy(F.xxhash64("text", "lang")).limit(2 * MAX_SAMPLE).toArrow().to_pydict() if counts else {"text": [], "lang": []}
    pairs = list(zip(got["text"], got["lang"]))
    return fit_field(pairs + [("", x) for x in names])


class _Numbers(dict):
    """Numbers of words; a new word gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Labeller:
    """A fitted field with the emissions of the words met so far."""

    def __init__(self, field: Field):
        self.field = field
        self.known = _Numbers()
        self.rows = np.empty((0, len(field.labels)))

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = _Numbers()
        at = len(self.known)
        index = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        if new := self.known.new:
            self.known.new = []
            raw = self.field.emissions(new)
            raw = np.exp(np.clip(raw - raw.max(axis=1, keepdims=True), -60, 0))
            if len(self.known) > len(self.rows):
                more = np.empty((2 * len(self.known), raw.shape[1]))
                more[:at] = self.rows[:at]
                self.rows = more
            self.rows[at:len(self.known)] = raw
        return index

    def probabilities(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words in a row, and each text's number of words."""
        index = self._numbers([w for t in texts for w in t])
        counts = np.array([len(t) for t in texts], dtype=np.int64)
        rows = self.rows[index] if len(index) else np.empty((0, len(self.field.labels)))
        return marginals(rows, counts, np.exp(self.field.start), np.exp(self.field.transitions)), counts


def mean_labels(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean label probabilities of each text."""
    total = np.zeros((len(p) + 1, p.shape[1]))
    np.cumsum(p, axis=0, out=total[1:])
    ends = np.cumsum(counts)
    return (total[ends] - total[ends - counts]) / np.maximum(counts, 1)[:, None]


def label_spans(p: np.ndarray, text: str, labels: list[str]) -> list[dict]:
    """Runs of a text's neighbouring words whose most probable label is the same."""
    best = p.argmax(axis=1)
    cut = np.flatnonzero(best[1:] != best[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(best)]])
    starts, ends = word_places(text)
    sure = np.add.reduceat(p[np.arange(len(best)), best], first) / (last - first)
    return [{"lang": labels[best[i]], "start": int(starts[i]), "end": int(ends[j - 1]), "words": int(j - i), "probability": min(1.0, float(x))}
            for i, j, x in zip(first, last, sure)]


SPAN = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("probability", pa.float64())]))


def identify(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", shares: bool = True,
             keep_text: bool = False, spans: bool = False) -> DataFrame:
    """``id``, ``lang``, ``score`` and, with ``shares``, ``shares map<string,double>`` (of each learned language) per row.

    With ``spans`` also ``spans array<struct<lang,start,end,words,probability>>``: the languages of a code-switched text in order, as runs of
    words with one label (code points, end exclusive; none where ``lang`` is ``und``)."""
    sent = df.sparkSession.sparkContext.broadcast(field)

    def run(texts: pa.Array) -> list[pa.Array]:
        labeller = held("langid", sent.value, Labeller)
        labels = labeller.field.labels
        texts = texts.to_pylist()
        words = [words_of(t) if t else [] for t in texts]
        spoken = [has_letter(t, w) and bool(labels) for t, w in zip(texts, words)]
        p, counts = labeller.probabilities(words) if labels else (np.empty((0, 1)), np.zeros(len(texts), dtype=np.int64))
        s = mean_labels(p, counts)
        best = s.argmax(axis=1)
        out = [pa.array([labels[b] if ok else "und" for b, ok in zip(best, spoken)], pa.string()),
               pa.array([min(1.0, float(s[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, spoken))], pa.float64())]
        if shares:
            out.append(pa.array([list(zip(labels, x.tolist())) if ok else [] for x, ok in zip(s, spoken)], pa.map_(pa.string(), pa.float64())))
        if spans:
            ends = np.cumsum(counts)
            out.append(pa.array([label_spans(p[e - n:e], t, labels) if ok and n else [] for t, ok, n, e in zip(texts, spoken, counts, ends)], SPAN))
        return out

    return map_texts(df, run, "lang string, score double" + ", shares map<string,double>" * shares
                     + ", spans array<struct<lang:string,start:bigint,end:bigint,words:bigint,probability:double>>" * spans,
                     id_col, text_col, 1 << 20, keep_text)
