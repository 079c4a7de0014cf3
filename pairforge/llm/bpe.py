"""Byte-level BPE encoding by backtracking, decoding by an offset table (operator 8).

A token sequence is the exact result of BPE merging when every neighbouring
pair of it is: merging the two tokens' bytes gives these two tokens again.  The
encoder therefore takes the longest token at each place (Aho-Corasick), checks
it against the token before it in the pair table, tries shorter prefixes when
the pair fails, and steps back one token when none is left.  Places from which
no way leads on are remembered, so each is given up once and the time is
linear.  Decoding gathers every id's bytes from one blob through a table of offsets.

Defined results: texts of any length are read whole; an empty table gives no
rows; a null text is the empty text (no ids, empty decoding); the
special token's own string in a text becomes its id; ids and decodings are per
row, so ties, repeated rows and further columns don't matter.
"""
from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pairforge.llm._arrow import held, map_texts

#: words held by a worker between texts (an entry takes about 250 bytes); full, it is emptied.
CACHE_WORDS = 300_000
#: checked token pairs held by a worker (an entry takes about 150 bytes); full, they are dropped.
PAIRS = 400_000
#: longer words are encoded each time
CACHE_CHARS = 48


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabulary files write each byte (fixed rule of the format)."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCodec:
    """Tables of one byte-level BPE vocabulary file and the two directions of the code."""

    def __init__(self, spec: str):
        import public_tokenizers
        j = json.loads(spec)
        letters = _byte_letters()
        raw = lambda t: bytes(letters[c] for c in t).decode("latin-1")
        vocab = {raw(t): i for t, i in j["model"]["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in j["model"]["merges"]]
        # own numbers: bytes first, then merges in their order, so a smaller number merges earlier
        self.own: list[str] = [chr(b) for b in range(256)]
        number = {t: i for i, t in enumerate(self.own)}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            x, y = number[raw(a)], number[raw(b)]
            t = self.own[x] + self.own[y]
            if t not in number:
                number[t] = len(self.own)
                self.own.append(t)
                self.halves.append((x, y))
            self.merged.setdefault((x, y), number[t])
        self.id_of = [vocab[t] for t in self.own]
        self.le = [int(i).to_bytes(4, "little") for i in self.id_of]
        self.length = [len(t) for t in self.own]
        self.automaton = ahocorasick.Automaton()
        for t, i in number.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.prefix = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1)
                       for t in self.own]
        self.specials = {t["content"]: t["id"] for t in j.get("added_tokens", ())}
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) \
            if self.specials else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        # decoding: all tokens' bytes in one blob, by id
        texts = {i: t.encode("latin-1") for t, i in vocab.items()} | {i: t.encode() for t, i in self.specials.items()}
        size = max(texts) + 1
        self.widths = np.array([len(texts.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.blob = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), dtype=np.uint8)

    def _compatible(self, a: int, b: int) -> bool:
        """True if merging the bytes of tokens a, b never joins across their border."""
        bar = len(self.own)
        while True:
            if self.merged.get((a, b), bar) < bar:
                return False
            # undo the later of the two merges that made the tokens at the border
            if a > b:
                if a < 256:
                    return True
                bar, a = a, self.halves[a][1]
            else:
                if b < 256:
                    if a < 256:
                        return True
                    bar, a = a, self.halves[a][1]
                else:
                    bar, b = b + 1, self.halves[b][0]

    def _word(self, word: str) -> bytes:
        """Ids (little-endian, 32 bits) of one word between split points."""
        text = word if word.isascii() else word.encode().decode("latin-1")
        n, length, fits = len(text), self.length, self.fits
        longest = [0] * n
        for end, t in self.automaton.iter(text):
            longest[end + 1 - length[t]] = t  # ends rise, so the last one is the longest
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    ok = fits.get((last, token))
                    if ok is None:
                        if len(fits) > PAIRS:
                            fits.clear()
                        ok = fits[last, token] = self._compatible(last, token)
                    if ok:
                        break
                token = self.prefix[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at < n:
                    token = longest[at]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
        le = self.le
        return b"".join([le[t] for t in out])

    def _plain(self, text: str) -> bytes:
        known, found = self.known, []
        for w in self.split.findall(text):
            ids = known.get(w)
            if ids is None:
                ids = self._word(w)
                if len(w) <= CACHE_CHARS:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = ids
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not self.at_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [self._plain(text[at:m.start()]), int(self.specials[m.group()]).to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids (one gather through the offset table); ids outside the table give nothing."""
        ids = ids[(ids >= 0) & (ids < len(self.widths))].astype(np.int64)
        w = self.widths[ids]
        total = int(w.sum())
        shift = self.starts[ids] - (np.cumsum(w) - w)
        return self.blob[np.repeat(shift, w) + np.arange(total)].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", "replace")


def _spec(path: str | None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           digests: bool = False, keep: bool = True) -> DataFrame:
    """Encode every text and decode the ids again: ``id``, ``n_tokens`` and, with ``keep``, ``ids array<int>``
    and ``decoded``; with ``digests`` also ``ids_sha256`` (little-endian 32-bit ids) and ``decoded_sha256``.

    The vocabulary file (bounded by its format, read once on the driver) goes to the tasks as one broadcast.
    """
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(_spec(path))
    schema = "n_tokens bigint"
    schema += ", ids array<int>, decoded string" if keep else ""
    schema += ", ids_sha256 string, decoded_sha256 string" if digests else ""

    def run(texts: pa.Array) -> list[pa.Array]:
        codec = held("bpe", spec.value, BytePairCodec)
        raw = [codec.encode(t or "") for t in texts.to_pylist()]
        ids = [np.frombuffer(r, dtype="<u4") for r in raw]
        texts_out = [codec.decode_text(i) for i in ids]
        cols = [pa.array([len(i) for i in ids], pa.int64())]
        if keep:
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            cols += [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(texts_out, pa.string())]
        if digests:
            cols += [pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts_out], pa.string())]
        return cols

    return map_texts(df, run, schema, id_col, text_col)
