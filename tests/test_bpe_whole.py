"""The encoding queries learn and apply the whole vocabulary."""
import random
from collections import Counter

from pairforge.operators import encode as EN


def _plain(counts, most, least):
    words, out = [(list(w), c) for w, c in counts.items()], []
    while len(out) < most:
        n = Counter()
        for s, c in words:
            for p in zip(s, s[1:]):
                n[p] += c
        p = min(n, key=lambda p: (-n[p], p), default=None)
        if p is None or n[p] < least:
            break
        out.append((*p, n[p]))
        for s, _ in words:
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == p:
                    s[i:i + 2] = [s[i] + s[i + 1]]
                i += 1
    return out


def test_encoded_documents_use_all_merges(spark, tmp):
    """Not the first 20 of them."""
    import __spark_entry__ as E

    r = random.Random(7)
    parts = ["ing", "tion", "ther", "and", "was", "re", "un", "ly"]
    docs = [(i, " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(40)) if i else None) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp}/documents.parquet")
    words = Counter(w for _, t in docs for w in (t or "").split())
    merges = _plain(words, 32_000, 3)
    ranks = {}
    for i, (a, b, _) in enumerate(merges):
        ranks.setdefault((a, b), i)
    want = {i: (len(t.split()), sum(len(EN.bpe_word(w, ranks)) for w in t.split())) for i, t in docs if t}
    assert len(merges) > 60
    for name in ("bpe_encode_docs", "bpe_pieces_docs"):
        assert {x.doc_id: (x.n_tokens, x.n_pieces) for x in E.queries()[name](spark, tmp).collect()} == want
    assert "bpe_encode_docs" not in E.oracle_sql()  # SQL can follow 20 merges only
