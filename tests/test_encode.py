from collections import Counter

from pyspark.sql import functions as F

from pairforge.operators import encode as EN


def _py_bpe(counts, k):
    words = {w: list(w) for w in counts}
    merges = []
    for r in range(k):
        pc = Counter()
        for w, s in words.items():
            for x, y in zip(s, s[1:]):
                pc[(x, y)] += counts[w]
        if not pc:
            break
        (a, b), n = sorted(pc.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        merges.append((r, a, b, n))
        for w, s in words.items():
            out, i = [], 0
            while i < len(s):
                if i < len(s) - 1 and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            words[w] = out
    return merges


def test_bpe_train_matches_loop(spark):
    counts = {"lower": 5, "lowest": 2, "newer": 6, "wider": 3, "new": 2, "aaaa": 4}
    df = spark.createDataFrame(list(counts.items()), "token string, count long")
    got = [tuple(r) for r in EN.bpe_train(df, 8, checkpoint_every=3).orderBy("rank").collect()]
    assert got == _py_bpe(counts, 8)


def test_bpe_encode(spark):
    merges = spark.createDataFrame([(0, "l", "o"), (1, "lo", "w")], "rank int, left string, right string")
    texts = spark.createDataFrame([(1, ["low", "lot", "x"])], "id int, t array<string>")
    rows = {r.token: r.pieces for r in EN.bpe_encode(texts, "id", "t", merges).collect()}
    assert rows == {"low": ["low"], "lot": ["lo", "t"], "x": ["x"]}


def test_encode_ids(spark):
    texts = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "id int, t array<string>")
    vocab = EN.build_vocab(EN.vocab_counts(texts, "t", 1))
    got = {r.id: r.ids for r in EN.encode(texts, "id", "t", vocab, 6).collect()}
    assert got[1] == [4, 5, 4, 2, 0, 0] and got[2] == [2, 0, 0, 0, 0, 0]


def test_bpe_many_merges_a_round_match_one_at_a_time(spark, monkeypatch):
    import random
    r = random.Random(9)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ab", "abc", "bc"]
    counts = {"".join(r.choice(parts) for _ in range(r.randint(1, 5))): r.randint(1, 60) for _ in range(400)}
    df = spark.createDataFrame(list(counts.items()), "token string, count long")
    rounds = []
    one_round = EN._independent
    monkeypatch.setattr(EN, "_independent", lambda top, least: rounds.append(1) or one_round(top, least))
    got = [tuple(x) for x in EN.bpe_train(df, 40).orderBy("rank").collect()]
    assert got == [m for m in _py_bpe(counts, 40) if m[3] >= 3]
    assert len(rounds) < len(got)


def _counts(seed, n):
    import random
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ab", "abc", "bc", "aa", "é"]
    return {"".join(r.choice(parts) for _ in range(r.randint(1, 5))): r.randint(1, 30) for _ in range(n)}


def test_rounds_learn_the_whole_vocabulary_like_one_merge_at_a_time(spark):
    from pairforge.operators import bpe_rounds as BR
    counts = _counts(4, 300)
    want = [m for m in _py_bpe(counts, 2000) if m[3] >= 3]
    df = spark.createDataFrame(list(counts.items()), "token string, count long")
    for bounds in ({}, {"words": 60, "pairs": 40}, {"words": 150, "pairs": 1000}):
        log = []
        got = [tuple(x) for x in BR.learn(df, 2000, log=log, **bounds).orderBy("rank").collect()]
        assert got == want, bounds
        assert all(n <= bounds.get("words", 10 ** 6) for _, n in log) and (not bounds or len(log) > 3)
    assert len(want) > 200


def test_vocabulary_size_counts_characters_and_special_tokens(spark):
    from pairforge.operators import bpe_rounds as BR
    counts = _counts(5, 50)
    df = spark.createDataFrame(list(counts.items()) + [("", 3)], "token string, count long")
    letters = len({x for w in counts for x in w})
    assert BR.vocabulary(df, vocab_size=5 + letters + 7, min_frequency=1).count() == 7
    assert BR.vocabulary(df, vocab_size=3).count() == 0
    assert BR.learn(df.limit(0), 5).count() == 0


def _loop_word(word, ranks):
    syms = list(word)
    while True:
        known = [ranks[p] for p in zip(syms, syms[1:]) if p in ranks]
        if not known:
            return syms
        best, out, i = min(known), [], 0
        while i < len(syms):
            if i + 1 < len(syms) and ranks.get((syms[i], syms[i + 1])) == best:
                out.append(syms[i] + syms[i + 1])
                i += 2
            else:
                out.append(syms[i])
                i += 1
        syms = out


def test_bpe_word_is_the_plain_loop_in_less_steps():
    import random
    import time
    r = random.Random(3)
    for _ in range(300):
        symbols = list("abc")
        ranks = {}
        for k in range(r.randint(1, 25)):
            a, b = r.choice(symbols), r.choice(symbols)
            ranks.setdefault((a, b), k)
            symbols.append(a + b)
        word = "".join(r.choice("abc") for _ in range(r.randint(0, 40)))
        assert EN.bpe_word(word, ranks) == _loop_word(word, ranks)
    ranks = {("a" * 2 ** k, "a" * 2 ** k): k for k in range(14)} | {("a", "b"): 20}
    t = time.perf_counter()
    assert "".join(EN.bpe_word("ab" * 50_000 + "a" * 50_000, ranks)) == "ab" * 50_000 + "a" * 50_000
    assert time.perf_counter() - t < 5


def test_encode_beyond_the_leading_tokens(spark):
    import random
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, [r.choice(words[:r.randint(1, 60)]) if r.random() < 0.95 else None for _ in range(r.randint(0, 30))]) for i in range(50)]
    rows += [(50, None), (None, ["w1", "w59"]), (51, ["not known"])]
    texts = spark.createDataFrame(rows, "id int, t array<string>")
    vocab = EN.build_vocab(EN.vocab_counts(texts.filter("id < 40"), "t", 2)).filter("token IS NOT NULL").cache()
    ids = {x.token: x.id for x in vocab.collect()}

    def plain(t, n, eos):
        out = [ids.get(w, EN.UNK) for w in (t or [])][:None if n is None else n - eos] + [EN.EOS] * eos
        return out + [EN.PAD] * ((n or 0) - len(out))
    for max_len, eos in ((12, True), (None, False), (None, True), (9, False)):
        want = sorted(((i, plain(t, max_len, eos)) for i, t in rows), key=str)
        for leading in (1000, 5, 0):
            got = EN.encode(texts, "id", "t", vocab, max_len, eos, leading=leading)
            assert sorted(((x.id, x.ids) for x in got.collect()), key=str) == want
