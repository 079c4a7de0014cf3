import hashlib
import random
import re

from pairforge.llm import secrets

KINDS = ["assign", "access", "hex"]


def brute(t):
    """The fixed kinds as their definition states them."""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


def test_fixed_kinds_match_definition():
    r = random.Random(4)
    parts = ["password", "PassWd", "secret", "toKen", "ſecret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA",
             "AKIAAKIA", "ABCDEFGH0123", "0123456789abcdef", "abc", "é", "😀", "x.y-z", "\n", "token:token:abcdefgh"]
    for _ in range(20000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert secrets.base_spans(t) == brute(t), t


def test_spans_and_opaque_runs(spark):
    uuid, sha = "123e4567-e89b-12d3-a456-426614174000", hashlib.sha256(b"x").hexdigest()
    rand = "aZ3kQ9xLw7Rt2VbN8yPc"
    docs = [(1, f"é😀 key {rand} end"), (2, f"{uuid} {sha.upper()} internationalization 12345678901234567890"),
            (3, f"token = '{rand}' "), (4, None), (5, ""), (1, f"é😀 key {rand} end"), (None, "AKIA" + "A1" * 8),
            (6, "Xq9" * 200_000), (7, "password " * 20_000 + " " * 300_000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, spans string")
    got = {}
    for x in secrets.find_secrets(df).collect():
        got.setdefault(x.id, []).append([(s.kind, s.start, s.end, s.base) for s in x.spans])
    assert got[1] == [[("opaque", 7, 27, False)]] * 2
    assert got[2] == [[]] and got[4] == [[]] and got[5] == [[]] and got[7] == [[]]
    assert got[3] == [[("assign", 0, 29, True)]]
    assert got[None] == [[("access", 0, 20, True)]]
    assert got[6] == [[("opaque", 0, 600_000, False)]]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_query_matches_definition_on_whole_table(spark):
    from pairforge.llm.queries import op4_secrets
    sf = "/root/testdata/sf0.01"
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op4_secrets(spark, sf).collect()
    assert len(rows) == len(texts)
    for x in rows:
        want = brute(texts[x.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert x.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(s[2] == k for s in want) for k in KINDS]
        assert set(said.split(",")) - {""} <= set(x.spans.split(","))


def test_random_strings_behind_paths_and_names_are_found():
    import string

    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        vocabulary = secrets._vocabulary(f.read(), public_tokenizers.PATTERN)
    r = random.Random(12)

    def found(t):
        return [x[:2] for x in secrets.opaque_spans(t, secrets.base_spans(t), vocabulary)]

    paths = ["/home/service/application/settings/credentials/", "my-service-production-account-", "snake_case_setting_name_"]
    for path in paths:
        assert found(f"see {path}readme now") == []
        for n in (24, 32, 40):
            hit = 0
            for _ in range(200):
                key = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
                t = f"see {path}{key}/latest-version now"
                a = t.index(key)
                hit += any(x <= a and a + n <= y for x, y in found(t))
            assert hit >= 196, (path, n, hit)
    uuid, sha = "123e4567-e89b-12d3-a456-426614174000", hashlib.sha256(b"x").hexdigest()
    for t in (f"/home/users/{uuid}/settings", f"/objects/store/{sha.upper()}/readme", "backup-of-production-2024-01-15T10-30-00",
              "linux-headers-x86_64-generic-5-15-0", "https://example/articles/internationalization-of-software/page-12"):
        assert found(t) == [], t
