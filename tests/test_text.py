import random
import re

from pyspark.sql import functions as F

from pairforge.functions import text as T
from pairforge.operators.textmetrics import lcs_length

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"


def _rand_strings(n=300, seed=7):
    rnd = random.Random(seed)
    alphabet = list("abcXYZ019_.,-;:/'\"()") + list(WS) + ["é", "ß", "日"]
    return [''.join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_split_strip_match_python(spark):
    xs = _rand_strings()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(xs)], "i int, s string")
    rows = df.select("i", T.py_split("s").alias("a"), T.py_strip("s").alias("b"), T.collapse_ws("s").alias("c")).collect()
    for r in rows:
        s = xs[r.i]
        assert r.a == s.split()
        assert r.b == s.strip()
        assert r.c == " ".join(s.split())


def test_puncts_and_words(spark):
    xs = _rand_strings(seed=11)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(xs)], "i int, s string")
    rows = df.select("i", T.split_puncts("s").alias("p"), T.word_tokens("s").alias("w")).collect()
    for r in rows:
        s = xs[r.i]
        assert r.p == " ".join(re.findall(r"[\w]+|[^\s\w]", s))
        assert r.w == re.findall(r"\b\w+\b", s.lower())


def _nist(s):
    # NIST-style normalisation written out from its published rules
    s = s.replace("<skipped>", "")
    s = re.sub(r"-\n", "", s)
    s = re.sub(r"\n", " ", s)
    s = s.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")
    s = (" %s " % s).lower()
    s = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", s)
    s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
    s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
    s = re.sub(r"([0-9])(-)", r"\1 \2 ", s)
    return s.split()


def test_nist_normalize(spark):
    xs = _rand_strings(seed=3) + ["a-\nb 3-4 x.y 1.5 &amp;lt; <skipped> Hello, World!"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(xs)], "i int, s string")
    for r in df.select("i", T.nist_normalize(F.col("s")).alias("n")).collect():
        assert r.n == _nist(xs[r.i]), xs[r.i]


def _strip_c(source):
    def repl(m):
        s = m.group(0)
        return " " if s.startswith("/") else s
    pat = re.compile(r'//.*?$|/\*.*?\*/|\'(?:\\.|[^\\\'])*\'|"(?:\\.|[^\\"])*"', re.DOTALL | re.MULTILINE)
    return "\n".join(x for x in re.sub(pat, repl, source).split("\n") if x.strip() != "")


def test_strip_comments(spark):
    xs = ['int a = 1; // c\n\n/* b\n c */ String s = "// no";\nchar q = \'/\';\n  \n x / y;',
          'a /* unterminated', 's = "x\\"y" // z', 'plain']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(xs)], "i int, s string")
    for r in df.select("i", T.strip_comments("s").alias("o")).collect():
        assert r.o == _strip_c(xs[r.i])


def _restore(code):
    out, cur = [], 0
    for line in [x.strip() for x in code.split("NEW_LINE")]:
        cur += line.count("INDENT") - line.count("DEDENT")
        line = re.sub(r"INDENT\s?", "", line)
        line = re.sub(r"DEDENT\s?", "", line)
        out.append("\t" * cur + line)
    return "\n".join(out)


def test_restore_indentation(spark):
    xs = ["def f ( x ) : NEW_LINE INDENT return x NEW_LINE DEDENT def g ( ) : NEW_LINE INDENT pass",
          "a NEW_LINE DEDENT DEDENT b NEW_LINE INDENT INDENT c", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(xs)], "i int, s string")
    for r in df.select("i", T.restore_indentation("s").alias("o")).collect():
        assert r.o == _restore(xs[r.i])
    from pairforge.operators.prepare import restore_indentation_df
    for r in restore_indentation_df(df, "i", "s").collect():
        assert r.code == _restore(xs[r.i])


def test_lcs_matches_dp():
    rnd = random.Random(5)
    for _ in range(200):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
        assert lcs_length(a, b) == t[-1][-1]


def test_ngram_helpers(spark):
    from pairforge.functions.ngrams import ngram_array, ngram_tuples
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "t array<string>")
    rows = df.select(ngram_array(F.col("t"), 2).alias("g"),
                     ngram_tuples(F.col("t"), 2, pad_left=True, left_symbol="<s>").alias("p")).collect()
    assert rows[0].g == ["a b", "b c"] and rows[1].g == []
    assert rows[0].p == [["<s>", "a"], ["a", "b"], ["b", "c"]] and rows[1].p == [["<s>", "a"]]
