import random

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
from pairforge.llm import bpe  # noqa: E402

LETTERS = "abethis  \n\t'sllre0129é漢字😀.,-_=A\x00"


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    return bpe.BytePairCodec(bpe._spec(path)), tokenizers.Tokenizer.from_file(path)


def check(both, text):
    codec, lib = both
    want = lib.encode(text, add_special_tokens=False).ids
    ids = np.frombuffer(codec.encode(text), "<u4")
    assert list(ids) == want, text[:80]
    assert codec.decode_text(ids) == lib.decode(want, skip_special_tokens=False)


def test_random_texts_match_library(both):
    r = random.Random(7)
    for k in range(600):
        t = "".join(r.choice(LETTERS) for _ in range(r.randint(0, 60)))
        check(both, t if k % 6 else t + "<|endoftext|>" + t)


def test_runs_and_long_words(both):
    for t in ("a" * 5000, "th" * 900, "=" * 2000, " " * 99 + "x", "0" * 333, "abc" * 4000):
        check(both, t)


def test_null_empty_repeated_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "ab c", 5), (1, "ab c", 6), (None, None, 7), (2, "", 8)],
                               "doc_id bigint, text string, n_tokens int")
    rows = bpe.encode(df, digests=True).orderBy(F.col("id"), "n_tokens").collect()
    got = sorted((r.id if r.id is not None else -1, r.n_tokens, r.decoded) for r in rows)
    assert got == [(-1, 0, ""), (1, 2, "ab c"), (1, 2, "ab c"), (2, 0, "")]
    assert bpe.encode(df.limit(0)).count() == 0


def test_query_round_trip_on_whole_table(spark):
    from pairforge.llm.queries import op8_bpe
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("want"))
    out = op8_bpe(spark, sf).join(docs, "doc_id")
    assert out.count() == docs.count()
    assert out.filter("decoded_sha256 <> want").count() == 0
