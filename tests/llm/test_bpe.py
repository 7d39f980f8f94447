import os
import random

import pytest
from pyspark.sql import functions as F

from tributary.llm import bpe
from tributary.llm.text_queries import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")
TEXTS = ["", None, " ", "a", "a" * 999, "  \n\n  x 　  y", "<|endoftext|> hi", "\x1c\x1d a\x85b", "aaaa" * 5 + " " + "-=" * 300, "don't we'll I'M 'S", "naïve café 数据源 한국어 👩‍💻→📦", "été vs été", "x" * 20_000, "ab" * 5_000, "퟿", "1234567890" * 50]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_same_ids_as_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    texts = TEXTS + [r.text for r in docs]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text", PATH).collect()}
    want = library(texts)
    assert [k for k in got if got[k] != want[k]] == [] and len(got) == len(texts)
    assert got[0] == [] and got[1] == []


def test_long_words(library):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for letters in ("ab", "etaoin shrdlu", "aé数👩", "-=_*") for n in (3, 40, 900, 5_000)] + ["x" * 100_001, "tion" * 9_999]
    v = bpe.Vocabulary(PATH)
    assert bpe.encode_texts(v, texts) == library(texts)


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    monkeypatch.setattr(bpe, "BYTES", 10)
    v = bpe.Vocabulary(PATH)
    texts = ["one two three four", "four three two", "five"]
    assert [x for t in texts for x in bpe.encode_texts(v, [t])] == library(texts)


def test_round_trip(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS[2:14])] + [(99, ""), (98, None)], "doc_id bigint, text string")
    back = bpe.decode(bpe.encode(df, "doc_id", "text", PATH), "doc_id", PATH).withColumnRenamed("text", "back")
    assert df.join(back, "doc_id").filter(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("back"))).count() == 0
    assert bpe.encode(df.limit(0), "doc_id", "text", PATH).collect() == []
