import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalloom.functions import text


def column(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


TEXTS = ["Hello, HELLO! 9", "Éleère ſharp İx K2", "a\x1cb\x85c\xa0d e　f", "  x  ", "", None, "It's 3.5 km", "​zero​", "ΑΒ Σς ß ẞ", "𝔘𝔫𝔦 ２４ ½"]


def test_tokens(spark):
    want = [[t.lower() for t in re.findall(r"[a-z0-9]+", v or "", re.IGNORECASE) if len(t) > 1] for v in TEXTS]
    assert column(spark, text.tokens, TEXTS) == want


def test_words_and_letters(spark):
    assert column(spark, text.words, TEXTS) == [(v or "").split() for v in TEXTS]
    assert column(spark, text.letters_only, TEXTS) == ["".join(re.findall(r"[^\W_]", (v or "").lower())) for v in TEXTS]
    assert column(spark, text.spaced_words, TEXTS) == [" ".join(re.findall(r"[^\W_]+", (v or "").lower())) for v in TEXTS]
    assert column(spark, text.ascii_token_count, TEXTS) == [len(re.findall(r"[A-Za-z0-9]{2,}", v or "")) for v in TEXTS]


def test_hashes(spark):
    import hashlib

    assert column(spark, text.content_sha256, ["hello"]) == ["2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"]
    words = ["token", "é", "42", "x" * 999]
    digests = [hashlib.sha256(w.encode()).digest() for w in words]
    assert column(spark, text.hashed_bucket, words) == [int.from_bytes(d[:4], "big") % 128 for d in digests]
    assert column(spark, text.hashed_sign, words) == [1.0 if d[4] % 2 else -1.0 for d in digests]
    assert [bytes(x) for x in column(spark, text.digest16, words)] == [d[:16] for d in digests]


@pytest.mark.parametrize("seed", range(2))
def test_random_texts(spark, seed):
    batch = []

    @given(st.lists(st.text(max_size=60), min_size=40, max_size=40))
    @settings(max_examples=3, deadline=None, database=None)
    def collect(values):
        batch.extend(v for v in values if "\x00" not in v and not any(0xD800 <= ord(c) < 0xE000 for c in v))

    collect()
    assert column(spark, text.words, batch) == [v.split() for v in batch]
