"""Signed tokens against the standard library's keyed digests."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from vellum.functions import tokens


@pytest.mark.parametrize("key", [b"", b"k", b"x" * 64, b"long " * 40, bytes(range(256))])
def test_keyed_digest_is_the_standard_one(spark, key):
    texts = ["", "a", "é😀", "long " * 1000, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in rows.select("i", tokens.keyed_digest(F.col("t"), key).alias("d")).collect()}
    assert got == {i: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for i, t in enumerate(texts)}


def test_tokens_name_their_subject_until_they_expire(spark):
    rows = spark.createDataFrame([("ada", 100), ("a.b é", 100), (None, 100), ("bo", None)], "s string, at long")
    made = {r.s: r.t for r in rows.select("s", tokens.signed(F.col("s"), F.col("at"), b"key").alias("t")).collect()}
    assert made[None] is None and made["bo"] is None
    asked = [made["ada"], made["a.b é"], made["ada"][:-1] + ("0" if made["ada"][-1] != "0" else "1"), made["ada"].replace(".100.", ".900."), "", "a.b", "a.b.c", "....", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, t string")
    says = lambda now, key: {r.i: r.v for r in frame.select("i", tokens.verified(F.col("t"), F.lit(now), key).alias("v")).collect() if r.v is not None}
    assert says(99, b"key") == {0: "ada", 1: "a.b é"}
    assert says(100, b"key") == {} and says(99, b"other") == {}
