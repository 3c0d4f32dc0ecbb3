import hashlib
import hmac

from pyspark.sql import functions as F

from ledgerloom.functions.identity import hmac_sha256, identity, short


def test_hmac_equals_python(spark):
    values = ["", "a", "ü" * 100, None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for key in (b"k", b"x" * 64, b"long" * 40):
        got = [r[0] for r in df.select(hmac_sha256(F.col("v"), key)).collect()]
        assert got == [None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in values]


def test_identity(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None)], "x string, y string")
    got = [r[0] for r in df.select(identity("user", [F.col("x"), F.col("y")], b"k")).collect()]
    assert got[0] != got[1] and got[1] == got[2]
    assert got[0] == hmac.new(b"k", b'["user","a","b"]', hashlib.sha256).hexdigest()
    (r,) = df.limit(1).select(short(identity("user", [F.col("x"), F.col("y")], b"k"))).collect()
    assert int(r[0]) == int(got[0][:16], 16)
