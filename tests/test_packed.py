from pyspark.sql import functions as F

from loomseq.functions.packed import pack_occurrence, pack_ops, picture, unpack_occurrence, unpack_ops


def test_occurrence(spark):
    rows = [(0, 0, 0, "-"), (32767, 65535, 2**32 - 1, "+"), (5, 3, 1000, "-")]
    df = spark.createDataFrame(rows, "c int, p int, x long, s string")
    packed = df.withColumn("k", pack_occurrence(F.col("c"), F.col("p"), F.col("x"), F.col("s")))
    got = packed.select(unpack_occurrence(F.col("k")).alias("u")).select("u.*").collect()
    assert [tuple(r) for r in got] == rows
    assert packed.collect()[2]["k"] == (5 << 49) | (3 << 33) | (1000 << 1)


def test_ops(spark):
    rows = [("",), ("=",), ("=XDI",), ("I" * 31,), ("=" * 32,), (None,)]
    df = spark.createDataFrame(rows, "ops string")
    got = [r[0] for r in df.select(unpack_ops(pack_ops(F.col("ops")))).collect()]
    assert got == ["", "=", "=XDI", "I" * 31, None, None]
    assert df.select(pack_ops(F.col("ops"))).collect()[2][0] == 0b1_00_01_10_11
    assert spark.range(1).select(picture(F.lit("A-C"), F.lit("=IX"), F.lit("AGt"))).first()[0] == "A-C\n|  \nAGt"
