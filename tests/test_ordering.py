from pyspark.sql import Window, functions as F

from tradeloom.operators.ordering import numbered


def test_numbering_equals_window_on_a_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("k"), F.xxhash64("id").alias("v"), "id")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "id")).cast("bigint"))
    got = numbered(df, ["k"], [F.desc("v"), F.asc("id")])
    assert got.select("k", "id", "rank").exceptAll(want.select("k", "id", "rank")).count() == 0 and got.count() == 5000
