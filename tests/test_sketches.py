"""Sketches by day and source, merged, against exact figures of the rows."""

import math

from pyspark.sql import functions as F

from postlark.operators import sketches

SF = "/root/testdata/sf0.01"


def table(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    i = F.col("o_orderkey")
    return o.select((i % 5).alias("day"), F.when(i % 2 == 0, "a").otherwise("b").alias("source"), F.col("o_totalprice").alias("price"), F.when(i % 11 != 0, i % 3001).alias("key"), F.when(i % 7 == 0, " N/A ").when(i % 7 == 1, "").otherwise(i.cast("string")).alias("word"), F.lit(None).cast("double").alias("none"))


def test_merged_sketches_are_within_their_errors(spark):
    df = table(spark).cache()
    columns = ["price", "key", "word", "none"]
    stored = sketches.sketched(df, ["day", "source"], columns, ("price", "key", "none")).cache()
    assert stored.count() == 5 * 2 * 4
    part = sketches.merged(stored.where("day < 3 and source = 'a'"), ["source"])
    rows = df.where("day < 3 and source = 'a'").collect()
    for r in sketches.profile_of(part).collect():
        values = [x[r.column] for x in rows]
        said = [str(v).strip().lower() for v in values if v is not None]
        assert (r.rows, r.null_count, r.empty_count, r.sentinel_count) == (len(rows), len(rows) - len(said), sum(v == "" for v in said), sum(v in ("n/a",) for v in said))
        exact = len({v for v in values if v is not None})
        assert abs(r.distinct_count - exact) <= max(3, 4 * 0.83 / math.sqrt(2**sketches.LG_K) * exact)
    for r in sketches.curve_of(part).collect():
        values = sorted(float(x[r.column]) for x in rows if x[r.column] is not None)
        low, high = sum(v < r.value for v in values) / len(values), sum(v <= r.value for v in values) / len(values)
        assert low - 0.04 <= r.quantile <= high + 0.04 and r.column != "none"


def test_drift_of_merged_sketches(spark):
    df = table(spark)
    stored = sketches.sketched(df.withColumn("price", F.when(F.col("source") == "b", F.col("price") * 1.5).otherwise(F.col("price"))), ["day", "source"], ["price", "key"], ("price", "key")).cache()
    a, b = (sketches.merged(stored.where(F.col("source") == s), []) for s in "ab")
    drift = {r.column: r.psi for r in sketches.drift_of(a, b).collect()}
    same = {r.column: r.psi for r in sketches.drift_of(a, a).collect()}
    assert max(same.values()) < 0.01 and set(same) == {"price", "key"} and drift["price"] > 0.1 > drift["key"] >= 0
    assert sketches.profile_of(stored.limit(0)).count() == sketches.curve_of(stored.limit(0)).count() == 0
