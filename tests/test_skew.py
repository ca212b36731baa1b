"""The paths for hot keys, forced on small data, against the plain form."""

import pyarrow as pa
from pyspark.sql import Window, functions as F

from plumbline.operators import compare as C, skew
from plumbline.operators.skew import join_unique, number_rows, ordered_concat


def skewed(spark, n=3000):
    """A third of all rows share key 0."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("k"),
        (F.col("id") * 7919 % 997).alias("at"), "id")


def slow_numbers(df, keys, order):
    within = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("n", F.row_number().over(within).cast("bigint"))


def test_number_rows_hot(spark):
    """A key cut by many ranges; null keys, repeated rows, two key columns, no key, no rows."""
    rows = skewed(spark).withColumn("k2", F.when(F.col("id") % 4 > 0, F.concat(F.lit("g"), F.col("id") % 4)))
    doubled = rows.union(rows.limit(500)).withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys in (["k"], ["k", "k2"], []):
            got = number_rows(doubled, keys, ["at", "id"], "n", cut_by=1 if keys == ["k"] else None)
            assert got.columns == [*doubled.columns, "n"]
            assert sorted(map(repr, got.collect())) == sorted(map(repr, slow_numbers(doubled, keys, ["at", "id"]).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert number_rows(rows.limit(0), ["k"], ["at"], "n").collect() == []


def test_number_rows_batches():
    """Keys that go on over Arrow batches of one task, with nulls and not-a-numbers."""
    values = [None, None, 1.0, 1.0, float("nan"), float("nan"), float("nan"), 2.0]
    for cut in range(1, len(values)):
        parts = [pa.array(v, pa.float64()) for v in (values[:cut], values[cut:])]
        got, before = [], None
        for p in parts:
            got += skew._key_changes([p], before).tolist()
            before = (p[-1].as_py(),)
        assert got == [True, False, True, False, True, False, False, True], cut


def test_number_rows_plan(spark, monkeypatch):
    """One range exchange and no join: numbering costs a single pass of the rows."""
    plans = []
    keep = skew.saved
    monkeypatch.setattr(skew, "saved", lambda df: plans.append(df._jdf.queryExecution().toString()) or keep(df))
    got = number_rows(skewed(spark), ["k"], ["at"], "n")
    physical = plans[0].split("== Physical Plan ==")[1]
    assert physical.count("Exchange rangepartitioning") == 1 and physical.count("Exchange") == 1
    assert "Join" not in plans[0] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_join_unique_hot(spark):
    df = skewed(spark)
    right = df.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    right = right.filter("k <> 5")
    want = sorted(map(tuple, df.join(right, "k").select("id", "k", "n", "first").collect()))
    for hot_rows in (100, 10_000):
        got = join_unique(df, right, ["k"], "n", ["id"], hot_rows=hot_rows)
        assert sorted(map(tuple, got.select("id", "k", "n", "first").collect())) == want


def test_ordered_concat_blocks(spark):
    df = spark.range(1, 26).select(F.lit("a").alias("k"), F.col("id").alias("pos"))
    one = ordered_concat(df, ["k"], "pos", "pos", ",", "s").collect()
    assert [(r["block_no"], r["s"]) for r in one] == [(0, ",".join(map(str, range(1, 26))))]
    many = ordered_concat(df, ["k"], "pos", "pos", ",", "s", block_rows=10).orderBy("block_no").collect()
    assert ",".join(r["s"] for r in many) == one[0]["s"] and len(many) == 3


def test_label_blocks(spark, monkeypatch):
    """A case spread over several label blocks gives the same comparison."""
    from tests.test_compare import drawings_of, labels_of
    from plumbline.catalogue import APPLIANCE as CAT
    labels = labels_of(spark, [(1, n, {"brand": "AB"[n % 2]}) for n in range(1, 12)] + [(2, 1, {"brand": "A"})])
    drawings = drawings_of(spark, [(1, {"brand": "A"}), (2, {"brand": "A"})])
    def run():
        a = [(r["case_id"], r["label_no"], r["verdict"]) for r in C.compare_to_drawing(labels, drawings, CAT).collect()]
        b = [(r["case_id"], r["label_no"], r["verdict"]) for r in C.compare_to_baseline(labels, CAT).collect()]
        return sorted(a), sorted(b)
    want = run()
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    assert run() == want
