from pyspark.sql import functions as F

from ledgerloom.operators import delivery

SCHEMA = "delivery_id bigint, ingested_at timestamp, id string, project_id string, rank string, __kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None, m, p, "x", None) for i, m, p in rows], SCHEMA)


def run(spark, rows):
    df = frame(spark, rows)
    found = delivery.repeated_deliveries(df, "delivery_id", delivery.observation_identity(), delivery.observation_order())
    kept = delivery.deduplicated(df, "delivery_id", delivery.observation_identity(), delivery.observation_order())
    return sorted(r.delivery_id for r in found.collect()), sorted(r.delivery_id for r in kept.collect())


def test_spellings_and_projects(spark):
    rows = [(3, " AB\t", "P"), (1, "ab", "p "), (2, "ab", "q"), (4, "Ab　", "p"), (5, None, "p"), (6, None, "p")]
    assert run(spark, rows) == ([3, 4], [1, 2, 5, 6])


def test_null_project_and_blank_id_are_values(spark):
    assert run(spark, [(1, "a", None), (2, "A", None), (3, " ", "p"), (4, "", "p")]) == ([2, 4], [1, 3])


def test_empty_table(spark):
    assert run(spark, []) == ([], [])


def test_hot_message_keeps_one(spark):
    df = spark.range(3000).select(
        F.col("id").alias("delivery_id"), F.lit(None).cast("timestamp").alias("ingested_at"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.lit("p").alias("project_id"),
    )
    kept = delivery.deduplicated(df, "delivery_id", delivery.observation_identity(), delivery.observation_order())
    assert kept.count() == 2001
    assert [r.delivery_id for r in kept.filter("id = 'hot'").collect()] == [0]


def test_order_with_ties_and_nulls(spark):
    rows = [(3, "a", "2026-01-02"), (2, "a", "2026-01-01"), (1, "a", "2026-01-01"), (4, "b", None), (5, "b", "2026-01-01")]
    df = spark.createDataFrame(rows, "key bigint, id string, at string")
    kept = delivery.deduplicated(df, "key", [F.col("id")], [F.col("at")])
    assert sorted(r.key for r in kept.collect()) == [1, 4]


def test_plan(spark, data):
    """Copies are reduced by a struct of delivery order within map tasks; whole rows take one scan."""
    df = spark.read.parquet(f"{data}/observations.parquet")
    for f in (delivery.kept_deliveries, delivery.deduplicated):
        plan = f(df, "delivery_id", delivery.observation_identity(), delivery.observation_order())._jdf.queryExecution().executedPlan().toString()
        assert "partial_min_by" in plan and "ingested_at" in plan and plan.count("FileScan") == 1 and "Join" not in plan


def test_clashing_names_and_nested_columns(spark):
    rows = [(2, "a", {"x": 1}, "r"), (1, "A", {"x": 2}, "s"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "k bigint, id string, c0 map<string,int>, rank string")
    kept = delivery.deduplicated(df, "k", delivery.observation_identity()[:1], [])
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [(1, "A", {"x": 2}, "s"), (3, None, None, None)]
