"""What a task holds and what a row costs, whatever the size of the tables."""

from pyspark.sql import functions as F

from lantern.operators import postings, vector
from lantern.shipping import BATCH_BYTES, ship


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_arrow_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        ship(spark)
        assert spark.conf.get(key) == str(BATCH_BYTES)
        spark.conf.set(key, "12345")
        ship(spark)
        assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_neighbours_that_a_task_keeps_are_bounded(spark, monkeypatch):
    """More queries take more scans, with the same rows."""
    ship(spark)
    rows = spark.range(60).select(F.col("id").alias("path"), F.array(*[F.sin(F.col("id") * k).cast("double") for k in (1, 2, 3)]).alias("embedding"))
    queries = rows.select(F.col("path").alias("query_id"), "embedding")
    whole = vector.knn(queries, rows, 5)
    monkeypatch.setattr(vector, "KEPT", 100)
    cut = vector.knn(queries, rows, 5)
    assert plan(cut).count("MapInArrow") == 3 and plan(whole).count("MapInArrow") == 1
    assert sorted(cut.collect()) == sorted(whole.collect())


def test_a_row_is_looked_up_in_a_set(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("term"))
    found = df.filter(postings.any_of("term", [str(x) for x in range(0, 60, 2)]))
    assert "INSET" in plan(found) and found.count() == 30
