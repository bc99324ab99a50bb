from pyspark.sql import functions as F

from tessera.llm import _common as C


def test_written_and_forgotten(spark):
    df = C.written(spark.range(5), "t")
    assert df.count() == 5 and C.forget(spark) >= 1 and C.forget(spark) == 0


def test_join_hot_keeps_every_row(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k % 2 = 0")
    got = C.join_hot(left, groups, "k", "n", 1000, 10)
    assert got.count() == 1000 and got.filter("n = 400").count() == 400 and got.filter("n IS NULL").count() == 300


def test_bucket_numbers_are_where_spark_looks(spark):
    from itertools import islice

    for part, buckets in ((0, 1), (3, 8), (21, 16), (5, 200)):
        some = [(n,) for n in islice(C.bucket_numbers(part, buckets), 50)]
        assert len(set(some)) == 50
        df = spark.createDataFrame(some, "n long")
        assert {r[0] for r in df.select(F.expr(f"pmod(hash(n), {buckets})")).collect()} == {part % buckets}


def test_bucketed_tables_meet_without_a_shuffle(spark):
    def numbers(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own = C.bucket_numbers(TaskContext.get().partitionId(), 4)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([next(own) for _ in range(b.num_rows)]), b.column(0)], names=["k", "v"])

    table = C.written_buckets(spark.range(0, 1000, 1, 6).mapInArrow(numbers, "k long, v long"), "t", "k", 4)
    other = C.written(table.select("k", (F.col("v") * 2).alias("w")), "o")
    met = table.join(other.hint("merge"), "k")
    assert met.count() == 1000 and met.filter("w <> 2 * v").count() == 0
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
