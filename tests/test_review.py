"""Cases that the SQL of the queries does not reach."""

from pyspark.sql import functions as F

from postmill.operators import deltas, gates
from postmill.sources import postings


def test_shares_round_half_to_even(spark):
    # 1 of 128 is 0.0078125: a tie at the seventh digit
    assert spark.range(1).select(F.bround(F.lit(1) / F.lit(128), 6)).head()[0] == 0.007812
    assert "F.round(" not in open(gates.__file__).read()


def test_ids_are_trimmed_before_they_are_compared(rows):
    days = rows("id string, ordinal int, day date", (" 1", 0, None), ("1", 1, None)).withColumn("day", F.lit("2000-01-01").cast("date"))
    assert deltas.materialize_latest(days, "day", "id", ["ordinal"], F.lit("2000-01-02").cast("date")).count() == 1


def test_skills_fall_back_for_each_row(rows):
    df = rows("vacancy_id string, title string, skills array<string>, top_skills_list string", ("1", "a", [], "x, y"), ("2", "b", ["z"], "w"))
    df = df.withColumnRenamed("vacancy_id", "hh_vacancy_id")
    got = {r["hh_vacancy_id"]: r["skills"] for r in deltas.posting_serving_rows(df, [F.col("hh_vacancy_id")]).collect()}
    assert got == {"1": ["x", "y"], "2": ["z"]}


def test_one_large_day_is_written_by_more_than_one_task(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        day = spark.range(200_000, numPartitions=8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("title"))
        postings.write_daily_snapshot(day, str(tmp_path / "days"), "2000-01-01")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "days" / "date=2000-01-01").glob("part-*"))) > 1
    assert spark.read.parquet(str(tmp_path / "days")).count() == 200_000
