"""A corpus from raw documents to shards: quality, near duplicates, leaks, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm import budget_mix, chosen_path, kd_sharding, preference_quality, spaced_seeds
from postmill.llm.common import may_contain, table, utf8_size, word_count
from postmill.session import forget, materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below the ranking's threshold.

    Labels of ids with crc32 mod 4 = 2 are not seen. Without labels of both kinds
    nothing is dropped.
    """
    seen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))
    ranking = preference_quality.learn(docs, table(spark, sf_dir, "labels"), seen)
    return docs.where(preference_quality.scored(ranking, F.col("text")) >= 0.7)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Of rows with the same id the one with the least text hash stays, of equal rows any
    one. A NULL id is larger than all others. Texts without words are no duplicates:
    each stays.
    """
    found = chosen_path.join_texts(docs).where("_root is not null")
    found = materialize(found.select(F.coalesce("_id", F.lit(2**63 - 1)).alias("_id"), "_hash", "_root"), "groups")
    kept = found.groupBy("_root").agg(F.min(F.struct("_id", "_hash")).alias("_kept"))
    texts = found.groupBy("_root", "_id", "_hash").agg(F.count(F.lit(1)).alias("_n")).join(kept, "_root")
    texts = texts.select("_id", "_hash", (F.struct("_id", "_hash") == F.col("_kept")).alias("_stays"), "_n")
    # most rows are the only ones of their group and stay without a shuffle
    thinned = materialize(texts.where("not _stays or _n > 1").drop("_n").withColumn("_key", F.xxhash64("_id", "_hash")), "thinned")
    rows = docs.select(
        F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_id"),
        F.xxhash64(F.col("text").cast("string")).alias("_hash"),
    )
    rows = rows.withColumn("_asked", may_contain(thinned, "_key")(F.xxhash64("_id", "_hash")))
    asked = rows.where("_asked").join(thinned.drop("_key"), ["_id", "_hash"], "left")
    first = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(0)))
    asked = asked.withColumn("_copy", first).where("_stays is null or (_stays and _copy = 1)")
    return rows.where("not _asked").select("_row.*").unionAll(asked.select("_row.*"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap with a benchmark item."""
    return docs.where(~spaced_seeds.leaked(table(spark, sf_dir, "benchmark"), F.col("text")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source meets its share of words."""
    rows = docs.select(F.struct("*").alias("_row"), "source", word_count(F.col("text")).alias("_size"), "doc_id", F.crc32("text").alias("_crc"))
    taken = budget_mix.mix(rows, F.col("source"), F.col("_size"), ["doc_id", "_crc"])
    repeated = taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))))
    return repeated.select("_row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put documents into eight shards of about equal bytes; adds ``shard_of_8``."""
    rows = docs.select(F.struct("*").alias("_row"), *[c.alias(f"_at{i}") for i, c in enumerate(kd_sharding.document_coordinates(docs))],
                       (utf8_size(F.col("text")) + 1).alias("_bytes"), "doc_id", F.crc32("text").alias("_crc"))
    rows = kd_sharding.prepared(rows, [F.col(f"_at{i}") for i in range(3)], F.col("_bytes"), ["doc_id", "_bytes", "_crc"])
    tree, _ = kd_sharding.fit(rows.select("_x", "_w", "_id", "_node"), shards=8)
    return kd_sharding.place(rows, tree, "shard_of_8").select("_row.*", "shard_of_8")


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", without_leaks),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

# the ranking, the path search and the knapsack have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each on what the one before has written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
