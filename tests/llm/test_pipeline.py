"""Pipeline stages on their own inputs, and the whole run."""

import collections

import corpus_pipeline as pipeline
from postmill.llm import queries

SF = "/root/testdata/sf0.001"


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    predicted = {r["doc_id"]: r["predicted"] for r in queries.op3_preference_quality(spark, SF).collect()}
    good = pipeline.good_documents(spark, docs, SF)
    assert ids(good) == collections.Counter(d for d, p in predicted.items() if p)
    one = pipeline.one_of_each_group(spark, docs, SF)
    groups = queries.op2_chosen_path_join(spark, SF).collect()
    assert ids(one) == collections.Counter({r["component_id"] for r in groups}) and sum(ids(one).values()) < docs.count()
    leaks = {r["doc_id"] for r in queries.op6_spaced_seeds(spark, SF).collect()}
    assert ids(pipeline.without_leaks(spark, docs, SF)) == ids(docs.where(~docs["doc_id"].isin(list(leaks))))
    times = {r["doc_id"]: r["taken"] // r["size"] for r in queries.op5_budget_mix(spark, SF).collect() if r["size"]}
    assert ids(pipeline.mixed(spark, docs, SF)) == collections.Counter({d: n for d, n in times.items() if n})
    assert good.columns == one.columns == columns
    shards = pipeline.sharded(spark, docs, SF)
    assert shards.columns == [*columns, "shard_of_8"] and ids(shards) == ids(docs)
    same = {(r["doc_id"], r["shard"]) for r in queries.op1_kd_sharding(spark, SF).collect()}
    assert {(r["doc_id"], r["shard_of_8"]) for r in shards.collect()} == same


def test_repeated_rows_and_empty_texts(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", "en", "s", 11), (3, "", "en", "s", 0), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows + [(None, "x y", "en", None, 3)], schema)
    one = pipeline.one_of_each_group(spark, docs, SF)
    assert ids(one) == {1: 1, 3: 2, None: 1}
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and out.select("shard_of_8").distinct().count() == 8
