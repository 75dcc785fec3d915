"""Exact quantiles under skew, ties, signs and tiny groups."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from postmill.operators.quantiles import grouped_quantiles, with_many_quantiles, with_quantiles

PROBS = {"lo": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "hi": 0.99, "max": 1.0, "min": 0.0}


def check(spark, data):
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in data], "k string, v double")
    found = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", PROBS).collect()}
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(found) == set(groups)
    for k, values in groups.items():
        for name, p in PROBS.items():
            assert found[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12), (k, name)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(
    st.none(), st.integers(-5, 5), st.floats(-1e9, 1e9, allow_nan=False))), min_size=1, max_size=60))
def test_small_groups(spark, data):
    check(spark, data)


def test_one_hot_group_and_ties(spark):
    rng = np.random.default_rng(1)
    data = [("hot", float(v)) for v in np.round(rng.lognormal(11, 0.6, 20_000), 2)]
    data += [("ties", 100.0)] * 5000 + [("ties", 101.0)] * 4999 + [("one", 7.0)]
    check(spark, data)


def test_many_columns_in_one_pass(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = with_many_quantiles(stats, df, ["k"], {"a": {"a50": 0.5}, "b": {"b25": 0.25, "b75": 0.75}}).collect()
    for r in out:
        a = [i for i in range(1000) if i % 3 == r["k"]]
        b = [i % 7 for i in a]
        assert (r["a50"], r["b25"], r["b75"]) == (np.quantile(a, 0.5), np.quantile(b, 0.25), np.quantile(b, 0.75))
        assert r["n"] == len(a)


def test_null_keys_are_told_apart(spark):
    rows = [(a, b, float(v)) for i, (a, b) in enumerate([("x", None), (None, "x"), (None, None), ("x", "x"), ("xx", "")]) for v in range(i, i + 3)]
    df = spark.createDataFrame(rows, "a string, b string, v double")
    stats = df.groupBy("a", "b").agg(F.min("v").alias("least"))
    for r in with_quantiles(stats, df, ["a", "b"], "v", {"m": 0.5}).collect():
        assert r["m"] == r["least"] + 1
    for r in with_many_quantiles(stats, df, ["a", "b"], {"v": {"m": 0.5}}).collect():
        assert r["m"] == r["least"] + 1


def test_a_million_values_of_one_magnitude(spark):
    df = spark.range(0, 1_000_000, 1, 16).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 1_000_000 / 1e6 + 1000).alias("v"))
    r = grouped_quantiles(df, ["k"], "v", PROBS).head()
    for name, p in PROBS.items():
        assert r[name] == pytest.approx(1000 + p * 999_999 / 1e6, abs=1e-9)


def test_approximate_quantiles_are_within_their_error(spark):
    rng = np.random.default_rng(2)
    data = {"hot": rng.lognormal(11, 0.6, 50_000), "small": rng.normal(0, 5, 7), "none": np.array([])}
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("none", None), ("none", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", PROBS, accuracy=200).collect()}
    assert set(found) == {"hot", "small", None}
    for k in ("hot", "small"):
        values = np.sort(data[k])
        for name, p in PROBS.items():
            at = np.searchsorted(values, found[k][name])
            assert values[at] == found[k][name] and abs(at - p * len(values)) <= len(values) / 200 + 1
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = {r["k"]: r["median"] for r in with_quantiles(stats, df, ["k"], "v", {"median": 0.5}, accuracy=200).collect()}
    assert joined["none"] is None and joined[None] is None or joined[None] == 1.0
