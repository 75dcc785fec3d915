"""Exact quantiles of hot groups without a per-group value buffer.

The built-in exact ``percentile`` keeps every distinct value of a group in one
task. Here values are counted per (group, value), located in narrow value bins
whose number does not grow with the data, and ranked only inside the few bins
that hold a wanted rank. A group with a third of all rows is spread over tasks
by value and by bin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.columns import any_of

# bins per unit of log1p(|value|): one bin spans about 0.024 % of its value
BINS_PER_LOG_UNIT = 4096

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _bin(value: Column) -> Column:
    # log1p is semi-monotonic on the JVM, so bins keep the order of the values
    bin_ = F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(float(BINS_PER_LOG_UNIT)))
    return F.coalesce(bin_, F.lit(0).cast("long"))


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None, key: Column | None = None
) -> DataFrame:
    """(``_key``, ``_v``, ``_n``): rows per distinct non-null value.

    The keys travel as one struct, in which NULL fields compare equal and which keeps plans with many
    keys small, or as ``key`` where the caller finds them by that again.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number))
    # never NULL after the filter; saying so keeps a pushed-down null check from
    # splitting the two uses of the counts, which then share one shuffle
    return rows.groupBy((_key(keys) if key is None else key).alias("_key"), F.coalesce(number, F.lit(0.0)).alias("_v")).agg(n.alias("_n"))


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def _marks(keys: Sequence[str]) -> Column:
    """128 bits that stand for the values of all keys, so that counts and bins travel without their texts.

    A hash skips NULLs, so which keys are NULL is hashed first.
    """
    if not keys:
        return _key(keys)
    nulls = F.concat(*[F.when(F.col(k).isNull(), F.lit("1")).otherwise(F.lit("0")) for k in keys])
    return F.struct(F.xxhash64(nulls, *keys).alias("a"), F.xxhash64(F.lit("b"), nulls, *keys).alias("b"))


def _position(p: float) -> Column:
    return (F.col("_total") - 1) * F.lit(float(p))


def _wanted_bins(bins: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """Bins (``_key``, ``_bin``, ``_bin_n``) that hold a wanted rank, with the rows before them."""
    in_key = Window.partitionBy("_key")
    running = in_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = (
        bins.withColumn("_end", F.sum("_bin_n").over(running))
        .withColumn("_total", F.sum("_bin_n").over(in_key))
        .withColumn("_start", F.col("_end") - F.col("_bin_n"))
    )
    ranks = [f(_position(p)) for p in probs.values() for f in (F.floor, F.ceil)]
    wanted = bins.where(any_of((F.col("_start") <= r) & (F.col("_end") > r) for r in ranks))
    return wanted.select("_key", "_bin", "_start", "_total")


def _interpolate(inside: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles from the values (``_v``, ``_n``) of the wanted bins."""
    within = Window.partitionBy("_key", "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_rank", F.col("_start") + F.sum("_n").over(within))
    aggregates = [F.max("_total").alias("_total")]
    for name, p in probs.items():
        low, high = F.col("_rank") > F.floor(_position(p)), F.col("_rank") > F.ceil(_position(p))
        aggregates.append(F.min(F.when(low, F.col("_v"))).alias(f"_lo_{name}"))
        aggregates.append(F.min(F.when(high, F.col("_v"))).alias(f"_hi_{name}"))
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (_position(p) - F.floor(_position(p)))).alias(name))
    return ranked.groupBy("_key").agg(*aggregates).select("_key", *out)


def quantiles_of_counts(counts: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """(``_key``, one column per entry of ``probs``): linear-interpolated quantiles."""
    counts = counts.where(F.col("_n") > 0).withColumn("_bin", _bin(F.col("_v")))
    bins = counts.groupBy("_key", "_bin").agg(F.sum("_n").alias("_bin_n"))
    return _interpolate(counts.join(_wanted_bins(bins, probs), ["_key", "_bin"]), probs)


def quantiles_of_counters(per_value: DataFrame, counters: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of many overlapping groups at once, (``_key`` = counter name).

    ``per_value`` has one row per distinct value ``_v`` with the rows of each
    group in a counter column. Only the bins are unpivoted, never the values.
    """
    per_value = per_value.where(F.col("_v").isNotNull()).withColumn("_bin", _bin(F.col("_v")))
    wide = per_value.groupBy("_bin").agg(*[F.sum(c).alias(c) for c in counters])
    bins = wide.unpivot(["_bin"], list(counters), "_key", "_bin_n").where(F.col("_bin_n") > 0)
    own = F.coalesce(*[F.when(F.col("_key") == c, F.col(f"`{c}`")) for c in counters])
    # at most two bins per counter and probability
    inside = per_value.join(F.broadcast(_wanted_bins(bins, probs)), "_bin").withColumn("_n", own)
    return _interpolate(inside.where(F.col("_n") > 0).select("_key", "_bin", "_v", "_n", "_start", "_total"), probs)


def approximate_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], accuracy: int) -> DataFrame:
    """One row per key (``_key`` struct) with values whose rank is off by rows / ``accuracy`` at most.

    A mergeable sketch of bounded size per key, built in the map tasks: only sketches are shuffled.
    Values come from the data, without interpolation. NULL and NaN do not count.
    """
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number))
    sketch = F.percentile_approx(number, [float(p) for p in probs.values()], int(accuracy)).alias("_q")
    found = rows.groupBy(_key(keys).alias("_key")).agg(sketch)
    return found.select("_key", *[F.element_at("_q", i + 1).alias(name) for i, name in enumerate(probs)])


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], weight: Column | None = None, accuracy: int | None = None
) -> DataFrame:
    """Quantiles of ``value`` per key; groups without values are absent.

    Exact and linear-interpolated, or with ``accuracy`` approximate (``approximate_quantiles``;
    weights are for exact ones only).
    """
    if accuracy is not None:
        found = approximate_quantiles(df, keys, value, probs, accuracy)
    else:
        found = quantiles_of_counts(value_counts(df, keys, value, weight), probs)
    return found.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *probs)


def with_quantiles(
    stats: DataFrame, df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
    weight: Column | None = None, accuracy: int | None = None,
) -> DataFrame:
    """Left join the quantiles of ``value`` to a table with one row per key; ``accuracy`` as in ``grouped_quantiles``."""
    if accuracy is not None:
        found, key = approximate_quantiles(df, keys, value, probs, accuracy), _key(keys)
    else:
        key = _marks(keys)
        found = quantiles_of_counts(value_counts(df, keys, value, weight, key), probs)
    return stats.withColumn("_key", key).join(found, "_key", "left").drop("_key")


def with_many_quantiles(
    stats: DataFrame, df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """Quantiles of several columns from one scan; ``wanted`` is column -> {output: probability}.

    The column's number is part of the group key, so all columns share one pass.
    """
    number = F.array(*[F.struct(F.lit(i).alias("metric"), F.col(c).cast("double").alias("value")) for i, c in enumerate(wanted)])
    long = df.select(_marks(keys).alias("_of"), F.explode(number).alias("_m"))
    long = long.select("_of", F.col("_m.metric").alias("_metric"), F.col("_m.value").alias("_value"))
    distinct = sorted({p for probs in wanted.values() for p in probs.values()})
    names = {f"p{i}": p for i, p in enumerate(distinct)}
    found = quantiles_of_counts(value_counts(long, ["_of", "_metric"], "_value"), names)
    found = found.select(F.col("_key._of").alias("_key"), F.col("_key._metric").alias("_metric"), *names)
    label = {p: n for n, p in names.items()}
    spread = found.groupBy("_key").agg(*[
        F.max(F.when(F.col("_metric") == i, F.col(label[p]))).alias(out)
        for i, probs in enumerate(wanted.values()) for out, p in probs.items()
    ])
    return stats.withColumn("_key", _marks(keys)).join(spread, "_key", "left").drop("_key")
