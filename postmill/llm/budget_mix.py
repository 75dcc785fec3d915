"""Mixing sources to target weights by fitting documents into word budgets.

Documents are counted by exact length per source. Whole repeats fill most of a
budget, a proportional share of every length fills all but a bounded rest, and a bounded
knapsack over what is left finds lengths that meet the budget exactly. Which
documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import gapless_ranks
from postmill.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
OPEN_WORDS = 1 << 16  # of a budget that are left to the knapsack


def source_key(source: Column) -> Column:
    """A key that is never NULL and sorts by code point, NULL sources last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(``_source``, ``_size``, ``_target``) from (``_source``, ``_size``).

    Sources, ordered by name, weigh ``weights`` repeating and share ``share`` of all
    sizes. No target passes ``cap`` times its source's size; the excess goes to the
    others by weight. That is one water level: a source gets weight × level or its
    cap. Only the table of sources is sorted.
    """
    everywhere = Window.orderBy("_source")
    place = F.pmod(F.row_number().over(everywhere) - 1, F.lit(len(weights)))
    by_fill = Window.orderBy("_fill", "_source")
    upto, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    total = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
        .withColumn("_cap", F.col("_size") * F.lit(float(cap)))
        .withColumn("_fill", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("_size").over(total) * F.lit(float(share)))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.sum("_weight").over(after))
        .withColumn("_water", F.max(F.when(F.col("_fill") >= F.col("_level"), F.col("_level"))).over(total))
    )
    target = F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_weight") * F.col("_water")))
    return rows.select("_source", "_size", target.alias("_target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words meet ``budget``.

    Of a budget over half of the words, the documents to leave out are chosen instead.
    Proportional shares of all lengths fill it up to the last OPEN_WORDS words, which the
    knapsack fits to what is left. It falls short only where no choice of that can meet it.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int(lengths @ counts)
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros(len(counts), np.int64)
    if 2 * budget > total:
        return counts - fit_lengths(lengths, counts, total - budget)
    wanted = counts * (max(0, budget - OPEN_WORDS) / total)
    take = np.floor(wanted).astype(np.int64)
    rest = budget - int(lengths @ take)
    while rest < 0:  # a product rounded up
        i = int(np.argmax(take * lengths))
        take[i] -= 1
        rest += int(lengths[i])
    # one more of the lengths that lost most by rounding, as far as they fit
    order = np.argsort(take - wanted, kind="stable")
    order = order[(take < counts)[order]]
    fits = np.cumsum(lengths[order]) <= rest - OPEN_WORDS
    take[order[fits]] += 1
    rest -= int(lengths[order[fits]].sum())
    return take + _knapsack(lengths, counts - take, rest)


def _knapsack(lengths: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """Bounded knapsack: bit s of ``sums`` says that some choice adds up to s."""
    more = np.zeros(len(lengths), np.int64)
    sums, full, steps = 1, (1 << (rest + 1)) - 1, []
    for i in np.argsort(-lengths, kind="stable"):
        size, n = int(lengths[i]), 0
        if 0 < size <= rest:
            n = min(int(left[i]), rest // size)
        part = 1
        while n > 0 and not sums >> rest & 1:
            part = min(part, n)
            grown = (sums | sums << (part * size)) & full
            if grown != sums:
                steps.append((i, part, sums))
                sums = grown
            n -= part
            part *= 2
    at = sums.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            more[i] += part
            at -= part * int(lengths[i])
    return more


def _quota(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole repeats and extra documents of each length, for one source's length counts."""
    lengths, counts = pdf["_len"].to_numpy(), pdf["_n"].to_numpy()
    size, target = int(lengths @ counts), float(pdf["_target"].iloc[0])
    repeats = int(target // size) if size else 0
    extra = fit_lengths(lengths, counts, round(target - repeats * size))
    return pdf[["_source", "_len"]].assign(_repeats=repeats, _extra=extra)


def counted(rows: DataFrame) -> DataFrame:
    """Write narrow rows with their sizes once, so that texts are read and counted once."""
    return materialize(rows, "mix-rows")


def mix(
    rows: DataFrame, source: Column, size: Column, identity: Sequence[Column], weights: Sequence[float] = WEIGHTS,
    share: float = 1.5, cap: float = 2.0, seed: int = 0,
) -> DataFrame:
    """Add ``_source_size``, ``_target`` and ``_times`` (how often a row is taken) to ``rows``.

    ``size`` is a row's words. Rows without words are taken as often as all rows of
    their source at least are. Rows of one length are taken in the order of a seeded
    hash of ``identity``; equal rows come in any order, which does not show. The
    counts by length are the only thing that one task holds per source, and their
    number does not grow with the rows.
    """
    sized = rows.withColumns({"_source": source_key(source), "_len": size, "_key": F.xxhash64(F.lit(seed), *identity)})
    lengths = materialize(sized.groupBy("_source", "_len").agg(F.count(F.lit(1)).alias("_n")), "mix-lengths")
    sizes = lengths.groupBy("_source").agg(F.sum(F.col("_len") * F.col("_n")).alias("_size"))
    targets = materialize(source_targets(sizes, weights, share, cap), "mix-targets")
    quota = lengths.join(targets, "_source").groupBy("_source").applyInPandas(
        _quota, "_source string, _len long, _repeats long, _extra long"
    )
    quota = quota.join(targets.select("_source", F.col("_size").alias("_source_size"), "_target"), "_source")
    out = gapless_ranks(sized, ["_source", "_len"], [F.col("_key")], F.col("_key"), "_rank", materialize(quota, "mix-quota"))
    times = F.col("_repeats") + F.when(F.col("_rank") < F.col("_extra"), F.lit(1)).otherwise(F.lit(0))
    return out.withColumn("_times", times).drop("_source", "_len", "_key", "_rank", "_repeats", "_extra")
