"""K-d tree sharding: split at weighted medians along the widest metadata dimension.

Everything is DataFrame work. A level of the tree takes three aggregates over a
narrow table (extents, a histogram along the widest dimension, a histogram of a
hash inside the one bin that holds the median); only (node, bin) sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import forget, materialize

BINS = 4096  # of a dimension's extent in its node
TIES = 65536  # hash classes that split the median bin


def number_coordinate(column: Column) -> Column:
    """Logarithmic position of a number; NULL and NaN lie below all others."""
    x = column.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(-1e3)).otherwise(F.signum(x) * F.log1p(F.abs(x)))


def text_coordinate(column: Column) -> Column:
    """Position of a string in byte order, from its first six bytes; NULL lies below the empty string."""
    head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0")
    return F.when(column.isNull(), F.lit(-1.0)).otherwise(F.conv(head, 16, 10).cast("double") / F.lit(float(1 << 48)))


def document_coordinates(docs: DataFrame) -> list[Column]:
    """Language, source and length: the metadata of ``documents``."""
    return [text_coordinate(docs["lang"]), text_coordinate(docs["source"]), number_coordinate(docs["n_chars"])]


@dataclass(frozen=True)
class Tree:
    """Cut tables, one for each level, and the number of leaves."""

    levels: list[DataFrame]
    shards: int


def prepared(rows: DataFrame, coordinates: Sequence[Column], size: Column, identity: Sequence[Column]) -> DataFrame:
    """Rows with ``_x`` (coordinates), ``_w`` (size), ``_id`` (hash) at the root of a tree."""
    return rows.withColumns({
        "_x": F.array(*coordinates), "_w": size.cast("long"), "_id": F.xxhash64(*identity), "_node": F.lit(0).cast("long"),
    })


def _descend(rows: DataFrame, cuts: DataFrame, level: int) -> DataFrame:
    """Move each row of a cut node to its left (2n + 1) or right (2n + 2) child."""
    rows = rows.join(cuts, "_node", "left")
    left = (F.col("_bin") < F.col("_cut_bin")) | ((F.col("_bin") == F.col("_cut_bin")) & (_tie(level) < F.col("_cut_tie")))
    child = F.col("_node") * 2 + F.when(left, F.lit(1)).otherwise(F.lit(2))
    moved = rows.withColumn("_bin", _bin()).withColumn("_node", F.when(F.col("_cut_bin").isNull(), F.col("_node")).otherwise(child))
    return moved.drop("_bin", *[c for c in cuts.columns if c != "_node"])


def _bin() -> Column:
    share = (F.element_at("_x", F.col("_dim")) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")


def _tie(level: int) -> Column:
    return F.pmod(F.xxhash64("_id", F.lit(level)), F.lit(TIES)).cast("int")


def _leaves(shards: int, levels: int) -> list[list[tuple[int, int, int]]]:
    """For each level the nodes to cut: (node, leaves left, leaves right)."""
    out, nodes = [], {0: shards}
    for _ in range(levels):
        out.append([(n, k // 2, k - k // 2) for n, k in nodes.items() if k > 1])
        nodes = {c: k for n, left, right in out[-1] for c, k in ((2 * n + 1, left), (2 * n + 2, right))}
    return out


def _leaf_numbers(shards: int) -> dict[int, int]:
    """Leaf node -> shard, from left to right."""
    out, stack = {}, [(0, shards)]
    while stack:
        n, k = stack.pop()
        if k == 1:
            out[n] = len(out)
        else:
            stack += [(2 * n + 2, k - k // 2), (2 * n + 1, k // 2)]
    return out


def _plan_table(spark, plan: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(plan, "_node long, _left long, _right long")


def _cuts(rows: DataFrame, plan: DataFrame, extent: Sequence[float], level: int) -> DataFrame:
    """(``_node``, ``_dim``, ``_lo``, ``_hi``, ``_cut_bin``, ``_cut_tie``) of one level."""
    dims = range(len(extent))
    x = [F.element_at("_x", d + 1) for d in dims]
    spans = rows.groupBy("_node").agg(
        F.sum("_w").alias("_total"), *[F.min(x[d]).alias(f"_lo{d}") for d in dims], *[F.max(x[d]).alias(f"_hi{d}") for d in dims]
    )
    # a dimension's width is its share of the whole table's extent; the first of equal ones is taken
    width = F.array_sort(F.array(*[
        F.struct(
            (-(F.col(f"_hi{d}") - F.col(f"_lo{d}")) / F.lit(extent[d] or 1.0)).alias("width"), F.lit(d + 1).alias("dim"),
            F.col(f"_lo{d}").alias("lo"), F.col(f"_hi{d}").alias("hi"),
        ) for d in dims
    ]))
    spans = spans.withColumn("_widest", F.element_at(width, 1)).join(plan, "_node").select(
        "_node", F.col("_widest.dim").alias("_dim"), F.col("_widest.lo").alias("_lo"), F.col("_widest.hi").alias("_hi"),
        (F.col("_total") * F.col("_left") / (F.col("_left") + F.col("_right"))).alias("_goal"),
    )
    spans = materialize(spans, "kd-spans")
    inside = rows.join(spans, "_node").withColumn("_bin", _bin())
    running = Window.partitionBy("_node").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = inside.groupBy("_node", "_bin").agg(F.sum("_w").alias("_n"), F.max("_goal").alias("_goal"))
    bins = bins.withColumn("_end", F.sum("_n").over(running)).where(F.col("_end") >= F.col("_goal"))
    bins = bins.groupBy("_node").agg(F.min(F.struct("_bin", (F.col("_goal") - (F.col("_end") - F.col("_n"))).alias("rest"))).alias("_cut"))
    median = materialize(bins.select("_node", F.col("_cut._bin").alias("_cut_bin"), F.col("_cut.rest").alias("_rest")), "kd-median")
    tied = inside.join(median, "_node").where(F.col("_bin") == F.col("_cut_bin")).withColumn("_tie", _tie(level))
    tied = tied.groupBy("_node", "_tie").agg(F.sum("_w").alias("_n"), F.max("_rest").alias("_rest"))
    ties = Window.partitionBy("_node").orderBy("_tie").rowsBetween(Window.unboundedPreceding, 0)
    # classes up to the one whose end is nearest to the median go left
    tied = tied.withColumn("_end", F.sum("_n").over(ties)).withColumn("_off", F.abs(F.col("_end") - F.col("_rest")))
    best = tied.groupBy("_node").agg(
        F.min(F.struct("_off", "_tie")).alias("_best"), F.max("_rest").alias("_rest")
    ).withColumn("_cut_tie", F.when(F.col("_rest") <= F.col("_best._off"), F.lit(0)).otherwise(F.col("_best._tie") + 1))
    cuts = spans.join(median, "_node").join(best.select("_node", "_cut_tie"), "_node")
    return materialize(cuts.select("_node", "_dim", "_lo", "_hi", "_cut_bin", "_cut_tie"), "kd-cuts")


def fit(rows: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> tuple[Tree, DataFrame]:
    """Grow the tree on ``prepared`` rows; returns it and the rows at their leaves.

    Leaves number ``shards``, or as many as keep each near ``target_bytes``. An
    odd number of leaves is cut in proportion. Ties on a dimension are cut by a
    hash of the row, so a value that a third of the rows share is cut like any other;
    rows equal in all identity columns stay together. Empty tables have a tree of
    one level with no cuts.
    """
    rows = materialize(rows, "kd-rows")
    dims = rows.select(F.size("_x")).head()
    dims = dims[0] if dims else 1
    whole = rows.agg(F.sum("_w"), *[F.max(F.element_at("_x", d + 1)) - F.min(F.element_at("_x", d + 1)) for d in range(dims)]).head()
    if shards is None:
        shards = max(1, -(-(whole[0] or 0) // target_bytes))
    plans = _leaves(shards, (shards - 1).bit_length())
    levels = []
    for level, plan in enumerate(plans):
        cuts = _cuts(rows, _plan_table(rows.sparkSession, plan), [w or 0.0 for w in whole[1:]], level)
        moved = materialize(_descend(rows, cuts, level), "kd-rows")
        forget(rows)
        rows = moved
        levels.append(cuts)
    return Tree(levels, shards), rows


def numbered(rows: DataFrame, tree: Tree, shard: str) -> DataFrame:
    """Replace the leaf node by the number of its shard."""
    numbers = rows.sparkSession.createDataFrame(sorted(_leaf_numbers(tree.shards).items()), f"_node long, `{shard}` int")
    return rows.join(materialize(numbers, "kd-leaves"), "_node").drop("_node", "_x", "_w", "_id")


def place(rows: DataFrame, tree: Tree, shard: str) -> DataFrame:
    """Put ``prepared`` rows, with whatever columns they carry, into the tree's shards."""
    for level, cuts in enumerate(tree.levels):
        rows = _descend(rows, cuts, level)
    return numbered(rows, tree, shard)
