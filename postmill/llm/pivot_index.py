"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), nearest first. Each
pivot has an inverted list of the vectors it describes; two vectors of a list that
share enough pivots are compared by cosine, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import by_group, components, in_blocks, local_roots
from postmill.session import materialize

SIMILARITY = 0.98
PREFIX = 10  # pivots that describe a vector
SHARED = 3  # pivots that two vectors have to share
MOST_PIVOTS = 2048
APART = 0.8  # no two pivots are as alike as this
BLOCK = 1024
_NO_ID = 2**63 - 1


def pivot_count(vectors: int) -> int:
    """Pivots grow with the root of the number of vectors, so lists do too, up to a bound."""
    return int(min(MOST_PIVOTS, max(64, 4 * math.isqrt(vectors))))


def apart(sample: np.ndarray, most_alike: float) -> np.ndarray:
    """Unit vectors of the sample, in its order, without those that are ``most_alike`` or more to an earlier one.

    A dense group of vectors would else be described by pivots that are all about as
    near, in an order that says nothing.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    kept = np.zeros(len(unit), bool)
    for i, v in enumerate(unit):
        kept[i] = not (unit[kept] @ v >= most_alike).any()
    return unit[kept]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots by cosine, nearest first; of equal ones the lower number."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


def _usable(batches):
    """Rows whose vectors have a direction: no NULL, NaN or infinite component, not all zero.

    Vectors are brought to a largest component between 0.5 and 1 by a power of two, which rounds
    nothing, so that no sum of squares overflows or vanishes.
    """
    for batch in batches:
        vectors = [None if v is None else np.asarray(v, dtype=float) for v in batch["_vector"]]
        good = np.array([v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any()) for v in vectors], bool)
        rows = batch.loc[good, ["_id", "_label"]]
        kept = [np.ldexp(v, -np.frexp(np.abs(v).max())[1]) for v, ok in zip(vectors, good) if ok]
        yield rows.assign(_bytes=[v.tobytes() for v in kept], _dim=np.array([len(v) for v in kept], np.int32))


def _indexed(pivots: dict[int, np.ndarray], prefix: int):
    def run(batches):
        for batch in batches:
            for dim, rows in batch.groupby("_dim"):
                vectors = np.frombuffer(b"".join(rows["_bytes"]), float).reshape(len(rows), dim)
                near = nearest_pivots(vectors, pivots[dim], prefix) if dim in pivots else np.zeros((len(rows), 1), np.int32)
                yield rows.assign(_near=list(near))

    return run


def _links(similarity: float, shared: int):
    """Links inside a list, each counted in the list of the lowest pivot that the two share."""

    def run(batches):
        for frame, starts in by_group(batches, ["_list", "_i", "_j"], 4000):
            for lo, hi in zip(starts, np.append(starts[1:], len(frame))):
                group = frame.iloc[lo:hi]
                n, pivot = hi - lo, group["_pivot"].iloc[0]
                near = np.vstack(group["_near"])
                x = np.frombuffer(b"".join(group["_bytes"]), float).reshape(n, -1)
                norm = np.sqrt((x * x).sum(1))
                linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= similarity
                used, place = np.unique(near, return_inverse=True)
                has = np.zeros((n, len(used)), np.float32)
                has[np.repeat(np.arange(n), near.shape[1]), place.ravel()] = 1
                linked &= has @ has.T >= min(shared, near.shape[1])
                before = has[:, used < pivot]
                linked &= before @ before.T == 0
                if group["_i"].iloc[0] == group["_j"].iloc[0]:
                    np.fill_diagonal(linked, False)
                else:
                    block = group["_block"].to_numpy()
                    linked &= block[:, None] != block[None, :]
                ids = group["_key"].to_numpy()
                a, b = np.nonzero(np.triu(linked))
                links = linked @ group["_copies"].to_numpy()
                to = local_roots(n, a, b)
                some = links > 0
                if some.any():
                    yield pd.DataFrame({"_key": ids[some], "_links": links[some], "_to": ids[to[some]]})

    return run


def link_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    similarity: float = SIMILARITY, prefix: int = PREFIX, shared: int = SHARED,
) -> DataFrame:
    """(``_id``, ``_links``, ``_component``), one row per input row.

    Vectors are compared when their labels are equal and not NULL and they have equally
    many components, of whatever magnitude. ``_links`` counts the other rows linked directly, ``_component`` is
    the smallest id reachable by links. A vector without a direction (NULL, empty, zero,
    or with a component that is NULL, NaN or infinite) links with nothing. A NULL id is
    larger than all others.

    Pivots are a seeded sample of at most MOST_PIVOTS distinct vectors of each of the 16
    most frequent lengths (others share one list), less those too close to another; every
    vector is indexed. Vectors of a label that are equal, or become so by a power of two,
    are indexed once. Lists are compared in blocks, whatever their size.
    """
    number = F.coalesce(F.col(vec_id).cast("long"), F.lit(_NO_ID))
    named = rows.select(number.alias("_id"), F.col(label).cast("string").alias("_label"), F.col(vector).alias("_vector"))
    usable = named.where("_label is not null and _vector is not null").where(~F.exists("_vector", lambda x: x.isNull()))
    usable = usable.mapInPandas(_usable, "_id long, _label string, _bytes binary, _dim int")
    # -0.0 and 0.0 differ as bytes only: such twins are linked by their cosine
    key = F.unhex(F.md5(F.concat(F.encode(F.concat("_label", F.lit("\n")), "UTF-8"), "_bytes")))
    usable = materialize(usable.withColumn("_key", key), "vectors")
    classes = usable.groupBy("_key").agg(
        F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_copies"), F.first("_label").alias("_label"),
        F.first("_bytes").alias("_bytes"), F.first("_dim").alias("_dim"),
    )
    classes = materialize(classes, "vector-classes")
    pivots = {}
    for dim, n in classes.groupBy("_dim").count().orderBy(F.desc("count"), "_dim").limit(16).collect():
        most = pivot_count(n)
        drawn = classes.where(F.col("_dim") == dim).orderBy(F.xxhash64("_key"), "_key").limit(most).select("_bytes").collect()
        pivots[dim] = apart(np.vstack([np.frombuffer(bytes(r[0]), float) for r in drawn]), APART)
    indexed = classes.drop("_least").mapInPandas(
        _indexed(pivots, prefix), "_key binary, _copies long, _label string, _bytes binary, _dim int, _near array<int>"
    )
    lists = materialize(
        indexed.withColumn("_pivot", F.explode("_near")).withColumn("_list", F.concat_ws(":", "_pivot", "_dim", "_label")).drop("_label", "_dim"),
        "pivot-lists",
    )
    sizes = lists.groupBy("_list").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = in_blocks(lists.join(sizes, "_list"), F.xxhash64("_key"), BLOCK)
    met = met.repartition("_list", "_i", "_j").sortWithinPartitions("_list", "_i", "_j", "_key")
    linked = materialize(met.mapInPandas(_links(similarity, shared), "_key binary, _links long, _to binary"), "vector-links")
    roots = components(linked.select(F.col("_key").alias("a"), F.col("_to").alias("b")))
    links = linked.groupBy("_key").agg(F.sum("_links").alias("_links"))
    joined = classes.select("_key", "_least", "_copies").join(links, "_key", "left").join(
        roots.select(F.col("node").alias("_key"), F.col("root").alias("_root")), "_key", "left"
    ).withColumn("_root", F.coalesce("_root", "_key"))
    joined = joined.join(joined.groupBy("_root").agg(F.min("_least").alias("_component")), "_root")
    joined = joined.select("_key", "_component", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"))
    good = usable.select("_id", "_key").join(joined, "_key").select("_id", "_links", "_component")
    return good.unionByName(_without_direction(named))


def _without_direction(named: DataFrame) -> DataFrame:
    """Rows that link with nothing."""
    sound = F.coalesce(
        F.col("_label").isNotNull() & F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("_vector", lambda x: x != 0), F.lit(False),
    )
    return named.where(~sound).select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component"))


def real_id(column: str):
    """An id, NULL again where it stood for NULL."""
    return F.when(F.col(column) != _NO_ID, F.col(column))
