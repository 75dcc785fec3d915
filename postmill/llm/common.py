"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.session import forget, materialize

# a word is a maximal run of anything but space and the five ASCII controls 9 to 13
WORD = r"[^\x20\x09-\x0D]+"

# ranks are built from so many hash buckets per group, so a hot group is many tasks
RANK_BUCKETS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand texts to Python in batches of so many rows at most, which bounds the memory of the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def word_count(text: Column) -> Column:
    """Words of a text; NULL counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of the text, NULL as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def gapless_ranks(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], spread: Column, rank: str, of_group: DataFrame | None = None
) -> DataFrame:
    """Add ``rank``: 0, 1, 2, … in each group, without a task that holds a group.

    Rows are ranked inside (group, bucket of ``spread``), and buckets start where
    the ones before them end. The order inside a bucket is ``order``; the order of
    buckets is that of the hash. Rows equal in all of ``order`` share a bucket and
    take its places in any order. Columns of ``of_group``, a table with one row per
    group, are added on the way, so that rows are shuffled once.
    """
    key = [*group, "_bucket"]
    rows = rows.withColumn("_bucket", F.pmod(spread, F.lit(RANK_BUCKETS)))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        .select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    if of_group is not None:
        starts = starts.join(of_group, list(group))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    ranked = rows.withColumn("_inside", inside)
    return ranked.join(starts, key).withColumn(rank, F.col("_start") + F.col("_inside") - 1).drop("_bucket", "_inside", "_start")


# --- byte strings as arrays ----------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit number."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def symbol_codes(seed: int, size: int = 256) -> np.ndarray:
    """A pseudo-random 64-bit number for each symbol."""
    return mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed * 2 + 1))


class RangeHashes:
    """64-bit hashes of any range of a symbol array, each in a few operations.

    A range's hash depends on its symbols only, not on where it starts, so equal
    ranges of different arrays, tasks and runs hash alike.
    """

    def __init__(self, codes: np.ndarray):
        powers = np.full(len(codes) + 1, _BASE, np.uint64)
        powers[0] = 1
        inverse = np.full(len(codes) + 1, _BASE_INVERSE, np.uint64)
        inverse[0] = 1
        self._inverse = np.multiply.accumulate(inverse)
        self._sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * np.multiply.accumulate(powers)[:-1], out=self._sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[start]) * self._inverse[start])

    def fixed(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size`` symbols."""
        n = max(0, len(self._sums) - size)
        return mix64((self._sums[size : size + n] - self._sums[:n]) * self._inverse[:n])


def joined_bytes(texts: Sequence[str | None], gap: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, ``gap`` after each, and where each starts (one more for the end)."""
    parts = [(t or "").encode("utf-8") + gap for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), np.uint8), starts


def pieces(batch, column: str, most_bytes: int = 1 << 20):
    """Cut a pandas batch so that each piece holds about ``most_bytes`` characters (one row at least)."""
    sizes = batch[column].str.len().fillna(0).to_numpy(dtype=np.int64)
    if not len(sizes):
        return
    part = np.cumsum(sizes) // most_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(sizes)]):
        yield batch.iloc[lo:hi]


SEPARATOR = np.zeros(256, np.int8)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1


def word_ranges(data: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array that ends in a separator."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = separator[data] ^ 1
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# --- groups of linked rows ------------------------------------------------------


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For rows 0 … n-1 and links between them, the smallest row of each row's component."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``): each node of ``edges`` (``a``, ``b``) with the smallest node it is connected to.

    Alternating large and small stars: every round links a node's larger, then its
    smaller neighbours to the least of them, until all edges point at a root. Rounds
    grow with the logarithm of a component's length. A round is written to the shared
    folder, so lineage stays short; nothing is gathered but the round's checksum.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        nxt = materialize(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        forget(now)
        now = nxt
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).head()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def in_blocks(rows: DataFrame, spread: Column, block: int) -> DataFrame:
    """Repeat rows so that any two of a group meet in some (``_i``, ``_j``) of at most about 2 × ``block`` rows.

    ``_n`` is the size of a row's group. A group of n rows is dealt into ceil(n / block)
    blocks by a hash; a block meets itself where ``_i`` = ``_j`` and each other block
    once. ``_block`` is the row's own block.
    """
    blocks = F.ceil(F.col("_n") / F.lit(float(block))).cast("int")
    dealt = rows.withColumn("_blocks", blocks).withColumn("_block", F.pmod(spread, F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_partner", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumns({
        "_i": F.least("_block", "_partner"), "_j": F.greatest("_block", "_partner"),
    }).drop("_n", "_blocks", "_partner")


FILTER_BITS = 1 << 23


def may_contain(keys: DataFrame, column: str):
    """A test of hash columns that is true for all 64-bit hashes in ``keys``, and false for most others.

    A Bloom filter of one megabyte, whatever the number of keys. Rows that fail it need
    not be shuffled for a join with ``keys``; those that pass still have to be joined.
    """
    places = F.explode(F.array(F.col(column), F.xxhash64(column)))
    bit = F.pmod("_place", F.lit(FILTER_BITS))
    words = keys.select(places.alias("_place")).select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))").alias("_bits")
    ).toPandas()
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    bits[words["_word"].to_numpy(dtype=np.int64)] = words["_bits"].to_numpy(dtype=np.int64).view(np.uint64)

    def test(first: Column) -> Column:
        def run(a, b):
            import pandas as pd

            found = [(bits[x % FILTER_BITS >> 6] >> (x % 64).astype(np.uint64)) & np.uint64(1) for x in (a.to_numpy(), b.to_numpy())]
            return pd.Series((found[0] & found[1]).astype(bool))

        return F.pandas_udf(run, "boolean")(first, F.xxhash64(first))

    return test


def by_group(batches, keys: Sequence[str], most_rows: int = 20000):
    """Join sorted pandas batches into frames of whole groups, (frame, group starts), each of ``most_rows`` rows or one group."""
    import pandas as pd

    held = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < most_rows:
            continue
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        starts = _starts(frame, keys)
        if len(starts) > 1:
            cut = starts[-1]
            yield frame.iloc[:cut], starts[:-1]
            frame = frame.iloc[cut:]
        held, rows = [frame], len(frame)
        if len(starts) == 1:
            most_rows = max(most_rows, 2 * rows)
    if held:
        frame = pd.concat(held, ignore_index=True)
        yield frame, _starts(frame, keys)


def _starts(frame, keys) -> np.ndarray:
    new = np.zeros(len(frame), bool)
    new[:1] = True
    for key in keys:
        values = frame[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def pairs_inside(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a < b) of rows of the same group, for groups that begin at ``starts``."""
    sizes = np.diff(np.append(starts, n))
    ends = np.repeat(starts + sizes, sizes)
    later = ends - np.arange(n) - 1
    left = np.repeat(np.arange(n), later)
    first = np.repeat(np.cumsum(later) - later, later)
    right = left + 1 + np.arange(len(left)) - first
    return left, right
