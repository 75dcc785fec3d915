"""N-gram Jaccard join by chosen paths.

A text is the set of its word shingles. In each run a set goes to the nodes of the
shingles it chooses: those whose seeded hash is below 1 / (similarity × set size), so
two sets above the similarity are expected to choose at least one shared shingle.
Nodes with few sets are searched by brute force; larger ones are split again by
shingles chosen under a hash of their path. Runs are repeated until the recall asked
for is reached. What the search finds is verified on whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import (
    LOWER, RangeHashes, by_group, components, in_blocks, joined_bytes, local_roots, may_contain, mix64, pairs_inside, pieces,
    small_batches, symbol_codes, word_ranges,
)
from postmill.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
SMALL = 48  # sets in a node that is searched without another split
DEPTH = 3
SKETCH = 64
BLOCK = 512
_NO_ID = 2**63 - 1


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair just at the similarity is found with this probability, even ``depth`` splits down.

    A pair shares a Poisson number of chosen shingles with mean one at least, so it
    survives d splits with s(d) = 1 - exp(-s(d - 1)), s(0) = 1.
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def shingle_sets(texts: Sequence[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: words are runs without blanks, A-Z in lower case.

    A text of fewer than ``size`` words is one shingle; one without words is empty.
    """
    data, starts = joined_bytes(texts, b" ")
    data = LOWER[data]
    begin, end = word_ranges(data)
    words = RangeHashes(symbol_codes(11)[data]).of(begin, end)
    first = np.searchsorted(begin, starts)
    grams = RangeHashes(words)
    out = []
    for lo, hi in zip(first[:-1], first[1:]):
        at = np.arange(lo, max(hi - size + 1, lo + (hi > lo)))
        out.append(np.unique(grams.of(at, np.minimum(at + size, hi))))
    return out


def _sketch(shingles: np.ndarray) -> bytes:
    """Least hash of each of SKETCH ranges, 16 bits of it, zero for an empty range."""
    bins = (shingles >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(SKETCH, np.uint16)
    out[bins[first]] = (shingles[first] & np.uint64(0xFFFF)) | np.uint64(1)
    return out.tobytes()


def chosen_paths(sets: Sequence[np.ndarray], runs: int, similarity: float, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Paths of all sets: (number of the set, nodes at depth 1, 2, … with zero where a path ended), sorted by set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    member = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    odds = np.minimum(1.0 / (similarity * np.maximum(sizes, 1)), 1.0 - 2.0**-53)
    bound = (odds * 2.0**64).astype(np.uint64)
    owners, nodes = [], []
    for run in range(1, runs + 1):
        own = np.flatnonzero(sizes)
        path = np.zeros((len(own), 0), np.uint64)
        seed = np.full(len(own), run, np.uint64)
        for level in range(depth):
            n = sizes[own]
            entry = np.repeat(np.arange(len(own)), n)
            at = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + starts[own][entry]
            h = mix64(member[at] ^ mix64(seed)[entry])
            hit = h < bound[own][entry]
            chosen = entry[hit]
            if level:  # paths that choose nothing more end here
                ended = np.ones(len(own), bool)
                ended[chosen] = False
                owners.append(own[ended])
                nodes.append(np.pad(path[ended], ((0, 0), (0, depth - level))))
            own, path, seed = own[chosen], np.column_stack([path[chosen], h[hit]]), h[hit]
        owners.append(own)
        nodes.append(path)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate(nodes)[order].view(np.int64)


def _fingerprint(shingles: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([mix64(shingles).sum(), mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes()


def _described(size: int, runs: int, similarity: float):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "_text", 1 << 18):
                sets = shingle_sets(piece["_text"].tolist(), size)
                owner, nodes = chosen_paths(sets, runs, similarity)
                cuts = np.searchsorted(owner, np.arange(1, len(sets)))
                yield pd.DataFrame({
                    "_id": piece["_id"].to_numpy(), "_hash": piece["_hash"].to_numpy(),
                    "_fp": [_fingerprint(s) if len(s) else None for s in sets], "_sketch": [_sketch(s) for s in sets],
                    "_size": [len(s) for s in sets],
                    **{f"_p{d + 1}": np.split(np.ascontiguousarray(nodes[:, d]), cuts) for d in range(DEPTH)},
                })

    return run


def _sets(size: int):
    """Shingle sets of texts that have the fingerprint they are wanted for; another text may have the same id."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "_text", 1 << 18):
                sets = shingle_sets(piece["_text"].tolist(), size)
                right = [_fingerprint(s) == bytes(fp) for s, fp in zip(sets, piece["_fp"])]
                yield piece.drop(columns="_text").assign(_set=[s.tobytes() for s in sets])[right]

    return run


def _alike(loose: float):
    """Roots of rows whose sketches agree on a share ``loose`` of the ranges that either fills."""

    def run(batches):
        for frame, starts in by_group(batches, ["_node", "_i", "_j"]):
            sketches = np.frombuffer(b"".join(frame["_sketch"]), np.uint16).reshape(len(frame), SKETCH)
            block, i, j = (frame[c].to_numpy() for c in ("_block", "_i", "_j"))
            left, right = pairs_inside(starts, len(frame))
            across = (i[left] == j[left]) | (block[left] != block[right])
            left, right = left[across], right[across]
            keep = np.zeros(len(left), bool)
            for at in range(0, len(left), 1 << 18):
                a, b = sketches[left[at : at + (1 << 18)]], sketches[right[at : at + (1 << 18)]]
                keep[at : at + (1 << 18)] = ((a == b) & (a != 0)).sum(1) >= loose * ((a | b) != 0).sum(1)
            root = local_roots(len(frame), left[keep], right[keep])
            moved = np.flatnonzero(root != np.arange(len(frame)))
            ids = frame["_fp"].to_numpy()
            if len(moved):
                yield pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]}).drop_duplicates()

    return run


def shared_counts(sets: Sequence[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Members that occur in the same sets are counted together."""
    n = len(sets)
    member = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(member, kind="stable")
    member, owner = member[order], owner[order]
    start = np.flatnonzero(np.diff(member, prepend=member[:1] ^ np.uint64(1)))
    size = np.diff(np.append(start, len(member)))
    with np.errstate(over="ignore"):
        pattern = np.add.reduceat(symbol_codes(23, n)[owner], start) if len(start) else start.astype(np.uint64)
    start, size, pattern = start[size > 1], size[size > 1], pattern[size > 1]
    _, first, weight = np.unique(pattern, return_index=True, return_counts=True)
    out = np.zeros((n, n))
    for at in range(0, len(first), 2048):
        chosen = first[at : at + 2048]
        x = np.zeros((n, len(chosen)), np.float32)
        for c, k in enumerate(chosen):
            x[owner[start[k] : start[k] + size[k]], c] = 1
        out += (x * weight[at : at + 2048].astype(np.float32)) @ x.T
    return out


def _links(similarity: float):
    """Links of each set inside its group, weighed by copies, and the root it is linked to."""

    def run(batches):
        for frame, starts in by_group(batches, ["_root", "_i", "_j"], 500):
            for lo, hi in zip(starts, np.append(starts[1:], len(frame))):
                # repeated rows of a text bring its set again
                group = frame.iloc[lo:hi].drop_duplicates("_fp")
                sets = [np.frombuffer(s, np.uint64) for s in group["_set"]]
                block, copies = group["_block"].to_numpy(), group["_copies"].to_numpy()
                size = np.array([len(s) for s in sets], float)
                shared = shared_counts(sets)
                linked = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-9
                if group["_i"].iloc[0] == group["_j"].iloc[0]:
                    np.fill_diagonal(linked, False)
                else:
                    linked &= block[:, None] != block[None, :]
                ids = group["_fp"].to_numpy()
                a, b = np.nonzero(np.triu(linked))
                yield pd.DataFrame({"_fp": ids, "_links": linked @ copies, "_to": ids[local_roots(len(ids), a, b)]})

    return run


def _one_of_each_text(rows: DataFrame, own: DataFrame) -> DataFrame:
    """One row of each text. Rows whose text occurs once stay where they are; only the others are shuffled."""
    twice = own.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least")).where("_n > 1").drop("_n")
    twice = materialize(twice, "copies")
    asked = rows.withColumn("_asked", may_contain(twice, "_hash")(F.col("_hash")))
    again = asked.where("_asked").join(twice, "_hash", "left").where("_least is null or _id = _least")
    first = F.row_number().over(Window.partitionBy("_hash").orderBy("_id"))
    again = again.withColumn("_copy", first).where("_copy = 1")
    return asked.where("not _asked").select(*rows.columns).unionAll(again.select(*rows.columns))


def _grouped(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(group, "_i", "_j").sortWithinPartitions(group, "_i", "_j", "_fp")


def join_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """(``_id``, ``_hash``, ``_class``, ``_group``, ``_links``, ``_root``), one row per input row.

    ``_id`` is the document's id and ``_hash`` a hash of its text. ``_class`` is the
    smallest id among texts with the same shingles, ``_group`` the smallest id reachable
    by links, ``_links`` the number of other rows with a Jaccard similarity of
    ``similarity`` or more, copies included. ``_root`` marks a group, and
    is NULL for texts without words. Texts without words link with nothing and
    are groups of their own, one for each row. A NULL id is larger than all others.

    Copies are folded before the search, so they cost one set. Nodes and groups of any
    size are compared in blocks, and only a spanning forest and link counts leave a task.
    """
    small_batches(docs.sparkSession)
    text_hash = F.xxhash64(F.col(text).cast("string"))
    # a NULL id travels as the largest number
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID))
    rows = docs.select(number.alias("_id"), text_hash.alias("_hash"), F.col(text).cast("string").alias("_text"))
    own = materialize(rows.select("_id", "_hash"), "rows")
    described = materialize(_one_of_each_text(rows, own).mapInPandas(
        _described(size, runs_for(recall), similarity),
        "_id long, _hash long, _fp binary, _sketch binary, _size int, " + ", ".join(f"_p{d + 1} array<long>" for d in range(DEPTH)),
    ), "described")
    named = own.join(described.select("_hash", "_fp"), "_hash")
    set_hash = F.xxhash64("_fp").alias("_set_hash")
    classes = named.where("_fp is not null").groupBy("_fp").agg(F.min("_id").alias("_class"), F.count(F.lit(1)).alias("_copies"))
    sketches = described.where("_fp is not null").groupBy("_fp").agg(F.min("_sketch").alias("_sketch"), F.min("_id").alias("_text_id"), F.min("_size").alias("_size"))
    classes = materialize(classes.join(sketches, "_fp"), "classes")

    # the nodes in which each set is searched: the first of its path that is small, else the last
    found, large = [], []
    for d in range(1, DEPTH + 1):
        # the steps down to this depth; a node's hash is that of its path, so a large node has large ones above it only
        path = [f"_p{k}" for k in range(max(1, d - 1), d + 1)]
        level = described.where("_fp is not null").select(set_hash, F.inline(F.array_distinct(F.arrays_zip(*path)))).where(f"_p{d} <> 0")
        if d > 1:
            level = level.join(large[-1].withColumnRenamed("_node", f"_p{d - 1}"), f"_p{d - 1}", "left_semi")
        nodes = level.select("_set_hash", F.col(f"_p{d}").alias("_node")).distinct()
        nodes = materialize(nodes, "nodes")
        sizes = materialize(nodes.groupBy("_node").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "node-sizes")
        found.append(nodes.join(sizes if d == DEPTH else sizes.where(f"_n <= {SMALL}"), "_node"))
        large.append(materialize(sizes.where(f"_n > {SMALL}").select("_node"), "large-nodes"))
    met = in_blocks(reduce(DataFrame.unionByName, found), F.col("_set_hash"), BLOCK)
    met = met.join(classes.select(set_hash, "_fp", "_sketch"), "_set_hash")
    loose = similarity - 4 * math.sqrt(similarity * (1 - similarity) / SKETCH)
    near = components(_grouped(met, "_node").mapInPandas(_alike(loose), "a binary, b binary"))

    # whole sets of the texts found, once for each block they meet
    near = near.select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    near = near.join(classes.select("_fp", "_text_id", "_copies", "_size"), "_fp")
    # a block is bounded in rows and in shingles
    weight = F.lit(1) + F.col("_size") / F.lit(2048)
    near = near.join(near.groupBy("_root").agg(F.sum(weight).alias("_n")), "_root").drop("_size")
    near = materialize(near, "near")
    candidate = may_contain(near.select(F.xxhash64("_text_id").alias("_key")), "_key")
    wanted = rows.where(candidate(F.xxhash64("_id"))).withColumnRenamed("_id", "_text_id").join(near, "_text_id")
    sets = wanted.select("_text", *near.columns).mapInPandas(_sets(size), "_fp binary, _root binary, _text_id long, _copies long, _n double, _set binary")
    met = _grouped(in_blocks(sets.drop("_text_id"), F.xxhash64("_fp"), 2 * BLOCK), "_root")
    linked = materialize(met.mapInPandas(_links(similarity), "_fp binary, _links long, _to binary"), "links")
    roots = components(linked.select(F.col("_fp").alias("a"), F.col("_to").alias("b")))
    links = linked.groupBy("_fp").agg(F.sum("_links").alias("_links"))
    joined = classes.drop("_sketch", "_text_id", "_size").join(links, "_fp", "left").join(
        roots.select(F.col("node").alias("_fp"), F.col("root").alias("_root")), "_fp", "left"
    ).withColumn("_root", F.coalesce("_root", "_fp"))
    joined = joined.join(joined.groupBy("_root").agg(F.min("_class").alias("_group")), "_root").select(
        "_fp", "_root", "_class", "_group", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links")
    )
    out = named.join(joined, "_fp", "left")
    real = lambda c: F.when(c != _NO_ID, c)
    return out.select(
        real(F.col("_id")).alias("_id"), "_hash", real(F.coalesce("_class", "_id")).alias("_class"),
        real(F.coalesce("_group", "_id")).alias("_group"), F.coalesce("_links", F.lit(0)).cast("long").alias("_links"), "_root",
    )
