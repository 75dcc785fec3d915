"""Language model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the bytes
before it. A node's Krichevsky-Trofimov estimate and the product of its children are
weighted half and half, so a prediction mixes the estimates of all depths along its
context. Counts come from all learning texts; a text's score is the sum of its byte
predictions, one end symbol included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import LOWER, RangeHashes, by_group, joined_bytes, mix64, pieces, symbol_codes, word_ranges
from postmill.session import materialize

DEPTH = 4  # bytes of context; seven at most, so that a gram is a 64-bit number
HEAD = 1 << 19  # words, and grams, that tasks hold at most: the most frequent ones; the others are joined
PIECE = 1 << 18  # characters of text that a task works on at a time
END = 0xFF  # never a byte of UTF-8

_HALF = math.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Γ(x) for x > 0, by Stirling's series eight places up."""
    y = x + 8.0
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    up = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    return up - np.log(np.prod([x + k for k in range(8)], axis=0))


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


# --- grams and words of texts ---------------------------------------------------


def grams(texts: Sequence[str | None], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte behind its context, as one number, and the text it is of. A-Z are lower case."""
    gap = bytes([END]) * depth
    data, starts = joined_bytes(["", *texts], gap)
    data = LOWER[data].astype(np.uint64)
    n = len(data) - depth
    key = np.zeros(n, np.uint64)
    for k in range(depth + 1):
        key = (key << np.uint64(8)) | data[k : k + n]
    # entry t predicts byte t + depth: a text's bytes and the first byte of the gap after it
    sizes = np.diff(starts)[1:] - depth + 1
    first = starts[1:-1] - depth
    at = np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return key[at], np.repeat(np.arange(len(texts)), sizes)


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, A-Z in lower case, and the text each is of."""
    data, starts = joined_bytes(texts, b" ")
    begin, end = word_ranges(data)
    return RangeHashes(symbol_codes(41)[LOWER[data]]).of(begin, end), np.searchsorted(starts, begin, side="right") - 1


class Lookup:
    """Open-addressed table from 64-bit keys to numbers, for whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self._shift, self._last = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, np.nan)
        used = np.zeros(1 << bits, bool)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[~used[slot[left]]]
            taken, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self._keys[taken], self._values[taken], used[taken] = keys[put], values[put], True
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self._last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, NaN for a key that is not there."""
        slot = self._slots(keys)
        out = self._values[slot]
        left = np.flatnonzero((self._keys[slot] != keys) & ~np.isnan(out))
        while len(left):
            slot[left] = (slot[left] + 1) & self._last
            out[left] = self._values[slot[left]]
            left = left[(self._keys[slot[left]] != keys[left]) & ~np.isnan(out[left])]
        return out


# --- counting --------------------------------------------------------------------


def _counts(depth: int):
    """(kind, key, learned, all) of a task's texts; kind 0 is a gram, 1 a word, 2 a text."""

    def merged(held):
        key = np.concatenate([h[0] for h in held])
        own, back = np.unique(key, return_inverse=True)
        return own, *(np.bincount(back, weights=np.concatenate([h[i] for h in held]), minlength=len(own)).astype(np.int64) for i in (1, 2))

    def run(batches):
        held: dict[int, list] = {0: [], 1: []}
        texts = learned_texts = 0
        for batch in batches:
            for piece in pieces(batch, "_text", PIECE):
                learn = piece["_learn"].to_numpy(dtype=bool)
                texts, learned_texts = texts + len(learn), learned_texts + int(learn.sum())
                for kind, (key, owner) in ((0, grams(piece["_text"].tolist(), depth)), (1, words(piece["_text"].tolist()))):
                    all_, n = np.unique(key, return_counts=True)
                    seen, m = np.unique(key[learn[owner]], return_counts=True)
                    learned = np.zeros(len(all_), np.int64)
                    learned[np.searchsorted(all_, seen)] = m
                    held[kind].append((all_, learned, n))
                    if sum(len(h[0]) for h in held[kind]) > 1 << 20:
                        held[kind] = [merged(held[kind])]
        for kind, parts in held.items():
            if parts:
                key, learned, n = merged(parts)
                for at in range(0, len(key), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pd.DataFrame({"_kind": kind, "_key": key[part].view(np.int64), "_learned": learned[part], "_all": n[part]})
        yield pd.DataFrame({"_kind": [2], "_key": [0], "_learned": [learned_texts], "_all": [texts]})

    return run


# --- the trees ---------------------------------------------------------------------


def _decisions(byte: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(node of the byte's binary tree, bit) of its eight decisions."""
    byte = byte.astype(np.int64)
    return [((1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1) for j in range(8)]


def _tree(key: np.ndarray, learned: np.ndarray, depth: int, top: int) -> list[dict]:
    """Nodes at depths ``top`` … ``depth``: sorted ``id`` (context, node), counts, log estimate, log weighted probability."""
    seen = learned > 0
    key, n = key[seen], learned[seen].astype(float)
    context = (key >> np.uint64(8)).astype(np.int64)
    ids, zeros, ones = [], [], []
    for node, bit in _decisions(key & np.uint64(255)):
        ids.append(context << 8 | node)
        zeros.append(np.where(bit == 0, n, 0))
        ones.append(np.where(bit == 1, n, 0))
    ids, zeros, ones, below = np.concatenate(ids), np.concatenate(zeros), np.concatenate(ones), None
    levels = []
    for d in range(depth, top - 1, -1):
        own, back = np.unique(ids, return_inverse=True)
        zeros, ones = (np.bincount(back, weights=x, minlength=len(own)) for x in (zeros, ones))
        estimate = log_estimate(zeros, ones)
        weighted = estimate
        if below is not None:
            weighted = np.logaddexp(_HALF + estimate, _HALF + np.bincount(back, weights=below, minlength=len(own)))
        levels.append({"id": own, "zeros": zeros, "ones": ones, "estimate": estimate, "weighted": weighted})
        # the byte farthest away is the highest of a context
        ids, below = own & ((1 << (8 * d)) - 1), weighted
    return levels[::-1]


def _mixed(levels: list[dict], key: np.ndarray, depth: int, top: int):
    """For each of a gram's decisions: node, bit, and the probability of the bit by the mixture from depth ``top`` on."""
    context = (key >> np.uint64(8)).astype(np.int64)
    for node, bit in _decisions(key & np.uint64(255)):
        p = np.full(len(key), 0.5)
        for d in range(depth, top - 1, -1):
            level = levels[d - top]
            own = (context & ((1 << (8 * d)) - 1)) << 8 | node
            if not len(level["id"]):
                continue
            at = np.minimum(np.searchsorted(level["id"], own), len(level["id"]) - 1)
            there = level["id"][at] == own
            zeros, ones = level["zeros"][at], level["ones"][at]
            here = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)
            stop = 1.0 if d == depth else np.exp(_HALF + level["estimate"][at] - level["weighted"][at])
            p = np.where(there, stop * here + (1 - stop) * p, 0.5)
        yield node, bit, p


def _lower_nodes(depth: int):
    """Counts and weighted probabilities of the nodes at depth 2, folded to their last byte of context."""

    def run(batches):
        for frame, _ in by_group(batches, ["_near"], 200_000):
            level = _tree(frame["_key"].to_numpy().view(np.uint64), frame["_learned"].to_numpy(), depth, 2)[0]
            if len(level["id"]):
                yield pd.DataFrame({
                    "_node": level["id"] & 0xFFFF, "_zeros": level["zeros"], "_ones": level["ones"], "_below": level["weighted"],
                }).groupby("_node", as_index=False).sum()

    return run


def upper_tables(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each (last byte, node): probability of a 0 and of a 1 from depths 0 and 1, and the weight left to deeper ones.

    ``node`` is byte << 8 | node, so there are 65,536 rows at most, however much text there is.
    """
    estimate = log_estimate(zeros, ones)
    weighted = np.logaddexp(_HALF + estimate, _HALF + below)
    own = node & 255
    total = [np.bincount(own, weights=x, minlength=256) for x in (zeros, ones, weighted)]
    root = log_estimate(total[0], total[1])
    stop = np.where(total[0] + total[1] > 0, np.exp(_HALF + root - np.logaddexp(_HALF + root, _HALF + total[2])), 0.0)
    out = np.zeros((65536, 3))
    all_nodes = np.arange(65536) & 255
    for bit in (0, 1):
        at_root = (total[bit] + 0.5) / (total[0] + total[1] + 1)
        # below the root nothing is known yet: one half
        out[:, bit] = (stop * at_root + (1 - stop) * 0.5)[all_nodes]
    deeper = np.exp(_HALF + estimate - weighted)
    for bit, n in ((0, zeros), (1, ones)):
        here = (n + 0.5) / (zeros + ones + 1)
        out[node, bit] += (1 - stop[own]) * (deeper * here - 0.5)
    out[node, 2] = (1 - stop[own]) * (1 - deeper)
    return out


def _predictions(depth: int, upper: np.ndarray):
    """log10 probability of each gram's byte."""

    def run(batches):
        for frame, _ in by_group(batches, ["_near"], 200_000):
            key = frame["_key"].to_numpy().view(np.uint64)
            levels = _tree(key, frame["_learned"].to_numpy(), depth, 2)
            last = ((key >> np.uint64(8)) & np.uint64(255)).astype(np.int64) << 8
            total = np.zeros(len(key))
            for node, bit, p in _mixed(levels, key, depth, 2):
                table = upper[last | node]
                total += np.log10(np.where(bit == 1, table[:, 1], table[:, 0]) + table[:, 2] * p)
            yield pd.DataFrame({"_key": frame["_key"].to_numpy(), "_value": total, "_all": frame["_all"].to_numpy()})

    return run


# --- scoring ---------------------------------------------------------------------


def _head(rows: DataFrame, most: int) -> Lookup:
    """The most frequent keys, ``most`` at most, and their values.

    Keys are taken down to a frequency; only sums over frequency classes and the keys
    themselves come to the driver.
    """
    frequency = F.floor(F.log2("_all") * 8)
    classes = rows.groupBy(frequency.alias("class")).count().orderBy(F.desc("class")).collect()
    least, held = math.inf, 0
    for r in classes:
        held += r["count"]
        if held > most:
            break
        least = r["class"]
    top = rows.where(frequency >= least).select("_key", "_value").toPandas()
    return Lookup(top["_key"].to_numpy(dtype=np.int64).view(np.uint64), top["_value"].to_numpy(dtype=float))


_SUMS = "_score double, _bytes long, _words long, _known long, _base double, _grams array<long>, _rare array<long>"


def _sums(texts: list, depth: int, gram_values: Lookup, word_counts: Lookup, total: float) -> pd.DataFrame:
    """Sums over what the tables hold, and the words and grams that they don't."""
    n, out = len(texts), {}
    key, owner = grams(texts, depth)
    value = gram_values.get(key)
    missing = np.isnan(value)
    out["_score"] = np.bincount(owner, weights=np.where(missing, 0, value), minlength=n)
    out["_bytes"] = np.bincount(owner, minlength=n) - 1
    rest = [(key[missing], owner[missing])]
    key, owner = words(texts)
    value = word_counts.get(key)
    missing = np.isnan(value)
    out["_words"] = np.bincount(owner, minlength=n)
    known = np.where(missing, 0, value)
    out["_known"] = np.bincount(owner, weights=known > 0, minlength=n).astype(np.int64)
    out["_base"] = np.bincount(owner, weights=np.where(missing, 0, np.log10((known + 1) / total)), minlength=n)
    rest.append((key[missing], owner[missing]))
    for name, (key, owner) in zip(("_grams", "_rare"), rest):
        out[name] = np.split(key.view(np.int64), np.searchsorted(owner, np.arange(1, n)))
    return pd.DataFrame(out)


def score(docs: DataFrame, learn: Column, keep: Sequence[str], text: str = "text", depth: int = DEPTH, head: int = HEAD) -> DataFrame:
    """``keep`` and ``n_bytes``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    Texts with ``learn`` are learned from; NULL counts as false and a NULL text as
    empty. ``score`` is the log10 probability of the lower-case text and its end;
    ``-score × log2(10) / n_bytes`` is the code length per byte. ``base_score`` is the
    unigram baseline with add-one smoothing over words and one end. With nothing to
    learn from, each decision has probability one half and each token counts 1 of 1.

    Tasks hold tables of at most ``head`` frequent words, and as many grams. All others are
    joined by key, so results do not depend on ``head``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(learn, F.lit(False)).alias("_learn"), F.col(text).alias("_text"))
    counts = rows.mapInPandas(_counts(depth), "_kind int, _key long, _learned long, _all long")
    counts = materialize(counts.groupBy("_kind", "_key").agg(F.sum("_learned").alias("_learned"), F.sum("_all").alias("_all")), "counts")
    totals = {r["_kind"]: r for r in counts.groupBy("_kind").agg(
        F.sum("_learned").alias("tokens"), F.count(F.when(F.col("_learned") > 0, 1)).alias("kinds")
    ).collect()}
    ends = totals[2]["tokens"] if 2 in totals else 0
    train = (totals[1]["tokens"] if 1 in totals else 0) + ends
    total = float(train + 1 * ((totals[1]["kinds"] if 1 in totals else 0) + (1 if ends else 0) + 1))

    gram_counts = counts.where("_kind = 0").withColumn("_near", F.shiftright("_key", 8).bitwiseAND(0xFFFF))
    near = gram_counts.repartition("_near").sortWithinPartitions("_near")
    folded = near.mapInPandas(_lower_nodes(depth), "_node long, _zeros double, _ones double, _below double")
    upper = folded.groupBy("_node").agg(F.sum("_zeros"), F.sum("_ones"), F.sum("_below")).orderBy("_node").toPandas()
    table = upper_tables(*(upper[c].to_numpy(dtype=t) for c, t in zip(upper.columns, (np.int64, float, float, float))))
    model = materialize(near.mapInPandas(_predictions(depth, table), "_key long, _value double, _all long"), "model")
    word_counts = counts.where("_kind = 1").select("_key", F.col("_learned").cast("double").alias("_value"), "_all")

    shared = spark.sparkContext.broadcast((_head(model, head), _head(word_counts, head)))

    @F.pandas_udf(_SUMS)
    def sums(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            parts = [_sums(p["_text"].tolist(), depth, *shared.value, total) for p in pieces(batch.to_frame("_text"), "_text", PIECE)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[f.split()[0] for f in _SUMS.split(", ")])

    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(text).alias("_text"))
    first = materialize(numbered.withColumn("_sums", sums("_text")).select("_row", *keep, "_sums.*"), "scores")
    rare = first.select("_row", F.explode("_rare").alias("_key")).groupBy("_row", "_key").agg(F.count(F.lit(1)).alias("_n"))
    seen = F.coalesce("_value", F.lit(0.0))
    rare = rare.join(word_counts.select("_key", "_value"), "_key", "left").groupBy("_row").agg(
        F.sum(F.when(seen > 0, F.col("_n")).otherwise(0)).alias("_rare_known"),
        F.sum(F.log10((seen + 1) / F.lit(total)) * F.col("_n")).alias("_rare_base"),
    )
    other = first.select("_row", F.explode("_grams").alias("_key")).groupBy("_row", "_key").agg(F.count(F.lit(1)).alias("_n"))
    other = other.join(model.select("_key", "_value"), "_key").groupBy("_row").agg(F.sum(F.col("_value") * F.col("_n")).alias("_other"))
    out = first.drop("_grams", "_rare").join(rare, "_row", "left").join(other, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        *keep, F.col("_bytes").alias("n_bytes"), (F.col("_words") + 1).alias("n_tokens"),
        (F.col("_known") + zero("_rare_known") + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("_base") + zero("_rare_base") + F.lit(math.log10((ends + 1) / total))).alias("base_score"),
        (F.col("_score") + zero("_other")).alias("score"),
    )
