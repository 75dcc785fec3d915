"""Document quality by Bradley-Terry ranking.

Pairs of a good and a bad document are preferences. A linear score of text features
is fitted so that sigmoid(score difference) is the probability of the preference:
logistic loss on feature differences. A quantile of the scores, at the share of bad
documents among the labelled ones, is the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import RangeHashes, joined_bytes, mix64, pieces, small_batches, symbol_codes, word_ranges

# byte classes: 0 other punctuation, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 beyond ASCII, then single marks
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, 0x09]] = 4
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 5
_CLASS[128:] = 6
for _i, _mark in enumerate(".,!?|*$%&#@<>{}[]()/\\_-=+~^\"':;"):
    _CLASS[ord(_mark)] = 7 + _i
CLASSES = int(_CLASS.max()) + 1


def features(texts: Sequence[str | None]) -> np.ndarray:
    """One row per text: shares of byte classes, shares of kinds of words, and sizes."""
    data, starts = joined_bytes(texts, b"\n")
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(starts))
    kind = _CLASS[data]
    by_class = np.bincount(owner * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    size = np.maximum(by_class.sum(1) - 1, 1)
    by_class[:, 5] -= 1
    begin, end = word_ranges(data)
    word_owner = owner[begin]
    words = np.bincount(word_owner, minlength=n).astype(float)
    each = np.maximum(words, 1)
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    lower = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 6))])
    marks = np.concatenate([[0], np.cumsum((kind == 0) | (kind >= 9))])
    within = lambda sums: sums[end] - sums[begin]
    share = lambda mask: np.bincount(word_owner, weights=mask, minlength=n) / each
    codes = RangeHashes(symbol_codes(3)[data]).of(begin, end)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (word_owner[1:] == word_owner[:-1])
    # a word's first occurrence in each document
    _, first = np.unique(codes ^ mix64(word_owner.astype(np.uint64) + np.uint64(1)), return_index=True)
    kinds = np.bincount(word_owner[first], minlength=n)
    shares = np.column_stack([
        by_class / size[:, None], share(same), share((within(upper) > 1) & (within(lower) == 0)), share(within(marks) > 0),
        share(within(marks) > 1), share(within(marks) == end - begin), share(end - begin > 20), share(end - begin < 3), kinds / each,
    ])
    sizes = np.column_stack([np.log1p(words), np.log1p(size), size / each / 10])
    return np.column_stack([shares, np.sqrt(shares), shares > 0.03, sizes, np.ones(n) * (words == 0)])


@dataclass(frozen=True)
class Ranking:
    """Feature scaling, Bradley-Terry weights and the score that counts as good."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray, at_threshold: float) -> np.ndarray:
        """Between 0 and 1, ``at_threshold`` at the threshold."""
        margin = ((x - self.centre) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(margin + np.log(at_threshold / (1 - at_threshold)), -500, 500)))


def fit_ranking(x: np.ndarray, good: np.ndarray, pairs: int = 100_000, ridge: float = 1e-3, rounds: int = 30) -> Ranking:
    """Fit by Newton steps on ``pairs`` seeded preferences, each of a good over a bad row.

    Without rows of both kinds all weights are zero, so that every text scores the
    threshold itself and nothing is rejected.
    """
    width = x.shape[1]
    centre, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(width), np.ones(width))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - centre) / scale
    ups, downs = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(ups) or not len(downs):
        return Ranking(centre, scale, np.zeros(width), 0.0)
    dice = np.random.default_rng(7)
    # every row takes part about equally often
    a = np.resize(dice.permutation(ups), pairs)
    b = dice.permutation(np.resize(downs, pairs))
    w = np.zeros(width)
    for _ in range(rounds):
        slope, curve = -ridge * w, ridge * np.eye(width)
        for at in range(0, pairs, 4096):  # differences exist for a few pairs at a time
            difference = z[a[at : at + 4096]] - z[b[at : at + 4096]]
            p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
            slope = slope + difference.T @ (1 - p) / pairs
            curve = curve + (difference * (p * (1 - p))[:, None]).T @ difference / pairs
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    scores = z @ w
    threshold = float(np.quantile(scores, len(downs) / (len(ups) + len(downs))))
    # the middle of the gap that the quantile falls into
    below, above = scores[scores < threshold], scores[scores >= threshold]
    if len(below):
        threshold = float(below.max() + above.min()) / 2
    return Ranking(centre, scale, w, threshold)


def _features(batches):
    for batch in batches:
        for piece in pieces(batch, "_text", 1 << 18):
            yield pd.DataFrame({"_good": piece["_good"].to_numpy(), "_x": list(features(piece["_text"].tolist()))})


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", most_rows: int = 20_000) -> Ranking:
    """Fit on at most ``most_rows`` labelled documents, those least by a hash of their id.

    ``learnable`` says, by the id, which labels may be seen. NULL labels and ids and
    labels without a document teach nothing; an id with several labels or texts counts
    once for each.
    """
    small_batches(docs.sparkSession)
    seen = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & learnable).select(
        F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_good")
    )
    seen = seen.orderBy(F.xxhash64("_id"), "_id", "_good").limit(most_rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    found = texts.join(F.broadcast(seen), "_id").select("_good", "_text").mapInPandas(_features, "_good int, _x array<double>")
    # repeated rows of an id could pass the bound again
    rows = found.limit(2 * most_rows).toPandas()
    width = features([""]).shape[1]
    x = np.vstack(rows["_x"]) if len(rows) else np.zeros((0, width))
    order = np.lexsort(np.column_stack([rows["_good"], x]).T) if len(rows) else []
    return fit_ranking(x[order], rows["_good"].to_numpy()[order])


def scored(ranking: Ranking, text: Column, at_threshold: float = 0.7) -> Column:
    """Score of a text between 0 and 1, ``at_threshold`` at the threshold; a NULL text scores as an empty one."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [ranking.score(features(piece["_text"].tolist()), at_threshold) for piece in pieces(texts.to_frame("_text"), "_text", 1 << 18)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(text)
