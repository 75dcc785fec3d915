"""Periodic runs of words, found as maximal pairs of a document's suffixes.

A stretch with smallest period q repeats its own words q places on: both copies are one
string that starts at two places at distance q, and neither a word to the left nor one to
the right can be added to both. Such maximal pairs are read off the tree of LCP intervals,
bottom up: an interval with common prefix of n words gathers the starts below it, and a pair
from different children with different words to the left is maximal with exactly n words.
A run of ``least_copies`` periods (two or more) has n >= (least_copies - 1) × distance, and then
its two starts are neighbours among all starts of that string: one between them would make a
smaller period. So an interval's starts are kept in text order, each with its left word as its
class, and only neighbours are compared. Nothing is extended afterwards.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import pieces, small_batches

RUNS = "array<struct<start:long,length:long,period:long>>"


def repeated_suffixes(codes: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, in groups that share a prefix of more than ``least`` / 2 words within a document.

    Returns their starts and the number of each one's group. ``codes`` are the words of several documents,
    ``ends`` where each word's document ends. Prefixes are doubled; starts that share theirs with no other one
    leave, so that a text without repeats costs two or three sorts.
    """
    n, width, group = len(codes), 1, None
    key = ends * (int(codes.max(initial=0)) + 1) + codes
    live = np.argsort(key)
    before = np.zeros(n, np.int64)
    after = key[live]
    rank = np.zeros(n, np.int64)
    while len(live):
        new = np.ones(len(live), bool)
        new[1:] = (after[1:] != after[:-1]) | (before[1:] != before[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(live)))
        split = np.ones(len(live), bool)
        split[1:] = before[1:] != before[:-1]
        outer = np.flatnonzero(split)
        # a group is named by the number of starts in front of it, and a part of it likewise
        rank[live] = before + np.repeat(heads, sizes) - np.repeat(outer, np.diff(np.append(outer, len(live)))) + (width == 1)
        live = live[np.repeat(sizes > 1, sizes)]
        if group is None and 2 * width > least:
            kept, group = live, rank[live]
        ahead = live + width
        after = np.zeros(len(live), np.int64)
        inside = ahead < ends[live]
        after[inside] = rank[ahead[inside]]
        order = np.argsort(rank[live] * (n + 1) + after)
        live, after = live[order], after[order]
        before = rank[live]
        width *= 2
    if group is None:
        return live, live
    order = np.argsort(rank[kept])
    return kept[order], group[order]


def neighbour_prefixes(codes: list[int], ends: list[int], order: list[int], group: list[int]) -> list[int]:
    """Common words of each start in ``order`` with the one before it, 0 where a group begins."""
    before = {}
    for k in range(1, len(order)):
        if group[k] == group[k - 1]:
            before[order[k]] = order[k - 1]
    common, last, h = {}, -2, 0
    for i in sorted(before):  # in text order a common prefix loses at most one word a step
        h = max(0, h - 1) if last == i - 1 else 0
        j = before[i]
        most = ends[i] - max(i, j)
        while h < most and codes[i + h] == codes[j + h]:
            h += 1
        common[i], last = h, i
    return [common.get(i, 0) if k and group[k] == group[k - 1] else 0 for k, i in enumerate(order)]


def maximal_pairs(order: list[int], common: list[int], left: Sequence[int], least_copies: int, least_words: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, from the LCP intervals of suffixes in ``order``, bottom up.

    ``left`` is the word in front of each start, a number of its own where there is none.
    """
    least = min(max((least_copies - 1) * p, least_words - p) for p in range(1, max(2, least_words)))
    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, list[list[int]]]] = []  # (common words, starts of each child), outermost first

    def closed(words: int, children: list[list[int]]) -> list[int]:
        children.sort(key=len)
        starts = children.pop()
        whose: dict[int, int] = {}
        for k, child in enumerate(children):
            if len(child) * 8 > len(starts):
                starts = sorted(starts + child)
            else:
                for i in child:
                    starts.insert(bisect_left(starts, i), i)
            whose.update(dict.fromkeys(child, k))
        for i, child in whose.items():
            at = bisect_left(starts, i)
            if at and whose.get(starts[at - 1], -1) != child:
                pair(words, starts[at - 1], i)
            if at + 1 < len(starts) and starts[at + 1] not in whose:
                pair(words, i, starts[at + 1])
        return starts

    def pair(words: int, i: int, j: int) -> None:
        period = j - i
        if words >= (least_copies - 1) * period and words + period >= least_words and left[i] != left[j]:
            found.append((i, words + period, period))

    for k in range(1, len(order) + 1):
        words = common[k] if k < len(order) and common[k] >= least else 0
        done = [order[k - 1]]
        while open_ and open_[-1][0] > words:
            at, children = open_.pop()
            children.append(done)
            done = closed(at, children)
        if open_ and open_[-1][0] == words:
            open_[-1][1].append(done)
        elif words:
            open_.append((words, [done]))
    return found


def runs_of(codes: np.ndarray, starts: np.ndarray, least_copies: int = 4, least_words: int = 6) -> list[tuple[int, int, int]]:
    """Runs of several documents whose words are ``codes``; document d has those from ``starts[d]`` to ``starts[d + 1]``."""
    least = min(max((least_copies - 1) * p, least_words - p) for p in range(1, max(2, least_words)))
    ends = np.repeat(starts[1:], np.diff(starts))
    order, group = repeated_suffixes(codes, ends, least)
    if not len(order):
        return []
    left = np.empty(len(codes), np.int64)
    left[1:] = codes[:-1]
    begins = starts[:-1][np.diff(starts) > 0]
    left[begins] = -1 - begins
    order, group = order.tolist(), group.tolist()
    common = neighbour_prefixes(codes.tolist(), ends.tolist(), order, group)
    return sorted(maximal_pairs(order, common, left.tolist(), least_copies, least_words))


def _of_texts(texts: Sequence[str | None], least_copies: int, least_words: int) -> tuple[list, list[str]]:
    """Runs of each text by word number, and each text without the words that repeat those before them."""
    words, starts = [], np.zeros(len(texts) + 1, np.int64)
    for d, text in enumerate(texts):
        words += (text or "").encode().split()  # splits at space and the controls 9 to 13 only
        starts[d + 1] = len(words)
    codes = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64) if words else np.zeros(0, np.int64)
    runs = [[] for _ in texts]
    step = np.zeros(len(words) + 1, np.int64)
    found = runs_of(codes, starts, least_copies, least_words)
    for d, (start, length, period) in zip((np.searchsorted(starts, [f[0] for f in found], "right") - 1).tolist(), found):
        runs[d].append({"start": start - int(starts[d]), "length": length, "period": period})
        step[start + period] += 1
        step[start + length] -= 1
    kept = (np.cumsum(step[:-1]) == 0).tolist()
    out = []
    for d, own in enumerate(runs):
        lo, hi = int(starts[d]), int(starts[d + 1])
        left = words[lo:hi] if not own else [w for w, k in zip(words[lo:hi], kept[lo:hi]) if k]
        out.append(b" ".join(left).decode())
    return runs, out


def periodic_runs(docs: DataFrame, text: str, runs: str = "runs", collapsed: str = "collapsed", least_copies: int = 4, least_words: int = 6) -> DataFrame:
    """Add all runs of words of whole texts, and the texts with one period of each run.

    A run is a longest stretch of words with smallest period q (words q apart are equal)
    and at least ``least_words`` words and ``least_copies`` × q. ``runs`` holds its first
    word's number, its words and its period, by start, length and period. ``collapsed`` holds the
    words that are in no run behind its first period, joined by one space. Words are runs
    of anything but space and the ASCII controls 9 to 13. A NULL text is an empty one: no
    runs, and an empty collapsed text. Every row is one document by itself, so repeated rows give
    repeated results; a text of any length is one task's work, in memory in proportion to it. Other columns
    stay as they are; columns that are named ``runs`` or ``collapsed`` are replaced.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            frame = batch.to_frame("text")
            parts = [_of_texts(list(part["text"]), least_copies, least_words) for part in pieces(frame, "text")]
            yield pd.DataFrame({"runs": [r for p in parts for r in p[0]], "collapsed": [c for p in parts for c in p[1]]})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, f"runs {RUNS}, collapsed string")(F.col(text).cast("string"))
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in (runs.lower(), collapsed.lower())]
    rows = docs.select(F.struct("*").alias("_row"), found.alias("_found"))
    return rows.select(*kept, F.col("_found.runs").alias(runs), F.col("_found.collapsed").alias(collapsed))
