"""Benchmark decontamination with spaced seeds.

A seed is a window of words under a fixed mask; words at zeros of the mask do not
count. Texts and benchmark items that share a seed are aligned there, and the whole
overlap of item and text is checked word by word, with substitutions allowed.

No overlap that the rule admits is without a seed. The masks miss no way to substitute
3 of 12, 4 of 16 or 5 of 20 words, which a test enumerates. A longer overlap, cut to a
multiple of four words, is a row of such stretches, and one of them has no more
substitutions than its own share, as all together have no more than theirs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import LOWER, RangeHashes, joined_bytes, mix64, pieces, small_batches, symbol_codes, word_ranges

MASKS = (
    "1101111", "111010011", "1110001011", "10111011", "111001000011", "110001111", "10110111", "110100010101", "11010001101",
)
SPAN = 12  # least words of an overlap with an item that has as many
EQUAL = 0.75  # least share of equal words in an overlap
PENALTY = 2  # an overlap ends where substitutions cost more than the words beyond them win
BLOCK_BYTES = 8 << 20

# words here are runs of ASCII letters and digits and of anything beyond ASCII
_GAP = np.ones(256, np.int8)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 0

_DRAWN = symbol_codes(31, 64) | np.uint64(1)


def tokens(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words in lower case, and where each text's words start (one more for the end)."""
    data, starts = joined_bytes(texts, b" ")
    data = LOWER[data]
    begin, end = word_ranges(data, _GAP)
    return RangeHashes(symbol_codes(17)[data]).of(begin, end), np.searchsorted(begin, starts)


def masks_of(words: int) -> tuple[str, ...]:
    """Masks for items of so many words: MASKS from SPAN words on.

    Shorter items are seeds as a whole. Where the rule admits n substitutions the words are
    cut into n + 3 parts, and each mask leaves out n of them.
    """
    if words >= SPAN:
        return MASKS
    allowed = int(words * (1 - EQUAL))
    if not allowed:
        return ("1" * words,)
    parts = np.array_split(np.arange(words), allowed + 3)
    left_out = [np.concatenate(some).tolist() for some in combinations(parts, allowed)]
    return tuple("".join("0" if k in out else "1" for k in range(words)) for out in left_out)


def seed_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask's words at each place where a whole window fits."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, int(mask, 2) * 64 + len(mask), np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            total += codes[k : k + n] * _DRAWN[k]
    return mix64(total)


@dataclass(frozen=True)
class Index:
    """Seeds of benchmark items, sorted by hash."""

    codes: np.ndarray
    starts: np.ndarray
    masks: tuple[str, ...]
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    present: np.ndarray  # by the first 20 bits of a hash


def build_index(items: Sequence[str | None]) -> Index:
    """Seeds of all items, each under the masks for its number of words."""
    codes, starts = tokens(items)
    sizes = np.minimum(np.diff(starts), SPAN)
    sizes_of = {}
    for n in np.unique(sizes[sizes > 0]).tolist() or [SPAN]:
        for mask in masks_of(n):
            sizes_of.setdefault(mask, []).append(n)
    hashes, owner, place = [], [], []
    for mask, own in sizes_of.items():
        h = seed_hashes(codes, mask)
        at = np.arange(len(h))
        item = np.searchsorted(starts, at, side="right") - 1
        inside = (at + len(mask) <= starts[item + 1]) & np.isin(sizes[item], own)
        hashes.append(h[inside])
        owner.append(item[inside])
        place.append((at - starts[item])[inside])
    hashes, owner, place = map(np.concatenate, (hashes, owner, place))
    order = np.argsort(hashes, kind="stable")
    present = np.zeros(1 << 20, bool)
    present[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return Index(codes, starts, tuple(sizes_of), hashes[order], owner[order], place[order], present)


def _best_run(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the run with the highest sum of 1 per equal word and -PENALTY per other."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    floor = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - floor))
    start = int(np.argmin(sums[: end + 1]))
    return start, end


def _runs(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of disjoint runs of ``least`` words or more with a share of EQUAL; any other such run meets one of them.

    The best run of a stretch is taken if it qualifies, the longest qualifying one otherwise; what lies
    on both sides of it is searched in the same way.
    """
    found, todo = [], [(0, len(equal))]
    while todo:
        begin, stop = todo.pop()
        if stop - begin < least:
            continue
        part = equal[begin:stop]
        start, end = _best_run(part)
        if end - start < least or part[start:end].sum() < EQUAL * (end - start):
            # a run has the share when the sum of 1 - EQUAL per equal word and -EQUAL per other is not below 0
            sums = np.concatenate([[0.0], np.cumsum(np.where(part, 1 - EQUAL, -EQUAL))])
            beyond = np.maximum.accumulate(sums[::-1])  # highest sum from each place on, last place first
            reach = len(part) - np.searchsorted(beyond, sums, side="left")
            size = reach - np.arange(len(sums))
            start = int(np.argmax(size))
            if size[start] < least:
                continue
            end = int(reach[start])
            while end - start > least and not part[end - 1]:
                end -= 1
            while end - start > least and not part[start]:
                start += 1
        found.append((begin + start, begin + end))
        todo += [(begin, begin + start), (begin + end, stop)]
    return sorted(found)


def overlaps(texts: Sequence[str | None], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, first word in text, first word in item, words, equal words) of every verified overlap.

    An overlap has at least SPAN words, or is a whole shorter item, and a share
    of EQUAL of them agree. One alignment of a text and an item can hold several.
    """
    codes, starts = tokens(texts)
    hits = []
    for mask in index.masks:
        h = seed_hashes(codes, mask)
        at = np.flatnonzero(index.present[(h >> np.uint64(44)).astype(np.int64)])
        lo = np.searchsorted(index.hashes, h[at], side="left")
        hi = np.searchsorted(index.hashes, h[at], side="right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        text = np.searchsorted(starts, at, side="right") - 1
        whole = at + len(mask) <= starts[text + 1]
        at, lo, n, text = at[whole], lo[whole], n[whole], text[whole]
        seed = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shift = np.repeat(at - starts[text], n) - index.places[seed]
        hits.append(np.column_stack([np.repeat(text, n), index.items[seed], shift]))
    out = []
    for text, item, shift in np.unique(np.concatenate(hits), axis=0).tolist():
        own = codes[starts[text] : starts[text + 1]]
        other = index.codes[index.starts[item] : index.starts[item + 1]]
        first = max(0, -shift)
        last = min(len(other), len(own) - shift)
        equal = own[first + shift : last + shift] == other[first:last]
        for start, end in _runs(equal, min(SPAN, len(other))):
            out.append((text, item, first + start + shift, first + start, end - start, int(equal[start:end].sum())))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    """(ids, index) of one block of items after the other, each of about BLOCK_BYTES."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(item_id).alias("_item"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    total = items.agg(F.sum(F.octet_length("_text"))).head()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(n)) == block) if n > 1 else items
        rows = part.orderBy("_item", "_text").collect()
        if rows:
            yield [r[0] for r in rows], build_index([r[1] for r in rows])


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``item_id``, ``doc_word``, ``item_word``, ``words``, ``equal``): verified overlaps of texts and items.

    NULL and empty texts overlap with nothing; equal items and repeated rows are each
    reported. The benchmark is taken in blocks of bounded size, each against all texts,
    so no side has to fit anywhere as a whole.
    """
    places = ("doc_word", "item_word", "words", "equal")
    hit = T.StructType([T.StructField("item_id", benchmark.schema[item_id].dataType), *[T.StructField(n, T.LongType()) for n in places]])

    def search(ids, index):
        @F.pandas_udf(T.ArrayType(hit))
        def hits(texts: pd.Series) -> pd.Series:
            out = [[] for _ in range(len(texts))]
            at = 0
            for piece in pieces(texts.to_frame("_text"), "_text", 1 << 18):
                for row, item, *found in overlaps(piece["_text"].tolist(), index):
                    out[at + row].append({"item_id": ids[item], **dict(zip(places, found))})
                at += len(piece)
            return pd.Series(out)

        return docs.select(F.col(doc_id).alias("doc_id"), F.inline(hits(F.col(text))))

    found = [search(ids, index) for ids, index in _blocks(benchmark, item_id, text)]
    if found:
        return reduce(DataFrame.unionAll, found)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *hit.fields])
    return docs.sparkSession.createDataFrame([], schema)


def leaked(benchmark: DataFrame, column: Column, item_id: str = "item_id", text: str = "text") -> Column:
    """Whether a text overlaps with any benchmark item; false for NULL."""

    def test(index):
        @F.pandas_udf("boolean")
        def hit(texts: pd.Series) -> pd.Series:
            out = np.zeros(len(texts), bool)
            at = 0
            for piece in pieces(texts.to_frame("_text"), "_text", 1 << 18):
                for found in overlaps(piece["_text"].tolist(), index):
                    out[at + found[0]] = True
                at += len(piece)
            return pd.Series(out)

        return hit(column)

    return reduce(lambda a, b: a | b, [test(index) for _, index in _blocks(benchmark, item_id, text)], F.lit(False))
