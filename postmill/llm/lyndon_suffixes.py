"""Repeated byte strings by suffix arrays, built by linear grouping.

A suffix array sorts the suffixes of all texts; a string that starts at two places is
a common prefix of two neighbours. Suffixes are dealt to tasks by the least hash of the
32-byte strings in their first ``length`` bytes, so equal strings meet. Suffixes that
share such an anchor are neighbours in a text and form a run; the bytes of a run are
its context. Equal contexts are folded to one with a count. Runs whose context is not
repeated as a whole are cut, at fixed distances from the anchor, into pieces of STEP
suffixes. All strings of a piece share its core, so only pieces with equal cores can
repeat each other. Equal pieces are folded again; for the others a suffix array over
pieces, with the core as one symbol, finds the strings that recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import RangeHashes, by_group, pieces, symbol_codes
from postmill.session import forget, materialize

LENGTH = 200
ANCHOR = 32
STEP = 16
MOST_PIECES = 20_000  # of a core in one suffix array; more are met by the strings themselves


# --- linear grouping ---------------------------------------------------------------


def suffix_array(text: bytes | Sequence[int]) -> list[int]:
    """Suffixes of a sequence of numbers in order, in linear time.

    Phase 1 groups suffixes by their Lyndon prefixes: groups are taken in descending
    order; for each suffix in a group the last earlier suffix of a lower group is its
    previous smaller one; those that are previous smaller ones of the group move to a
    new group right behind their own, the further the more often they are. Phase 2
    emits the groups in ascending order: the suffix before a placed one, and then its
    previous smaller ones, take the first free places of their groups. No group is
    sorted and nothing is renamed recursively.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group = [0] * n, [0] * n
    start = 0
    for at, i in enumerate(order):
        if at and text[order[at - 1]] != text[i]:
            start = at
        place[i], group[i] = at, start
    end_of = {}
    for at, i in enumerate(order):
        end_of[group[i]] = at
    smaller = [-1] * n
    end = n - 1
    while end >= 0:
        first = group[order[end]]
        times: dict[int, int] = {}
        for i in sorted(order[first : end + 1]) if end > first else order[first : end + 1]:
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if len(times) == 1:
            moves = [(0, 0, list(times))]
        else:
            by_times: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                by_times.setdefault((group[j], -k), []).append(j)
            moves = [(*key, by_times[key]) for key in sorted(by_times)]
        for _, _, moved in moves:
            # to the end of what is left of their group; the more often, the further back
            old = group[moved[0]]
            last = end_of[old]
            new = last - len(moved) + 1
            if new > old:
                at = last
                for j in moved:
                    other = order[at]
                    order[place[j]], order[at] = other, j
                    place[other], place[j] = place[j], at
                    at -= 1
                end_of[old] = new - 1
                end_of[new] = last
                for j in moved:
                    group[j] = new
        end = first - 1
    free = {}
    out = [-1] * n
    placed = [False] * n
    # the empty suffix comes first, and the last suffix stands before it
    at = -1
    while at < n:
        j = (n if at < 0 else out[at]) - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            k = free.get(g, g)
            out[k] = j
            free[g] = k + 1
            placed[j] = True
            j = smaller[j]
        at += 1
    return out


# --- runs of suffixes that share an anchor ------------------------------------------


def anchored_runs(texts: Sequence[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, first suffix, suffixes, anchor, context, whether the anchor recurs) of all runs of suffixes with ``length`` or more bytes.

    A suffix's anchor is the least hash of the ANCHOR-byte strings in its first
    ``length`` bytes. A run is cut after as many suffixes as an anchor spans, so that
    monotonous texts have bounded contexts too.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    span = length - ANCHOR + 1
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    hashes = RangeHashes(symbol_codes(53)[data])
    strings = hashes.fixed(ANCHOR)
    least = _sliding(np.minimum, strings, span)
    edge = np.zeros(span - 1, np.uint64)
    anchors = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), span) == strings)
    whole = np.zeros(n + 1, bool)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= length:
            whole[a : b - length + 1] = True
    new = whole[:n].copy()
    new[1:] &= (least[1:] != least[:-1]) | ~whole[: n - 1]
    cut = starts[:-1][(sizes >= length)]
    new[cut] = True
    first = np.flatnonzero(new)
    stop = np.flatnonzero(~whole)
    end = np.minimum(np.append(first[1:], n), stop[np.searchsorted(stop, first)]) if len(first) else first
    parts = -(-(end - first) // span)
    run = np.repeat(np.arange(len(first)), parts)
    number = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[run] + number * span
    many = np.minimum(end[run] - begin, span)
    text = np.searchsorted(starts, begin, side="right") - 1
    # empty texts share their start with the next
    context = hashes.of(begin, begin + many + length - 1)
    # whether the anchor occurs again in the run, as it does where a string repeats inside its context
    value, rank = np.unique(strings[anchors], return_inverse=True)
    place = np.sort(rank * len(data) + anchors)
    own = np.searchsorted(value, least[begin]) * len(data)
    inner = np.searchsorted(place, own + begin + many + span - 1) - np.searchsorted(place, own + begin) > 1
    return text, begin - starts[text], many, least[begin], context, inner


def _sliding(best, values: np.ndarray, span: int) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``span`` neighbouring values."""
    width = 1
    while 2 * width <= span:
        values = best(values[: len(values) - width], values[width:])
        width *= 2
    return best(values[: len(values) - (span - width)], values[span - width :]) if width < span else values


def _as_bytes(column) -> list[bytes]:
    return [(t or "").encode("utf-8") for t in column]


def _runs(length: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "_text", 1 << 21):
                text, at, many, anchor, context, inner = anchored_runs(_as_bytes(piece["_text"]), length)
                yield pd.DataFrame({
                    "_t": piece["_t"].to_numpy()[text], "_at": at.astype(np.int32), "_many": many.astype(np.int32),
                    "_anchor": anchor.view(np.int64), "_context": context.view(np.int64), "_inner": inner,
                })

    return run


def core_pieces(contexts: Sequence[bytes], anchors: np.ndarray, length: int = LENGTH):
    """(context, first suffix, core, left, right) of all pieces of the contexts' runs.

    A string's distance to the first anchor in it depends on the string alone, and so
    does the piece it falls into: the core, which is in all strings of the piece, and up
    to STEP - 1 bytes on either side of it.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    hashes = RangeHashes(symbol_codes(53)[data])
    strings = hashes.fixed(ANCHOR)
    anchor_at = np.flatnonzero(strings == np.repeat(anchors, sizes)[: len(strings)])
    many = sizes - length + 1
    at = np.repeat(starts[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    owner = np.repeat(np.arange(len(contexts)), many)
    anchor = anchor_at[np.searchsorted(anchor_at, at)]
    block = (anchor - at) // STEP
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    core, end = anchor[first] - block[first] * STEP, anchor[first] - block[first] * STEP - STEP + 1 + length
    code = RangeHashes(symbol_codes(59)[data]).of(core, end)
    whole = data.tobytes()
    left = [whole[a:b] for a, b in zip(at[first].tolist(), core.tolist())]
    right = [whole[a:b] for a, b in zip(end.tolist(), (at[last] + length).tolist())]
    return owner[first], at[first] - starts[owner[first]], code, left, right


def _pieces(length: int):
    """Pieces of the runs that are listed with a text."""

    def run(batches):
        for batch in batches:
            for rows in pieces(batch, "_text", 1 << 21):
                listed = [(t, text, r) for t, text, runs in zip(rows["_t"], _as_bytes(rows["_text"]), rows["_runs"]) for r in runs]
                contexts = [text[r["_at"] : r["_at"] + r["_many"] + length - 1] for _, text, r in listed]
                anchors = np.array([r["_anchor"] for _, _, r in listed], np.int64)
                owner, at, core, left, right = core_pieces(contexts, anchors.view(np.uint64), length)
                t, begin, n = (np.array(x, np.int64) for x in zip(*[(t, r["_at"], r["_n"]) for t, _, r in listed]))
                yield pd.DataFrame({
                    "_anchor": anchors[owner], "_core": core.view(np.int64), "_left": left, "_right": right, "_t": t[owner],
                    "_at": (begin[owner] + at).astype(np.int32), "_n": n[owner],
                })

    return run


def repeated_starts(sides: Sequence[tuple[bytes, bytes]], counts: Sequence[int], step: int = STEP) -> list[tuple[int, int, int]]:
    """(piece, first, last) of the starts of strings that also start elsewhere, by a suffix array of all pieces of a core.

    With the core as one symbol a string is ``step`` symbols long. Pieces that occur more
    than once are repeated as a whole already and are not reported; they only serve as
    neighbours.
    """
    text, begin, starts = [], [], []
    for left, right in sides:
        begin.append(len(text))
        text += [b + 2 for b in left] + [1] + [b + 2 for b in right]
        starts.append(len(left) + len(right) + 2 - step)
        text.append(0)
    begin = np.array(begin)
    order = np.array(suffix_array(text))
    owner = np.searchsorted(begin, order, side="right") - 1
    whole = order - begin[owner] < np.array(starts)[owner]
    order, owner = order[whole], owner[whole]
    # suffixes with a common prefix of that length are neighbours
    strings = np.array(text + [0] * step, np.int16)[order[:, None] + np.arange(step)]
    same = (strings[1:] == strings[:-1]).all(1)
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.sort(order[twice & (np.array(counts)[owner] == 1)])
    if not len(hit):
        return []
    owner = np.searchsorted(begin, hit, side="right") - 1
    edge = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner) != 0)) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(hit)]]) - 1
    return [(int(owner[a]), int(hit[a] - begin[owner[a]]), int(hit[b] - begin[owner[b]])) for a, b in zip(lo, hi)]


def _by_suffixes(length: int):
    def run(batches):
        for frame, starts in by_group(batches, ["_anchor", "_core"], 5000):
            out = []
            t, at, n, left, right = (frame[c].tolist() for c in ("_t", "_at", "_n", "_left", "_right"))
            sides = list(zip(left, right))
            for lo, hi in zip(starts, np.append(starts[1:], len(frame))):
                for c, first, last in repeated_starts(sides[lo:hi], n[lo:hi]):
                    out.append((t[lo + c], at[lo + c] + first, at[lo + c] + last + length))
            if out:
                yield pd.DataFrame(out, columns=["_t", "_from", "_to"])

    return run


def _strings(batches):
    """The strings of pieces, without the core, and where each starts."""
    for batch in batches:
        out = []
        for anchor, core, left, right, t, at, n in zip(*(batch[c] for c in ("_anchor", "_core", "_left", "_right", "_t", "_at", "_n"))):
            for k in range(len(left) + len(right) + 2 - STEP):
                out.append((anchor, core, left[k:] + b"|" + right[: STEP - 1 - len(left) + k], t, at + k, n == 1))
        yield pd.DataFrame(out, columns=["_anchor", "_core", "_string", "_t", "_start", "_single"])


# --- the operator ----------------------------------------------------------------------


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, most_pieces: int = MOST_PIECES) -> DataFrame:
    """(``_t``, ``_from``, ``_to``): byte ranges covered by strings of ``length`` bytes that also start elsewhere.

    ``_t`` is a 64-bit hash of the text, ``xxhash64``. Ranges may overlap; each is inside
    one text. Equal rows repeat each other. Runs and cores are known by two 64-bit hashes.
    Cores with more than ``most_pieces`` different pieces are not sorted in one task: their
    strings are grouped as they are, which gives the same ranges for any number of them.
    """
    rows = docs.select(F.xxhash64(F.col(text).cast("string")).alias("_t"), F.col(text).cast("string").alias("_text"))
    rows = rows.where(F.octet_length("_text") >= length)
    runs = materialize(rows.mapInPandas(_runs(length), "_t long, _at int, _many int, _anchor long, _context long, _inner boolean"), "runs")
    often = runs.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n"), F.max("_inner").alias("_inner")).where("_n > 1 or _inner").select("_anchor")
    live = materialize(runs.join(often, "_anchor", "left_semi"), "live-runs")
    forget(runs)
    classes = materialize(live.groupBy("_anchor", "_context").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("_t", "_at", "_many")).alias("_run"), F.max("_inner").alias("_inner"),
    ), "contexts")
    many = classes.where("_n > 1").select("_anchor", "_context")
    spans = materialize(live.join(many, ["_anchor", "_context"], "left_semi").select(
        "_t", F.col("_at").alias("_from"), (F.col("_at") + F.col("_many") + length - 1).alias("_to")
    ).distinct(), "whole-contexts")
    forget(live)

    mixed = classes.groupBy("_anchor").agg(
        F.count(F.lit(1)).alias("_size"), F.count(F.when(F.col("_n") == 1, 1)).alias("_single"), F.max("_inner").alias("_inner")
    ).where("(_size > 1 or _inner) and _single > 0")
    listed = classes.join(mixed.select("_anchor"), "_anchor", "left_semi").groupBy(F.col("_run._t").alias("_t")).agg(F.collect_list(
        F.struct(F.col("_run._at").alias("_at"), F.col("_run._many").alias("_many"), "_anchor", "_n")
    ).alias("_runs"))
    cut = rows.join(listed, "_t").mapInPandas(
        _pieces(length), "_anchor long, _core long, _left binary, _right binary, _t long, _at int, _n long"
    )
    # equal texts list the same runs: a piece is one row for each place, and counts its run's copies once
    key = ["_anchor", "_core", "_left", "_right"]
    cut = materialize(cut.groupBy(*key, "_t", "_at").agg(F.max("_n").alias("_n")), "pieces")
    forget(classes)
    folded = materialize(cut.groupBy(*key).agg(F.sum("_n").alias("_n"), F.min(F.struct("_t", "_at")).alias("_first")), "folded-pieces")
    whole = materialize(cut.where("_n = 1").join(folded.where("_n > 1").select(*key), key, "left_semi").select(
        "_t", F.col("_at").alias("_from"),
        (F.col("_at") + F.length("_left") + F.length("_right") + 1 - STEP + length).cast("int").alias("_to"),
    ), "whole-pieces")
    forget(cut)
    cores = folded.groupBy("_anchor", "_core").agg(
        F.count(F.lit(1)).alias("_size"), F.count(F.when(F.col("_n") == 1, 1)).alias("_single")
    ).where("_size > 1 and _single > 0").drop("_single")
    apart = materialize(folded.join(cores, ["_anchor", "_core"]).select(*key, "_first.*", "_n", "_size"), "split-pieces")
    forget(folded)
    few = apart.where(f"_size <= {most_pieces}").repartition("_anchor", "_core").sortWithinPartitions("_anchor", "_core", "_t", "_at")
    by_suffixes = few.mapInPandas(_by_suffixes(length), "_t long, _from int, _to int")
    strings = apart.where(f"_size > {most_pieces}").mapInPandas(
        _strings, "_anchor long, _core long, _string binary, _t long, _start int, _single boolean"
    )
    twice = strings.groupBy("_anchor", "_core", "_string").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    by_strings = strings.where("_single").join(twice, ["_anchor", "_core", "_string"], "left_semi").select(
        "_t", F.col("_start").alias("_from"), (F.col("_start") + length).alias("_to")
    )
    return spans.union(whole).union(by_suffixes).union(by_strings)


def kept_bytes(data: bytes, ranges) -> tuple[bytes, int]:
    """What is left of a text without the ranges, and the number of maximal removed runs."""
    gone = np.zeros(len(data) + 1, np.int32)
    for a, b in ranges:
        gone[a] += 1
        gone[b] -= 1
    removed = np.cumsum(gone)[:-1] > 0
    n = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~removed].tobytes(), n


def _digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for text, ranges in zip(_as_bytes(texts), spans):
        left, n = kept_bytes(text, [(r["_from"], r["_to"]) for r in ranges] if ranges is not None else [])
        out.append((len(text), len(text) - len(left), n, hashlib.sha256(left).hexdigest()))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_spans(docs: DataFrame, keep: Sequence[Column], text: str = "text", length: int = LENGTH) -> DataFrame:
    """``keep``, ``_text`` and ``_spans`` (array of byte ranges, NULL without any) of every row; a NULL text has none."""
    found = repeated_spans(docs, text, length).groupBy("_t").agg(F.collect_list(F.struct("_from", "_to")).alias("_spans"))
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"), F.xxhash64(F.col(text).cast("string")).alias("_t"))
    return rows.join(found, "_t", "left").drop("_t")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id``, and bytes, removed bytes, removed runs and SHA-256 of the rest of every text; a NULL text is empty."""
    rows = with_spans(docs, [F.col(doc_id)], text, length)
    digest = F.pandas_udf(_digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return rows.select(doc_id, digest("_text", "_spans").alias("_digest")).select(doc_id, "_digest.*")
