"""Best-fit packing of tokenized documents, planned on the histogram of lengths.

A plan needs only how many pieces there are of each length, so it is made on at most
``budget`` counts: lengths in descending order go to the open sequences with the least
room that still holds them, whole groups of equal sequences at a time. Pieces then take
the planned slots by their rank within their length.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import gapless_ranks, small_batches

# fixed value: how a byte-level tokenizer splits a text into words before it merges bytes
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PLAN = "_length long, _from long, _groups long, _per long, _first long, _at long"


def _byte_symbols() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranked(path: str):
    """The vocabulary as merge ranks, if the file is a plain byte-level one whose ids follow its merges; else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )
    symbols, special = _byte_symbols(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = {t: i for t, i in model.get("vocab", {}).items() if t not in special} if plain else {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    made = [vocabulary.get(m, -1) for m in merges]
    if not plain or made != sorted(set(made)) or (made and made[0] < 256) or len(vocabulary) != 256 + len(made):
        return None
    import tiktoken

    ranks = {bytes(symbols[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding("packing", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids by the tokenizer file at ``path``, without special tokens around them.

    Ids are those of the ``tokenizers`` library. For byte-level files whose ids are merge
    ranks, ``tiktoken`` finds the same ids in a third of the time; a text it cannot
    handle, such as megabytes without a break, goes to ``tokenizers``.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    ranked = _ranked(path) if path.endswith(".json") else None

    def by_merges(text: str) -> np.ndarray:
        return np.array(plain.encode(text, add_special_tokens=False).ids, "<u4")

    def by_ranks(text: str) -> np.ndarray:
        try:
            return ranked.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except Exception:
            return by_merges(text)

    return by_ranks if ranked is not None else by_merges


def piece_starts(tokens: int, budget: int) -> np.ndarray:
    """Where the pieces of a document of so many tokens start: full pieces, behind a first one that may be shorter."""
    first = (tokens - 1) % budget + 1 if tokens else 0
    return np.concatenate([[0], np.arange(first, tokens, budget)]).astype(np.int64)


def pieces(docs: DataFrame, text: str, keep: Sequence[str], tokenizer: str, budget: int = 1024, end: int | None = 2) -> DataFrame:
    """Tokenize whole texts and cut those longer than ``budget``.

    Returns the columns ``keep``, which may have any names but the four added ones, and
    ``piece`` (from 0), ``start`` (the document's ids before it), ``length`` and ``ids``
    (little-endian unsigned 32-bit numbers). A NULL text is an empty one and has its end
    id only; without ``end`` an empty text is one piece of no ids. Repeated rows give
    repeated pieces. ``tokenizer`` is a path that every executor can read.
    """
    small_batches(docs.sparkSession, 500)
    given = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(g) for c, g in zip(keep, given)], F.col(text).cast("string").alias("_text"))
    kept = rows.drop("_text")
    tail = np.array([] if end is None else [end], "<u4")

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            held, size = [], 0
            for i, text_ in enumerate(batch["_text"]):
                ids = np.concatenate([encode(text_ or ""), tail]).astype("<u4")
                starts = piece_starts(len(ids), budget)
                for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    held.append((i, k, lo, hi - lo, ids[lo:hi].tobytes()))
                    size += hi - lo
                if size > 1 << 20:
                    yield _frame(batch, held)
                    held, size = [], 0
            if held:
                yield _frame(batch, held)

    def _frame(batch, held):
        of, k, lo, n, ids = zip(*held)
        out = batch[given].iloc[list(of)].reset_index(drop=True)
        return out.assign(piece=np.array(k, np.int32), start=np.array(lo, np.int64), length=np.array(n, np.int64), ids=list(ids))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    out = rows.mapInPandas(run, f"{schema + ', ' if schema else ''}piece int, start long, length long, ids binary")
    return out.withColumnsRenamed(dict(zip(given, keep)))


def plan(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: where the pieces of each length go.

    A row (length, from, groups, per, first, at) says that the pieces of this length with
    the ranks from … from + groups × per - 1 go, ``per`` to a sequence one after the other,
    to the sequences first, first + 1, …, each from place ``at`` on. Sequences of equal room
    are handled together, so the work depends on the lengths and not on the pieces.
    Pieces of length 0 take no room and go to the first sequence.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(budget + 1)]  # by free places: (first sequence, sequences)
    rows, opened = [], 0
    for length, left in sorted(zip(lengths, counts), reverse=True):
        if not 0 <= length <= budget:
            raise ValueError(f"a piece of {length} tokens does not fit {budget}")
        if left <= 0:
            continue
        if length == 0:
            rows.append((0, 0, 1, left, 0, 0))
            opened = max(opened, 1)
            continue
        rank = 0
        for free in range(length, budget + 1):
            groups, room[free] = room[free], []
            while groups and left:
                first, n = groups.pop()
                left, rank = _fill(room, rows, groups, free, first, n, length, left, rank, budget)
            room[free] += groups
            if not left:
                break
        if left:
            n = -(-left // (budget // length))
            groups = [(opened, n)]
            opened += n
            while groups and left:
                first, n = groups.pop()
                left, rank = _fill(room, rows, groups, budget, first, n, length, left, rank, budget)
    return rows


def _fill(room, rows, groups, free, first, n, length, left, rank, budget):
    """Give pieces of one length to ``n`` sequences of equal room; what is not reached goes back to ``groups``."""
    per = free // length
    whole = min(n, left // per)
    if not whole:
        whole, per = 1, left
    rows.append((length, rank, whole, per, first, budget - free))
    room[free - per * length].append((first, whole))
    if whole < n:
        groups.append((first + whole, n - whole))
    return left - whole * per, rank + whole * per


def pack(pieces: DataFrame, identity: Sequence[str], length: str = "length", budget: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless from 0 in each sequence) to pieces of at most ``budget`` tokens.

    ``pieces`` is read twice, so it should be a written table. Pieces of one length are
    ranked by a hash of ``identity`` inside hash buckets; a hot length is many tasks. Equal
    rows take neighbouring places. The plan is broadcast: its rows follow from the at most
    ``budget`` lengths, whatever the number of pieces. Columns may have any names; those
    named ``sequence_id`` or ``offset`` are replaced. An empty table stays empty.
    """
    kept = [F.col(f"_row.`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = pieces.select(F.struct("*").alias("_row"), F.col(length).cast("long").alias("_length"), F.xxhash64(*identity).alias("_key"))
    counted = rows.groupBy("_length").agg(F.count(F.lit(1)).alias("_n")).orderBy("_length").collect()
    planned = pieces.sparkSession.createDataFrame(plan([r["_length"] for r in counted], [r["_n"] for r in counted], budget), PLAN)
    ranked = gapless_ranks(rows, ["_length"], [F.col("_key")], F.col("_key"), "_rank")
    slots = F.broadcast(planned.withColumnRenamed("_length", "_of"))
    past = F.col("_rank") - F.col("_from")
    here = (F.col("_of") == F.col("_length")) & (past >= 0) & (past < F.col("_groups") * F.col("_per"))
    return ranked.join(slots, here).select(
        *kept, F.expr("_first + (_rank - _from) div _per").alias("sequence_id"),
        F.expr("_at + (_rank - _from) % _per * _length").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(``sequence_id``, ``length``, ``ids``) of packed pieces that carry their ``ids``: what a trainer reads.

    A sequence holds at most ``budget`` ids, so a group is small.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: F.hex(p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(parts, "")).alias("ids"))
