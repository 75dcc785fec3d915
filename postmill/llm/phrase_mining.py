"""Phrases whose words occur together more often than chance, from exact counts of frequent n-grams.

The first pass sums n-grams up in Misra-Gries summaries, one per hash partition: tasks send
what they counted in a chunk of text, and the partition's owner merges those counts under
a fixed number of counters. With more counters than mass / threshold, what a summary takes off
any n-gram stays below the threshold, so every n-gram that reaches it survives, and the amount taken off
is known, so most others can be told apart. The second pass counts n-grams that survived, exactly and
by their words.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import mix64, small_batches
from postmill.session import materialize

CHUNK_BYTES = 4 << 20  # of text whose n-grams a task counts before it sends them
PARTITION_BYTES = 1 << 26  # of text for each hash partition of n-grams; 64 partitions at least
FILTER_BITS = (1 << 23, 1 << 28)  # size of the filter of survivors: 32 bits a survivor between these bounds

# A-Z lower-cased by bytes.lower(); what ends a piece becomes a newline, a tab a space
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


class Chunk:
    """Words of some documents, numbered, and their n-grams: where they start and a 64-bit hash of each.

    The hash depends on language and words only, so it is the same in every task and run.
    """

    def __init__(self, langs: list[str], texts: list[str | None]):
        parts = [(t or "").encode().lower().translate(_PIECES) + b"\n" for t in texts]
        text = b"".join(parts)
        data = np.frombuffer(text, np.uint8)
        word = (data != 0x20) & (data != 0x0A)
        word[1:] &= ~word[:-1]
        starts = np.flatnonzero(word).astype(np.int32 if len(text) < 1 << 31 else np.int64)
        self.words = text.split()  # no other white space is left
        self.piece = np.cumsum(data == 0x0A, dtype=starts.dtype)[starts] if len(starts) else np.zeros(0, np.int32)
        of_doc = np.searchsorted(np.cumsum([len(p) for p in parts]), starts, "right")
        lang, self.langs = pd.factorize(np.array(langs, dtype=object))
        self.lang = lang[of_doc] if len(starts) else np.zeros(0, np.int64)
        self.codes, distinct = pd.factorize(np.array(self.words, dtype=object)) if self.words else (np.zeros(0, np.int64), [])
        named = [int.from_bytes(_digest(w), "little") for w in [*distinct, *[x.encode() for x in self.langs]]]
        hashes = np.array(named, np.uint64)
        self._of_lang = mix64(hashes[len(distinct):] + np.uint64(1))
        self._of_word = hashes[: len(distinct)]

    def words_by_lang(self) -> dict[str, int]:
        return dict(zip(self.langs, np.bincount(self.lang, minlength=len(self.langs)).tolist()))

    def ngrams(self, most_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first word's place, hash) for 1, 2, … words; an n-gram lies in one piece."""
        at = np.arange(len(self.codes))
        hashes = self._of_lang[self.lang] if len(at) else np.zeros(0, np.uint64)
        for k in range(1, most_words + 1):
            inside = at + k <= len(self.codes)
            at, hashes = at[inside], hashes[inside]
            inside = self.piece[at] == self.piece[at + k - 1]
            at, hashes = at[inside], hashes[inside]
            hashes = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + self._of_word[self.codes[at + k - 1]])
            yield k, at, hashes

    def counted(self, k: int, at: np.ndarray, hashes: np.ndarray, partitions: int) -> Iterator[tuple[int, str, list[str], np.ndarray]]:
        """(hash partition, language, phrases, occurrences) of the n-grams of ``k`` words at ``at``, told apart by words, not by hash."""
        owner = _partition(hashes, partitions)
        lang = self.lang[at]
        order = np.lexsort([hashes, lang, owner])
        at, owner, lang = at[order], owner[order], lang[order]
        outer = np.ones(len(at), bool)
        outer[1:] = (owner[1:] != owner[:-1]) | (lang[1:] != lang[:-1])
        new = outer.copy()
        for j in range(k):
            codes = self.codes[at + j]
            new[1:] |= codes[1:] != codes[:-1]
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(at)))
        phrases = [b" ".join(self.words[i : i + k]).decode() for i in at[heads].tolist()]
        cuts = np.flatnonzero(outer[heads])
        for lo, hi in zip(cuts, [*cuts[1:], len(heads)]):
            yield int(owner[heads[lo]]), self.langs[lang[heads[lo]]], phrases[lo:hi], counts[lo:hi]


def _digest(word: bytes) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(word)


def _chunks(batches, most_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of about so much text: short texts are gathered over batches, one text is never cut."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            langs.append(lang)
            texts.append(text)
            size += len(text or "")
            if size >= most_bytes:
                yield Chunk(langs, texts)
                langs, texts, size = [], [], 0
    if texts:
        yield Chunk(langs, texts)


def _packed(marks: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit marks and their counts in few bytes: steps and counts, byte planes apart, compressed."""
    import zstandard

    steps = np.diff(marks, prepend=np.uint32(0)).astype("<u4")
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 4).T.ravel(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    values = [np.ascontiguousarray(p.T).view("<u4").ravel() for p in (planes[:4], planes[4:])]
    return np.cumsum(values[0], dtype=np.uint32), values[1].astype(np.int64)


class Summary:
    """A Misra-Gries summary of marks that merges counted lots.

    At most ``capacity`` counters are kept between lots; each cut takes the same amount off
    all counters and so off at least ``capacity`` + 1 of them. ``lost`` is what any mark's counter may
    be short of its count, at most mass / (capacity + 1).
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self._marks, self._counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._lots: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, marks: np.ndarray, counts: np.ndarray) -> None:
        self._lots.append((marks, counts))
        self._waiting += len(marks)
        if self._waiting >= max(2 * self.capacity, 1 << 17):
            self._merge()

    def _merge(self) -> None:
        marks = np.concatenate([self._marks, *[m for m, _ in self._lots]])
        counts = np.concatenate([self._counts, *[c for _, c in self._lots]])
        self._lots, self._waiting = [], 0
        order = np.argsort(marks)
        marks, counts = marks[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])) if len(marks) else np.zeros(0, np.int64)
        marks, counts = marks[heads], np.add.reduceat(counts, heads) if len(heads) else counts
        if len(marks) > self.capacity:
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.lost += cut
            counts = counts - cut
            marks, counts = marks[counts > 0], counts[counts > 0]
        self._marks, self._counts = marks, counts

    def reaching(self, threshold: int) -> np.ndarray:
        """Marks whose count may reach ``threshold``; none that does is missing while ``lost`` is below it."""
        self._merge()
        return self._marks[self._counts + self.lost >= threshold]


def _partition(hashes: np.ndarray, partitions: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(partitions)).astype(np.int64)


def _places(part: np.ndarray, marks: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three bits of the filter for each n-gram."""
    key = part.astype(np.uint64) << np.uint64(32) | marks.astype(np.uint64)
    for _ in range(3):
        key = mix64(key + np.uint64(1))
        yield (key % np.uint64(bits)).astype(np.int64)


def _known(table: np.ndarray, hashes: np.ndarray, partitions: int) -> np.ndarray:
    """Where in ``hashes`` there is an n-gram that the filter lets pass."""
    left = np.arange(len(hashes))
    for i in range(3):
        place = next(itertools.islice(_places(_partition(hashes[left], partitions), hashes[left] >> np.uint64(32), 64 * len(table)), i, None))
        left = left[(table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return left


def survivors(rows: DataFrame, threshold: int, most_words: int, partitions: int) -> DataFrame:
    """(``part``, ``mark``): hash partition and 32 more bits of the hash of every n-gram that may reach ``threshold``.

    A partition's lots are sorted behind the masses they stand for, so its capacity is known
    before the first of them is merged, and neither lots nor counters are held whole.
    """

    def counted(batches):
        for chunk, (_, _, hashes) in ((c, x) for c in _chunks(batches) for x in c.ngrams(most_words)):
            chunk.words = None  # not asked for here
            # by partition, then by mark
            keys = _partition(hashes, partitions).astype(np.uint64) << np.uint64(32) | hashes >> np.uint64(32)
            keys, counts = np.unique(keys, return_counts=True)
            owner = (keys >> np.uint64(32)).astype(np.int64)
            marks = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            lots = [(int(owner[lo]), marks[lo:hi], counts[lo:hi]) for lo, hi in zip(cuts, [*cuts[1:], len(keys)])]
            yield pd.DataFrame({"part": [p for p, _, _ in lots], "mass": [int(c.sum()) for _, _, c in lots], "lot": None})
            yield pd.DataFrame({"part": [p for p, _, _ in lots], "mass": 0, "lot": [_packed(m, c) for _, m, c in lots]})

    def merged(batches):
        part, mass, summary = None, 0, None
        for batch in batches:
            for p, m, lot in zip(batch["part"], batch["mass"], batch["lot"]):
                if p != part:
                    if summary is not None:
                        yield _rows(part, summary)
                    part, mass, summary = p, 0, None
                if lot is None:
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(mass // threshold + 1)
                summary.add(*_unpacked(lot))
        if summary is not None:
            yield _rows(part, summary)

    def _rows(part, summary):
        marks = summary.reaching(threshold)
        return pd.DataFrame({"part": np.full(len(marks), part, np.int64), "mark": marks.astype(np.int64)})

    lots = rows.mapInPandas(counted, "part long, mass long, lot binary")
    dealt = lots.repartition("part").sortWithinPartitions("part", F.col("lot").isNotNull())
    return dealt.mapInPandas(merged, "part long, mark long")


def exact_counts(rows: DataFrame, found: DataFrame, threshold: int, most_words: int, partitions: int) -> DataFrame:
    """(``lang``, ``words``, ``phrase``, ``n``) of all n-grams that occur ``threshold`` times, and of all words (``words`` 0).

    ``found`` tells which to count; its filter has a bounded size and lets all of them pass, and
    few others, which then stay below the threshold by their exact counts. A task sends what it
    counted in a chunk as one lot to each hash partition, whose owner adds lots up by phrase.
    """
    bits = FILTER_BITS[0]
    while bits < min(FILTER_BITS[1], 32 * found.count()):
        bits *= 2

    def places(batches):
        for batch in batches:
            for at in _places(batch["part"].to_numpy(), batch["mark"].to_numpy(), bits):
                yield pd.DataFrame({"word": at >> 6, "bit": at & 63})

    words = found.mapInPandas(places, "word long, bit int").groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toPandas()
    table = np.zeros(bits >> 6, np.uint64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(table)  # 32 megabytes at most

    def counted(batches):
        import zstandard

        table, small = shared.value, zstandard.ZstdCompressor(level=1)
        for chunk in _chunks(batches):
            parts = [(0, lang, [""], np.array([n])) for lang, n in chunk.words_by_lang().items()]
            for k, at, hashes in chunk.ngrams(most_words):
                known = _known(table, hashes, partitions)
                parts += chunk.counted(k, at[known], hashes[known], partitions)
                if parts:
                    lots = [small.compress(c.astype("<i8").tobytes() + "\n".join(p).encode()) for _, _, p, c in parts]
                    yield pd.DataFrame({"part": [p[0] for p in parts], "lang": [p[1] for p in parts], "size": [len(p[2]) for p in parts], "lot": lots})
                parts = []

    def added(batches):
        import zstandard

        whole, key, sums = zstandard.ZstdDecompressor(), None, {}
        for batch in batches:
            for part, lang, size, lot in zip(batch["part"], batch["lang"], batch["size"], batch["lot"]):
                if key != (part, lang):
                    yield from _frequent(key, sums)
                    key, sums = (part, lang), {}
                data = whole.decompress(lot)
                for phrase, n in zip(data[8 * size :].decode().split("\n"), np.frombuffer(data, "<i8", size).tolist()):
                    sums[phrase] = sums.get(phrase, 0) + n
        yield from _frequent(key, sums)

    def _frequent(key, sums):
        kept = [(p, n) for p, n in sums.items() if n >= threshold or (not p and n)]
        if kept:
            words = [p.count(" ") + 1 if p else 0 for p, _ in kept]
            yield pd.DataFrame({"lang": key[1], "words": words, "phrase": [p for p, _ in kept], "n": [n for _, n in kept]})

    lots = rows.mapInPandas(counted, "part long, lang string, size int, lot binary")
    dealt = lots.repartition("part").sortWithinPartitions("part", "lang")
    return dealt.mapInPandas(added, "lang string, words int, phrase string, n long")


def association(a: Column, n: Column, left: Column, right: Column, scale: int = 1000) -> Column:
    """floor(scale × a × n / (left × right)) of whole numbers, exact to 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (a, n, left, right)]
    return F.call_function("div", F.lit(scale).cast("decimal(6,0)") * wide[0] * wide[1], wide[2] * wide[3])


def mine(docs: DataFrame, text: str, lang: str, threshold: int = 100, most_words: int = 5, share: int = 100) -> DataFrame:
    """Phrases of 2 to ``most_words`` words that occur at least ``threshold`` times in a language, with their score.

    Returns ``lang``, ``phrase``, ``words``, ``a`` (its occurrences), ``l`` and ``r`` (those of the two parts
    it falls into at its weakest cut), ``n`` (all words of the language) and ``score``, floor(1000 a n / (l r)); of
    equal cuts the first. A phrase inside a longer frequent one that occurs ``share`` percent as often is left
    out. A-Z are lower-cased; phrases stay inside pieces, which end at . , ; : ! ? and at line ends;
    words are parted by spaces and tabs. Overlapping occurrences count. A NULL text is an empty one, a NULL
    language is ``und``. Repeated rows count as often as they occur. Other columns of ``docs`` are not read.
    Counts are of whole texts of all rows; an empty table gives no phrases.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    partitions = max(64, size // PARTITION_BYTES)
    found = materialize(survivors(rows, threshold, most_words, partitions), "phrase-survivors")
    counts = materialize(exact_counts(rows, found, threshold, most_words, partitions), "phrase-counts")
    return scored(counts, share)


def scored(counts: DataFrame, share: int = 100) -> DataFrame:
    """Phrases with their weakest cut, without those that a longer one stands for, from exact counts."""
    totals = materialize(counts.where("words = 0").select("lang", F.col("n").alias("_total")), "phrase-totals")
    parts = counts.where("words > 0").select("lang", F.col("phrase").alias("_part"), F.col("n").alias("_of"))
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"))
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("_w", i, k), " ")),
    ))
    longer = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_longest"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(f"_longest is null or {int(share)} * a > 100 * _longest")
    kept = materialize(kept.drop("_longest"), "phrases")
    cut = F.posexplode(F.sequence(F.lit(1), F.col("words") - 1)).alias("_at", "_k")
    cuts = kept.select("lang", "phrase", "words", "a", "_w", cut)
    cuts = cuts.withColumns({
        "_first": F.array_join(F.slice("_w", F.lit(1), F.col("_k")), " "),
        "_rest": F.array_join(F.slice("_w", F.col("_k") + 1, F.col("words")), " "),
    })
    cuts = cuts.join(parts.withColumnsRenamed({"_part": "_first", "_of": "l"}), ["lang", "_first"])
    cuts = cuts.join(parts.withColumnsRenamed({"_part": "_rest", "_of": "r"}), ["lang", "_rest"])
    cuts = cuts.join(totals, "lang")
    score = association(F.col("a"), F.col("_total"), F.col("l"), F.col("r"))
    best = cuts.groupBy("lang", "phrase", "words").agg(
        F.min(F.struct(score.alias("score"), F.col("_k"), "a", "l", "r", F.col("_total").alias("n"))).alias("_best")
    )
    return best.select("lang", "phrase", "words", *[f"_best.{c}" for c in ("a", "l", "r", "n", "score")])


def top(phrases: DataFrame, most: int) -> DataFrame:
    """The first ``most`` phrases of each language by score, then occurrences, then phrase, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = phrases.withColumn("rank", rank).where(F.col("rank") <= most)  # not cast before, so that tasks send their first rows only
    return first.withColumn("rank", F.col("rank").cast("long"))
