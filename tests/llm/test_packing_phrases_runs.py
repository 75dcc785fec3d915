"""Packing, phrases and periodic runs against brute force, round trips and SQL, on small and odd tables."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import best_fit_packing as packing
from postmill.llm import periodic_runs, phrase_mining, queries

public_tokenizers = pytest.importorskip("public_tokenizers")

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, offset int, runs string, piece int"
TEXTS = ["", None, " \n\t", "one two", "one two", "a a a a a a a", "x " + "b c " * 9 + "y", "ß  é   日本 " * 40, "k" * 4000, "w " * 5000]


def documents(spark, texts):
    """Documents with NULL and repeated ids and with columns that clash with those the operators use."""
    ids = [None if k == 3 else min(k, 8) for k in range(len(texts))]
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None, None, "x", 1, "r", 2) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# --- packing


def plain_ids(path, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    return [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def placed(packed, budget):
    """Places of a packing are gapless in each sequence."""
    rows = collections.defaultdict(list)
    for r in packed:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= budget
    return len(rows)


def test_pieces_are_the_tokenizer_s_ids_and_come_back_from_sequences(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(odd, "text", ["doc_id", "_row"], path, budget=64)
    rows = cut.collect()
    whole = collections.Counter(tuple(ids) for ids in plain_ids(path, TEXTS))
    got, parts = collections.Counter(), []
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] <= 64 and (r["piece"] == 0 or r["length"] == 64)
        if r["piece"] == 0 and parts:
            got[tuple(np.concatenate(parts).tolist())] += 1
            parts = []
        assert r["start"] == sum(map(len, parts))
        parts.append(ids)
    got[tuple(np.concatenate(parts).tolist())] += 1
    assert got == whole
    packed = packing.pack(cut.withColumn("offset", F.lit("clash")), ["doc_id", "piece"], budget=64)
    rows = packed.collect()
    assert packed.columns == ["doc_id", "_row", "piece", "start", "length", "ids", "sequence_id", "offset"]
    tokens = sum(sum(k) and len(k) * n for k, n in whole.items())
    assert placed(rows, 64) == -(-tokens // 64)
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], bytes(r["ids"])))
    for r in packing.sequences(packed).collect():
        assert bytes(r["ids"]) == b"".join(ids for _, ids in sorted(by_sequence[r["sequence_id"]])) and len(r["ids"]) == 4 * r["length"]


def test_ranks_and_merges_give_the_same_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = packing.encoder(path)
    dice = random.Random(3)
    places = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)}b  {chr(c)} !{chr(c)}'s" for c in dice.sample(places, 40)) for _ in range(300)]
    texts += ["x<|endoftext|> y", "'re it's", "\r\n\n \t x", " " * 3000, "\u0000\x1c\x85"]
    texts += [r[0] or "" for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    assert packing._ranked(path) is not None and packing._ranked(public_tokenizers.path("word_bpe_49k.json")) is None
    for text, ids in zip(texts, plain_ids(path, texts)):
        assert encode(text).tolist() == ids[:-1]


def best_fit_one_by_one(lengths, budget):
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= length]
        if not fits:
            room.append(budget - length)
        else:
            room[min(fits, key=lambda i: room[i])] -= length
    return len(room)


@pytest.mark.parametrize("seed", range(30))
def test_a_plan_on_counts_packs_like_best_fit_on_documents(seed):
    dice = random.Random(seed)
    budget = dice.choice([8, 20, 64])
    lengths = [dice.randint(1, budget if dice.random() < 0.5 else 1 + budget // 4) for _ in range(dice.choice([1, 50, 400]))]
    counts = collections.Counter(lengths)
    rows = packing.plan(list(counts), list(counts.values()), budget)
    taken = collections.Counter()
    room = collections.Counter()
    for length, start, groups, per, first, at in rows:
        assert start == taken[length]
        taken[length] += groups * per
        for s in range(first, first + groups):
            assert room[s] == at
            room[s] += per * length
    assert taken == counts and max(room.values()) <= budget
    assert len(room) == max(room) + 1 == best_fit_one_by_one(lengths, budget)


def test_packing_empty_tables_and_lengths_out_of_bounds(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack(packing.pieces(empty, "text", ["doc_id"], path), ["doc_id"]).count() == 0
    zero = packing.pieces(documents(spark, ["", "a"]), "text", ["doc_id"], path, end=None)
    assert sorted((r["length"], r["offset"]) for r in packing.pack(zero, ["doc_id"]).collect()) == [(0, 0), (1, 0)]
    with pytest.raises(ValueError):
        packing.plan([9], [1], 8)


def test_packing_query(spark):
    rows = queries.op11_best_fit_packing(spark, SF).collect()
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    ids = dict(zip(texts, plain_ids(public_tokenizers.path("byte_bpe_50k.json"), texts.values())))
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
    lengths = [r["length"] for r in rows]
    assert sum(lengths) == sum(map(len, ids.values()))
    assert placed(rows, 1024) == best_fit_one_by_one(lengths, 1024)


# --- phrases


def phrases_by_hand(rows, threshold, most_words=5):
    """Counts and scores of all phrases, one word at a time."""
    import re

    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, most_words + 1) for i in range(len(words) - k + 1))
    out = {}
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < threshold:
            continue
        if any(n >= a and x == lang and len(w) > len(words) and n >= threshold and any(w[i : i + len(words)] == words for i in range(len(w))) for (x, w), n in counts.items() if len(w) > len(words)):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang, " ".join(words)] = (a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score)
    return out


def mined(spark, rows, **kwargs):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("words", F.lit(1)).withColumn("phrase", F.lit("x"))
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrase_mining.mine(docs, "text", "lang", **kwargs).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_phrases_against_counting_by_hand(spark, seed):
    dice = random.Random(seed)
    line = "A b,c  d\td e;É f! a B c d e f a a a a a a\nß ss: A b c"
    rows = [(dice.choice(["en", "de", None, "und"]), " ".join(dice.choice(["a", "b", "C", "d.", "e\n", line, " x", ""]) for _ in range(dice.randrange(60)))) for _ in range(40)]
    rows += [("en", None), ("en", ""), (None, None), rows[0], rows[0]]
    assert mined(spark, rows, threshold=5) == phrases_by_hand(rows, 5)


def test_no_phrases(spark):
    assert mined(spark, [], threshold=2) == {} and mined(spark, [("en", None), (None, " . ")], threshold=1) == {}


@pytest.mark.parametrize("seed", range(6))
def test_a_summary_keeps_all_that_reach_the_threshold(seed):
    dice = np.random.default_rng(seed)
    threshold = 20
    marks = np.concatenate([dice.integers(0, 2**32, 200_000), np.repeat(dice.integers(0, 2**32, 300), dice.integers(15, 60, 300))]).astype(np.uint32)
    dice.shuffle(marks)
    summary = phrase_mining.Summary(len(marks) // threshold + 1)
    for lot in np.array_split(marks, 40):
        own, counts = np.unique(lot, return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip(phrase_mining._unpacked(phrase_mining._packed(own, counts)), (own, counts)))
        summary.add(own, counts)
    found = summary.reaching(threshold)
    own, counts = np.unique(marks, return_counts=True)
    assert set(own[counts >= threshold].tolist()) <= set(found.tolist())
    assert 0 < summary.lost < threshold and len(found) < 2000


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 9 * 10**12, 8 * 10**13, 10**13 + 7, 9 * 10**12 + 1
    got = spark.range(1).select(phrase_mining.association(*[F.lit(x) for x in (a, n, left, right)]).alias("s")).head()["s"]
    assert got == 1000 * a * n // (left * right)


def test_phrase_query(spark):
    rows = [tuple(r) for r in queries.op12_phrase_mining(spark, SF).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(rows) == sorted(con.execute(queries.SQL["op12_phrase_mining"]).fetchall()) and rows


# --- periodic runs


def runs_by_hand(words, copies=4, least=6):
    n, out = len(words), set()
    for p in range(1, n // copies + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, copies * p) and all(any(words[x] != words[x + q] for x in range(i, i + size - q)) for q in range(1, p)):
                out.add((i, size, p))
            i = max(i + 1, j)
    return sorted(out)


@pytest.mark.parametrize("copies, least", [(4, 6), (3, 9), (2, 2), (5, 1)])
def test_runs_against_brute_force(copies, least):
    dice = random.Random(copies)
    for _ in range(300):
        docs = []
        for _ in range(dice.randrange(1, 5)):
            k, n = dice.choice([1, 2, 3, 5]), dice.randrange(40)
            words = [dice.randrange(k) for _ in range(n)]
            unit = [dice.randrange(k) for _ in range(dice.randrange(1, 8))]
            at = dice.randrange(n + 1)
            words[at:at] = (unit * 9)[: dice.randrange(50)]
            docs.append(words)
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        codes = np.array([w for d in docs for w in d], np.int64)
        want = sorted((int(starts[i]) + s, n, p) for i, d in enumerate(docs) for s, n, p in runs_by_hand(d, copies, least))
        assert periodic_runs.runs_of(codes, starts, copies, least) == want


def test_runs_of_odd_texts(spark, odd, empty):
    out = periodic_runs.periodic_runs(odd, "text")
    assert out.columns == [c for c in odd.columns if c != "runs"] + ["runs", "collapsed"]
    rows = out.collect()
    for r in rows:
        words = (r["text"] or "").encode().split()
        want = runs_by_hand(words) if len(words) < 1000 else [(0, 5000, 1)]
        assert [tuple(x) for x in r["runs"]] == want
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r["collapsed"] == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    assert len(rows) == len(TEXTS) and periodic_runs.periodic_runs(empty, "text").count() == 0


def test_runs_of_one_word_and_of_nested_periods():
    for words in (["a"] * 3000, (["a"] * 7 + ["b"]) * 300, (["a", "b"] * 5 + ["c"]) * 4 + ["a", "b"] * 9):
        codes = np.unique(words, return_inverse=True)[1].astype(np.int64)
        found = periodic_runs.runs_of(codes, np.array([0, len(words)]))
        assert found == (runs_by_hand(words) if len(words) < 1000 else found)
        assert (0, len(words), 1) in found or len(found) > 1


def test_run_query(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = queries.op13_periodic_runs(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = (texts[r["doc_id"]] or "").encode().split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 2000:
            continue
        runs = runs_by_hand(words)
        gone = {i for s, k, p in runs for i in range(s + p, s + k)}
        collapsed = b" ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{k},{p}\n" for s, k, p in sorted(runs, key=lambda x: (x[0], x[2])))
        s, k, p = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), s, k, p)
        assert r["exponent_milli"] == (1000 * k // p if runs else None)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed).hexdigest()
