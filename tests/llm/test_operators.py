"""Corpus operators against brute force, round trips and held-out accuracy, on small and odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import (
    budget_mix, chat_windows, chosen_path, context_trees, entropy_secrets, kd_sharding, lyndon_suffixes, pivot_index,
    preference_quality, queries, spaced_seeds,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, size int, score double"


def documents(spark, texts, ids=None):
    """Documents with columns that clash with those the operators use."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", None if t is None else len(t), "x", 1, 0.5) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def prose(n, seed):
    dice = random.Random(seed)
    return " ".join(dice.choice("the and of zu ein onwh erly tion hash blean ndre".split()) + str(dice.randrange(400)) for _ in range(n))


BASE = prose(60, 1)
ODD = ["", None, " \n\t", "one two", "one two", "ONE two", BASE, BASE, BASE.replace("the", "teh", 1), prose(80, 2), "ß " * 40, prose(6000, 3)]
ODD_IDS = [0, 1, 2, 3, 4, 5, 6, 6, 8, None, None, 11]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD, ODD_IDS)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# --- sharding


def test_shards_have_near_equal_bytes_and_gapless_slots(spark):
    rows = queries.op1_kd_sharding(spark, SF).toPandas()
    size = rows.groupby("shard")["size"].sum()
    assert list(size.index) == list(range(8)) and size.max() - size.min() <= 2 * rows["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard")["slot"])
    text = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    assert all(zlib.crc32(text[d].encode()) == c for d, c in zip(rows["doc_id"], rows["text_crc32"]))


def sharded(docs, **leaves):
    rows = kd_sharding.prepared(docs, kd_sharding.document_coordinates(docs), F.lit(10), ["doc_id", "text"])
    tree, at_leaves = kd_sharding.fit(rows, **leaves)
    return kd_sharding.place(rows, tree, "shard").toPandas(), kd_sharding.numbered(at_leaves, tree, "shard").toPandas()


def test_sharding_odd_and_empty_tables(spark, odd, empty):
    placed, fitted = sharded(odd, shards=3)
    assert len(placed) == len(ODD) and sorted(placed["shard"]) == sorted(fitted["shard"])
    assert set(placed["shard"]) <= {0, 1, 2}
    assert placed[placed["doc_id"] == 6]["shard"].nunique() == 1  # equal rows stay together
    assert len(sharded(empty, shards=4)[0]) == 0
    assert sharded(odd, target_bytes=60)[0]["shard"].nunique() == 2


def test_one_value_of_all_dimensions_is_cut_by_hash(spark):
    docs = documents(spark, ["same"] * 400).withColumn("source", F.lit("hot"))
    sizes = sharded(docs, shards=8)[0].groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() <= 60


# --- Jaccard join


def brute_links(texts, ids):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    sets = [shingles(t) for t in texts]
    links = [
        {b for b in range(len(sets)) if b != a and s and sets[b] and len(s & sets[b]) >= 0.8 * len(s | sets[b])}
        for a, s in enumerate(sets)
    ]
    key = [math.inf if i is None else i for i in ids]
    out = []
    for a in range(len(sets)):
        seen, todo = {a}, [a]
        while todo:
            todo += [b for b in links[todo.pop()] if b not in seen and not seen.add(b)]
        out.append((ids[a], len(links[a]), min(key[b] for b in seen)))
    return sorted(out, key=repr)


def test_links_and_groups_match_brute_force(spark, odd, empty):
    texts = list(ODD)
    dice = random.Random(5)
    for g in range(6):
        words = prose(120, 10 + g).split()
        for _ in range(25):  # a group of near copies, some of them equal
            copy = list(words)
            for _ in range(dice.randrange(3)):
                copy[dice.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    ids = ODD_IDS + list(range(100, 100 + len(texts) - len(ODD_IDS)))
    found = chosen_path.join_texts(documents(spark, texts, ids)).collect()
    got = sorted(((r["_id"], r["_links"], math.inf if r["_group"] is None else r["_group"]) for r in found), key=repr)
    assert got == brute_links(texts, ids)
    assert chosen_path.join_texts(empty).count() == 0


def test_runs_follow_the_recall():
    assert chosen_path.runs_for(0.999) > chosen_path.runs_for(0.9) > 1


def test_blocks_of_a_large_group_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    words = prose(100, 77).split()
    texts = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in range(90)]
    found = chosen_path.join_texts(documents(spark, texts)).collect()
    assert sorted((r["_id"], r["_links"], r["_group"]) for r in found) == sorted(brute_links(texts, list(range(90))))


# --- quality


def test_held_out_quality(spark):
    scored = queries.op3_preference_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = scored[scored["held_out"]].merge(labels, on="doc_id")
    assert len(scored) == 1000 and scored["score"].between(0, 1).all()
    assert (both["predicted"] == both["quality"]).mean() > 0.97


def test_quality_without_labels_rejects_nothing(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    ranking = preference_quality.learn(odd, labels, F.lit(True))
    got = odd.select(preference_quality.scored(ranking, F.col("text")).alias("p")).toPandas()["p"]
    assert np.allclose(got, 0.7) and len(got) == len(ODD)
    labels = spark.createDataFrame([(0, 1), (None, 0), (3, None), (6, 0), (6, 1), (99, 0)], "doc_id long, quality int")
    ranking = preference_quality.learn(odd, labels, F.lit(True))
    assert np.isfinite(ranking.weights).all()


# --- repeated strings


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_arrays_by_linear_grouping():
    dice = random.Random(1)
    for _ in range(1500):
        k = dice.choice([1, 2, 3, 5, 20])
        text = bytes(dice.randrange(k) for _ in range(dice.randrange(50)))
        assert lyndon_suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def repeating_texts():
    passage = prose(70, 4)
    texts = [*ODD, "und " * 200, "x" * 500, prose(40, 6) + passage + prose(30, 7), passage[:300], prose(9, 8) + passage[100:] + "é"]
    return texts + [prose(10, 20 + i) + passage[i : i + 320] + prose(10, 50 + i) for i in range(20)]


@pytest.mark.parametrize("most", [20_000, 1])
def test_removed_bytes_match_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(lyndon_suffixes.repeated_spans, "__defaults__", ("text", 200, most))
    texts = repeating_texts()
    got = lyndon_suffixes.digests(documents(spark, texts)).drop("doc_id").collect()
    assert sorted(map(tuple, got)) == brute_removed(texts, 200)


def test_removed_bytes_of_an_empty_table(empty):
    assert lyndon_suffixes.digests(empty).count() == 0


# --- mixing


def reference_targets(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in left) if left else 0
        over = [s for s in left if weight[s] * level > cap * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in left}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rows = queries.op5_budget_mix(spark, SF).toPandas()
    again = queries.op5_budget_mix(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert sorted(map(tuple, rows.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    rows = rows.merge(docs[["doc_id", "source"]], on="doc_id")
    targets = reference_targets(rows.groupby("source")["size"].sum().to_dict())
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert all(abs(by["target"][s] - t) < 1e-6 * t for s, t in targets.items())
    assert (rows["taken"] <= 2 * rows["size"]).all()
    for source, own in rows.groupby("source")["size"]:
        taken, target, all_ = int(by["taken"][source]), round(by["target"][source]), int(own.sum())
        sums = {0}
        for n in own:
            sums |= {s + n for s in sums}
        budget = target % all_ if target < 2 * all_ else 0
        nearest = max(s for s in sums if s <= budget) if 2 * budget <= all_ else min(s for s in sums if s >= budget)
        assert taken - target == nearest - budget


def test_mix_of_odd_and_empty_tables(odd, empty):
    mixed = budget_mix.mix(odd.drop("size").withColumn("size", F.lit(7).cast("long")), F.col("source"), F.col("size"), ["doc_id", "text"]).toPandas()
    assert len(mixed) == len(ODD) and mixed["_times"].between(0, 2).all()
    assert budget_mix.mix(empty, F.col("source"), F.col("size").cast("long"), ["doc_id"]).count() == 0


def test_knapsack_reaches_what_can_be_reached():
    dice = random.Random(3)
    for _ in range(200):
        lengths = np.array(sorted(dice.sample(range(1, 40), 5)))
        counts = np.array([dice.randrange(1, 4) for _ in lengths])
        budget = dice.randrange(0, int(lengths @ counts) + 1)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = budget_mix._knapsack(lengths, counts, budget)
        assert (take <= counts).all() and int(lengths @ take) == max(s for s in sums if s <= budget)


# --- benchmark overlaps


def test_leaks_with_substitutions(spark, odd, empty):
    item = prose(30, 90)
    changed = item.split()
    changed[7] = changed[19] = "other"
    texts = [f"{prose(20, 91)} {item.upper()}, {prose(9, 92)}", f"{prose(5, 93)} {' '.join(changed)}", prose(90, 94), None, "", "tiny item here"]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item here"), (4, "tiny item here")], "item_id long, text string")
    docs = documents(spark, texts)
    found = {(r["doc_id"], r["item_id"], r["words"], r["equal"]) for r in spaced_seeds.find(docs, bench).collect()}
    assert found == {(0, 1, 30, 30), (1, 1, 30, 28), (5, 4, 3, 3)}
    clean = docs.where(~spaced_seeds.leaked(bench, F.col("text"))).select("doc_id").collect()
    assert {r["doc_id"] for r in clean} == {2, 3, 4}
    assert spaced_seeds.find(empty, bench).count() == 0 and spaced_seeds.find(docs, bench.limit(0)).count() == 0


def test_leaks_of_which_the_best_run_is_too_different(spark):
    """A quarter substituted, with an equal window of twelve words; and two overlaps on one diagonal."""
    item = prose(60, 95)
    words = item.split()
    changed = [w if i < 12 or i % 3 else f"x{i}" for i, w in enumerate(words[:36])] + [f"y{i}" for i in range(24)]
    ahead = [w if i % 3 else f"x{i}" for i, w in enumerate(words[:46])] + [f"y{i}" for i in range(14)]
    ahead[20:32] = words[20:32]
    twice = words[:15] + [f"z{i}" for i in range(30)] + words[45:]
    docs = documents(spark, [" ".join(changed), " ".join(ahead), " ".join(twice)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = sorted((r["doc_id"], r["doc_word"], r["item_word"], r["words"], r["equal"]) for r in spaced_seeds.find(docs, bench).collect())
    assert {f[0] for f in found} == {0, 1, 2} and all(f[3] >= 12 and f[4] >= 0.75 * f[3] for f in found)
    assert [f for f in found if f[0] == 2] == [(2, 0, 0, 15, 15), (2, 45, 45, 15, 15)]
    assert docs.where(~spaced_seeds.leaked(bench, F.col("text"))).count() == 0


def test_every_qualifying_run_is_met():
    dice = np.random.default_rng(7)
    lost = 0
    for _ in range(1500):
        equal = dice.random(dice.integers(1, 70)) < dice.choice([0.6, 0.75, 0.85])
        least = int(dice.choice([1, 5, 12]))
        sums = np.concatenate([[0], np.cumsum(equal)])
        good = [(i, j) for i in range(len(equal)) for j in range(i + least, len(equal) + 1) if sums[j] - sums[i] >= 0.75 * (j - i)]
        runs = spaced_seeds._runs(equal, least)
        assert all(r in good for r in runs) and all(a[1] <= b[0] for a, b in zip(runs, runs[1:]))
        assert all(any(i < end and start < j for start, end in runs) for i, j in good)
        best = spaced_seeds._best_run(equal)
        lost += bool(good) and best not in good
        assert best not in good or best in runs
    assert lost


def _missed(masks, words, changed):
    """How many ways to change so many of so many words leave no mask whole anywhere."""
    ways = np.array([sum(1 << k for k in way) for way in combinations(range(words), changed)])
    missed = np.ones(len(ways), bool)
    for mask in masks:
        ones = sum(1 << k for k, on in enumerate(mask) if on == "1")
        for at in range(words - len(mask) + 1):
            missed &= (ways & (ones << at)) != 0
    return int(missed.sum())


def test_masks_miss_no_substitution():
    assert [_missed(spaced_seeds.MASKS, *case) for case in ((12, 3), (16, 4), (20, 5))] == [0, 0, 0]
    for words in range(1, spaced_seeds.SPAN):
        masks = spaced_seeds.masks_of(words)
        assert {len(m) for m in masks} == {words} and _missed(masks, words, words // 4) == 0


def test_overlaps_are_those_of_all_alignments():
    """Items of any length, words from a small set, copies of which up to a third is substituted."""
    dice = np.random.default_rng(8)
    seen = 0
    for _ in range(60):
        items = [dice.integers(0, 40, dice.integers(1, 45)).tolist() for _ in range(6)] + [[1, 1, 1, 1, 1, 2]]
        texts = [[1] * 30, []]
        for _ in range(6):
            copy = [int(w) if dice.random() < dice.choice([0.7, 0.8, 1.0]) else 99 for w in items[dice.integers(6)]]
            texts.append(dice.integers(0, 40, dice.integers(0, 9)).tolist() + copy + dice.integers(0, 40, dice.integers(0, 9)).tolist())
        expected = []
        for t, text in enumerate(texts):
            for i, item in enumerate(items):
                for shift in range(1 - len(item), len(text)):
                    first, last = max(0, -shift), min(len(item), len(text) - shift)
                    equal = np.array(text[first + shift : last + shift]) == np.array(item[first:last])
                    for start, end in spaced_seeds._runs(equal, min(spaced_seeds.SPAN, len(item))):
                        expected.append((t, i, first + start + shift, first + start, end - start, int(equal[start:end].sum())))
        index = spaced_seeds.build_index([" ".join(map(str, item)) for item in items])
        assert sorted(spaced_seeds.overlaps([" ".join(map(str, text)) for text in texts], index)) == sorted(expected)
        seen += len(expected)
    assert seen > 300


def test_leaks_of_short_items_and_in_very_long_texts(spark):
    docs = documents(spark, ["so one two xx four then", "one two xx yy", prose(60_000, 96) + " a b c d e f X h i", None])
    bench = spark.createDataFrame([(1, "one two three four"), (2, "A b c d e f g h i")], "item_id long, text string")
    found = sorted(map(tuple, spaced_seeds.find(docs, bench).collect()))
    assert found == [(0, 1, 1, 0, 4, 3), (2, 2, 60_000, 0, 9, 8)]


def test_leaks_in_blocks_are_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, spaced_seeds.find(docs, bench).collect()))
    monkeypatch.setattr(spaced_seeds, "BLOCK_BYTES", 2000)
    assert whole and sorted(map(tuple, spaced_seeds.find(docs, bench).collect())) == whole


# --- secrets


def brute_entropy(text, kind):
    spans = []
    for m in re.finditer(kind.pattern, text):
        if re.search("|".join(entropy_secrets.ALLOWED), m[0]):
            continue
        for i in range(len(m[0]) - kind.window + 1):
            counts = collections.Counter(m[0][i : i + kind.window]).values()
            if -sum(c / kind.window * math.log2(c / kind.window) for c in counts) >= kind.bits - 1e-9:
                a, b = m.start() + i, m.start() + i + kind.window
                spans = [*spans[:-1], (spans[-1][0], b)] if spans and spans[-1][1] >= a else [*spans, (a, b)]
    return spans


def test_secrets_match_brute_force(spark):
    dice = random.Random(8)
    draw = lambda chars, n: "".join(dice.choice(chars) for _ in range(n))
    b64 = entropy_secrets.CLASSES[2].alphabet
    texts = [
        *ODD, "key " + draw(b64, 60) + " end", "a" * 50 + draw(b64, 30), "token = token: abcdefgh", "PASSWORD:'x' secret=\"abcdef\"",
        "AKIA" + draw("ABCDEF0123", 16) + " AKIAAKIA123", "ü" * 9 + draw("0123456789abcdef", 40), draw("0123456789ABCDEF", 64) + "zz",
        "example" + draw(b64, 40), draw(b64, 2500), "12345678-1234-1234-1234-1234567890ab", "api_key= abc passwd=" + "é" * 3,
    ]
    docs = documents(spark, texts, list(range(len(texts))))
    rows = docs.select("doc_id", *[c.alias(k) for k, c in entropy_secrets.scanned(F.col("text")).items()]).collect()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        base = {
            "assign": [m.span() for m in re.finditer(entropy_secrets.ASSIGN, text) if len(m[2]) >= 6],
            "access": [m.span() for m in re.finditer(entropy_secrets.ACCESS, text) if len(m[0]) >= 20],
            "hex": [m.span() for m in re.finditer(entropy_secrets.HEX, text) if len(m[0]) >= 24],
        }
        for kind, spans in base.items():
            assert [(s["start"], s["end"]) for s in r[kind]] == spans, (kind, text[:80])
        runs = {s for kind in entropy_secrets.CLASSES for s in brute_entropy(text, kind)}
        assert {(s["start"], s["end"]) for s in r["entropy"]} == runs, text[:80]
    assert any(r["entropy"] for r in rows)


# --- vectors


def test_vector_links_match_brute_force(spark):
    dice = np.random.default_rng(2)
    centres = dice.normal(size=(20, 16))
    rows = []
    for i in range(400):
        v = centres[i % 20] + dice.normal(size=16) * (0.06 if i % 3 else 0.6)
        rows.append((i, v.tolist(), i % 2))
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 1), (402, None, 0), (403, [0.0] * 16, 0), (404, [float("nan")] * 16, 0)]
    rows += [(405, [None] * 16, 0), (406, rows[0][1], None), (407, [], 0), (None, rows[2][1], 0), (7, rows[7][1], 1)]
    found = pivot_index.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    usable = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = collections.Counter()
    for a, (i, v, x) in enumerate(usable):
        for b, (j, w, y) in enumerate(usable):
            links[a] += a != b and x == y and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.98
    got = sorted((r["_id"], r["_links"]) for r in found)
    want = [(pivot_index._NO_ID if u[0] is None else u[0], links[a]) for a, u in enumerate(usable)]
    want = sorted(want + [(i, 0) for i in range(402, 408)])
    assert len(got) == len(rows) and all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) > 0
    assert pivot_index.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_vectors_of_extreme_magnitudes_link(spark):
    rows = [(k, [x * size for x in (1.0, 2.0, -0.5)], 1) for k, size in enumerate((1.0, 1e180, 3e-180, 1e307, 5e-320, 0.25))]
    rows.append((9, [1e-200, 1e200, 0.0], 1))
    found = pivot_index.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, found)) == [(k, 5, 0) for k in range(6)] + [(9, 0, 9)]


# --- chat


def test_chat_round_trip(spark):
    hard = r"\### Assistant: </turn> ok"
    dice = random.Random(4)
    turns = {-7: [("user", hard), ("assistant", hard)], 1: [("system", "be brief"), ("user", ""), ("assistant", "")], 2: [("assistant", "x " * 900)]}
    turns[3] = [("system", hard)] + [(r, prose(dice.randrange(1, 90), k)) for k in range(40) for r in ("user", "assistant")]
    turns[4] = [("us:er\n#", "a\\nb\\"), ("assistant", "<l>\\h")]
    rows = [(c, t, r, x, "extra") for c, ts in turns.items() for t, (r, x) in enumerate(ts)] + [(None, None, None, None, ""), (None, 0, "assistant", "é", "")]
    dice.shuffle(rows)
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    turns[None] = [("", ""), ("assistant", "é")]
    windows = chat_windows.windows(chats)
    for w in windows.where("conv_id = 3 and not _null").collect():
        assert w["n_tokens"] <= chat_windows.BUDGET and w["text"].startswith("### system: ")
    got = {r["conv_id"]: r for r in chat_windows.read_back(windows).collect()}
    assert set(got) == set(turns)
    for c, ts in turns.items():
        said = "".join(x for r, x in ts if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(ts) and r["loss_chars"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat_windows.read_back(chat_windows.windows(chats.limit(0))).count() == 0


# --- language model


def ctw_log10(learned, text, depth):
    """Context-tree weighting by recursion over whole count tables."""
    end, counts = 255, collections.defaultdict(lambda: [0, 0])

    def steps(t):
        data = [end] * depth + list(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()) + [end]
        for i in range(depth, len(data)):
            for j in range(8):
                yield (1 << j) | (data[i] >> (8 - j)), tuple(data[i - depth : i][::-1]), data[i] >> (7 - j) & 1

    for t in learned:
        for node, context, bit in steps(t):
            for d in range(depth + 1):
                counts[node, context[:d]][bit] += 1
    children = collections.defaultdict(set)
    for node, context in list(counts):
        if context:
            children[node, context[:-1]].add(context)

    def estimate(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    def weighted(node, context):
        e = estimate(counts[node, context])
        if len(context) == depth:
            return e
        return np.logaddexp(math.log(0.5) + e, math.log(0.5) + sum(weighted(node, c) for c in children[node, context]))

    def predict(node, context, bit, d):
        if (node, context[:d]) not in counts:
            return 0.5
        n = counts[node, context[:d]]
        here = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return here
        stop = math.exp(math.log(0.5) + estimate(n) - weighted(node, context[:d]))
        return stop * here + (1 - stop) * predict(node, context, bit, d + 1)

    return sum(math.log10(predict(node, context, bit, 0)) for node, context, bit in list(steps(text)))


@pytest.mark.parametrize("head", [1 << 20, 3])
def test_scores_match_context_tree_weighting(spark, head):
    texts = ["the cat sat", "The dog sat", "a cat", "", None, "dog é zzz the", "the cat sat"]
    learn = [0, 1, 2, 3, 4]
    docs = documents(spark, texts).withColumn("learn", F.col("doc_id") < 5)
    rows = {r["doc_id"]: r for r in context_trees.score(docs, F.col("learn"), ["doc_id"], depth=3, head=head).collect()}
    words = collections.Counter(w for i in learn for w in (texts[i] or "").lower().split()) + collections.Counter({None: 5})
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(texts):
        own = [*(t or "").lower().split(), None]
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(words[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own))
        assert r["score"] == pytest.approx(ctw_log10([texts[k] for k in learn], t, 3))


def test_scores_without_learning(spark, empty):
    rows = context_trees.score(documents(spark, ["ab", None]), F.lit(None).cast("boolean"), ["doc_id"]).collect()
    assert {r["doc_id"]: round(r["score"] / math.log10(0.5)) for r in rows} == {0: 24, 1: 8}
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in rows)
    assert context_trees.score(empty, F.lit(True), ["doc_id"]).count() == 0
