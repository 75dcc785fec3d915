"""One query per corpus operator, over its whole table, and the SQL it must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import best_fit_packing, budget_mix, chat_windows, chosen_path, context_trees, kd_sharding, lyndon_suffixes, periodic_runs, phrase_mining, pivot_index, preference_quality, spaced_seeds
from postmill.llm import entropy_secrets as secrets
from postmill.llm.common import WORD, gapless_ranks, table, utf8_size, word_count
from postmill.session import materialize

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


@query("op1_kd_sharding")
def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of about equal bytes."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", (utf8_size(F.col("text")) + 1).alias("size"), F.crc32("text").alias("text_crc32"),
        F.array(*kd_sharding.document_coordinates(docs)).alias("_at"),
    )
    at = [F.element_at("_at", i + 1) for i in range(3)]
    rows = kd_sharding.prepared(rows, at, F.col("size"), ["doc_id", "size", "text_crc32"]).drop("_at")
    tree, rows = kd_sharding.fit(rows, shards=8)
    rows = kd_sharding.numbered(rows, tree, "shard").withColumn("_key", F.xxhash64("doc_id", "size", "text_crc32"))
    rows = gapless_ranks(rows, ["shard"], [F.col("_key")], F.col("_key"), "slot")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_chosen_path_join")
def op2_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, component and number of links of every document."""
    found = chosen_path.join_texts(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("_id").alias("doc_id"), F.col("_class").alias("class_id"), F.col("_group").alias("component_id"),
        F.col("_links").alias("n_links"),
    )


@query("op3_preference_quality")
def op3_preference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    ranking = preference_quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = docs.select("doc_id", preference_quality.scored(ranking, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op4_lyndon_suffixes")
def op4_lyndon_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that start elsewhere too."""
    return lyndon_suffixes.digests(table(spark, sf_dir, "documents"))


@query("op5_budget_mix")
def op5_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = budget_mix.counted(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.crc32("text").alias("_crc")))
    mixed = budget_mix.mix(rows, F.col("source"), F.col("size"), ["doc_id", "_crc"])
    return mixed.select(
        "doc_id", "size", F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"),
        (F.col("size") * F.col("_times")).cast("long").alias("taken"),
    )


@query("op6_spaced_seeds")
def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of documents with benchmark items."""
    return spaced_seeds.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_entropy_secrets")
def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    kinds = ("assign", "access", "hex")
    docs = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in secrets.scanned(F.col("text")).items()])
    base = F.concat(*[secrets.labelled(F.col(kind), kind, i) for i, kind in enumerate(kinds)])
    rows = docs.select("doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in kinds], base.alias("_base"), "entropy")
    more = secrets.labelled(secrets.outside(F.col("entropy"), F.col("_base")), "entropy", 3)
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined(F.col("_base")), 256).alias("base_sha256"),
        secrets.joined(F.concat("_base", more)).alias("spans"),
    )


@query("op8_pivot_index")
def op8_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    found = pivot_index.link_vectors(table(spark, sf_dir, "embeddings"))
    vec, least = pivot_index.real_id("_id"), pivot_index.real_id("_component")
    return found.select(
        vec.alias("vec_id"), F.col("_links").alias("n_links"), least.alias("component_id"), vec.eqNullSafe(least).alias("kept")
    )


@query("op9_chat_windows")
def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted windows of every conversation say, and of one whose texts look like control strings."""
    hard = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(
        [(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"
    ))
    return chat_windows.read_back(chat_windows.windows(rows))


@query("op10_context_trees")
def op10_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = context_trees.score(table(spark, sf_dir, "documents"), ~held_out, ["doc_id"])
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"
    )


@query("op11_best_fit_packing")
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = best_fit_packing.pieces(table(spark, sf_dir, "documents"), "text", ["doc_id"], path)
    found = found.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = best_fit_packing.pack(materialize(found, "packing-pieces"), ["doc_id", "piece"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op12_phrase_mining", """
    with docs as (
        select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
        from documents
    ), pieces as (
        select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from docs
    ), lists as (
        select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
    ), spans as (
        select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from lists, range(1, 6) as ks(k) where len(w) >= k
    ), counts as (
        select lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') as phrase, count(*) as f from spans group by all
    ), totals as (
        select lang, sum(f) as n from counts where k = 1 group by lang
    ), phrases as (
        select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counts where k > 1 and f >= 100
    ), inner_parts as (
        select lang, k, a, w, m, unnest(range(1, k - m + 2)) as i from phrases, range(2, 5) as ms(m) where m < k
    ), longer as (
        select lang, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') as phrase, max(a) as longest from inner_parts group by all
    ), kept as (
        select p.* from phrases p left join longer using (lang, phrase) where longest is null or 100 * longest < 100 * a
    ), cuts as (
        select lang, phrase, a, c, list_aggregate(w[1:c], 'string_agg', ' ') as head, list_aggregate(w[c + 1:k], 'string_agg', ' ') as tail
        from kept, range(1, 5) as cs(c) where c < k
    ), scores as (
        select c.lang, c.phrase, c.a, c.c, x.f as l, y.f as r, n, (1000::hugeint * c.a * n) // (x.f::hugeint * y.f) as score
        from cuts c join counts x on x.lang = c.lang and x.phrase = c.head join counts y on y.lang = c.lang and y.phrase = c.tail
        join totals t on t.lang = c.lang
    ), weakest as (
        select * from scores qualify row_number() over (partition by lang, phrase order by score, c) = 1
    ), ranked as (
        select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from weakest
    )
    select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
""")
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest 2000 phrases of each language."""
    found = phrase_mining.top(phrase_mining.mine(table(spark, sf_dir, "documents"), "text", "lang"), 2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``text``): in every tenth document by the hash of its id, words repeat from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))).alias("_words"))
    rows = rows.withColumn("_n", F.greatest(F.size("_words"), F.lit(0)).cast("long"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", (F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (F.lit(3) + F.col("_g") % 8))).cast("int"))
    left = (F.col("_n") - F.col("_a")).cast("int")
    copies = F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil(left / F.col("_p")).cast("int"))
    words = F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(F.flatten(copies), F.lit(1), left))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document and its text without their repeats, as digests."""
    docs = with_planted_runs(table(spark, sf_dir, "documents"))
    rows = periodic_runs.periodic_runs(docs, "text").withColumn(
        "_longest", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    )
    lines = F.transform(
        F.array_sort(F.transform("runs", lambda r: F.struct(r["start"].alias("s"), r["period"].alias("p"), r["length"].alias("n")))),
        lambda r: F.concat(r["s"], F.lit(","), r["n"], F.lit(","), r["p"], F.lit("\n")),
    )
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_longest.s")).alias("start"), F.col("_longest.n").alias("length"),
        (-F.col("_longest.p")).alias("period"), F.expr("1000 * _longest.n div -_longest.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
