"""I: posting search, profile matching at scale, digests, search state and name suggestions.

Profiles meet postings through their own stated fields: a field that is not set
is a wildcard. Each combination of set fields is one mask; postings are reduced
to the newest few per full combination of fields before they are repeated per
mask, so no group of postings is ever paired with a group of profiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.columns import any_of, first_match, total
from postmill.operators.market import apply_filters

# --- fixed values ----------------------------------------------------------

BASE_SCORE, ROLE_SCORE, GRADE_SCORE, GEO_SCORE = 20, 20, 15, 5
OVERLAP_SCORE, SKILL_SCORE, PLAN_SCORE, TOP_SCORE = 35, 25, 10, 100
LEVELS = [(75, "high"), (45, "medium")]
SHOWN_SKILLS = 8
# profile column, posting column
SEARCH_FIELDS = (
    ("target_role", "primary_role"), ("target_grade", "grade"), ("target_country", "country"),
    ("target_region", "region"), ("target_city", "city_normalized"), ("target_geo_scope", "geo_scope"),
)
DIGEST_FIELDS = (
    ("target_role", "primary_role"), ("target_grade", "grade_final"), ("target_city_tier", "city_tier"),
    ("target_work_mode", "work_mode"), ("target_domain", "domain"), ("target_country", "country"),
    ("target_region", "region"), ("target_city", "city_normalized"), ("target_geo_scope", "geo_scope"),
)

# ---------------------------------------------------------------------------


def norm(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def search_confidence(n: Column) -> Column:
    return F.when(n >= 30, "high").when(n >= 5, "medium").otherwise("low")


def search_postings(
    df: DataFrame, q: str, filters: dict[str, object] | None = None, skill: str | None = None, limit: int = 20, offset: int = 0
) -> DataFrame:
    """One page of postings whose title or snippet contains the text, newest first."""
    text = f"%{q}%"
    hits = df.where(F.col("title").ilike(text) | F.col("description_snippet").ilike(text))
    hits = apply_filters(hits, filters or {})
    if skill:
        hits = hits.where(F.array_contains("skills", skill))
    whole = hits.agg(F.count(F.lit(1)).alias("total"))
    page = hits.orderBy(F.desc_nulls_last("published_at"), "hh_vacancy_id").offset(offset).limit(limit)
    return page.join(whole).withColumn("confidence", search_confidence(F.col("total")))


def folded(value: Column) -> Column:
    """Case folded and otherwise as it is: spaces count, only an empty value is unset."""
    return F.lower(F.upper(F.coalesce(value, F.lit(""))))


def _set_mask(fields: Sequence[tuple[str, str]], form: Callable[[Column], Column]) -> Column:
    return total(F.when(form(F.col(t)) != "", F.lit(1 << i)).otherwise(0) for i, (t, _) in enumerate(fields))


def _masked(fields: Sequence[tuple[str, str]], mask: Column, side: int, form: Callable[[Column], Column]) -> Column:
    values = [
        F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, form(F.col(f[side]))).alias(f"f{i}") for i, f in enumerate(fields)
    ]
    return F.struct(mask.alias("mask"), *values)


def newest_per_profile(
    profiles: DataFrame, postings: DataFrame, fields: Sequence[tuple[str, str]], key: str, order: Sequence[Column], n: int,
    form: Callable[[Column], Column] = norm, prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(profile, posting) rows: the ``n`` first postings by ``order`` that equal all set fields of a profile.

    Values are compared in the given ``form``; one whose form is empty is unset.

    ``n`` is the page size of the feature. The first ``n`` of a coarse group are
    among the first ``n`` of its full combinations, so reducing those first
    loses nothing; ``row_number`` limits run before each shuffle.

    With ``prepare``, which adds columns to the page's rows, the page goes to all tasks and profiles are
    spread by ``key``, not by their fields: for fields with few values, where most profiles share a group.
    """
    fields = [(t, p) for t, p in fields if p in postings.columns and t in profiles.columns]
    asked = profiles.withColumn("_mask", _set_mask(fields, form))
    # at most 2^fields small integers
    masks = sorted(r[0] for r in asked.select("_mask").distinct().collect())
    full = F.lit((1 << len(fields)) - 1)
    finest = Window.partitionBy("_full").orderBy(*order)
    kept = postings.withColumn("_full", _masked(fields, full, 1, form)).withColumn("_rn", F.row_number().over(finest))
    kept = kept.where(F.col("_rn") <= n).drop("_rn", "_full")
    repeated = kept.withColumn("_m", F.explode(F.array(*[F.lit(m) for m in masks])))
    repeated = repeated.withColumn("_group", _masked(fields, F.col("_m"), 1, form)).drop("_m")
    # a posting with an empty value cannot match a set field; its struct holds "" there
    within = Window.partitionBy("_group").orderBy(*order)
    page = repeated.withColumn("position", F.row_number().over(within)).where(F.col("position") <= n)
    page = page.withColumnsRenamed({c: f"posting_{c}" for c in postings.columns})
    mine = asked.withColumn("_group", _masked(fields, F.col("_mask"), 0, form)).drop("_mask")
    if prepare is not None:
        # at most n rows per combination of the fields' values
        mine, page = mine.repartition(key), F.broadcast(prepare(page))
    return mine.join(page, "_group").drop("_group")


def digest_matches(profiles: DataFrame, postings: DataFrame, limit: int = 3) -> DataFrame:
    """The newest postings equal on all set fields and published since the last digest.

    Case does not count, spaces do: a field of blanks is set and matches blanks only.

    The newest ``limit`` of a group that are late enough are exactly the late
    enough ones among its newest ``limit``, so the time condition comes last.
    """
    order = [F.desc_nulls_last("published_at"), F.col("title"), F.col("url")]
    found = newest_per_profile(profiles, postings, DIGEST_FIELDS, "user_id", order, limit, folded)
    late = F.col("since").isNull() | F.coalesce(F.col("posting_published_at") >= F.col("since"), F.lit(False))
    return found.where(late & (F.coalesce("posting_title", F.lit("")) != "")).select(
        "user_id", "position", F.col("posting_title").alias("title"), F.col("posting_url").alias("url"),
        F.col("posting_published_at").alias("published_at"))


def _skill_keys(skills: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(skills, norm), lambda s: s != ""))


def _originals(keys: Column, skills: Column, normalized: Column) -> Column:
    """First spelling of each key."""
    return F.transform(keys, lambda k: F.element_at(skills, F.array_position(normalized, k).cast("int")))


def plan_relevance(actions: Column, posting_skills: Column, title: Column, some_skills: Column) -> Column:
    """I4: struct(kind, action_title): open action on a posting skill, else any practice, else the saved posting.

    ``actions`` is a user's short list of open actions in plan order:
    array<struct<title, skill_name, action_type>>.
    """
    by_skill = F.get(F.filter(actions, lambda a: (norm(a["skill_name"]) != "") & F.array_contains(posting_skills, norm(a["skill_name"]))), F.lit(0))
    practice = F.get(F.filter(actions, lambda a: a["action_type"] != "saved_vacancy"), F.lit(0))
    saved = F.get(F.filter(actions, lambda a: (a["action_type"] == "saved_vacancy") & (norm(a["title"]) == norm(title))), F.lit(0))
    return (
        F.when(by_skill.isNotNull(), F.struct(F.lit("skill").alias("kind"), by_skill["title"].alias("action_title")))
        .when(some_skills & practice.isNotNull(), F.struct(F.lit("practice").alias("kind"), practice["title"].alias("action_title")))
        .when(saved.isNotNull(), F.struct(F.lit("saved").alias("kind"), saved["title"].alias("action_title"))))


def _with_own(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("_own", _skill_keys(F.coalesce("current_skills", F.array().cast("array<string>"))))


def _with_keys(postings: DataFrame) -> DataFrame:
    offered = F.coalesce("posting_skills", F.array().cast("array<string>"))
    return postings.withColumn("_offered", offered).withColumns({
        "_keys": _skill_keys(F.col("_offered")), "_spelled": F.transform("_offered", norm)})


def match_score(pairs: DataFrame, skill: str | None = None) -> DataFrame:
    """I2-I4 over (profile, posting) rows.

    Profile columns: target_*, current_skills, open_actions. Posting columns carry
    the prefix ``posting_``. Adds matched and missing skills, plan relevance,
    score and level.
    """
    empty = F.array().cast("array<string>")
    pairs = pairs.withColumns({t: F.lit(None).cast("string") for t, _ in SEARCH_FIELDS if t not in pairs.columns} or {})
    # where profiles and postings were paired many times, each side has its own columns already
    pairs = pairs if "_own" in pairs.columns else _with_own(pairs)
    pairs = pairs if "_keys" in pairs.columns else _with_keys(pairs)
    wanted = F.lit((skill or "").strip().lower())
    asked = (wanted != "") & F.array_contains("_keys", wanted)
    common = F.array_intersect("_keys", "_own")
    pairs = pairs.withColumn("_common", F.array_sort(F.when(asked, F.array_union(common, F.array(wanted))).otherwise(common)))
    has_own = F.size("_own") > 0
    pairs = pairs.withColumns({
        "matched_skills": F.slice(_originals(F.col("_common"), F.col("_offered"), F.col("_spelled")), 1, SHOWN_SKILLS),
        "missing_skills": F.when(has_own, F.slice(
            _originals(F.array_except("_keys", "_own"), F.col("_offered"), F.col("_spelled")), 1, SHOWN_SKILLS)).otherwise(empty),
    })
    some = (F.size("matched_skills") > 0) | (F.size("missing_skills") > 0)
    actions = F.col("open_actions") if "open_actions" in pairs.columns else F.lit(None).cast(
        "array<struct<title:string,skill_name:string,action_type:string>>")
    pairs = pairs.withColumn("plan_relevance", plan_relevance(actions, F.col("_keys"), F.col("posting_title"), some))

    def same(target: str, *columns: str) -> Column:
        present = [norm(F.col(f"posting_{c}")) == norm(F.col(target)) for c in columns if f"posting_{c}" in pairs.columns]
        return (norm(F.col(target)) != "") & any_of(present)

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    signal = any_of([norm(F.col(t)) != "" for t, _ in SEARCH_FIELDS]) | has_own | (wanted != "")
    both = (F.size("_keys") > 0) & has_own
    overlap = F.bround(F.size("_common") / F.greatest(F.size("_keys"), F.lit(1)) * OVERLAP_SCORE, 0).cast("int")
    raw = (
        points(signal, BASE_SCORE) + points(same("target_role", "primary_role"), ROLE_SCORE)
        + points(same("target_grade", "grade"), GRADE_SCORE) + points(same("target_country", "country"), GEO_SCORE)
        + points(same("target_region", "region"), GEO_SCORE)
        + points(same("target_city", "city_normalized", "city"), GEO_SCORE)
        + points(same("target_geo_scope", "geo_scope"), GEO_SCORE)
        + F.when(both, overlap).when(asked, SKILL_SCORE).otherwise(0)
    )
    planned = F.col("plan_relevance").isNotNull()
    score = F.when(signal | planned, F.least(raw + points(planned, PLAN_SCORE), F.lit(TOP_SCORE)))
    level = first_match([(F.col("match_score") >= n, label) for n, label in LEVELS], "low")
    return pairs.withColumn("match_score", score).withColumn(
        "match_level", F.when(F.col("match_score").isNull(), "unknown").otherwise(level)
    ).drop("_offered", "_own", "_keys", "_spelled", "_common")


def match_profiles(profiles: DataFrame, postings: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """I2 for all profiles: every posting of the requested search page by role and grade, with its score.

    ``limit`` and ``offset`` are the page a request asks for, newest postings first;
    ``rank`` orders the page's own rows by score.
    """
    order = [F.desc_nulls_last("published_at"), F.col("hh_vacancy_id")]
    pairs = newest_per_profile(
        _with_own(profiles), postings, SEARCH_FIELDS[:2], "user_id", order, offset + limit, prepare=_with_keys)
    scored = match_score(pairs.where(F.col("position") > offset))
    best = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("match_score"), "position")
    return scored.withColumn("rank", F.row_number().over(best))


def search_state(index_status: Column, used_fallback: Column, warnings: Column) -> Column:
    """I6."""
    return (
        F.when(used_fallback, "fallback").when(index_status.isNull() | (index_status == "not_configured"), "unavailable")
        .when((index_status != "success") | (F.coalesce(F.size(warnings), F.lit(0)) > 0), "degraded").otherwise("ready"))


def trust_tier(state: Column | None, confidence: Column, freshness: Column) -> Column:
    """Degraded search first (when a state is given), then stale data, then the sample."""
    rest = (
        F.when(freshness == "stale", "stale_data").when(confidence.isin("low", "medium"), "limited_sample")
        .when(confidence == "high", "trusted").otherwise("unknown"))
    return rest if state is None else F.when(state != "ready", "degraded_search").otherwise(rest)


def suggest_names(names: DataFrame, column: str, known: Sequence[str], n: int = 5, cutoff: float = 0.4) -> DataFrame:
    """The ``n`` closest known names for each distinct unknown name, best first, then by name.

    ``known`` is the skill vocabulary, one entry per flag column. Closeness is 1 - edits / longer length.
    A pair that reaches ``cutoff`` shares a letter, since a name without common letters is all
    edits, and the shorter name is at least ``cutoff`` of the longer one: names meet on their letters, under
    that bound of lengths, and only those pairs are scored. Names without a close one
    have an empty list; NULL names are left out.
    """
    spark = names.sparkSession
    vocabulary = list(dict.fromkeys(k.strip().lower().removeprefix("skill_").removeprefix("has_") for k in known))
    letters = lambda c: F.array_distinct(F.split(c, ""))
    words = spark.createDataFrame([(k,) for k in vocabulary], "_known string")
    words = words.select("_known", F.explode(letters(F.col("_known"))).alias("_letter"))
    unknown = names.select(F.col(column).cast("string").alias("_name")).where(F.col("_name").isNotNull()).distinct()
    unknown = unknown.join(F.broadcast(words.select(F.col("_known").alias("_name")).distinct()), "_name", "left_anti")
    spelled = unknown.select("_name", F.explode_outer(letters(F.col("_name"))).alias("_letter"))
    short, long = F.least(F.length("_name"), F.length("_known")), F.greatest(F.length("_name"), F.length("_known"))
    near = (F.col("_own") == F.col("_letter")) & (short >= F.lit(float(cutoff)) * long)
    # the vocabulary is a list of columns, so its letters are few rows
    met = spelled.withColumnRenamed("_letter", "_own").join(F.broadcast(words), near, "left").select("_name", "_known").distinct()
    score = 1 - F.levenshtein("_name", "_known") / long
    scored = met.withColumn("_far", F.when(score >= F.lit(float(cutoff)), -score))
    best = F.slice(F.array_sort(F.collect_list(F.when(F.col("_far").isNotNull(), F.struct("_far", "_known")))), 1, n)
    found = scored.groupBy("_name").agg(F.transform(best, lambda x: x["_known"]).alias("suggestions"))
    return found.withColumnRenamed("_name", column)
