"""Posting features as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.columns import (
    any_of, column_groups, contains_any, dtype, first_existing, first_match, flag, flag_int, prefixed_flags, total,
    whole_days,
)
from postmill.functions.fixed_values import (
    AREA_DEFAULTS, CITY_ALIASES, CORE_DATA_SKILLS, COUNTRY_WORDS, GRADE_BY_TEXT, GRADE_BY_YEARS, KAZAKH_WORDS,
    MILLION_CITIES, ML_SKILLS, MOSCOW_WORDS, PETERSBURG_WORDS, ROLE_PRIORITY, ROLE_TITLE_WORDS,
)
from postmill.operators.quantiles import grouped_quantiles


def _timestamp(df: DataFrame, name: str) -> Column:
    if isinstance(dtype(df, name), T.StringType):
        return F.try_to_timestamp(F.trim(F.col(name)))
    return F.col(name).cast("timestamp")


def _col_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def add_time_features(df: DataFrame, published: str = "published_at_iso", scraped: str = "scraped_at_utc") -> DataFrame:
    """Weekday (Monday 0), month, weekend flag and age in whole days."""
    if published not in df.columns:
        return df.withColumns({
            "published_weekday": F.lit(None).cast("int"), "published_month": F.lit(None).cast("int"),
            "is_weekend_post": F.lit(None).cast("boolean"), "vacancy_age_days": F.lit(None).cast("int"),
        })
    when = _timestamp(df, published)
    age = whole_days(_timestamp(df, scraped), when) if scraped in df.columns else F.lit(None).cast("int")
    return df.withColumns({
        "published_weekday": F.weekday(when),
        "published_month": F.month(when),
        "is_weekend_post": F.coalesce(F.weekday(when).isin(5, 6), F.lit(False)),
        "vacancy_age_days": age,
    })


def city_tier(city: Column, lowered: Column | None = None) -> Column:
    """C2; ``lowered`` may be a column that already holds the lower-cased city."""
    name = F.lower(city) if lowered is None else lowered
    return first_match([
        (city.isNull(), "unknown"),
        (contains_any(name, MOSCOW_WORDS), "Moscow"),
        (contains_any(name, PETERSBURG_WORDS), "SPb"),
        (name.isin(*MILLION_CITIES), "Million+"),
        (contains_any(name, KAZAKH_WORDS), "KZ/Other"),
    ], "Other RU")


def add_city_tier(df: DataFrame, city: str = "city") -> DataFrame:
    raw = _col_or_null(df, city, "string")
    # lower-cased once per row, as a column of its own
    lowered = df.withColumn("_lower", F.lower(raw))
    return lowered.withColumn("city_tier", city_tier(raw, F.col("_lower"))).drop("_lower")


def _picked(index: Column, values: Sequence[str], otherwise: Column) -> Column:
    """Value by 1-based index, 0 taking ``otherwise``."""
    return F.when(index > 0, F.element_at(F.array(*[F.lit(v) for v in values]), index)).otherwise(otherwise)


def _rule_index(lowered: Column, words: Sequence[Sequence[str]]) -> Column:
    """Number of the first rule one of whose words occurs, 0 for none."""
    return first_match([(contains_any(lowered, ws), F.lit(i)) for i, ws in enumerate(words, 1)], F.lit(0))


def add_places(df: DataFrame, city: Column, area: Column) -> DataFrame:
    """Country, region and city by alias, else country word over the area default.

    The word rules run once per row and leave an index; names are looked up by it.
    """
    areas = list(AREA_DEFAULTS)
    df = df.withColumn("_raw", F.coalesce(F.trim(city), F.lit(""))).withColumn("_lower", F.lower("_raw"))
    df = df.withColumns({
        "_alias": _rule_index(F.col("_lower"), [a[3] for a in CITY_ALIASES]),
        "_area": first_match([(area == k, F.lit(i)) for i, k in enumerate(areas, 1)], F.lit(0)),
    })
    by_word = F.when(F.col("_alias") == 0, _rule_index(F.col("_lower"), [ws for _, ws in COUNTRY_WORDS])).otherwise(0)
    df = df.withColumn("_word", by_word)
    defaults = [_picked(F.col("_area"), [AREA_DEFAULTS[k][i] for k in areas], F.lit("unknown")) for i in range(3)]
    collapsed = F.trim(F.regexp_replace(F.col("_raw"), r"(?U)\s+", " "))
    shown = F.when(collapsed != "", F.substring(collapsed, 1, 100)).otherwise("unknown")
    named = F.when(defaults[2] == "unknown", shown).otherwise(defaults[2])
    country = _picked(F.col("_word"), [c for c, _ in COUNTRY_WORDS], defaults[0])
    return df.withColumns({
        "country": _picked(F.col("_alias"), [a[0] for a in CITY_ALIASES], country),
        "region": _picked(F.col("_alias"), [a[1] for a in CITY_ALIASES], defaults[1]),
        "city_normalized": _picked(F.col("_alias"), [a[2] for a in CITY_ALIASES], named),
    }).drop("_raw", "_lower", "_alias", "_area", "_word")


def geo_scope(work_mode: Column, is_remote: Column, is_hybrid: Column) -> Column:
    """C4."""
    mode = F.lower(F.trim(F.coalesce(work_mode, F.lit(""))))
    return first_match([
        ((mode == "remote") | flag(is_remote), "remote"),
        ((mode == "hybrid") | flag(is_hybrid), "mixed"),
        (mode.isin("office", "field"), "local"),
    ], "unknown")


def add_geography(df: DataFrame, city: str = "city", area: str = "search_area_id") -> DataFrame:
    """C3 and C4."""
    area_id = F.col(area).try_cast("int") if area in df.columns else F.lit(None).cast("int")
    scope = geo_scope(
        _col_or_null(df, "work_mode", "string"), _col_or_null(df, "is_remote", "boolean"),
        _col_or_null(df, "is_hybrid", "boolean"),
    )
    df = add_places(df, _col_or_null(df, city, "string"), area_id).withColumn("geo_scope", scope)
    return df.withColumn("remote_geo_eligible", F.col("geo_scope").isin("remote", "mixed"))


def add_work_mode(df: DataFrame) -> DataFrame:
    """A valid explicit format wins, then the remote flag, then the hybrid flag."""
    stated = _col_or_null(df, "work_format", "string")
    return df.withColumn("work_mode", first_match([
        (F.coalesce(stated.isin("remote", "hybrid", "office", "field"), F.lit(False)), stated),
        (flag(_col_or_null(df, "is_remote", "boolean")), "remote"),
        (flag(_col_or_null(df, "is_hybrid", "boolean")), "hybrid"),
    ], "unknown"))


def add_experience_flags(df: DataFrame) -> DataFrame:
    """C6."""
    names = [c for c in ("is_for_juniors", "allows_students", "exp_is_no_experience") if c in df.columns]
    if not names:
        return df
    friendly = any_of(flag(c) for c in names)
    return df.withColumns({"is_junior_friendly": friendly, "battle_experience": ~friendly})


COUNTED_PREFIXES = {
    "benefit_": "benefits_count", "soft_": "soft_skills_count", "has_": "hard_stack_count",
    "skill_": "skills_count", "role_": "role_count",
}


def add_boolean_counts(df: DataFrame, flags: Sequence[str] | None = None) -> DataFrame:
    """Number of true flags per prefix; ``flags`` limits the flags that count."""
    known = list(flags) if flags is not None else df.columns
    out = {}
    for prefix, target in COUNTED_PREFIXES.items():
        names = [c for c in prefixed_flags(df, prefix) if c in known]
        if names:
            out[target] = total(flag_int(c) for c in names)
    return df.withColumns(out) if out else df


def add_stack_aggregates(df: DataFrame) -> DataFrame:
    """C8."""
    def count(names: Sequence[str]) -> Column:
        return total(flag_int(c) for c in names if c in df.columns)

    return df.withColumns({
        "core_data_skills_count": count(CORE_DATA_SKILLS),
        "ml_stack_count": count(ML_SKILLS),
        "tech_stack_size": count(prefixed_flags(df, "has_", "skill_")),
    })


def grade_from_experience(years: Column, no_experience: Column, text: Column) -> Column:
    """C9."""
    raw = F.lower(text)
    by_years = first_match([(years < hi, g) for hi, g in GRADE_BY_YEARS], "lead")
    by_text = [(F.coalesce(contains_any(raw, words), F.lit(False)), g) for words, g in GRADE_BY_TEXT]
    return first_match([(flag(no_experience), "intern"), (years.isNotNull(), by_years), *by_text], "unknown")


def add_grades(df: DataFrame) -> DataFrame:
    """Grade from experience, and the final grade."""
    years = [F.expr(f"try_cast({c} AS double)") for c in ("exp_min_years", "exp_max_years") if c in df.columns]
    base = F.coalesce(*years) if years else F.lit(None).cast("double")
    derived = grade_from_experience(
        base, _col_or_null(df, "exp_is_no_experience", "boolean"), _col_or_null(df, "experience", "string")
    )
    df = df.withColumn("grade_from_experience", derived)
    final = (F.when(F.coalesce(F.col("grade") != "unknown", F.lit(True)), F.col("grade"))
             .otherwise(F.col("grade_from_experience")) if "grade" in df.columns else F.col("grade_from_experience"))
    return df.withColumn("grade_final", final)


def primary_role(df: DataFrame) -> Column:
    """First true flag by priority, else first word group found in the title."""
    title = _col_or_null(df, first_existing(df, "title", "name") or "title", "string")
    if "title" in df.columns and "name" in df.columns:
        title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("name"))
    lowered = F.coalesce(F.lower(title), F.lit(""))
    flags = [(flag(c), c.removeprefix("role_")) for c in ROLE_PRIORITY if c in df.columns]
    words = [(contains_any(lowered, ws), role) for role, ws in ROLE_TITLE_WORDS]
    return first_match(flags + words, "other")


def add_primary_role(df: DataFrame) -> DataFrame:
    return df.withColumn("primary_role", primary_role(df))


def add_salary_bucket(
    df: DataFrame, salary: str = "salary_mid_rub_capped", labels: Sequence[str] = ("low", "mid", "high")
) -> DataFrame:
    """C11: equal-frequency bins, right-closed; equal edges merge into the lower bin."""
    if salary not in df.columns:
        return df.withColumns({salary: F.lit(None).cast("double"), "salary_bucket": F.lit(None).cast("string")})
    k = len(labels)
    edges = {f"_e{i}": i / k for i in range(1, k)}
    bounds = grouped_quantiles(df, [], salary, edges)
    size = df.agg(F.count(salary).alias("_size"))
    bucket = first_match(
        [(F.col(salary).isNull() | (F.col("_size") < k), F.lit(None).cast("string"))]
        + [(F.col(salary) <= F.col(e), label) for e, label in zip(edges, labels)],
        labels[-1],
    )
    return (
        df.join(F.broadcast(size)).join(F.broadcast(bounds), F.lit(True), "left")
        .withColumn("salary_bucket", bucket).drop("_size", *edges)
    )


def word_count(text: Column) -> Column:
    """Whitespace tokens of a text, NULL as 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def add_text_sizes(df: DataFrame) -> DataFrame:
    """C12."""
    out = {}
    if "description" in df.columns:
        out["description_len_chars"] = F.length(F.coalesce("description", F.lit("")))
        out["description_len_words"] = word_count(F.col("description"))
    for name, target in {
        "requirements": "requirements_count", "responsibilities": "responsibilities_count",
        "must_have_skills": "must_have_skills_count", "optional_skills": "optional_skills_count",
    }.items():
        if name in df.columns:
            out[target] = word_count(F.col(name))
    return df.withColumns(out) if out else df


_DEFAULTS = {
    "int": {"published_weekday": None, "vacancy_age_days": None, "core_data_skills_count": 0, "ml_stack_count": 0,
            "tech_stack_size": 0, "benefits_count": 0, "soft_skills_count": 0, "role_count": 0},
    "string": {"country": "unknown", "region": "unknown", "city_normalized": "unknown", "geo_scope": "unknown",
               "city_tier": "unknown", "work_mode": "unknown", "grade_from_experience": "unknown",
               "grade_final": "unknown", "primary_role": "other", "salary_bucket": None},
    "boolean": {"remote_geo_eligible": None, "is_junior_friendly": None, "battle_experience": None},
}


def ensure_feature_columns(df: DataFrame) -> DataFrame:
    """Derived columns that are still absent get their default."""
    missing = {
        name: F.lit(value).cast(kind)
        for kind, values in _DEFAULTS.items() for name, value in values.items() if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def assemble_features(df: DataFrame) -> DataFrame:
    """C14: all posting features in one plan."""
    groups = [c for names in column_groups(df).values() for c in names]
    df = add_city_tier(add_time_features(df))
    df = add_geography(add_work_mode(df))
    df = add_boolean_counts(df, groups)
    df = add_experience_flags(add_stack_aggregates(df))
    df = add_primary_role(add_grades(df))
    return ensure_feature_columns(add_text_sizes(add_salary_bucket(df)))
