"""D: grouped salary, skill, benefit and employer statistics, and chart data.

Group keys that are NULL are dropped. Quantiles are exact and interpolated; see
``operators.quantiles``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.columns import (
    NUMERIC, columns_of, first_match, flag_int, not_null_keys, prefixed_flags, share, total, wide_to_long,
)
from postmill.functions.fixed_values import NOT_HARD_SKILLS
from postmill.functions.normalize import (
    ENGLISH_ORDER, category_rank, normalize_education_level, normalize_english_level,
)
from postmill.operators.market import primary_domain
from postmill.operators.quantiles import quantiles_of_counters, quantiles_of_counts, value_counts, with_quantiles
from postmill.session import materialize

SALARY = "salary_mid_rub_capped"


def skill_columns(df: DataFrame) -> list[str]:
    """Skill flags without the three non-skills, sorted."""
    return sorted(c for c in prefixed_flags(df, "skill_", "has_") if c not in NOT_HARD_SKILLS)


def _salary_stats(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], salary: str, probs: Mapping[str, float]
) -> DataFrame:
    rows = not_null_keys(df, keys)
    return with_quantiles(rows.groupBy(*keys).agg(*aggregates), rows, keys, salary, probs)


def salary_by_group(df: DataFrame, group: str, salary: str = SALARY, top_n: int | None = None) -> DataFrame:
    """D1."""
    out = _salary_stats(df, [group], [
        F.count(salary).alias("n"), F.avg(salary).alias("mean"), F.min(salary).alias("min"), F.max(salary).alias("max"),
    ], salary, {"median": 0.5}).orderBy(F.desc_nulls_last("median"), group)
    return out.limit(top_n) if top_n else out


def salary_pivot(
    df: DataFrame, a: str, b: str, b_values: Sequence[str], salary: str = SALARY, agg: str = "median"
) -> DataFrame:
    """One row per ``a``, one column per value of ``b``; rows without any value are dropped."""
    rows = not_null_keys(df, [a, b]).where(F.col(salary).isNotNull())
    if agg == "median":
        cells = quantiles_of_counts(value_counts(rows, [a, b], salary), {"cell": 0.5}).select("_key.*", "cell")
    else:
        cells = rows.groupBy(a, b).agg(F.expr(f"{agg}({salary})").alias("cell"))
    return cells.groupBy(a).pivot(b, list(b_values)).agg(F.first("cell")).orderBy(a)


def salary_summary(
    df: DataFrame, category: str, salary: str = SALARY, categories: DataFrame | None = None
) -> DataFrame:
    """D3: n, median, mean, sample standard deviation; listed categories are kept with n = 0."""
    out = _salary_stats(df, [category], [
        F.count(salary).alias("n"), F.avg(salary).alias("mean"), F.stddev_samp(salary).alias("std"),
    ], salary, {"median": 0.5})
    if categories is not None:
        out = categories.select(category).distinct().join(out, category, "left").fillna(0, ["n"])
    return out


def salary_by_experience_bucket(df: DataFrame, salary: str = SALARY) -> DataFrame:
    """Rows without years land in the first bucket."""
    years = [F.col(c) for c in ("exp_min_years", "exp_max_years") if c in df.columns]
    if not years:
        raise ValueError("expected exp_min_years or exp_max_years")
    base = F.coalesce(*years, F.lit(-1))
    bucket = (
        F.when((base >= -1) & (base <= 1), "0-1").when((base > 1) & (base <= 3), "1-3")
        .when((base > 3) & (base <= 6), "3-6").when((base > 6) & (base <= 100), "6+")
    )
    return salary_summary(df.withColumn("exp_bucket", bucket), "exp_bucket", salary)


def salary_by_stack_size(
    df: DataFrame, salary: str = SALARY, bins: Sequence[int] = (0, 3, 6, 10, 100)
) -> DataFrame:
    """Left-closed bins; the last bin also holds its right edge."""
    size = F.col("tech_stack_size")
    cases = []
    for i, (lo, hi) in enumerate(zip(bins, bins[1:])):
        last = i == len(bins) - 2
        cases.append(((size >= lo) & ((size <= hi) if last else (size < hi)), f">={lo}" if last else f"{lo}-{hi}"))
    return salary_summary(df.withColumn("tech_stack_bin", first_match(cases, None)), "tech_stack_bin", salary)


def _requirement_stats(df: DataFrame, key: str, salary: str) -> DataFrame:
    """Salaried rows, quartiles and their share in all rows."""
    names = {"salary_q25": 0.25, "salary_median": 0.5, "salary_q75": 0.75}
    per_key = df.groupBy(key).agg(F.count(salary).alias("vacancy_count"), F.count(F.lit(1)).alias("_rows"))
    whole = per_key.agg(F.sum("_rows").alias("_all"))
    out = with_quantiles(per_key.where(F.col(key).isNotNull()), df, [key], salary, names)
    return out.join(whole).withColumn("share", F.col("vacancy_count") / F.col("_all")).drop("_rows", "_all")


def english_requirement_stats(df: DataFrame, salary: str = SALARY) -> DataFrame:
    """D7."""
    level = normalize_english_level(
        F.col("lang_english_level") if "lang_english_level" in df.columns else F.lit(None).cast("string"),
        F.col("lang_english_required") if "lang_english_required" in df.columns else F.lit(None).cast("boolean"),
    )
    out = _requirement_stats(df.withColumn("english_level", level), "english_level", salary)
    return out.orderBy(category_rank(F.col("english_level"), ENGLISH_ORDER))


def education_requirement_stats(df: DataFrame, salary: str = SALARY) -> DataFrame:
    """D8."""
    level = normalize_education_level(
        F.col("edu_level") if "edu_level" in df.columns else F.lit(None).cast("string"),
        F.col("edu_required") if "edu_required" in df.columns else F.lit(None).cast("boolean"),
        F.col("edu_technical") if "edu_technical" in df.columns else F.lit(None).cast("boolean"),
    )
    out = _requirement_stats(df.withColumn("education_level", level), "education_level", salary)
    return out.orderBy(F.desc("vacancy_count"), "education_level")


def salary_by_domain(df: DataFrame, salary: str = SALARY, priorities: Sequence[str] = ()) -> DataFrame:
    """Domain columns are tried by priority, then by name."""
    names = sorted(prefixed_flags(df, "domain_"))
    first = [f"domain_{p}" for p in priorities if f"domain_{p}" in names]
    ordered = first + [n for n in names if n not in first]
    out = _requirement_stats(df.withColumn("domain", primary_domain(ordered)), "domain", salary)
    return out.orderBy(F.desc("vacancy_count"), "domain")


def salary_by_grade_and_city(df: DataFrame, grade: str = "grade_final", salary: str = SALARY) -> DataFrame:
    """D10."""
    return _salary_stats(df, [grade, "city_tier"], [F.count(salary).alias("count")], salary,
                         {"median": 0.5, "q1": 0.25, "q3": 0.75})


def salary_by_role_and_work_mode(df: DataFrame, salary: str = SALARY) -> DataFrame:
    """Groups without a salary keep a NULL median."""
    out = _salary_stats(df, ["primary_role", "work_mode"], [F.lit(1).alias("_one")], salary, {"salary_median": 0.5})
    return out.drop("_one")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson as (left, right, corr) rows, from one aggregate."""
    names = list(columns) if columns is not None else columns_of(df, NUMERIC)
    pairs = list(combinations_with_replacement(names, 2))

    def corr(a: str, b: str) -> Column:
        # both columns NULL unless both are present, so each pair uses its complete rows
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.corr(F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double")))

    wide = df.agg(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(a, b).alias("corr")) for a, b in pairs
    ]).alias("cells"))
    half = wide.select(F.explode("cells").alias("c")).select("c.*")
    mirrored = half.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    return half.unionByName(mirrored).withColumnsRenamed({"a": "left", "b": "right"})


def soft_skill_correlation(df: DataFrame) -> DataFrame:
    """D13."""
    soft = prefixed_flags(df, "soft_")
    return correlation_matrix(df.select(*[flag_int(c).alias(c) for c in soft]), soft)


def top_values(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """D14."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column).limit(n)


def _aggregated_flags(df: DataFrame, keys: Sequence[str], flags: Sequence[str], how, label: str, value: str) -> DataFrame:
    """One aggregated row per key, unpivoted afterwards to a row per flag."""
    wide = df.groupBy(*keys).agg(*[how(c).alias(c) for c in flags])
    return wide_to_long(wide, keys, flags, label, value)


def skill_frequency(df: DataFrame, n: int = 15, skills: Sequence[str] | None = None) -> DataFrame:
    """NULL flags are skipped."""
    flags = [c for c in (skills if skills is not None else skill_columns(df)) if c in df.columns]
    long = _aggregated_flags(df, [], flags, lambda c: F.avg(F.col(c).cast("double")), "skill", "share")
    return long.orderBy(F.desc_nulls_last("share"), "skill").limit(n)


def skill_share_by_grade(
    df: DataFrame, grades: Sequence[str], grade: str = "grade_final", skills: Sequence[str] | None = None
) -> DataFrame:
    """One row per skill, one column per grade."""
    flags = [c for c in (skills if skills is not None else skill_columns(df)) if c in df.columns]
    long = _aggregated_flags(not_null_keys(df, [grade]), [grade], flags, share, "skill", "share")
    return long.groupBy("skill").pivot(grade, list(grades)).agg(F.first("share"))


def junior_friendly_share(df: DataFrame, group: str = "primary_role") -> DataFrame:
    """D18."""
    flags = [c for c in ("is_junior_friendly", "battle_experience") if c in df.columns]
    if not flags:
        raise ValueError("expected is_junior_friendly or battle_experience")
    return not_null_keys(df, [group]).groupBy(group).agg(*[share(c).alias(c) for c in flags])


def junior_share_by_segment(df: DataFrame, flags: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean of each flag per segment, NULL skipped."""
    rows = not_null_keys(df, keys)
    return _aggregated_flags(rows, keys, flags, lambda c: F.avg(F.col(c).cast("double")), "flag", "share")


def remote_share_by_role(df: DataFrame) -> DataFrame:
    """D20."""
    rows = not_null_keys(df, ["primary_role"])
    out = rows.groupBy("primary_role").agg(F.avg(F.col("is_remote").cast("double")).alias("remote_share"))
    return out.orderBy(F.desc_nulls_last("remote_share"), "primary_role")


def _of_top(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the ``n`` most frequent values; the list has ``n`` rows, so it broadcasts."""
    return df.join(F.broadcast(top_values(df, column, n).select(column)), column, "left_semi")


def _flag_means(df: DataFrame, key: str, flags: Sequence[str], per_row: str | None) -> DataFrame:
    aggregates = [share(c).alias(c) for c in flags]
    if per_row:
        aggregates.append(F.avg(total(flag_int(c) for c in flags)).alias(per_row))
    return df.groupBy(key).agg(*aggregates, F.count(F.lit(1)).alias("n_vacancies"))


def benefits_by_company(df: DataFrame, top_n: int = 10, company: str = "company") -> DataFrame:
    """D21."""
    return _flag_means(_of_top(df, company, top_n), company, prefixed_flags(df, "benefit_"), "benefits_per_vacancy")


def benefits_by_grade(df: DataFrame, grade: str = "grade_final") -> DataFrame:
    """D22."""
    return _flag_means(not_null_keys(df, [grade]), grade, prefixed_flags(df, "benefit_"), "benefits_per_vacancy")


def soft_skills_overall(df: DataFrame) -> DataFrame:
    """D23."""
    soft = prefixed_flags(df, "soft_")
    wide = df.agg(*[F.sum(flag_int(c)).alias(c) for c in soft], F.count(F.lit(1)).alias("_rows"))
    long = wide_to_long(wide, ["_rows"], soft, "soft_skill", "count")
    return long.select("soft_skill", "count", (F.col("count") / F.col("_rows")).alias("share"))


def soft_skills_by_employer(df: DataFrame, top_n: int = 10, company: str = "company") -> DataFrame:
    """D24."""
    return _flag_means(_of_top(df, company, top_n), company, prefixed_flags(df, "soft_"), None)


def top_employers(
    df: DataFrame, n: int = 15, company: str = "company", salary: str = SALARY, rating: str = "employer_rating"
) -> DataFrame:
    """The share divides by all rows, named or not. Companies are counted once and written for the three steps that read them."""
    per_company = materialize(df.groupBy(company).agg(
        F.count(F.lit(1)).alias("vacancy_count"), F.avg(rating).alias("rating_mean")
    ), "companies")
    whole = per_company.agg(F.sum("vacancy_count").alias("_all"))
    top = per_company.where(F.col(company).isNotNull()).orderBy(F.desc("vacancy_count"), company).limit(n)
    rows = df.join(F.broadcast(top.select(company)), company, "left_semi")
    out = with_quantiles(top, rows, [company], salary, {"salary_median": 0.5})
    return out.join(whole).withColumn("share", F.col("vacancy_count") / F.col("_all")).drop("_all")


def skill_premium(
    df: DataFrame, skills: Sequence[str], salary: str = SALARY, min_count: int = 30
) -> DataFrame:
    """Medians with and without each skill.

    Rows are first counted per distinct salary, with one counter per skill; only
    counts of value bins are unpivoted, never rows or salaries.
    """
    flags = [c for c in skills if c in df.columns]
    per_value = df.groupBy(F.col(salary).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(flag_int(c)).alias(c) for c in flags]
    )
    counts = wide_to_long(per_value.agg(*[F.sum(c).alias(c) for c in flags]), [], flags, "skill", "count_with_skill")
    without = {f"no {c}": F.col("_rows") - F.col(c) for c in flags}
    found = quantiles_of_counters(per_value.withColumns(without), [*flags, *without], {"median": 0.5})
    has = ~F.col("_key").startswith("no ")
    medians = found.groupBy(F.regexp_replace("_key", "^no ", "").alias("skill")).agg(
        F.max(F.when(has, F.col("median"))).alias("median_with"),
        F.max(F.when(~has, F.col("median"))).alias("median_without"),
    )
    gain = F.col("median_with") - F.col("median_without")
    return (
        counts.where(F.col("count_with_skill") >= min_count).join(medians, "skill", "left")
        .withColumns({
            "premium_abs": gain,
            "premium_pct": F.when(F.col("median_without") != 0, gain / F.col("median_without")),
        }).orderBy(F.desc_nulls_last("premium_pct"), "skill")
    )


def median_and_count(df: DataFrame, category: str, top_n: int = 10, salary: str = SALARY) -> DataFrame:
    """D27 chart data: the categories with most salaried rows."""
    out = _salary_stats(df, [category], [F.avg(salary).alias("mean"), F.count(salary).alias("count")], salary,
                        {"median": 0.5})
    return out.orderBy(F.desc("count"), category).limit(top_n)


def stack_bucket(size: Column) -> Column:
    """0-2 / 3-5 / 6-10 / 10+, NULL counted as 0."""
    n = F.coalesce(size, F.lit(0))
    return F.when(n <= 2, "0-2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("10+")


FIVE_NUMBERS = {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0}


def box_stats(
    df: DataFrame, group: str, salary: str = SALARY, top_n: int | None = None, exclude: Sequence[str] = ()
) -> DataFrame:
    """D28 chart data: five numbers per group with salaries."""
    rows = not_null_keys(df, [group])
    if exclude:
        rows = rows.where(~F.col(group).isin(*exclude))
    if top_n:
        rows = _of_top(rows, group, top_n)
    n = rows.groupBy(group).agg(F.count(salary).alias("n")).where(F.col("n") > 0)
    return with_quantiles(n, rows, [group], salary, FIVE_NUMBERS)


def multilabel_box_stats(df: DataFrame, flags: Sequence[str], salary: str = SALARY) -> DataFrame:
    """D29 chart data: a row counts in every role it is flagged with.

    Counts of value bins are unpivoted, not rows; roles without a salary keep
    their totals and are marked as left out.
    """
    per_value = df.groupBy(F.col(salary).cast("double").alias("_v")).agg(*[F.sum(flag_int(c)).alias(c) for c in flags])
    salaried = F.col("_v").isNotNull()
    entries = F.array(*[
        F.struct(F.lit(c).alias("role"), F.sum(c).alias("n_total"),
                 F.coalesce(F.sum(F.when(salaried, F.col(c))), F.lit(0)).alias("n_salary"))
        for c in flags
    ])
    totals = per_value.agg(entries.alias("e")).select(F.explode("e").alias("e")).select("e.*")
    box = quantiles_of_counters(per_value, flags, FIVE_NUMBERS).withColumnRenamed("_key", "role")
    return totals.join(box, "role", "left").withColumn("left_out", F.col("n_salary") == 0)


def share_crosstab(df: DataFrame, a: str, b: str, b_values: Sequence[str]) -> DataFrame:
    """D30 chart data: row-normalised counts, missing cells 0."""
    rows = not_null_keys(df, [a, b])
    counts = rows.groupBy(a).pivot(b, list(b_values)).agg(F.count(F.lit(1))).fillna(0)
    whole = total(F.col(f"`{v}`") for v in b_values)
    return counts.select(a, *[(F.col(f"`{v}`") / whole).alias(v) for v in b_values])


def top_skills_for_role(
    df: DataFrame, role_text: str, n: int = 15, skills: Sequence[str] | None = None
) -> DataFrame:
    """D31 chart data: rows whose role contains the text."""
    flags = list(skills) if skills is not None else skill_columns(df)
    rows = df.where(F.lower("primary_role").contains(role_text.lower()))
    wide = rows.agg(*[F.sum(flag_int(c)).alias(c) for c in flags], F.count(F.lit(1)).alias("_rows"))
    long = wide_to_long(wide, ["_rows"], flags, "skill", "count").where(F.col("_rows") > 0)
    out = long.select("skill", "count", (F.col("count") / F.col("_rows")).alias("share"))
    return out.orderBy(F.desc("count"), "skill").limit(n)


def skill_heatmap(df: DataFrame, segment: str, n: int = 20, skills: Sequence[str] | None = None) -> DataFrame:
    """D32 chart data: shares of the overall top skills per segment, long form."""
    flags = list(skills) if skills is not None else skill_columns(df)
    top = skill_frequency(df, n, flags).select("skill")
    long = _aggregated_flags(not_null_keys(df, [segment]), [segment], flags,
                             lambda c: F.avg(F.col(c).cast("double")), "skill", "share")
    return long.join(F.broadcast(top), "skill", "left_semi").fillna(0.0, ["share"])


def _heatmap(summary: DataFrame, key: str, flags: Sequence[str], n: int, label: str) -> DataFrame:
    long = wide_to_long(summary, [key], flags, label, "share")
    top = long.groupBy(label).agg(F.avg("share").alias("_m")).orderBy(F.desc("_m"), label).limit(n).select(label)
    return long.join(F.broadcast(top), label, "left_semi")


def benefit_heatmap(df: DataFrame, employers: int = 10, n: int = 12) -> DataFrame:
    """D33 chart data."""
    return _heatmap(benefits_by_company(df, employers), "company", prefixed_flags(df, "benefit_"), n, "benefit")


def soft_heatmap(df: DataFrame, employers: int = 10, n: int = 12) -> DataFrame:
    """D33 chart data."""
    return _heatmap(soft_skills_by_employer(df, employers), "company", prefixed_flags(df, "soft_"), n, "soft_skill")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """D34 chart data: equal-width bins from min to max, the last one closed."""
    value = df.select(F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    edges = value.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)))
    counted = value.join(edges).groupBy("_lo", "_hi", index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        "bin", (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("right_edge"), "count",
    )


def segment_share(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Normalised counts, NULL is a value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    whole = counts.agg(F.sum("count").alias("_all"))
    top = counts.orderBy(F.desc("count"), F.asc_nulls_last(column)).limit(n)
    return top.join(whole).select(column, "count", (F.col("count") / F.col("_all")).alias("share"))
