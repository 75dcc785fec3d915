"""Grade progression per role, and the next step for many users at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.columns import (
    GRADE_COLUMNS, SALARY_COLUMNS, first_match, flag_int, market_skills, prefixed_flags, require,
)
from postmill.functions.fixed_values import CAREER_ROLE_ALIASES, GRADE_RANK
from postmill.functions.normalize import clean_skill
from postmill.operators.market import ranked_labels
from postmill.operators.quantiles import with_quantiles
from postmill.operators.trends import top_skill_names

UNRANKED = 10_000
# fixed values: order of grades when unranked ones are shown too
GRADE_LIST = ["junior", "jun", "middle", "senior", "lead", "principal"]


def normalize_label(value: Column) -> Column:
    return F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit(" "))


def grade_rank(grade: Column) -> Column:
    label = normalize_label(grade)
    return first_match([(label == g, F.lit(r)) for g, r in GRADE_RANK.items()], F.lit(UNRANKED))


def _candidates(role: str) -> list[str]:
    label = role.strip().lower().replace("_", " ")
    return CAREER_ROLE_ALIASES.get(label, [label])


def _requested(df: DataFrame, roles: Sequence[str]) -> DataFrame:
    """(role, _label): labels of the table that answer each requested role.

    Aliases first; a role none of whose aliases occurs falls back to substring
    matches in both directions. Works on the distinct labels only.
    """
    labels = df.select(F.coalesce(normalize_label(F.col("primary_role")), F.lit("")).alias("_label")).distinct()
    wanted = F.array(*[
        F.struct(F.lit(r).alias("role"), F.array(*[F.lit(c) for c in _candidates(r)]).alias("aliases"),
                 F.lit(r.strip().lower().replace("_", " ")).alias("text"))
        for r in roles
    ])
    pairs = labels.select("_label", F.explode(wanted).alias("w")).select("_label", "w.*")
    pairs = pairs.withColumns({
        "_exact": F.array_contains("aliases", F.col("_label")),
        "_near": F.col("_label").contains(F.col("text")) | F.col("text").contains(F.col("_label")),
    })
    some = pairs.groupBy("role").agg(F.max("_exact").alias("_some"))
    pairs = pairs.join(some, "role")
    return pairs.where(F.col("_exact") | (~F.col("_some") & F.col("_near"))).select("role", "_label")


def career_nodes(df: DataFrame, roles: Sequence[str] | None = None, top_n: int = 10) -> DataFrame:
    """ranked grades of each role with median salary, postings and top skills.

    Without ``roles`` every role of the table is its own path.
    """
    grade, salary = require(df, *GRADE_COLUMNS), require(df, *SALARY_COLUMNS)
    skills = market_skills(df)
    rows = df.select(
        F.coalesce(normalize_label(F.col("primary_role")), F.lit("")).alias("_label"), F.col("primary_role").alias("role"),
        F.col(grade).cast("string").alias("grade"), grade_rank(F.col(grade).cast("string")).alias("grade_rank"),
        F.col(salary).try_cast("double").alias("_salary"), *skills,
    ).where(F.col("grade").isNotNull() & (F.col("grade_rank") != UNRANKED))
    if roles is None:
        rows = rows.where(F.col("role").isNotNull()).drop("_label")
    else:
        # as many rows as labels that answer the given roles; the rows of a frequent label stay in their own tasks
        rows = rows.drop("role").join(F.broadcast(_requested(df, roles)), "_label").drop("_label")
    keys = ["role", "grade", "grade_rank"]
    sums, names = top_skill_names(rows, keys, skills, top_n)
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("vacancy_count"), *sums)
    out = with_quantiles(stats, rows, keys, "_salary", {"salary_p50": 0.5})
    return out.select(*keys, "salary_p50", "vacancy_count", names.alias("top_skills"))


def salary_delta_pct(before: Column, after: Column) -> Column:
    return F.when(before > 0, (after - before) / before * 100)


def _transitions(nodes: DataFrame, delta) -> DataFrame:
    # a role has a handful of grades, so its window is small whatever the table
    path = Window.partitionBy("role").orderBy("grade_rank", "grade")
    following = F.lead(F.struct("grade", "salary_p50", "top_skills")).over(path)
    out = nodes.withColumn("_next", following).where(F.col("_next").isNotNull())
    return out.select(
        "role", F.col("grade").alias("from_grade"), F.col("_next.grade").alias("to_grade"),
        F.slice(F.array_except("_next.top_skills", "top_skills"), 1, 5).alias("skills_to_add"),
        delta(F.col("salary_p50"), F.col("_next.salary_p50")).alias("salary_delta_pct"),
        F.lit("stable").alias("demand_trend"),
    )


def career_graph(df: DataFrame, roles: Sequence[str] | None = None) -> DataFrame:
    """F8: transitions between consecutive grades of each role."""
    return _transitions(career_nodes(df, roles), salary_delta_pct)


def unranked_nodes(df: DataFrame, top_n: int = 10) -> DataFrame:
    """every grade of every role by the order list, skills by share."""
    grade, salary = require(df, *GRADE_COLUMNS), require(df, *SALARY_COLUMNS)
    skills = prefixed_flags(df, "skill_", "has_")
    label = F.lower(F.col(grade).cast("string"))
    rank = first_match([(label == g, F.lit(i)) for i, g in enumerate(GRADE_LIST)], F.lit(999))
    rows = df.where(F.col("primary_role").isNotNull() & F.col(grade).isNotNull()).select(
        F.col("primary_role").alias("role"), F.col(grade).cast("string").alias("grade"), rank.alias("grade_rank"),
        F.col(salary).try_cast("double").alias("_salary"), *skills,
    )
    keys = ["role", "grade", "grade_rank"]
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("vacancy_count"), *[F.sum(flag_int(c)).alias(f"_n_{c}") for c in skills])
    out = with_quantiles(stats, rows, keys, "_salary", {"salary_p50": 0.5})
    ranked = ranked_labels({c: F.col(f"_n_{c}") / F.col("vacancy_count") for c in skills}, top_n)
    names = F.transform(ranked, lambda e: F.regexp_replace(e["label"], "^(skill_|has_)", ""))
    return out.select(*keys, "salary_p50", "vacancy_count", names.alias("top_skills"))


def unranked_graph(df: DataFrame) -> DataFrame:
    """F11."""
    return _transitions(unranked_nodes(df), lambda a, b: F.when(a != 0, F.bround((b - a) / a * 100, 2)))


def _trend_word(first: Column, last: Column, points: Column) -> Column:
    change = (last - first) / first
    return (
        F.when(points < 2, "stable")
        .when(first <= 0, F.when(last > 0, "growing").otherwise("stable"))
        .when(change > 0.05, "growing").when(change < -0.05, "declining").otherwise("stable")
    )


def demand_trends(history: DataFrame, requests: DataFrame, weeks: int = 12) -> DataFrame:
    """F9 for many (role, grade) requests: first against last of the newest weeks.

    Requests without history have no row; callers read that as stable.
    """
    alias = F.create_map(*[
        x for r, cs in CAREER_ROLE_ALIASES.items() for x in (F.lit(r), F.array(*[F.lit(c) for c in cs]))
    ])
    label = normalize_label(F.col("role"))
    names = F.coalesce(alias[label], F.array(label))
    asked = requests.select("role", "grade").distinct().select(
        "role", "grade", F.explode(names).alias("_role"), normalize_label(F.col("grade")).alias("_grade"))
    known = history.groupBy(
        normalize_label(F.col("role")).alias("_role"), normalize_label(F.col("grade")).alias("_grade"), "week_start"
    ).agg(F.sum("vacancy_count").alias("_n"))
    weekly = asked.join(known, ["_role", "_grade"]).groupBy("role", "grade", "week_start").agg(F.sum("_n").alias("_n"))
    newest = Window.partitionBy("role", "grade").orderBy(F.desc("week_start"))
    recent = weekly.withColumn("_i", F.row_number().over(newest)).where(F.col("_i") <= weeks)
    ends = recent.groupBy("role", "grade").agg(
        F.min_by("_n", "week_start").alias("_first"), F.max_by("_n", "week_start").alias("_last"),
        F.count(F.lit(1)).alias("_points"))
    return ends.select("role", "grade", _trend_word(F.col("_first"), F.col("_last"), F.col("_points")).alias("demand_trend"))


def demand_trend(history: DataFrame, role: str, grade: str, weeks: int = 12) -> DataFrame:
    """F9 for one role and grade; always one row."""
    one = history.sparkSession.range(1).select(F.lit(role).alias("role"), F.lit(grade).alias("grade"))
    found = demand_trends(history, one, weeks)
    return one.join(found, ["role", "grade"], "left").withColumn(
        "demand_trend", F.coalesce("demand_trend", F.lit("stable")))


def recommend_next_step(nodes: DataFrame, users: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """F10 for all users: (user_id, role, grade, skills) against the nodes of their role.

    A role's nodes are a short array, so each user reads its own and the next
    node from one joined row.
    """
    entry = F.struct("grade_rank", "grade", "salary_p50", "vacancy_count", "top_skills")
    paths = nodes.groupBy("role").agg(F.array_sort(F.collect_list(entry)).alias("_path"))
    rows = users.select("user_id", "role", "grade", "skills").join(paths, "role", "left")
    wanted = normalize_label(F.col("grade"))
    rows = rows.withColumn("_now", F.get(F.filter("_path", lambda n: normalize_label(n["grade"]) == wanted), F.lit(0)))
    rank = grade_rank(F.col("grade"))
    rows = rows.withColumn("_next", F.get(F.filter("_path", lambda n: n["grade_rank"] > rank), F.lit(0)))
    own = F.transform(F.coalesce("skills", F.array().cast("array<string>")), clean_skill)
    fresh = F.array_except(F.array_except("_next.top_skills", F.coalesce("_now.top_skills", F.array().cast("array<string>"))), own)
    out = rows.select(
        "user_id", F.col("role").alias("current_role"), F.col("grade").alias("current_grade"),
        F.col("_next.grade").alias("next_grade"), F.col("_now.salary_p50").alias("salary_current_p50"),
        F.col("_next.salary_p50").alias("salary_next_p50"),
        salary_delta_pct(F.col("_now.salary_p50"), F.col("_next.salary_p50")).alias("salary_delta_pct"),
        F.coalesce(F.slice(fresh, 1, 5), F.array().cast("array<string>")).alias("skills_to_add"),
        F.coalesce("_now.vacancy_count", F.lit(0)).alias("vacancy_count_current"),
        F.coalesce("_next.vacancy_count", F.lit(0)).alias("vacancy_count_next"),
    )
    if history is None:
        return out.withColumn("demand_trend", F.lit("stable"))
    asked = out.where(F.col("next_grade").isNotNull()).select(
        F.col("current_role").alias("role"), F.col("next_grade").alias("grade"))
    trend = demand_trends(history, asked).withColumnsRenamed({"role": "current_role", "grade": "next_grade"})
    joined = out.join(trend, ["current_role", "next_grade"], "left")
    return joined.withColumn("demand_trend", F.coalesce("demand_trend", F.lit("stable")))
