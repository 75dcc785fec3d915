"""Weekly snapshots, trends and trend readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.columns import (
    GRADE_COLUMNS, SALARY_COLUMNS, all_of, dtype, flag_int, market_skills, monday, prefixed_flags, require, skill_label,
)
from postmill.functions.normalize import clean_skill, parse_skill_list
from postmill.operators.market import primary_domain, ranked_labels
from postmill.operators.quantiles import with_quantiles

SNAPSHOT_KEYS = ["week_start", "role", "grade", "city_tier", "work_mode", "domain"]


def top_skill_names(df: DataFrame, keys: Sequence[str], skills: Sequence[str], n: int) -> tuple[list[Column], Column]:
    """Aggregates per flag, and the array of most frequent names over them.

    A name that exists both as skill_ and has_ flag counts with its larger sum.
    """
    sums = {c: f"_n_{i}" for i, c in enumerate(skills)}
    by_name: dict[str, list[Column]] = {}
    for c, alias in sums.items():
        by_name.setdefault(skill_label(c), []).append(F.col(alias))
    scores = {name: F.greatest(*cs) if len(cs) > 1 else cs[0] for name, cs in by_name.items()}
    aggregates = [F.sum(flag_int(c)).alias(a) for c, a in sums.items()]
    if not scores:
        return aggregates, F.array().cast("array<string>")
    return aggregates, F.transform(ranked_labels(scores, n), lambda e: e["label"])


def weekly_snapshot(df: DataFrame, week: Column) -> DataFrame:
    """one row per week and the five string keys; NULL keys become ``unknown``.

    ``week`` is any date column: a literal for one snapshot, or the publication
    date to build the whole history in one job.
    """
    role, grade, salary = require(df, "primary_role"), require(df, *GRADE_COLUMNS), require(df, *SALARY_COLUMNS)
    skills = market_skills(df)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("unknown")) if name in df.columns else F.lit("unknown")

    domains = prefixed_flags(df, "domain_")
    domain = text("domain") if "domain" in df.columns else primary_domain(domains)
    rows = df.select(
        monday(week).alias("week_start"), text(role).alias("role"), text(grade).alias("grade"),
        text("city_tier").alias("city_tier"), text("work_mode").alias("work_mode"), domain.alias("domain"),
        F.col(salary).try_cast("double").alias("_salary"), *skills,
    )
    sums, names = top_skill_names(rows, SNAPSHOT_KEYS, skills, 10)
    stats = rows.groupBy(*SNAPSHOT_KEYS).agg(F.count(F.lit(1)).alias("vacancy_count"), *sums)
    out = with_quantiles(stats, rows, SNAPSHOT_KEYS, "_salary",
                         {"salary_p25": 0.25, "salary_p50": 0.5, "salary_p75": 0.75})
    return out.select(*SNAPSHOT_KEYS, "vacancy_count", "salary_p25", "salary_p50", "salary_p75", names.alias("skill_top10"))


def upsert_snapshots(existing: DataFrame, new: DataFrame) -> DataFrame:
    """rows of ``new`` replace those with the same six-part key."""
    kept = existing.join(new.select(*SNAPSHOT_KEYS), SNAPSHOT_KEYS, "left_anti")
    return kept.unionByName(new)


def _history(history: DataFrame, role: str | None, grade: str | None) -> DataFrame:
    if role is not None:
        history = history.where(F.col("role") == role)
    return history.where(F.col("grade") == grade) if grade is not None else history


def _last_weeks(points: DataFrame, weeks: int) -> DataFrame:
    """Weekly points are few; the newest ``weeks`` of them in time order."""
    if weeks < 1:
        raise ValueError("weeks must be >= 1")
    return points.orderBy(F.desc("week_start")).limit(weeks).orderBy("week_start")


def skill_demand_trend(
    history: DataFrame, skill: str, role: str | None = None, grade: str | None = None, weeks: int = 12
) -> DataFrame:
    """weekly postings of rows whose top skills hold the skill, ignoring case."""
    names = F.col("skill_top10")
    if isinstance(dtype(history, "skill_top10"), T.StringType):
        names = parse_skill_list(names)
    wanted = skill.strip().removeprefix("skill_").removeprefix("has_").lower()
    held = F.array_contains(F.transform(names, clean_skill), wanted)
    rows = _history(history, role, grade).where(held)
    return _last_weeks(rows.groupBy("week_start").agg(F.sum("vacancy_count").alias("vacancy_count")), weeks)


def salary_trend(history: DataFrame, role: str, grade: str, weeks: int = 12) -> DataFrame:
    """count-weighted weekly median; plain mean where the weights add to zero."""
    p50, n = F.col("salary_p50"), F.coalesce("vacancy_count", F.lit(0))
    weight = F.sum(F.when(p50.isNotNull(), n))
    value = F.when(weight > 0, F.sum(p50 * n) / weight).otherwise(F.avg(p50))
    return _last_weeks(_history(history, role, grade).groupBy("week_start").agg(value.alias("salary_p50")), weeks)


def vacancy_count_trend(history: DataFrame, role: str | None, grade: str | None, weeks: int = 12) -> DataFrame:
    """F5."""
    rows = _history(history, role, grade)
    return _last_weeks(rows.groupBy("week_start").agg(F.sum("vacancy_count").alias("vacancy_count")), weeks)


def annotate_points(points: DataFrame, history: DataFrame, role: str, grade: str, as_of: Column) -> DataFrame:
    """completeness, source rows and confidence of each point."""
    sources = _history(history, role, grade).groupBy("week_start").agg(F.sum("vacancy_count").alias("source_row_count"))
    rows = F.col("source_row_count")
    return points.join(sources, "week_start", "left").withColumns({
        "is_complete": F.col("week_start") < monday(as_of),
        "completeness": F.when(F.col("week_start") < monday(as_of), "complete").otherwise("partial"),
        "confidence": F.when(rows >= 100, "high").when(rows >= 30, "medium").when(rows.isNotNull(), "low"),
    })


def iso_week(value: Column) -> Column:
    """ISO year and week as text, e.g. 2026-W21."""
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), value).cast("int"), F.weekofyear(value))
    return F.when(value.isNotNull(), week)


def forward_window_readiness(runs: DataFrame, as_of: Column, min_weeks: int = 8) -> DataFrame:
    """per dataset, how far its passed weekly snapshots reach.

    ``runs``: dataset, run_id, generated_at, dataset_semantic_type, source_kind,
    quality_status, date_semantics_status, trend_gate_eligible.
    """
    passed = F.coalesce(F.col("quality_status") == "passed", F.lit(False))
    current = passed & F.coalesce(F.col("dataset_semantic_type") == "current_market_snapshot", F.lit(False))
    facts = F.coalesce(F.col("dataset_semantic_type") == "historical_publication_facts", F.lit(False))
    dates = F.coalesce(F.col("date_semantics_status") == "passed", F.lit(False))
    gate = F.coalesce("trend_gate_eligible", F.lit(False))
    runs = runs.withColumns({"_current": current, "_facts": facts, "_dates": dates, "_gate": gate,
                             "_ready": passed & facts & dates & gate,
                             "_week": F.when(current, monday(F.col("generated_at")))})
    # first to one row per dataset and week, so the set of weeks is counted, not collected
    weekly = runs.groupBy("dataset", "_week").agg(
        F.sum(F.col("_current").cast("long")).alias("_runs"),
        F.sum(F.col("_ready").cast("long")).alias("_ready_runs"),
        F.max(F.struct("generated_at", "run_id", "_facts", "_dates", "_gate", "_ready")).alias("_latest"),
    )
    complete = F.col("_week") < monday(as_of)
    per = weekly.groupBy("dataset").agg(
        F.sum("_runs").alias("quality_current_snapshot_runs"),
        F.sum("_ready_runs").alias("historical_ready_runs"),
        F.count("_week").alias("generated_weeks_observed"),
        F.count(F.when(complete, 1)).alias("complete_weeks_observed"),
        F.min(F.when(complete, F.col("_week"))).alias("first_complete_week"),
        F.max(F.when(complete, F.col("_week"))).alias("latest_complete_week"),
        F.max("_latest").alias("_latest"),
    )
    left = F.greatest(F.lit(min_weeks) - F.col("complete_weeks_observed"), F.lit(0))
    status = (
        F.when(F.col("_latest._ready"), "historical_trend_ready")
        .when(F.col("complete_weeks_observed") >= min_weeks, "forward_window_ready_for_review")
        .when(F.col("generated_weeks_observed") > 0, "forward_accumulating")
        .otherwise("blocked_no_evidence")
    )
    per = per.withColumns({"weeks_remaining": left, "status": status})
    blocked = F.col("status") != "historical_trend_ready"
    reasons = F.array_compact(F.array(
        F.when(blocked, "latest_dataset_is_not_public_trend_ready_historical_facts"),
        F.when(blocked & ~F.col("_latest._facts"),
               "latest_dataset_semantic_type_is_not_historical_publication_facts"),
        F.when(blocked & ~F.col("_latest._dates"), "latest_date_semantics_not_passed"),
        F.when(blocked & ~F.col("_latest._gate"), "latest_trend_ready_gate_not_eligible"),
        F.when((F.col("status") == "forward_accumulating") & (F.col("weeks_remaining") > 0),
               "forward_current_snapshot_history_has_too_few_complete_weeks"),
        F.when(F.col("status") == "forward_window_ready_for_review",
               "forward_history_needs_explicit_product_and_data_model_review_before_claim_unlock"),
    ))
    return per.select(
        "dataset", "status", F.when(blocked, "blocked").otherwise("ready").alias("claim_status"),
        "quality_current_snapshot_runs", "historical_ready_runs", "generated_weeks_observed",
        "complete_weeks_observed", "weeks_remaining",
        iso_week(F.col("first_complete_week")).alias("first_complete_week"),
        iso_week(F.col("latest_complete_week")).alias("latest_complete_week"),
        F.col("_latest.run_id").alias("latest_run_id"), reasons.alias("blocked_reasons"),
    )


def runs_by_source(runs: DataFrame) -> DataFrame:
    """passed current snapshots per dataset and source."""
    rows = runs.where((F.col("quality_status") == "passed") & (F.col("dataset_semantic_type") == "current_market_snapshot"))
    return rows.groupBy("dataset", F.coalesce("source_kind", F.lit("unknown")).alias("source_kind")).agg(
        F.count(F.lit(1)).alias("runs"))


TREND_BLOCKED = "trend claims are blocked until the trend gates pass"


def trend_claim_status(meta: DataFrame) -> DataFrame:
    """ready only if eligibility, gate, facts and date semantics all agree.

    ``meta``: trends_eligible, trend_gate_eligible, dataset_semantic_type,
    date_semantics_status, trends_reason, trends_message, gate_message.
    """
    ready = all_of([
        F.coalesce("trends_eligible", F.lit(False)), F.coalesce("trend_gate_eligible", F.lit(False)),
        F.coalesce(F.col("dataset_semantic_type") == "historical_publication_facts", F.lit(False)),
        F.coalesce(F.col("date_semantics_status") == "passed", F.lit(False)),
    ])
    from_trends = F.when(F.col("trends_reason") != "", F.when(F.col("trends_message") != "", F.col("trends_message")))
    message = F.coalesce(F.when(F.col("gate_message") != "", F.col("gate_message")), from_trends, F.lit(TREND_BLOCKED))
    return meta.withColumns({
        "claim_status": F.when(ready, "ready").otherwise("blocked"), "warning": F.when(~ready, message),
    })


def gated_points(points: DataFrame, status: DataFrame) -> DataFrame:
    """trend points only when the one-row status is ready."""
    allowed = status.where(F.col("claim_status") == "ready").limit(1)
    return points.join(F.broadcast(allowed.select(F.lit(1).alias("_ok"))), F.lit(True), "left_semi")
