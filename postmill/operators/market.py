"""E: segment view, segment summaries, filters, listings and trust labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.columns import (
    GRADE_COLUMNS, first_match, flag, flag_int, not_null_keys, prefixed_flags, require, skill_label,
)
from postmill.functions.fixed_values import CONFIDENCE_LEVELS
from postmill.operators.quantiles import with_many_quantiles

SALARY_QUANTILES = {"salary_median": 0.5, "salary_q25": 0.25, "salary_q75": 0.75}
STACK_QUANTILES = {"median_tech_stack_size": 0.5}
GEO_COLUMNS = ("country", "region", "city_normalized", "geo_scope")


def market_confidence(rows: Column, salaried: Column, coverage: Column) -> Column:
    """High / medium / low from segment size, salaried rows and coverage."""
    salaried, coverage = F.coalesce(salaried, F.lit(0)), F.coalesce(coverage, F.lit(0.0))
    return first_match(
        [((rows >= n) & (salaried >= ns) & (coverage >= cov), label) for label, n, ns, cov in CONFIDENCE_LEVELS],
        "low",
    )


def primary_domain(flags: Sequence[str]) -> Column:
    """Name of the first true domain flag in the given order."""
    return first_match([(flag(c), c.removeprefix("domain_")) for c in flags], "unknown")


def ranked_labels(scores: Mapping[str, Column], n: int) -> Column:
    """Array of struct(label, score): positive scores, highest first, name breaks ties."""
    entries = F.array(*[
        F.struct((-s.cast("double")).alias("neg"), F.lit(label).alias("label")) for label, s in scores.items()
    ])
    return F.slice(F.array_sort(F.filter(entries, lambda e: e["neg"] < 0)), 1, n)


def salary_metric(df: DataFrame, salary: str) -> Column:
    """Salary as number, NULL where the posting does not disclose it."""
    value = F.col(salary).cast("double") if dict(df.dtypes)[salary] != "string" else F.expr(
        f"try_cast({salary} AS double)"
    )
    return F.when(flag("salary_disclosed"), value) if "salary_disclosed" in df.columns else value


def market_view(df: DataFrame, top: int = 5) -> DataFrame:
    """One row per role, city tier, grade, present geography and domain."""
    require(df, "primary_role")
    require(df, "city_tier")
    grade, salary = require(df, *GRADE_COLUMNS), require(df, "salary_mid_rub_capped")
    keys = ["primary_role", "city_tier", grade, *[c for c in GEO_COLUMNS if c in df.columns]]
    domains = prefixed_flags(df, "domain_")
    if domains:
        df = df.withColumn("domain", primary_domain(domains))
        keys.append("domain")
    junior = (
        flag_int("is_junior_friendly") if "is_junior_friendly" in df.columns
        else (~flag("battle_experience")).cast("int") if "battle_experience" in df.columns
        else F.lit(None).cast("int")
    )
    remote = (
        flag_int("is_remote") if "is_remote" in df.columns
        else F.lower(F.coalesce("work_mode", F.lit(""))).isin("remote", "hybrid").cast("int")
        if "work_mode" in df.columns else F.lit(None).cast("int")
    )
    stack = F.col("tech_stack_size") if "tech_stack_size" in df.columns else F.lit(None).cast("int")
    skills = prefixed_flags(df, "skill_", "has_")
    rows = not_null_keys(df, keys).select(
        *keys, salary_metric(df, salary).alias("_salary"), junior.alias("_junior"), remote.alias("_remote"),
        stack.alias("_stack"), *skills,
    )
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("vacancy_count_total"),
        F.count("_salary").alias("vacancy_count_salary"),
        F.avg("_junior").alias("junior_friendly_share"),
        F.avg("_remote").alias("remote_share"),
        *[F.sum(flag_int(s)).alias(f"_n_{s}") for s in skills],
    )
    view = with_many_quantiles(stats, rows, keys, {"_salary": SALARY_QUANTILES, "_stack": STACK_QUANTILES})
    coverage = F.col("vacancy_count_salary") / F.col("vacancy_count_total")
    view = view.withColumns({
        "vacancy_count": F.col("vacancy_count_total"),
        "sample_size": F.col("vacancy_count_total"),
        "salary_sample_size": F.col("vacancy_count_salary"),
        "salary_coverage_share": coverage,
        "confidence": market_confidence(F.col("vacancy_count_total"), F.col("vacancy_count_salary"), coverage),
    })
    if skills:
        best = ranked_labels({skill_label(s): F.col(f"_n_{s}") / F.col("vacancy_count_total") for s in skills}, top)
        text = F.transform(
            best, lambda e: F.format_string("%s (%d%%)", e["label"], F.bround(-e["neg"] * 100, 0).cast("int"))
        )
        view = view.withColumn("top_skills", F.array_join(text, ", ")).drop(*[f"_n_{s}" for s in skills])
    return view.orderBy(F.desc("vacancy_count_total"), *keys)


def apply_filters(df: DataFrame, specs: Mapping[str, object]) -> DataFrame:
    """Equality or IN per column; NULL specs and absent columns are no-ops."""
    for column, value in specs.items():
        if value is None or column not in df.columns:
            continue
        many = isinstance(value, (list, tuple, set, frozenset))
        df = df.where(F.col(column).isin(*sorted(value, key=str)) if many else F.col(column) == F.lit(value))
    return df


def scope_label(scope: Column, requested: object = None) -> Column:
    """E7 aggregate: the requested scope, else the one known scope, ``mixed`` for several, else NULL."""
    if isinstance(requested, str) and requested:
        return F.lit(requested)
    known = F.when((scope != "") & (scope != "unknown"), scope)
    return F.when(F.min(known) == F.max(known), F.min(known)).when(F.min(known) != F.max(known), F.lit("mixed"))


def _selected(df: DataFrame, specs: Mapping[str, object]) -> Column:
    """E8 as a condition: absent columns and NULL specs select everything."""
    out = F.lit(True)
    for column, value in specs.items():
        if value is None or column not in df.columns:
            continue
        many = isinstance(value, (list, tuple, set, frozenset))
        out = out & F.coalesce(F.col(column).isin(*value) if many else F.col(column) == F.lit(value), F.lit(False))
    return out


def _skill_list(skills: Column) -> Column:
    """Names of a comma-joined text without blanks; NULL when none is left."""
    names = F.filter(F.transform(F.split(skills, ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(names) > 0, names)


def _summary(out: DataFrame, warnings: Column) -> DataFrame:
    """Coverage, confidence and warnings of a one-row summary; an empty segment has its count and warnings only."""
    n, salaried = F.col("vacancy_count"), F.col("salary_sample_size")
    coverage = F.when(n > 0, F.bround(salaried / n, 6))
    out = out.withColumns({
        "sample_size": n, "salary_coverage_share": coverage, "confidence": market_confidence(n, salaried, coverage)})
    last = F.array(F.when(n == 0, "empty_segment").when(F.col("confidence") == "low", "low_confidence"))
    hidden = [c for c in out.columns if c.startswith("_")]
    kept = {c: F.when(n > 0, F.col(c)) for c in out.columns if c != "vacancy_count" and c not in hidden}
    return out.withColumn("warnings", F.concat(warnings, F.array_compact(last))).withColumns(kept).drop(*hidden)


VALIDATED = ("primary_role", *GRADE_COLUMNS, "domain")


def segment_summary_from_view(view: DataFrame, filters: Mapping[str, object], weighted: bool = False) -> DataFrame:
    """One row from the segment view, in one scan of it.

    Shares, medians and quartiles are means over segments, by request weighted by
    their postings. ``warnings`` names single requested values of role, grade and
    domain that the view does not hold. An empty segment has ``vacancy_count`` 0,
    its warnings and NULL elsewhere.
    """
    asked = {c: v for c, v in filters.items() if c in VALIDATED and c in view.columns and isinstance(v, str)}
    view = view.withColumn("_in", _selected(view, filters))
    total, inside = F.col("vacancy_count_total"), F.col("_in")

    def mean(name: str) -> Column:
        value = F.when(inside, F.col(name))
        return F.avg(value) if not weighted else F.sum(value * total) / F.sum(F.when(value.isNotNull(), total))

    listed = F.struct(-total, "top_skills")
    means = ("salary_median", "salary_q25", "salary_q75", "junior_friendly_share", "remote_share", "median_tech_stack_size")
    scope = F.when(inside, F.col("geo_scope")) if "geo_scope" in view.columns else F.lit(None).cast("string")
    out = view.agg(
        F.coalesce(F.sum(F.when(inside, total)), F.lit(0).cast("long")).alias("vacancy_count"),
        F.coalesce(F.sum(F.when(inside, F.col("vacancy_count_salary"))), F.lit(0).cast("long")).alias("salary_sample_size"),
        *[mean(c).alias(c) for c in means],
        scope_label(scope, filters.get("geo_scope")).alias("geo_scope"),
        _skill_list(F.min_by("top_skills", F.when(inside & F.col("top_skills").isNotNull(), listed))).alias("top_skills"),
        *[F.max(F.col(c) == v).alias(f"_has_{c}") for c, v in asked.items()],
    )
    # a view without any value of a dimension cannot tell
    unknown = [F.when(~F.col(f"_has_{c}"), F.lit(f"unknown_{c}:{v}")) for c, v in asked.items()]
    return _summary(out, F.array_compact(F.array(F.lit(None).cast("string"), *unknown)))


def segment_summary_from_postings(
    df: DataFrame, filters: Mapping[str, object], small: int = 5, view: DataFrame | None = None
) -> DataFrame:
    """E5: the same summary recomputed from posting rows, for work-mode filters.

    Skills and warnings about unknown values come from the segment view, when given.
    """
    salary = require(df, "salary_mid_rub_capped", "salary_mid_rub", "salary_mid")
    part = apply_filters(df, filters)
    remote = F.col("work_mode") == "remote" if "work_mode" in df.columns else F.col("is_remote")
    scope = F.col("geo_scope") if "geo_scope" in df.columns else F.lit(None).cast("string")
    stats = part.agg(
        F.count(F.lit(1)).alias("vacancy_count"),
        F.count(salary).alias("salary_sample_size"),
        F.avg(F.col("is_junior_friendly").cast("int")).alias("junior_friendly_share"),
        F.avg(remote.cast("int")).alias("remote_share"),
        scope_label(scope, filters.get("geo_scope")).alias("geo_scope"),
    )
    out = with_many_quantiles(stats, part, [], {salary: SALARY_QUANTILES, "tech_stack_size": STACK_QUANTILES})
    warnings = F.array_compact(F.array(F.when(F.col("vacancy_count").between(1, small - 1), "small_segment")))
    if view is None:
        return _summary(out.withColumn("top_skills", F.lit(None).cast("array<string>")), warnings)
    known = segment_summary_from_view(view, {c: v for c, v in filters.items() if c != "work_mode"})
    unknown = F.filter("warnings", lambda w: w.startswith("unknown_"))
    return _summary(out.join(known.select("top_skills", unknown.alias("_unknown"))), F.concat("_unknown", warnings))


def filter_warnings(df: DataFrame, requested: Mapping[str, str]) -> DataFrame:
    """One row per requested value that the table does not hold."""
    distinct = [
        df.select(F.lit(c).alias("dimension"), F.col(c).alias("value")).where(F.col(c).isNotNull()).distinct()
        for c in requested if c in df.columns
    ]
    values = distinct[0]
    for d in distinct[1:]:
        values = values.unionByName(d)
    wanted = F.create_map(*[F.lit(x) for c, v in requested.items() for x in (c, v)])
    # dimension values are few by design: roles, grades, domains
    seen = values.groupBy("dimension").agg(F.array_sort(F.collect_set("value")).alias("available"))
    return (
        seen.withColumn("requested", wanted[F.col("dimension")])
        .where(~F.array_contains("available", F.col("requested")))
        .select("dimension", "requested", "available")
    )


def validate_dimension(df: DataFrame, column: str, view: DataFrame | None, dimension: str) -> DataFrame:
    """Accept a value when it equals a value of the view ignoring case."""
    if view is None:
        return df.withColumns({"accepted": F.lit(True), "warning": F.lit("segment view is not available")})
    known = (
        view.where(F.col(dimension).isNotNull())
        .select(F.lower(F.trim(F.col(dimension))).alias("_known")).distinct()
    )
    joined = df.join(known, F.lower(F.trim(F.col(column))) == F.col("_known"), "left")
    return joined.withColumns({
        "accepted": F.col(column).isNull() | F.col("_known").isNotNull(),
        "warning": F.lit(None).cast("string"),
    }).drop("_known")


def dimension_values(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Distinct non-null values per dimension in one pass."""
    present = [d for d in dimensions if d in df.columns]
    entries = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in present
    ])
    combos = df.select(*present).distinct()
    return (
        combos.select(F.explode(entries).alias("e")).select("e.*").where(F.col("value").isNotNull()).distinct()
        .orderBy("dimension", "value")
    )


def skills_listing(names: DataFrame, column: str, search: str | None, limit: int, offset: int = 0) -> DataFrame:
    """One page of the sorted canonical skill names with the total of matches."""
    canonical = F.lower(F.regexp_replace(F.trim(F.col(column)), "^(skill_|has_)", ""))
    listed = names.select(canonical.alias("skill")).where(F.col("skill") != "").distinct()
    if search:
        listed = listed.where(F.col("skill").contains(search.strip().lower()))
    whole = listed.agg(F.count(F.lit(1)).alias("total"))
    return listed.orderBy("skill").offset(offset).limit(limit).join(whole)


def freshness(updated: Column, as_of: Column) -> Column:
    """Fresh up to 7 days, aging up to 30, else stale; NULL is unknown."""
    age = (F.unix_micros(as_of) - F.unix_micros(updated)) / 86_400_000_000
    return F.when(updated.isNull(), "unknown").when(age <= 7, "fresh").when(age <= 30, "aging").otherwise("stale")


def with_trust(df: DataFrame, as_of: Column, updated: str, sample: str, salaried: str, confidence: str) -> DataFrame:
    """Trust columns repeated on every row."""
    return df.withColumns({
        "trust_updated_at": F.col(updated),
        "trust_freshness": freshness(F.col(updated), as_of),
        "trust_sample_size": F.col(sample),
        "trust_salary_coverage": F.when(F.col(sample) > 0, F.bround(F.col(salaried) / F.col(sample), 6)),
        "trust_confidence": F.coalesce(F.col(confidence), F.lit("unknown")),
    })


def _label_map() -> Column:
    """Aggregate over (label, n) rows: one map in label order; labels are few by design."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n"))))


def dataset_trust(view: DataFrame) -> DataFrame:
    """Postings, salaried postings, coverage and segments per confidence label of the segment view.

    An empty view has zeros, a NULL coverage and an empty map.
    """
    rows = F.col(require(view, "vacancy_count", "vacancy_count_total"))
    salaried = F.col(require(view, "salary_sample_size", "vacancy_count_salary"))
    label = F.coalesce(F.col("confidence"), F.lit("unknown")).alias("label")
    per_label = view.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.sum(rows).alias("rows"), F.sum(salaried).alias("salaried"))
    out = per_label.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("vacancy_count"),
        F.coalesce(F.sum("salaried"), F.lit(0)).cast("long").alias("salary_sample_size"),
        _label_map().alias("confidence_counts"))
    share = F.bround(F.col("salary_sample_size") / F.col("vacancy_count"), 6)
    return out.withColumn("salary_coverage_share", F.when(F.col("vacancy_count") > 0, share))


def dataset_scope(df: DataFrame, disclosed: Column | None = None) -> DataFrame:
    """One row with all rows, rows per ``dataset_scope`` and the rows that disclose a salary.

    ``disclosed`` stands in for an absent ``salary_disclosed``; without a scope
    column the map is NULL.
    """
    known = flag("salary_disclosed") if "salary_disclosed" in df.columns else disclosed
    if known is None:
        raise ValueError("salary_disclosed is absent and nothing stands in for it")
    scope = F.col("dataset_scope") if "dataset_scope" in df.columns else F.lit(None)
    per_scope = df.groupBy(F.coalesce(scope.cast("string"), F.lit("unknown")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(known, F.lit(False)).cast("long")).alias("disclosed"))
    out = per_scope.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_count"),
        (_label_map() if "dataset_scope" in df.columns else F.lit(None).cast("map<string,bigint>")).alias("dataset_scope_counts"),
        F.coalesce(F.sum("disclosed"), F.lit(0)).cast("long").alias("salary_disclosed_count"))
    share = F.bround(F.col("salary_disclosed_count") / F.col("row_count"), 6)
    return out.withColumn("salary_disclosure_share", F.when(F.col("row_count") > 0, share))


def dataset_warning(meta: DataFrame, as_of: Column) -> DataFrame:
    """The first problem of a dataset, or NULL; a status that was never set is no problem."""
    return meta.withColumn("dataset_warning", F.coalesce(
        F.when(F.col("quality_status") != "passed", F.lit("quality_not_passed")),
        F.when(F.col("date_semantics_status") != "passed", F.lit("date_semantics_not_passed")),
        F.when(freshness(F.col("updated_at"), as_of) == "stale", F.lit("stale")),
    ))


def domain_priorities(df: DataFrame) -> DataFrame:
    """Domain flags by number of true rows, from one aggregate."""
    names = sorted(prefixed_flags(df, "domain_"))
    entries = F.array(*[F.struct(F.lit(c).alias("domain"), F.sum(flag_int(c)).alias("count")) for c in names])
    long = df.agg(entries.alias("e")).select(F.explode("e").alias("e")).select("e.*")
    return long.orderBy(F.desc("count"), "domain")
