"""G: quality gates over processed runs, raw snapshots and collection shards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.columns import GRADE_COLUMNS, SALARY_COLUMNS, any_of, first_existing, flag, wide_to_long
from postmill.functions.normalize import ID_ALIASES, canonical_key, first_date
from postmill.session import materialize

# --- fixed values ----------------------------------------------------------

UNKNOWN_VALUES = ["", "unknown", "other", "none", "nan", "n/a"]
REQUIRED_COLUMNS = ["title", "primary_role", "grade_final", "city_tier", "work_mode"]
SEGMENT_COLUMNS = ["primary_role", "grade_final", "city_tier", "work_mode", "domain"]
THRESHOLDS = {
    "min_rows": 100, "max_duplicate_share": 0.0, "min_salary_known_share": 0.01, "max_unknown_role_share": 0.80,
    "max_unknown_grade_share": 0.95, "max_unknown_geo_share": 0.95, "max_unknown_work_mode_share": 0.95,
    "min_market_view_rows": 1, "min_segment_rows": 20, "min_segment_salary_known_share": 0.05,
    "trend_min_complete_periods": 8, "trend_min_salary_known_share": 0.10, "trend_max_duplicate_share": 0.0,
}
CRITICAL_GROUPS = {
    "title": ["title"], "id": ["vacancy_id", "hh_vacancy_id", "id"], "url": ["url", "vacancy_url"],
    "published_at": ["published_at_iso", "published_at"],
}
RAW_ID_ALIASES = ("vacancy_id", "hh_vacancy_id", "id")
PLANNED_STATUSES = ["planned", "probing", "collecting", "validating"]
ACCEPTED_STATUSES = ["accepted", "accepted_empty"]
BLOCKING_STATUSES = [
    "blocked_source_capability", "blocked_source", "blocked_over_cap", "blocked_empty", "failed", "quarantined",
    "incomplete",
]
BLOCKED_WORDS = ["captcha", "blocked", "429", "403"]
UNPROVEN_CLAIMS = ["", "unproven", "unproven_source_access"]
SHARD_LIMITS = {"max_found": 1800, "max_pages": 18}

# ---------------------------------------------------------------------------


def _thresholds(overrides: Mapping[str, float] | None) -> dict[str, float]:
    return {**THRESHOLDS, **(overrides or {})}


def is_unknown(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))).isin(*UNKNOWN_VALUES)


def salary_known(df: DataFrame) -> Column:
    """Whether a row states a salary, by the best column the table has."""
    if "salary_known" in df.columns:
        return flag("salary_known")
    name = first_existing(df, *SALARY_COLUMNS)
    if name:
        return F.col(name).isNotNull()
    return any_of(F.col(c).isNotNull() for c in ("salary_from", "salary_to") if c in df.columns)


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def processed_metrics(features: DataFrame, view: DataFrame) -> DataFrame:
    """One row of metrics; repeated NULL ids count as duplicates.

    Everything is counted per id first, so the distinct ids and all shares come
    from the same shuffle.
    """
    key = first_existing(features, *ID_ALIASES)
    grade = first_existing(features, "grade_final", "grade")
    unknown = {"role": "primary_role", "grade": grade, "geo": "city_tier", "work_mode": "work_mode"}

    def count_if(condition: Column) -> Column:
        return F.sum(condition.cast("long"))

    absent = F.lit(None).cast("string")
    per_id = features.groupBy((F.col(key) if key else absent).alias("_id")).agg(
        F.count(F.lit(1)).alias("_rows"), count_if(salary_known(features)).alias("_salaried"),
        *[count_if(is_unknown(c) if c in features.columns else F.lit(True)).alias(f"_{n}") for n, c in unknown.items()],
    )
    rows = F.coalesce(F.sum("_rows"), F.lit(0))
    duplicates = rows - F.count(F.lit(1)) if key else rows
    out = per_id.agg(
        rows.alias("features_rows"), duplicates.alias("duplicate_count"), F.sum("_salaried").alias("_salaried"),
        *[F.sum(f"_{n}").alias(f"_{n}") for n in unknown],
    )
    n = F.col("features_rows")
    out = out.withColumns({
        "duplicate_share": _share(F.col("duplicate_count"), n, 1.0),
        "salary_known_share": _share(F.col("_salaried"), n, 0.0),
        **{f"unknown_{name}_share": _share(F.col(f"_{name}"), n, 1.0) for name in unknown},
    }).drop("_salaried", *[f"_{name}" for name in unknown])
    return out.join(view.agg(F.count(F.lit(1)).alias("market_view_rows")))


def _gate(name: str, passed: Column, value: Column, threshold: float | None) -> Column:
    return F.struct(
        F.lit(name).alias("name"), passed.alias("passed"), F.bround(value.cast("double"), 6).alias("value"),
        F.lit(threshold).cast("double").alias("threshold"),
    )


def _rows_of(one: DataFrame, gates: Sequence[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*gates)).alias("g")).select("g.*")


def processed_gates(
    features: DataFrame, view: DataFrame, thresholds: Mapping[str, float] | None = None
) -> DataFrame:
    """G1: ten gate rows (name, passed, value, threshold)."""
    return _rows_of(processed_metrics(features, view), _gates(features, _thresholds(thresholds)))


def _gates(features: DataFrame, t: Mapping[str, float]) -> list[Column]:
    """The ten gates over a row of metrics of the table."""
    missing = [c for c in REQUIRED_COLUMNS if c not in features.columns]
    missing += [] if first_existing(features, *ID_ALIASES) else ["id"]
    c = F.col

    def at_most(name: str, limit: str) -> Column:
        return _gate(name, c(name) <= t[limit], c(name), t[limit])

    return [
        _gate("non_empty_features", c("features_rows") > 0, c("features_rows"), 0),
        _gate("min_rows", c("features_rows") >= t["min_rows"], c("features_rows"), t["min_rows"]),
        _gate("required_columns", F.lit(not missing), F.lit(len(missing)), 0),
        at_most("duplicate_share", "max_duplicate_share"),
        _gate("salary_known_share", c("salary_known_share") >= t["min_salary_known_share"], c("salary_known_share"),
              t["min_salary_known_share"]),
        at_most("unknown_role_share", "max_unknown_role_share"),
        at_most("unknown_grade_share", "max_unknown_grade_share"),
        at_most("unknown_geo_share", "max_unknown_geo_share"),
        at_most("unknown_work_mode_share", "max_unknown_work_mode_share"),
        _gate("min_market_view_rows", c("market_view_rows") >= t["min_market_view_rows"], c("market_view_rows"),
              t["min_market_view_rows"]),
    ]


def gate_status(gates: DataFrame, good: str = "passed", bad: str = "failed") -> DataFrame:
    """One row: status and the sorted names of failed gates."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return gates.agg(failed.alias("failed_gates")).select(
        F.when(F.size("failed_gates") == 0, good).otherwise(bad).alias("status"), "failed_gates")


def segment_quality(features: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Rows and salary share of every value of five dimensions, from one pass over the rows."""
    t = _thresholds(thresholds)
    present = [c for c in SEGMENT_COLUMNS if c in features.columns]
    combos = features.groupBy(*present).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(salary_known(features).cast("long")).alias("_s"))
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("dimension"),
                 F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value"))
        for i, c in enumerate(present)
    ])
    per_value = combos.select("_n", "_s", F.explode(entries).alias("e")).groupBy("e.position", "e.dimension", "e.value").agg(
        F.sum("_n").alias("row_count"), F.sum("_s").alias("_s"))
    share = F.col("_s") / F.col("row_count")
    passed = (
        (F.col("row_count") >= t["min_segment_rows"]) & (share >= t["min_segment_salary_known_share"])
        & ~F.lower(F.trim("value")).isin(*UNKNOWN_VALUES)
    )
    return per_value.select(
        "position", "dimension", "value", "row_count", F.bround(share, 6).alias("salary_known_share"),
        passed.alias("passed"), F.when(passed, "usable").otherwise("low").alias("confidence"),
    )


def low_segments(segments: DataFrame, n: int = 50) -> DataFrame:
    """The first low segments in dimension and value order."""
    return segments.where(~F.col("passed")).orderBy("position", "value").limit(n).drop("position")


def segment_status(segments: DataFrame) -> DataFrame:
    low = F.sum((~F.col("passed")).cast("long"))
    return segments.agg(F.coalesce(low, F.lit(0)).alias("low_confidence_segments")).withColumn(
        "segment_status", F.when(F.col("low_confidence_segments") == 0, "passed").otherwise("warning"))


def publication_date(df: DataFrame) -> Column:
    return first_date(*[F.col(c) for c in ("published_at_iso", "published_at") if c in df.columns])


def observed_periods(features: DataFrame) -> DataFrame:
    """Distinct ISO weeks of publication."""
    weeks = features.select(F.date_trunc("week", publication_date(features)).alias("w")).where("w IS NOT NULL").distinct()
    return weeks.agg(F.count(F.lit(1)).alias("complete_periods"))


def publication_range(features: DataFrame) -> DataFrame:
    """G4."""
    day = publication_date(features)
    return features.agg(
        F.date_format(F.min(day), "yyyy-MM-dd").alias("observed_published_at_from"),
        F.date_format(F.max(day), "yyyy-MM-dd").alias("observed_published_at_to"))


# all that the metrics, segments and periods of a table look at
_GATE_COLUMNS = {
    *ID_ALIASES, *SALARY_COLUMNS, *SEGMENT_COLUMNS, *GRADE_COLUMNS, "salary_known", "salary_from", "salary_to",
    "published_at_iso", "published_at",
}


def trend_gate(
    features: DataFrame, view: DataFrame, lineage: DataFrame, thresholds: Mapping[str, float] | None = None
) -> DataFrame:
    """Eight criteria. ``lineage`` is one row with dataset_semantic_type,
    date_semantics_status and source_supported."""
    t = _thresholds(thresholds)
    # metrics, segments and periods read the same few columns, so the table's plan runs once
    read = [c for c in features.columns if c in _GATE_COLUMNS]
    rows = materialize(features.select(*read), "gate-rows") if read else features
    gates = F.array(*_gates(features, t))
    quality = F.when(F.exists(gates, lambda g: ~g["passed"]), "failed").otherwise("passed")
    one = (
        processed_metrics(rows, view).withColumn("quality_status", quality)
        .join(segment_status(segment_quality(rows, thresholds))).join(observed_periods(rows)).join(lineage)
    )
    c = F.col

    def is_true(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    def criterion(name: str, passed: Column, value: Column | None = None, threshold: float | None = None) -> Column:
        return _gate(name, passed, value if value is not None else F.lit(None), threshold)

    return _rows_of(one, [
        criterion("processed_quality_passed", is_true(c("quality_status") == "passed")),
        criterion("historical_publication_facts", is_true(c("dataset_semantic_type") == "historical_publication_facts")),
        criterion("date_semantics_passed", is_true(c("date_semantics_status") == "passed")),
        criterion("source_capability_supported", is_true(c("source_supported"))),
        criterion("min_complete_periods", c("complete_periods") >= t["trend_min_complete_periods"], c("complete_periods"),
                  t["trend_min_complete_periods"]),
        criterion("duplicate_share", c("duplicate_share") <= t["trend_max_duplicate_share"], c("duplicate_share"),
                  t["trend_max_duplicate_share"]),
        criterion("salary_known_share", c("salary_known_share") >= t["trend_min_salary_known_share"],
                  c("salary_known_share"), t["trend_min_salary_known_share"]),
        criterion("segment_coverage", c("segment_status") == "passed", c("low_confidence_segments"), 0),
    ])


def product_eligibility(metrics: DataFrame, quality: DataFrame, trends: DataFrame) -> DataFrame:
    """One row per product area. ``quality`` and ``trends`` are ``gate_status`` rows."""
    one = metrics.join(quality.select((F.col("status") == "passed").alias("_quality"))).join(
        trends.select((F.col("status") == "passed").alias("_trend")))
    covered = F.col("salary_known_share") >= 0.10
    known = (F.col("unknown_role_share") <= 0.50) & (F.col("unknown_grade_share") <= 0.50)

    def area(name: str, eligible: Column, good: str, bad: str, condition: Column) -> Column:
        return F.struct(F.lit(name).alias("product"), eligible.alias("eligible"),
                        F.when(condition, good).otherwise(bad).alias("reason"))

    q, tr = F.col("_quality"), F.col("_trend")
    return _rows_of(one, [
        area("search", q, "processed quality gates passed", "processed quality gates failed", q),
        area("salary", q & covered, "salary coverage is usable", "salary coverage is too low", covered),
        area("trends", tr, "trend-ready gates passed", "trend-ready gates not passed", tr),
        area("recommendations", q & known, "role and grade coverage are usable", "role or grade coverage is too weak", known),
    ])


def lineage(meta: DataFrame) -> DataFrame:
    """Semantic type of a processed run.

    ``meta``: source_kind, source_mode, source, dataset_semantic_type, date_semantics_status.
    """
    kind = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("source_kind", "source_mode", "source")], F.lit("unknown"))
    facts = (kind == "minio_backfill_completed") & F.col("date_semantics_status").isNotNull()
    return meta.withColumns({
        "source_kind": kind,
        "dataset_semantic_type": F.coalesce(
            F.when(F.col("dataset_semantic_type") != "", F.col("dataset_semantic_type")),
            F.when(facts, "historical_publication_facts").otherwise("current_market_snapshot")),
    })


def backfill_semantic_type(meta: DataFrame) -> DataFrame:
    """G7 for a backfill: quarantined, coverage_claim, date_semantics_status, source_supported."""
    proven = ~F.coalesce(F.col("coverage_claim").isin(*UNPROVEN_CLAIMS), F.lit(False))
    passed = F.coalesce(F.col("date_semantics_status") == "passed", F.lit(False))
    return meta.withColumn("dataset_semantic_type", F.when(flag("quarantined"), "forensic_quarantined_snapshot").when(
        proven & passed & flag("source_supported"), "historical_publication_facts").otherwise("current_market_snapshot"))


def date_semantics(
    df: DataFrame, first: Column, last: Column, keys: Sequence[str] = (), max_unknown: float = 0.05,
    max_outside: float = 0.0,
) -> DataFrame:
    """Known, unknown and out-of-window publication dates, per ``keys`` or for the whole table.

    ``first`` and ``last`` are dates; for a grouped report they may be key columns.
    """
    rows = df.select(*keys, publication_date(df).alias("_d"), first.cast("date").alias("_from"), last.cast("date").alias("_to"))
    outside = (F.col("_d") < F.col("_from")) | (F.col("_d") > F.col("_to"))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.count("_d").alias("known_published_at_count"),
        F.coalesce(F.sum(F.when(outside, 1).otherwise(0)), F.lit(0)).cast("long").alias("out_of_window_count"),
        F.min("_d").alias("observed_published_at_from"), F.max("_d").alias("observed_published_at_to"),
    )
    out = out.withColumn("unknown_published_at_count", F.col("row_count") - F.col("known_published_at_count"))
    out = out.withColumns({
        "unknown_date_share": _share(F.col("unknown_published_at_count"), F.col("row_count"), 0.0),
        "out_of_window_share": _share(F.col("out_of_window_count"), F.col("row_count"), 0.0),
    })
    failures = F.array_compact(F.array(
        F.when(F.col("unknown_date_share") > max_unknown, F.format_string(
            "unknown_date_share %.6f > max_unknown_share %.6f", "unknown_date_share", F.lit(float(max_unknown)))),
        F.when(F.col("out_of_window_share") > max_outside, F.format_string(
            "out_of_window_share %.6f > max_out_of_window_share %.6f", "out_of_window_share", F.lit(float(max_outside)))),
    ))
    out = out.withColumn("failures", failures)
    return out.withColumn("status", F.when(F.size("failures") == 0, "passed").otherwise("failed"))


def out_of_window_examples(df: DataFrame, first: Column, last: Column, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first rows outside the window, by an explicit order."""
    key = first_existing(df, *RAW_ID_ALIASES)
    rows = df.withColumn("published_on", publication_date(df))
    outside = (F.col("published_on") < first.cast("date")) | (F.col("published_on") > last.cast("date"))
    return rows.where(outside).orderBy(*order).limit(n).select(
        F.col(key).cast("string").alias("vacancy_id") if key else F.lit(None).cast("string").alias("vacancy_id"),
        "published_on")


def cross_partition_duplicates(df: DataFrame, part: str, key: str | None = None) -> DataFrame:
    """G9 as long rows (section, name, value), from one scan of the table.

    Rows are counted per (id, partition) and that narrow table is written once. Ids
    are then counted per list of their partitions; an id is in two neighbouring
    partitions when they stand side by side in its sorted list, so overlaps need no
    join of ids. Blank and NULL ids are missing ones; an empty table has zeros.
    """
    key = key or first_existing(df, *RAW_ID_ALIASES)
    text = F.trim(F.col(key).cast("string"))
    pairs = materialize(df.groupBy(F.when(text != "", text).alias("_id"), F.col(part).cast("string").alias("_part")).agg(
        F.count(F.lit(1)).alias("_n")), "id-partitions")
    # one row per partition value: the list of partitions, not of rows
    per_part = materialize(pairs.groupBy("_part").agg(
        F.sum("_n").alias("rows"), F.count("_id").alias("ids"), F.sum(F.when(F.col("_id").isNull(), F.col("_n"))).alias("missing")), "partitions")
    per_id = pairs.where(F.col("_id").isNotNull()).groupBy("_id").agg(
        F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_parts"), F.array_sort(F.collect_list("_part")).alias("_list"))
    lists = materialize(per_id.groupBy("_list", "_parts").agg(
        F.count(F.lit(1)).alias("ids"), F.sum((F.col("_n") > 1).cast("long")).alias("repeated")), "partition-lists")

    def whole(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    rows = per_part.agg(whole("rows").alias("raw_rows"), whole("missing").alias("missing_id_rows"))
    ids = lists.agg(whole("ids").alias("unique_ids"), whole("repeated").alias("repeated_id_count"))
    one = rows.join(ids).withColumn("duplicate_rows", F.greatest(
        F.col("raw_rows") - F.col("missing_id_rows") - F.col("unique_ids"), F.lit(0)))
    names = ["raw_rows", "missing_id_rows", "unique_ids", "repeated_id_count", "duplicate_rows"]
    summary = wide_to_long(one, [], names, "name", "value").select(F.lit("summary").alias("section"), "name", "value")
    histogram = lists.groupBy("_parts").agg(F.sum("ids").alias("value")).select(
        F.lit("partitions_per_id").alias("section"), F.col("_parts").cast("string").alias("name"), "value")
    sizes = per_part.select(F.lit("partition_rows").alias("section"), F.col("_part").alias("name"), F.col("rows").alias("value"))
    distinct = per_part.select(F.lit("partition_ids").alias("section"), F.col("_part").alias("name"), F.col("ids").alias("value"))
    neighbours = per_part.select("_part", F.lead("_part").over(Window.orderBy("_part")).alias("_right")).where(
        F.col("_right").isNotNull())
    following = F.slice("_list", 2, F.greatest(F.size("_list"), F.lit(1)))
    side_by_side = lists.where(F.size("_list") > 1).select("ids", F.explode(F.filter(
        F.arrays_zip(F.col("_list").alias("_part"), following.alias("_right")), lambda x: x["_right"].isNotNull())).alias("_pair"))
    both = side_by_side.groupBy("_pair._part", "_pair._right").agg(F.sum("ids").alias("_n"))
    overlap = neighbours.join(both, ["_part", "_right"], "left").select(
        F.lit("adjacent_overlap").alias("section"), F.concat_ws("..", "_part", "_right").alias("name"),
        F.coalesce("_n", F.lit(0)).alias("value"))
    return summary.unionByName(histogram).unionByName(sizes).unionByName(distinct).unionByName(overlap)


def with_canonical_key(df: DataFrame) -> DataFrame:
    """C37 on whatever identity columns the table has."""
    def text(*names: str) -> Column:
        present = [F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in df.columns]
        return F.coalesce(*present, F.lit(None).cast("string"))

    source = F.coalesce(text("source_id", "source_mode"), F.lit("hh"))
    content = [text(n) for n in ("title", "name", "company", "employer", "published_at_iso", "published_at")]
    key = canonical_key(source, text("source_vacancy_id", "hh_vacancy_id", "vacancy_id", "id"),
                        text("vacancy_url", "url", "hh_url"), content)
    published = text("published_at_iso", "published_at")
    return df.withColumns({"canonical_key": key, "_published": published})


def _per_key(df: DataFrame, ordinal: str) -> DataFrame:
    """Per canonical key and publication: rows, and the publication seen first for the key."""
    seen = with_canonical_key(df).groupBy("canonical_key", "_published").agg(
        F.count(F.lit(1)).alias("_n"), F.min(ordinal).alias("_first"))
    first = seen.groupBy("canonical_key").agg(
        F.min_by("_published", "_first").alias("first_published_at"), F.sum("_n").alias("_rows"))
    return seen.join(first, "canonical_key")


def _conflict() -> Column:
    return F.coalesce(F.col("_published") != F.col("first_published_at"), F.lit(False))


def duplicate_conflicts(df: DataFrame, ordinal: str) -> DataFrame:
    """One row; a conflict is a publication date that differs from the first row's of its key."""
    per = _per_key(df, ordinal)
    keyed = per.groupBy("canonical_key").agg(
        F.max("_rows").alias("_rows"), F.sum(F.when(_conflict(), F.col("_n")).otherwise(0)).alias("_conflicts"))
    out = keyed.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("unique_keys"),
        F.coalesce(F.sum("_conflicts"), F.lit(0)).alias("conflict_count"))
    return out.withColumns({
        "duplicate_count": F.col("total_rows") - F.col("unique_keys"),
        "duplicate_share": F.bround(_share(F.col("total_rows") - F.col("unique_keys"), F.col("total_rows"), 0.0), 6),
    })


def conflict_examples(df: DataFrame, ordinal: str, n: int = 100) -> DataFrame:
    """Conflicting publications in first-seen order, at most ``n`` of them."""
    return _per_key(df, ordinal).where(_conflict()).orderBy("_first", "canonical_key").limit(n).select(
        "canonical_key", "first_published_at", F.col("_published").alias("conflicting_published_at"),
        F.col("_n").alias("rows"))


def raw_quality(df: DataFrame) -> DataFrame:
    """Rows, duplicates over non-blank ids, completeness per field and per field group."""
    key = first_existing(df, *RAW_ID_ALIASES)
    fields = [c for names in CRITICAL_GROUPS.values() for c in names if c in df.columns]

    def filled(c: str) -> Column:
        return (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").cast("long")

    text = F.trim(F.col(key).cast("string")) if key else F.lit("")
    per_id = df.groupBy(F.when(text != "", text).alias("_id")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(filled(c)).alias(f"_f_{c}") for c in fields])
    out = per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("_id").isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("duplicate_count"),
        *[F.sum(f"_f_{c}").alias(f"_f_{c}") for c in fields])
    n = F.col("row_count")
    out = out.withColumn("duplicate_share", F.bround(_share(F.col("duplicate_count"), n, 0.0), 6))
    out = out.withColumns({f"{c}_completeness": F.bround(_share(F.col(f"_f_{c}"), n, 0.0), 6) for c in fields})
    groups = {}
    for name, members in CRITICAL_GROUPS.items():
        cols = [F.col(f"{c}_completeness") for c in members if c in fields]
        groups[f"{name}_group_completeness"] = F.greatest(*cols) if len(cols) > 1 else (cols[0] if cols else F.lit(0.0))
    return out.withColumns(groups).drop(*[f"_f_{c}" for c in fields])


def collection_quality(shards: DataFrame) -> DataFrame:
    """Shards with errors, blocked shards, empty shards and shares."""
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    blocked = F.exists(errors, lambda e: any_of(F.lower(e).contains(w) for w in BLOCKED_WORDS))

    def count_if(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    out = shards.agg(
        F.count(F.lit(1)).alias("shard_count"), count_if(F.size(errors) > 0).alias("error_shards"),
        count_if(blocked).alias("blocked_shards"),
        count_if(F.coalesce("records_collected", F.lit(0)) == 0).alias("zero_row_shards"))
    n = F.col("shard_count")
    return out.withColumns({
        "successful_shards": n - F.col("error_shards"),
        "success_share": F.when(n > 0, F.bround((n - F.col("error_shards")) / n, 6)),
        "error_share": F.when(n > 0, F.bround(F.col("error_shards") / n, 6)),
    })


def raw_gate(
    state: DataFrame, raw: DataFrame, shards: DataFrame, *, first: Column | None = None, last: Column | None = None,
    min_rows: int, max_removed_share: float, max_duplicate_share: float = 0.20, min_completeness: float = 0.95,
    max_unknown: float = 0.05, max_outside: float = 0.0, max_zero_row_shards: int = 0, max_error_share: float = 0.0,
    min_success_share: float = 1.0,
) -> DataFrame:
    """One row with status and all failures.

    ``state`` is one row: row_count, new_count, removed_count, dataset_scope,
    salary_only and collection_status. Without a window the date check is left out.
    """
    quality = raw_quality(raw).withColumnsRenamed({"row_count": "csv_row_count"})
    collected = collection_quality(shards)
    one = state.join(quality).join(collected)
    if first is not None and last is not None:
        dates = date_semantics(raw, first, last, max_unknown=max_unknown, max_outside=max_outside)
        one = one.join(dates.select(F.col("status").alias("_dates"), F.array_join("failures", "; ").alias("_date_text")))
    else:
        one = one.withColumns({"_dates": F.lit("passed"), "_date_text": F.lit("")})
    c = F.col
    previous = c("row_count") - c("new_count") + c("removed_count")
    removed = F.when(previous > 0, c("removed_count") / previous).otherwise(0.0)
    some = c("shard_count") > 0

    def text(pattern: str, *args) -> Column:
        return F.format_string(pattern, *[a if isinstance(a, Column) else F.lit(a) for a in args])

    incomplete = [
        F.when(c(f"{g}_group_completeness") < min_completeness, text(
            f"{g}_completeness %.4f < min_critical_field_completeness %.4f", c(f"{g}_group_completeness"), min_completeness))
        for g in CRITICAL_GROUPS
    ]
    failures = F.array_compact(F.array(
        F.when(c("row_count") < min_rows, text("row_count %d < min_rows %d", c("row_count"), min_rows)),
        F.when(~F.coalesce(c("dataset_scope").isin("all_vacancies", "salary_disclosed"), F.lit(False)),
               "dataset_scope must be all_vacancies or salary_disclosed"),
        F.when(c("salary_only").isNull(), "salary_only must be present as boolean"),
        F.when(removed > max_removed_share, text("removed_share %.4f > max_removed_share %.4f", removed, max_removed_share)),
        F.when(c("duplicate_share") > max_duplicate_share, text(
            "duplicate_share %.4f > max_duplicate_share %.4f", c("duplicate_share"), max_duplicate_share)),
        F.when(c("csv_row_count") != c("row_count"), text(
            "csv row_count %d != state row_count %d", c("csv_row_count"), c("row_count"))),
        *incomplete,
        F.when(c("_dates") != "passed", F.concat(F.lit("date semantics failed: "), c("_date_text"))),
        F.when(c("collection_status") == "failed", "collection report status failed"),
        F.when(c("blocked_shards") > 0, "collection report contains blocked shards"),
        F.when(some & (c("zero_row_shards") > max_zero_row_shards), text(
            "zero_row_shards %d > max_zero_row_shards %d", c("zero_row_shards"), max_zero_row_shards)),
        F.when(some & (c("error_share") > max_error_share), text(
            "collection_error_share %.4f > max_collection_error_share %.4f", c("error_share"), max_error_share)),
        F.when(some & (c("success_share") < min_success_share), text(
            "collection_success_share %.4f < min_collection_success_share %.4f", c("success_share"), min_success_share)),
    ))
    return one.withColumn("failures", failures).select(
        F.when(F.size("failures") == 0, "passed").otherwise("failed").alias("status"), "failures",
        F.bround(removed, 6).alias("removed_share"), previous.alias("previous_row_count"), "duplicate_share")


def shard_failures(shards: DataFrame, limits: Mapping[str, int] = SHARD_LIMITS) -> DataFrame:
    """(shard_id, failure) rows."""
    c = F.col
    accepted, split = c("status").isin(*ACCEPTED_STATUSES), c("status") == "split"
    plain = c("status") == "accepted"
    empty = (F.coalesce("collected_rows", F.lit(0)) == 0) & ~flag("expected_empty") & ~split
    found = F.array_compact(F.array(
        F.when(c("status").isin(*BLOCKING_STATUSES), F.concat(
            F.lit("blocking status "), c("status"), F.lit(": "), F.coalesce(F.when(c("failure_reason") != "", c("failure_reason")), F.lit("no reason")))),
        F.when((c("found") >= limits["max_found"]) & ~split, F.format_string("found %d reaches result-depth cap", "found")),
        F.when((c("pages") >= limits["max_pages"]) & ~split, F.format_string("pages %d reaches result-depth cap", "pages")),
        F.when(accepted & c("found").isNull(), "accepted shard has no found metadata"),
        F.when(accepted & c("pages").isNull(), "accepted shard has no page metadata"),
        F.when(accepted & (F.coalesce(F.size("status_code_summary"), F.lit(0)) <= 0), "accepted shard has no status_code_summary"),
        F.when(plain & (F.coalesce("collected_rows", F.lit(0)) <= 0), "accepted shard has no rows"),
        F.when(plain & (F.coalesce(F.size("output_keys"), F.lit(0)) <= 0), "accepted shard has no output_keys"),
        F.when(plain & (F.coalesce("checksum", F.lit("")) == ""), "accepted shard has no checksum"),
        F.when(accepted & empty, "zero-row shard lacks expected_empty evidence"),
    ))
    return shards.select("shard_id", F.explode(found).alias("failure"))


def shard_completeness(shards: DataFrame, limits: Mapping[str, int] = SHARD_LIMITS) -> DataFrame:
    """One row of counts and the pass/fail status."""
    c = F.col
    split = F.coalesce(c("status") == "split", F.lit(False))

    def count_if(condition: Column) -> Column:
        return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0))

    out = shards.agg(
        F.count(F.lit(1)).alias("shard_count"), count_if(c("status").isin(*ACCEPTED_STATUSES)).alias("accepted_shards"),
        count_if(c("status").isin(*BLOCKING_STATUSES)).alias("blocking_shards"),
        (count_if((c("found") >= limits["max_found"]) & ~split) + count_if((c("pages") >= limits["max_pages"]) & ~split))
        .alias("over_cap_shards"),
        count_if((F.coalesce("collected_rows", F.lit(0)) == 0) & ~flag("expected_empty") & ~split)
        .alias("unexplained_empty_shards"),
        F.coalesce(F.sum("collected_rows"), F.lit(0)).alias("row_count"))
    failed = shard_failures(shards, limits).agg(F.count(F.lit(1)).alias("shard_failures"))
    out = out.join(failed)
    bad = (c("shard_failures") > 0) | (c("shard_count") == 0) | (c("accepted_shards") == 0)
    return out.withColumn("status", F.when(bad, "failed").otherwise("passed"))


def shard_status_counts(shards: DataFrame) -> DataFrame:
    """Shards and rows per status."""
    return shards.groupBy("status").agg(
        F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("collected_rows"), F.lit(0)).alias("collected_rows"))


def candidate_gate(
    job: DataFrame, shards: DataFrame, rows: DataFrame, ordinal: str, max_duplicate_share: float = 0.05,
    limits: Mapping[str, int] = SHARD_LIMITS,
) -> DataFrame:
    """Accepted or blocked, with the number and kinds of failures.

    ``job`` is one row: status, status_reason, coverage_claim,
    closed_archived_coverage, source_supported.
    """
    c = F.col
    one = job.select(
        c("status").alias("job_status"), "status_reason", "coverage_claim", "closed_archived_coverage", "source_supported"
    ).join(shard_completeness(shards, limits).withColumnRenamed("status", "shard_status")).join(duplicate_conflicts(rows, ordinal))
    archive = c("coverage_claim") == "complete_hh_archive"
    open_archive = F.coalesce(c("closed_archived_coverage"), F.lit("")) != "included"
    failures = F.array_compact(F.array(
        F.when(~flag("source_supported"), "source_capability_ref: not supported"),
        F.when(c("job_status").isin("blocked", "quarantined", "failed"), F.concat(
            F.lit("job status is "), c("job_status"), F.lit(": "), F.coalesce("status_reason", F.lit("no reason")))),
        F.when(c("coverage_claim").isin(*UNPROVEN_CLAIMS), "coverage_claim is not publishable"),
        F.when(archive & open_archive, "complete archive claim requires closed_archived_coverage=included"),
        F.when(c("shard_failures") > 0, F.format_string("shard failures: %d", "shard_failures")),
        F.when(c("shard_count") == 0, "candidate has no shards"),
        F.when(c("accepted_shards") == 0, "candidate has no accepted shards"),
        F.when(c("conflict_count") > 0, F.format_string("duplicate conflicts detected: %d", "conflict_count")),
        F.when(c("duplicate_share") > max_duplicate_share, F.format_string(
            "duplicate_share %.6f > max_duplicate_share %.6f", "duplicate_share", F.lit(float(max_duplicate_share)))),
    ))
    warnings = F.array_compact(F.array(F.when(
        (c("coverage_claim") == "retrievable_through_proven_source") & open_archive,
        "coverage is source-retrievable, not a proven complete archive")))
    return one.withColumns({"failures": failures, "warnings": warnings}).select(
        F.when(F.size("failures") == 0, "accepted").otherwise("blocked").alias("status"), "failures", "warnings",
        "shard_count", "accepted_shards", "row_count", "duplicate_count", "conflict_count")


def backfill_progress(shards: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shards per status group and collected rows."""
    def count_in(statuses: Sequence[str]) -> Column:
        return F.sum(F.coalesce(F.col("status").isin(*statuses), F.lit(False)).cast("long"))

    return shards.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shard_count"), count_in(ACCEPTED_STATUSES).alias("accepted_shards"),
        count_in(PLANNED_STATUSES).alias("planned_shards"), count_in(BLOCKING_STATUSES).alias("blocking_shards"),
        F.coalesce(F.sum("collected_rows"), F.lit(0)).alias("collected_rows"))


def completeness_status(expected: Column, stored: Column, indexed: Column) -> Column:
    """G19."""
    return (
        F.when(F.coalesce(stored, F.lit(-1)) != expected, "incomplete").when(indexed.isNull(), "not_configured")
        .when(indexed == expected, "complete").otherwise("incomplete"))
