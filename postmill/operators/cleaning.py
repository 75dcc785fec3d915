"""B: marker handling, column health, boolean coercion, dates, salary, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.columns import NUMERIC, columns_of, dtype, first_match, whole_days
from postmill.functions.fixed_values import (
    BOOL_NULL_TEXTS, BUSINESS_COLUMNS, COLUMN_NOTES, COVERAGE_BUCKETS, COVERAGE_REST, FALSE_MARKERS,
    LOW_INFORMATION_SHARE, MOSTLY_MISSING_SHARE, PREFIX_GROUPS, TRUE_MARKERS, UNKNOWN_FILLED, UNKNOWN_MARKERS,
    ZERO_FILLED,
)
from postmill.operators.quantiles import grouped_quantiles


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _is_marker(name: str, markers: Sequence[str]) -> Column:
    return F.coalesce(F.lower(F.trim(_q(name))).isin(*markers), F.lit(False))


def _share(condition: Column) -> Column:
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))


def _is_missing(df: DataFrame, name: str) -> Column:
    missing = _q(name).isNull()
    if isinstance(dtype(df, name), (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(_q(name))
    return missing


def standardize_unknown_markers(df: DataFrame, markers: Sequence[str] = UNKNOWN_MARKERS) -> DataFrame:
    """B1: text markers of an unknown value become NULL."""
    return df.withColumns({
        f"{c}": F.when(~_is_marker(c, markers), _q(c)) for c in columns_of(df, T.StringType)
    })


def marker_counts(df: DataFrame, markers: Sequence[str] = UNKNOWN_MARKERS) -> DataFrame:
    """B1 report: affected columns with their marker rows, from one aggregate."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.sum(_is_marker(c, markers).cast("long")).alias("rows"))
        for c in columns_of(df, T.StringType)
    ])
    return df.agg(entries.alias("e")).select(F.explode("e").alias("e")).select("e.*").where(F.col("rows") > 0)


def _health(df: DataFrame, prefix: str = "", notes: Mapping[str, str] = COLUMN_NOTES) -> Column:
    """Aggregate: one struct per column with its shares of missing values and markers."""
    entries = []
    for f in df.schema.fields:
        text = isinstance(f.dataType, T.StringType)
        entries.append(F.struct(
            F.lit(f"{prefix}{f.name}").alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(notes.get(f.name)).cast("string").alias("note"),
            _share(_is_missing(df, f.name)).alias("share_nan"),
            (_share(_is_marker(f.name, UNKNOWN_MARKERS)) if text else F.lit(0.0)).alias("share_unknown_marker"),
        ))
    return F.array(*entries)


def data_health(df: DataFrame, prefix: str = "", notes: Mapping[str, str] = COLUMN_NOTES) -> DataFrame:
    """B2: one row per column; one wide aggregate, unpivoted afterwards."""
    long = df.agg(_health(df, prefix, notes).alias("e")).select(F.explode("e").alias("e")).select("e.*")
    effective = F.least(F.col("share_nan") + F.col("share_unknown_marker"), F.lit(1.0))
    coverage = F.greatest(1 - F.col("effective_missing_share"), F.lit(0.0))
    by_coverage = [(F.col("coverage_share") >= lo, bucket, use) for lo, bucket, use in COVERAGE_BUCKETS]
    remarks = F.array_compact(F.array(
        F.col("note"),
        F.when(F.col("share_nan") > 0, F.format_string("NaN %.1f%%", F.col("share_nan") * 100)),
        F.when(F.col("share_unknown_marker") > 0,
               F.format_string("text marker %.1f%%", F.col("share_unknown_marker") * 100)),
    ))
    return (
        long.withColumn("effective_missing_share", effective)
        .withColumn("coverage_share", coverage)
        .withColumns({
            "quality_bucket": first_match([(c, b) for c, b, _ in by_coverage], COVERAGE_REST[0]),
            "recommended_use": first_match([(c, u) for c, _, u in by_coverage], COVERAGE_REST[1]),
            "comment": F.when(F.size(remarks) > 0, F.array_join(remarks, "; ")).otherwise("clean"),
        })
        .drop("note")
    )


def low_information_columns(df: DataFrame, threshold: float = LOW_INFORMATION_SHARE) -> DataFrame:
    """B3."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    return (
        data_health(df).where(F.col("effective_missing_share") >= threshold)
        .select("column", "dtype", F.col("share_nan").alias("na_share"),
                F.col("share_unknown_marker").alias("unknown_share"), "effective_missing_share")
        .orderBy(F.desc("effective_missing_share"), "column")
    )


def drop_low_information(
    df: DataFrame, threshold: float = LOW_INFORMATION_SHARE, keep: Sequence[str] = BUSINESS_COLUMNS
) -> tuple[DataFrame, list[str], list[str]]:
    """(frame, dropped, retained). Collects one row per column to choose the projection."""
    low = [r["column"] for r in low_information_columns(df, threshold).collect()]
    dropped = [c for c in low if c not in keep]
    return df.drop(*dropped), dropped, [c for c in low if c in keep]


def drop_mostly_missing(
    df: DataFrame, threshold: float = MOSTLY_MISSING_SHARE
) -> tuple[DataFrame, list[str]]:
    """As B4 on the plain NULL share."""
    dropped = [r["column"] for r in data_health(df).where(F.col("share_nan") >= threshold).collect()]
    return df.drop(*dropped), dropped


def to_boolean(df: DataFrame, name: str) -> Column:
    """Boolean-like text or 0/1 as boolean; anything else becomes NULL."""
    kind = dtype(df, name)
    if isinstance(kind, T.BooleanType):
        return _q(name)
    text = F.lower(F.trim(_q(name).cast("string")))
    if isinstance(kind, NUMERIC):
        return F.when(_q(name) == 1, True).when(_q(name) == 0, False)
    return F.when(text.isin(*TRUE_MARKERS), True).when(text.isin(*FALSE_MARKERS), False)


def _all_boolean_like(names: Sequence[str]) -> list[Column]:
    """Aggregates ``c0``, ``c1``, ...: whether all values of a text column are boolean-like, NULL without values."""
    allowed = [*TRUE_MARKERS, *FALSE_MARKERS, *UNKNOWN_MARKERS, *BOOL_NULL_TEXTS]
    return [F.bool_and(F.lower(F.trim(_q(c))).isin(*allowed)).alias(f"c{i}") for i, c in enumerate(names)]


def boolean_like_columns(df: DataFrame) -> list[str]:
    """B6 detection: string columns whose every value is boolean-like (one aggregate, one row)."""
    names = columns_of(df, T.StringType)
    if not names:
        return []
    row = df.agg(*_all_boolean_like(names)).first()
    # an all-NULL text column stays text
    return [c for i, c in enumerate(names) if row[f"c{i}"] is True]


def coerce_boolean_columns(df: DataFrame, texts: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Prefixed columns and ``salary_gross`` always, text columns when all values allow it.

    ``texts`` are the boolean-like text columns where they are known already. Counters that share a prefix (``*_count``) and other numeric columns are left alone.
    """
    forced = [
        f.name for f in df.schema.fields
        if (f.name.startswith(tuple(PREFIX_GROUPS)) or f.name == "salary_gross") and not f.name.endswith("_count")
    ]
    names = list(dict.fromkeys(forced + (boolean_like_columns(df) if texts is None else list(texts))))
    return df.withColumns({c: to_boolean(df, c) for c in names}), names


def ensure_salary_gross_boolean(df: DataFrame) -> DataFrame:
    """B7."""
    return df.withColumn("salary_gross", to_boolean(df, "salary_gross")) if "salary_gross" in df.columns else df


def fill_categorical(df: DataFrame, names: Sequence[str] = UNKNOWN_FILLED) -> DataFrame:
    """B8."""
    present = [c for c in names if c in columns_of(df, T.StringType)]
    return df.fillna("unknown", present) if present else df


def fill_counters(df: DataFrame, names: Sequence[str] = ZERO_FILLED) -> DataFrame:
    """Listed counters and ``*_count`` columns; salaries and ratings keep their gaps."""
    present = [c for c in columns_of(df, NUMERIC) if c in names or c.endswith("_count")]
    return df.fillna(0, present) if present else df


def handle_missingness(df: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
    """Markers, low information, booleans, categories, counters, in this order."""
    df = standardize_unknown_markers(df)
    # both choices read the same rows, so one aggregate serves them
    texts = columns_of(df, T.StringType)
    row = df.agg(_health(df).alias("health"), *_all_boolean_like(texts)).first()
    missing = {e["column"]: min(e["share_nan"] + e["share_unknown_marker"], 1.0) for e in row["health"]}
    low = sorted((c for c, share in missing.items() if share >= LOW_INFORMATION_SHARE), key=lambda c: (-missing[c], c))
    dropped, retained = [c for c in low if c not in BUSINESS_COLUMNS], [c for c in low if c in BUSINESS_COLUMNS]
    df, booleans = coerce_boolean_columns(
        df.drop(*dropped), [c for i, c in enumerate(texts) if row[f"c{i}"] is True and c not in dropped])
    return fill_counters(fill_categorical(df)), {"dropped": dropped, "retained": retained, "boolean": booleans}


def _as_timestamp(df: DataFrame, name: str) -> Column:
    if isinstance(dtype(df, name), T.StringType):
        return F.try_to_timestamp(F.trim(_q(name)))
    return _q(name).cast("timestamp")


def parse_dates(df: DataFrame, published: str = "published_at_iso", scraped: str = "scraped_at_utc") -> DataFrame:
    """Invalid text becomes NULL; the age floors toward minus infinity."""
    df = df.withColumns({c: _as_timestamp(df, c) for c in (published, scraped) if c in df.columns})
    if published in df.columns and scraped in df.columns:
        df = df.withColumn("vacancy_age_days", whole_days(_q(scraped), _q(published)))
    return df


def prepare_salary(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """RUB salary, known flag and the salary capped at exact quantiles (one joined row)."""
    mid = _q("salary_mid").cast("double") if "salary_mid" in df.columns else F.lit(None).cast("double")
    rub = F.when(_q("currency") == "RUB", mid) if "currency" in df.columns else F.lit(None).cast("double")
    df = df.withColumn("salary_mid_rub", rub).withColumn("salary_known", F.col("salary_mid_rub").isNotNull())
    caps = grouped_quantiles(df, [], "salary_mid_rub", {"_low": low, "_high": high})
    capped = F.when(
        F.col("salary_mid_rub").isNotNull(), F.least(F.greatest("salary_mid_rub", "_low"), F.col("_high"))
    )
    return (
        df.join(F.broadcast(caps), F.lit(True), "left")
        .withColumn("salary_mid_rub_capped", capped).drop("_low", "_high")
    )


def non_rub_share(df: DataFrame) -> DataFrame:
    """B12 report."""
    return df.agg(F.avg((F.coalesce("currency", F.lit("")) != "RUB").cast("double")).alias("non_rub_share"))


def deduplicate_latest(
    df: DataFrame, key: str = "vacancy_id", scraped: str = "scraped_at_utc", ties: Sequence[Column] = ()
) -> DataFrame:
    """The latest row per id, missing dates last.

    ``row_number() = 1`` lets Spark keep one row per id in every map task before
    the shuffle, so an id with very many copies does not reach one task whole.
    """
    if key not in df.columns:
        return df
    order = [F.desc_nulls_last(scraped)] if scraped in df.columns else []
    newest = Window.partitionBy(key).orderBy(*order, *ties, *([] if order or ties else [F.lit(0)]))
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1).drop("_rn")


def check_unique_id(df: DataFrame, key: str = "vacancy_id") -> DataFrame:
    """duplicates = rows - distinct ids; all NULL ids together are one id."""
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    out = per_id.agg((F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"))
    return out.select((F.col("duplicates") == 0).alias("is_unique"), "duplicates")


def missing_share(df: DataFrame, n: int = 20) -> DataFrame:
    """Columns with the highest NULL share."""
    return (
        data_health(df).select("column", F.col("share_nan").alias("missing_share"))
        .orderBy(F.desc("missing_share"), "column").limit(n)
    )


def basic_profile(df: DataFrame) -> DataFrame:
    """Rows, columns and columns per type."""
    kinds: dict[str, int] = {}
    for f in df.schema.fields:
        kinds[f.dataType.simpleString()] = kinds.get(f.dataType.simpleString(), 0) + 1
    types = F.array(*[F.struct(F.lit(k).alias("dtype"), F.lit(n).alias("columns")) for k, n in kinds.items()])
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("rows", F.lit(len(df.columns)).alias("columns_total"), F.explode(types).alias("t")).select(
        "rows", "columns_total", "t.dtype", "t.columns"
    )


def stage_profile(stages: Mapping[str, DataFrame]) -> DataFrame:
    """One row per stage; the aggregate stage weighs its remote share by count."""
    parts = []
    for name, df in stages.items():
        salary = next((c for c in ("salary_mid_rub_capped", "salary_mid_rub", "salary_mid", "salary_median")
                       if c in df.columns), None)
        aggregate = "vacancy_count_total" in df.columns
        if aggregate and "remote_share" in df.columns:
            remote = F.sum(F.col("remote_share") * F.col("vacancy_count_total")) / F.sum("vacancy_count_total")
        elif "is_remote" in df.columns:
            remote = F.avg(F.coalesce("is_remote", F.lit(False)).cast("double"))
        else:
            remote = F.lit(None).cast("double")
        currency = (F.avg((F.coalesce("currency", F.lit("")) == "RUB").cast("double"))
                    if "currency" in df.columns else F.lit(None).cast("double"))
        role = (F.avg((F.coalesce("primary_role", F.lit("unknown")) == "unknown").cast("double"))
                if "primary_role" in df.columns else F.lit(None).cast("double"))
        parts.append(df.agg(
            F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
            (F.avg(_q(salary).isNotNull().cast("double")) if salary else F.lit(None).cast("double"))
            .alias("salary_share"),
            currency.alias("rub_share"), remote.alias("remote_share"), role.alias("unknown_role_share"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
