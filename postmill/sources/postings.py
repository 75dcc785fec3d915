"""Raw snapshots, daily partitions, compaction, source items and snapshot history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from postmill.functions.fixed_values import (
    BENEFIT_WORDS, DATA_SKILL_WORDS, DOMAIN_WORDS, JUNIOR_WORDS, ROLE_WORDS, SOFT_SKILL_WORDS, TECH_WORDS,
)
from postmill.functions.text import salary_features
from postmill.operators.cleaning import boolean_like_columns, to_boolean

# --- fixed values: typed columns of a raw posting; all others are text ------

LONG_COLUMNS = [
    "salary_from", "salary_to", "salary_range_width", "metro_count", "search_area_id", "exp_min_years", "exp_max_years",
    "description_len_chars", "description_len_words", "description_bullets_count", "description_paragraphs_count",
    "requirements_count", "responsibilities_count", "must_have_skills_count", "optional_skills_count", "skills_count",
    "core_data_skills_count", "ml_stack_count", "tech_stack_size", "lang_other_count", "vacancy_age_days",
    "employer_reviews_count",
]
DOUBLE_COLUMNS = ["salary_mid", "employer_rating"]
BOOLEAN_COLUMNS = [
    "salary_gross", "salary_is_exact", "salary_disclosed", "has_metro", "address_has_district", "exp_is_no_experience",
    "is_remote", "is_hybrid", "edu_required", "edu_technical", "edu_math_or_cs", "lang_english_required",
    "employer_has_remote", "employer_has_flexible_schedule", "employer_has_med_insurance", "employer_has_education",
    "employer_accredited_it",
]

# ---------------------------------------------------------------------------

FLAG_COLUMNS = [
    *ROLE_WORDS, *TECH_WORDS, *BENEFIT_WORDS, *DATA_SKILL_WORDS, *SOFT_SKILL_WORDS, *DOMAIN_WORDS, *JUNIOR_WORDS,
]


def declared_types() -> dict[str, str]:
    """Column -> type of the raw posting table."""
    return {
        **dict.fromkeys(LONG_COLUMNS, "bigint"), **dict.fromkeys(DOUBLE_COLUMNS, "double"),
        **dict.fromkeys([*BOOLEAN_COLUMNS, *FLAG_COLUMNS], "boolean"),
    }


def read_raw_postings(spark: SparkSession, path: str, types: Mapping[str, str] | None = None) -> DataFrame:
    """A1: CSV with header and quoted line breaks; types are declared by name, never inferred."""
    declared = declared_types() if types is None else types
    text = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')

    def typed(c: str) -> Column:
        kind = declared.get(c)
        if kind is None:
            return F.col(f"`{c}`")
        value = to_boolean(text, c) if kind == "boolean" else F.trim(F.col(f"`{c}`")).try_cast("double")
        return (value if kind in ("boolean", "double") else value.cast(kind)).alias(c)

    return text.select(*[typed(c) for c in text.columns])


def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A2: boolean-like text columns become booleans, then Parquet or CSV."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt}")
    df = df.withColumns({c: to_boolean(df, c) for c in boolean_like_columns(df)} or {})
    writer = df.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.parquet(path)


def write_daily_snapshot(df: DataFrame, path: str, date: str | Column) -> None:
    """A3: every column as text, zstd, one ``date=`` partition per day; a day that is written again is replaced."""
    day = F.lit(date) if isinstance(date, str) else F.date_format(date, "yyyy-MM-dd")
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != "date"], day.alias("date"))
    (
        text.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd").partitionBy("date").parquet(path)
    )


def unified_schema(schemas: Sequence[T.StructType]) -> dict[str, str]:
    """Fields of all schemas in first-seen order; differing types widen to double among numbers, else to text."""
    out: dict[str, str] = {}
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    for schema in schemas:
        for f in schema.fields:
            kind = f.dataType.simpleString()
            old = out.setdefault(f.name, kind)
            if old != kind:
                pair = {old, kind}
                whole = pair <= numbers - {"float", "double"}
                out[f.name] = "bigint" if whole else "double" if pair <= numbers else "string"
    return out


def union_with_schema(frames: Sequence[DataFrame], types: Mapping[str, str]) -> DataFrame:
    """Union by name under one schema; missing columns are NULL."""
    parts = [
        df.select(*[
            (F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in types.items()
        ]) for df in frames
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column from the folder names; empty when the table does not exist yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(unquote(n.removeprefix(f"{column}=")) for n in names if n.startswith(f"{column}="))


def _same_schema_days(spark: SparkSession, source: str, days: Sequence[str]) -> list[tuple[T.StructType, list[str]]]:
    """(schema, days) groups that one reader can take; only footers are read.

    Days whose schemas merge stay together. Where types conflict the days are
    halved, so only the days around a change of schema are looked at closely.
    """
    paths = [f"{source}/date={d}" for d in days]
    try:
        return [(spark.read.option("mergeSchema", True).parquet(*paths).schema, list(days))]
    except Exception as e:  # the conflict arrives as an untyped JVM error
        if "CANNOT_MERGE_SCHEMAS" not in str(e) or len(days) == 1:
            raise
    half = len(days) // 2
    return _same_schema_days(spark, source, days[:half]) + _same_schema_days(spark, source, days[half:])


def compact_monthly(spark: SparkSession, source: str, target: str, months: Sequence[str] | None = None) -> list[str]:
    """A4: daily partitions to one partition per month; months that exist are skipped.

    Rows are dealt by month and months are split by size, so a large month is
    written by several tasks. Conflicting column types become text.
    """
    days = partition_values(spark, source, "date")
    done = set(partition_values(spark, target, "month"))
    wanted = [d for d in days if (months is None or d[:7] in months) and d[:7] not in done]
    if not wanted:
        return []
    parts = _same_schema_days(spark, source, wanted)
    types = unified_schema([schema for schema, _ in parts])
    frames = [
        spark.read.option("basePath", source).schema(T.StructType([*schema.fields, T.StructField("date", T.StringType())]))
        .parquet(*[f"{source}/date={d}" for d in days])
        for schema, days in parts
    ]
    rows = union_with_schema(frames, {**types, "date": "string"}).withColumn("month", F.substring("date", 1, 7))
    (
        rows.hint("rebalance", "month").write.mode("append").option("compression", "zstd")
        .partitionBy("month").parquet(target)
    )
    return sorted({d[:7] for d in wanted})


def union_all_partitions(frames: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """A5: (date, source key, frame) rows under the union header, with their provenance."""
    out = None
    for date, key, df in frames:
        part = df.withColumns({"backfill_snapshot_date": F.lit(date), "backfill_source_key": F.lit(key)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no partitions")
    provenance = ["backfill_snapshot_date", "backfill_source_key"]
    return out.select(*[c for c in out.columns if c not in provenance], *provenance)


ITEM_SCHEMA = """id string, name string, published_at string, alternate_url string, url string,
  salary struct<`from`: double, `to`: double, currency: string, gross: boolean>,
  employer struct<name: string, alternate_url: string, url: string>, area struct<name: string>,
  experience struct<id: string, name: string>, schedule struct<id: string, name: string>,
  employment struct<id: string, name: string>"""


def read_api_items(spark: SparkSession, path: str) -> DataFrame:
    """Source items, one JSON object per line, with a declared schema."""
    return spark.read.schema(ITEM_SCHEMA).json(path)


def flatten_api_items(items: DataFrame, area_id: int, dataset_scope: str) -> DataFrame:
    """Nested source items as flat postings; every flag group starts as false."""
    def text(*names: str) -> Column:
        return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names], F.lit(""))

    low, high = F.col("salary.from"), F.col("salary.to")
    derived = salary_features(low, high)
    flags = [c for c in FLAG_COLUMNS if c.startswith(("role_", "has_", "skill_", "benefit_", "soft_", "domain_"))]
    return items.select(
        text("id").alias("vacancy_id"), text("name").alias("title"), text("employer.name").alias("company"),
        low.alias("salary_from"), high.alias("salary_to"), F.col("salary.currency").alias("currency"),
        F.col("salary.gross").alias("salary_gross"), derived["salary_mid"].alias("salary_mid"),
        F.when(low.isNotNull() & high.isNotNull(), (high - low).cast("bigint")).alias("salary_range_width"),
        derived["salary_is_exact"].alias("salary_is_exact"), text("area.name").alias("city"),
        F.lit(area_id).alias("search_area_id"), text("experience.name", "experience.id").alias("experience"),
        F.coalesce(F.col("experience.id") == "noExperience", F.lit(False)).alias("exp_is_no_experience"),
        text("employment.name", "employment.id").alias("employment_type"), text("schedule.name", "schedule.id").alias("schedule"),
        F.coalesce(F.col("schedule.id") == "remote", F.lit(False)).alias("is_remote"), F.lit(False).alias("is_hybrid"),
        F.coalesce("published_at", F.lit("")).alias("published_at_raw"),
        F.when(F.col("published_at") != "", F.substring("published_at", 1, 10)).alias("published_at_iso"),
        F.lit("unknown").alias("grade"), text("alternate_url", "url").alias("vacancy_url"),
        text("employer.alternate_url", "employer.url").alias("employer_url"), F.lit(dataset_scope).alias("dataset_scope"),
        (low.isNotNull() | high.isNotNull()).alias("salary_disclosed"), *[F.lit(False).alias(c) for c in flags],
    )


def write_weekly_snapshot(snapshot: DataFrame, path: str) -> None:
    """One partition per week; a week that is written again is replaced."""
    (
        snapshot.hint("rebalance", "week_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("week_start").parquet(path)
    )


def load_snapshot_history(spark: SparkSession, path: str) -> DataFrame:
    """All weekly snapshots; consumers order by week where they need it."""
    history = spark.read.parquet(path)
    return history.withColumn("week_start", F.col("week_start").cast("date"))
