"""H: snapshot deltas, latest-per-id materialisation, serving rows and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.columns import dtype
from postmill.functions.normalize import from_aliases, id_text, normalize_id
from postmill.operators.gates import date_semantics

# --- fixed values ----------------------------------------------------------

SCHEMA_ALIASES = {
    "hh_vacancy_id": ["hh_vacancy_id", "vacancy_id", "id"],
    "title": ["title", "name"],
    "url": ["url", "vacancy_url", "hh_url"],
    "hh_url": ["hh_url", "vacancy_url", "url"],
    "published_at": ["published_at", "published_at_iso", "published_at_raw"],
}
COMPARED_FIELDS = [
    "title", "primary_role", "grade", "city", "city_tier", "country", "region", "city_normalized", "geo_scope",
    "salary_from", "salary_to", "skills", "description_snippet", "url", "hh_url", "published_at", "dataset_run_id",
]
SNIPPET_LENGTH = 5000

# ---------------------------------------------------------------------------


def _ids(df: DataFrame, key: str) -> DataFrame:
    text = F.trim(F.col(key).cast("string"))
    return df.select(text.alias("id")).where((F.col("id") != "") & F.col("id").isNotNull())


def snapshot_delta(previous: DataFrame, current: DataFrame, key: str = "vacancy_id") -> DataFrame:
    """H1: (id, change) for added and removed ids.

    Both sides are tagged and folded per id: one shuffle, and copies of an id
    collapse before it.
    """
    tagged = _ids(previous, key).withColumns({"_old": F.lit(True), "_new": F.lit(False)}).unionByName(
        _ids(current, key).withColumns({"_old": F.lit(False), "_new": F.lit(True)}))
    sides = tagged.groupBy("id").agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    changed = sides.where(F.col("_old") != F.col("_new"))
    return changed.select("id", F.when(F.col("_new"), "new").otherwise("removed").alias("change")).orderBy("change", "id")


def delta_counts(delta: DataFrame) -> DataFrame:
    """H1: new and removed ids."""
    return delta.agg(
        F.count(F.when(F.col("change") == "new", 1)).alias("new_count"),
        F.count(F.when(F.col("change") == "removed", 1)).alias("removed_count"))


def completed_days(df: DataFrame, day: str, max_date: Column, min_days: int) -> int:
    """H2 guard: number of days up to ``max_date``; fails when there are too few."""
    n = df.where(F.col(day) <= max_date).select(day).distinct().count()
    if n < min_days:
        raise ValueError(f"only {n} completed days, need {min_days}")
    return n


def materialize_latest(
    partitions: DataFrame, day: str, key: str, ordinal: Sequence[str], max_date: Column, min_days: int = 1,
    prefix: str = "",
) -> DataFrame:
    """H2: the newest day wins per id without its blanks, the first row wins inside a day, blank ids are left out.

    The filter on the partition column prunes files; ``row_number() = 1`` keeps
    one row per id in each map task before the shuffle.
    """
    completed_days(partitions, day, max_date, min_days)
    rows = partitions.where(F.col(day) <= max_date)
    named = rows.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "")
    newest = Window.partitionBy(F.trim(F.col(key).cast("string"))).orderBy(F.desc(day), *ordinal)
    picked = named.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1).drop("_rn")
    date = F.col(day).cast("string")
    return picked.withColumns({
        "backfill_snapshot_date": date,
        "backfill_source_key": F.concat(F.lit(f"{prefix}date="), date, F.lit("/snapshot.csv")),
    })


def materialization_report(partitions: DataFrame, day: str, key: str, max_date: Column) -> DataFrame:
    """H2: rows and blank ids per day."""
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    return partitions.where(F.col(day) <= max_date).groupBy(day).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(blank.cast("long")).alias("skipped_missing_id"))


def normalize_schema(df: DataFrame) -> DataFrame:
    """C38 over the serving schema: each target filled from its first filled alias."""
    out = {}
    for target, names in SCHEMA_ALIASES.items():
        present = [n for n in names if n in df.columns]
        if not present:
            continue
        # the target itself leads, whatever its place in the list
        ordered = ([target] if target in present else []) + [n for n in present if n != target]
        kinds = {dtype(df, n).simpleString() for n in ordered}

        def as_text(n: str) -> Column:
            if isinstance(dtype(df, n), (T.DoubleType, T.FloatType)):
                return id_text(F.col(n))
            return F.col(n).cast("string")

        mixed = len(kinds) > 1 or target == "hh_vacancy_id"
        out[target] = from_aliases(*[as_text(n) if mixed else F.col(n) for n in ordered])
    return df.withColumns(out)


def posting_serving_rows(features: DataFrame, ordinal: Sequence[Column], run_id: str | None = None) -> DataFrame:
    """H4: one row per normalised id, the last by ``ordinal``; blank ids and titles are left out."""
    df = normalize_schema(features)
    if not {"hh_vacancy_id", "title"} <= set(df.columns):
        raise ValueError("expected an id and a title column")
    df = df.withColumns({"hh_vacancy_id": normalize_id(F.col("hh_vacancy_id")), "title": F.trim("title")})
    df = df.where((F.col("hh_vacancy_id") != "") & (F.col("title") != ""))

    def text(name: str) -> Column:
        return F.when(F.col(name).cast("string") != "", F.col(name).cast("string")) if name in df.columns else F.lit(
            None).cast("string")

    def listed(source: str) -> Column:
        if isinstance(dtype(df, source), T.ArrayType):
            return F.filter(source, lambda s: s != "")
        return F.filter(F.transform(F.split(source, ","), lambda s: F.trim(s)), lambda s: s != "")

    # each row falls back from the one column to the other
    present = [listed(c) for c in ("skills", "top_skills_list") if c in df.columns]
    skills = F.coalesce(*[F.when(F.size(c) > 0, c) for c in present], *present[:1], F.array().cast("array<string>"))
    last = Window.partitionBy("hh_vacancy_id").orderBy(*ordinal)
    rows = df.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") == 1)
    number = {n: F.col(n).try_cast("long") if n in df.columns else F.lit(None).cast("long") for n in ("salary_from", "salary_to")}
    return rows.select(
        "hh_vacancy_id", "title", text("primary_role").alias("primary_role"),
        F.coalesce(text("grade_final"), text("grade")).alias("grade"),
        *[text(c).alias(c) for c in ("city", "city_tier", "country", "region", "city_normalized", "geo_scope")],
        number["salary_from"].alias("salary_from"), number["salary_to"].alias("salary_to"),
        F.coalesce(skills, F.array().cast("array<string>")).alias("skills"),
        F.substring(text("description"), 1, SNIPPET_LENGTH).alias("description_snippet"), text("url").alias("url"),
        F.coalesce(text("hh_url"), text("url")).alias("hh_url"),
        (F.col("published_at").try_cast("timestamp") if "published_at" in df.columns else F.lit(None).cast("timestamp"))
        .alias("published_at"),
        F.lit(run_id).cast("string").alias("dataset_run_id"),
    )


def _differing(fields: Sequence[str]) -> Column:
    """Names of the fields in which the structs ``_old`` and ``_new`` differ."""
    return F.array_compact(F.array(*[
        F.when(~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")), F.lit(f)) for f in fields
    ]))


def reconcile(
    existing: DataFrame, incoming: DataFrame, key: str = "hh_vacancy_id", fields: Sequence[str] = COMPARED_FIELDS
) -> DataFrame:
    """H5: (key, action, changed_fields) from one full outer join on unique ids."""
    present = [f for f in fields if f in existing.columns and f in incoming.columns]
    old = existing.select(F.col(key), F.struct(*present).alias("_old"))
    new = incoming.select(F.col(key), F.struct(*present).alias("_new"))
    both = old.join(new, key, "full")
    differing = _differing(present)
    action = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
        .when(F.size(differing) > 0, "update").otherwise("unchanged"))
    changed = F.when(action == "update", differing).otherwise(F.array().cast("array<string>"))
    return both.select(key, action.alias("action"), changed.alias("changed_fields"))


def reconcile_counts(actions: DataFrame) -> DataFrame:
    """H5: inserted, updated, deleted and unchanged rows."""
    def n(name: str, alias: str) -> Column:
        return F.count(F.when(F.col("action") == name, 1)).alias(alias)

    return actions.agg(
        n("insert", "inserted"), n("update", "updated"), n("delete", "deleted"), n("unchanged", "unchanged"),
        F.count(F.when(F.col("action") != "delete", 1)).alias("expected"))


def apply_reconciliation(existing: DataFrame, incoming: DataFrame, key: str = "hh_vacancy_id") -> DataFrame:
    """H5: the table after reconciliation is the incoming one; ids keep their first-seen index time.

    ``existing`` carries indexed_at; unchanged rows keep it, others take the incoming one.
    Ids are unique, as in ``reconcile``. Both tables are read once: an incoming row is unchanged when the
    existing row of its id differs in no compared field, and deleted ids have no incoming row.
    """
    present = [f for f in COMPARED_FIELDS if f in existing.columns and f in incoming.columns]
    old = existing.select(key, F.struct(*present).alias("_old"), F.col("indexed_at").alias("_was"))
    both = incoming.where(F.col(key).isNotNull()).withColumn("_new", F.struct(*present)).join(old, key, "left")
    unchanged = F.col("_old").isNotNull() & (F.size(_differing(present)) == 0)
    when = F.when(unchanged, F.col("_was")).otherwise(F.col("indexed_at"))
    return both.withColumn("indexed_at", when).drop("_old", "_new", "_was")


def day_metadata(df: DataFrame, day: str, limit_per_day: int, max_unknown: float = 0.05, max_outside: float = 0.0) -> DataFrame:
    """H6: rows, limit flag and date semantics of each day's partition."""
    out = date_semantics(df, F.col(day), F.col(day), [day], max_unknown, max_outside)
    return out.withColumn("hit_limit", F.col("row_count") >= limit_per_day)
