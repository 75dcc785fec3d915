"""Export shapes and learning resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_skill_gap(gaps: DataFrame, trust: DataFrame) -> DataFrame:
    """Gap rows with the one-row trust table repeated on each."""
    return gaps.join(F.broadcast(trust))


def _normalized(skill: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(skill)), "^(skill_|has_)", "")


def attach_resources(skills: DataFrame, resources: DataFrame) -> DataFrame:
    """Skills with their learning resources, only where present.

    The resource list is aggregated to one row per skill before the join; its
    size decides the join strategy.
    """
    listed = resources.groupBy(_normalized(F.col("skill")).alias("_skill")).agg(
        F.array_sort(F.collect_list(F.struct("title", "url", "type"))).alias("resources")
    )
    return skills.join(listed, _normalized(F.col("skill")) == F.col("_skill")).drop("_skill")


def cohort_report(metrics: DataFrame, heatmap: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Long rows section / cohort_id / name / value for metrics, skills and suppressed cohorts."""
    shape = ("section", "cohort_id", "name", "value")

    def part(df: DataFrame, section: str, name: str, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), "cohort_id", F.col(name).alias("name"),
                         value.cast("string").alias("value")).select(*shape)

    return (
        part(metrics, "metric", "metric", F.col("value"))
        .unionByName(part(heatmap, "skill_heatmap", "skill", F.col("users")))
        .unionByName(part(suppressed, "suppression", "reason", F.col("bucket")))
    )


def write_export(df: DataFrame, path: str) -> None:
    """Exports are CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
