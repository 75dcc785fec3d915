"""Raw postings to a published run.

Two small driver round trips choose columns (low information, booleans). Clean
postings, features and the segment view are written once; gates read the
written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.features import assemble_features
from postmill.operators import cleaning, gates, market, trends
from postmill.plans.publish import publish_run, write_run
from postmill.session import forget, materialize


def clean(raw: DataFrame, ties: tuple[Column, ...] = ()) -> DataFrame:
    """Missing values, dates, salary, then duplicates: shares are taken before deduplication."""
    # column choices, salary caps and the rows themselves each read the raw postings, which may be a plan of many joins
    return _cleaned(materialize(raw, "raw", "zstd"), ties)


def _cleaned(raw: DataFrame, ties: tuple[Column, ...]) -> DataFrame:
    df, _ = cleaning.handle_missingness(raw)
    df = cleaning.prepare_salary(cleaning.parse_dates(df))
    return cleaning.deduplicate_latest(df, ties=ties)


def refresh(
    raw: DataFrame, root: str, run_id: str, week: Column, thresholds: dict[str, float] | None = None,
    ties: tuple[Column, ...] = (), publish: bool = True,
) -> dict[str, DataFrame]:
    """All tables of one run; the latest pointer moves when the gates pass."""
    spark = raw.sparkSession
    raw = materialize(raw, "raw", "zstd")
    done = write_run({"clean": _cleaned(raw, ties)}, root, run_id)
    forget(raw)
    done |= write_run({"features": assemble_features(done["clean"])}, root, run_id)
    done |= write_run({"market_view": market.market_view(done["features"])}, root, run_id)
    done |= write_run({"weekly_snapshot": trends.weekly_snapshot(done["features"], week)}, root, run_id)
    checked = gates.processed_gates(done["features"], done["market_view"], thresholds)
    done |= write_run({
        "gates": checked, "segments": gates.segment_quality(done["features"], thresholds),
        "scope": market.dataset_scope(
            done["features"], None if "salary_disclosed" in done["features"].columns else gates.salary_known(done["features"])),
    }, root, run_id)
    if publish:
        publish_run(spark, root, run_id, done["gates"])
    return done
