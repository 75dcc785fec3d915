"""Registered queries against their SQL; all of them with POSTMILL_ALL_QUERIES=1."""

import os

import pytest

from compare import compare, duck
from postmill.queries import load, registry

load()
SF_DIR = os.environ.get("COMPARE_SF_DIR", "/root/testdata/sf0.001")
CORE = [
    "market_view", "salary_by_group", "skill_premium", "correlation_matrix", "data_health", "deduplicate_latest",
    "assemble_features", "keyword_flags", "split_sections", "weekly_snapshot", "career_graph", "recommend_next_step",
    "analyze_personas", "relax_filters", "processed_gates", "segment_quality", "cross_partition_duplicates", "reconcile",
    "snapshot_delta", "match_profiles", "digest_matches", "weekly_cohorts", "cohort_analytics", "billing_history",
    "sanitize_events", "extract_listing_links", "compact_monthly",
]
NAMES = list(registry.SPARK) if os.environ.get("POSTMILL_ALL_QUERIES") else CORE


@pytest.fixture(scope="session")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    verdict = compare(spark, con, SF_DIR, name)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.SPARK)
