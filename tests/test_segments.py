"""Segment summaries, dataset summaries, employer pages and exact comparisons on small fixtures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import deltas, gates, market, matching, product
from postmill.plans import publish
from postmill.sources import pages, postings

VIEW = """primary_role string, grade_final string, domain string, geo_scope string, vacancy_count_total long, vacancy_count_salary long,
  salary_median double, salary_q25 double, salary_q75 double, junior_friendly_share double, remote_share double,
  median_tech_stack_size double, top_skills string"""


@pytest.fixture
def view(rows):
    return rows(
        VIEW, ("data", "senior", "it", "remote", 60, 30, 200.0, 180.0, 220.0, 0.5, 1.0, 6.0, None),
        ("data", "senior", "bank", "local", 40, 10, 100.0, 80.0, 120.0, 0.0, None, 4.0, "sql (80%), python (20%)"),
        ("dev", "junior", "it", "unknown", 3, 0, None, None, None, 0.0, 0.0, 2.0, ""))


def test_summary_over_two_segments(view):
    out = market.segment_summary_from_view(view, {"primary_role": "data"}).head()
    assert (out["vacancy_count"], out["sample_size"], out["salary_sample_size"]) == (100, 100, 40)
    assert (out["salary_coverage_share"], out["confidence"], out["warnings"]) == (0.4, "high", [])
    assert (out["salary_median"], out["remote_share"], out["geo_scope"]) == (150.0, 1.0, "mixed")
    assert out["top_skills"] == ["sql (80%)", "python (20%)"]
    heavy = market.segment_summary_from_view(view, {"primary_role": "data"}, weighted=True).head()
    assert (heavy["salary_median"], heavy["remote_share"]) == (160.0, 1.0)


def test_summary_names_what_is_missing(view):
    out = market.segment_summary_from_view(view, {"primary_role": "data", "grade_final": "lead", "domain": "sea", "geo_scope": "remote"}).head()
    assert out["vacancy_count"] == 0 and out["warnings"] == ["unknown_grade_final:lead", "unknown_domain:sea", "empty_segment"]
    assert all(out[c] is None for c in out.asDict() if c not in ("vacancy_count", "warnings"))
    low = market.segment_summary_from_view(view, {"primary_role": "dev", "geo_scope": "unknown"}).head()
    assert (low["confidence"], low["warnings"], low["top_skills"], low["geo_scope"]) == ("low", ["low_confidence"], None, "unknown")
    assert market.segment_summary_from_view(view, {"primary_role": "dev"}).head()["geo_scope"] is None
    nothing = market.segment_summary_from_view(view.limit(0), {"primary_role": "data"}).head()
    assert (nothing["vacancy_count"], nothing["warnings"]) == (0, ["empty_segment"])


def test_summary_from_postings(rows, view):
    schema = "primary_role string, grade_final string, work_mode string, geo_scope string, domain string, salary_mid double, is_junior_friendly boolean, tech_stack_size int"
    data = [("data", "senior", "remote", "remote", "it", 180.0 + 20 * i, i < 2, 6) for i in (0, 0, 1, 2, 2)]
    df = rows(schema, *data, ("data", "senior", "office", "local", "it", 1.0, None, None))
    asked = {"primary_role": "data", "grade_final": "senior", "work_mode": "remote"}
    out = market.segment_summary_from_postings(df, asked, view=view).head()
    assert (out["vacancy_count"], out["salary_sample_size"], out["salary_coverage_share"]) == (5, 5, 1.0)
    assert (out["salary_median"], out["salary_q25"], out["salary_q75"], out["remote_share"]) == (200.0, 180.0, 220.0, 1.0)
    assert (out["geo_scope"], out["warnings"], out["top_skills"]) == ("remote", ["low_confidence"], ["sql (80%)", "python (20%)"])
    few = market.segment_summary_from_postings(df, {**asked, "work_mode": "office", "geo_scope": "local"}).head()
    assert (few["geo_scope"], few["warnings"]) == ("local", ["small_segment", "low_confidence"])
    none = market.segment_summary_from_postings(df, {**asked, "grade_final": "chief"}, view=view).head()
    assert (none["vacancy_count"], none["confidence"], none["warnings"]) == (0, None, ["unknown_grade_final:chief", "empty_segment"])


def test_dataset_summaries(rows):
    view = rows("vacancy_count long, salary_sample_size long, confidence string", (60, 20, "high"), (30, None, "low"), (10, 1, None), (0, 0, "odd"))
    out = market.dataset_trust(view).head()
    assert (out["vacancy_count"], out["salary_sample_size"], out["salary_coverage_share"]) == (100, 21, 0.21)
    assert out["confidence_counts"] == {"high": 1, "low": 1, "odd": 1, "unknown": 1}
    empty = market.dataset_trust(view.limit(0)).head()
    assert (empty["vacancy_count"], empty["salary_coverage_share"], empty["confidence_counts"]) == (0, None, {})
    df = rows("dataset_scope string, salary_disclosed boolean", ("all_vacancies", True), ("all_vacancies", None), (None, False))
    out = market.dataset_scope(df).head()
    assert (out["row_count"], out["salary_disclosed_count"], out["salary_disclosure_share"]) == (3, 1, 0.333333)
    assert out["dataset_scope_counts"] == {"all_vacancies": 2, "unknown": 1}
    plain = market.dataset_scope(rows("salary_from double", (1.0,), (None,)), F.col("salary_from").isNotNull()).head()
    assert (plain["row_count"], plain["salary_disclosed_count"], plain["dataset_scope_counts"]) == (2, 1, None)


def embedded(**fields):
    return f'<script>var x = {{"a": 1, "employerReviews": {json.dumps(fields)}, "b": {{"rating": 1}}}}</script>'


def test_ratings_in_embedded_objects(rows):
    escaped = json.dumps(embedded(totalRating="3,5", reviewsCount="1 204"))[1:-1].replace("rating", "\\u0072ating")
    html = [
        (embedded(totalRating=4.1, reviewsCount=12), 4.1, 12), (embedded(rating="4,2"), 4.2, None),
        (embedded(rating={"value": 4.3, "reviewsCount": 7}), 4.3, 7), (embedded(ratingInfo={"value": "4.4", "reviewsCount": 8}), 4.4, 8),
        (embedded(totalRating=9) + embedded(ratingInfo={"value": 2.5}), 2.5, None), (escaped, 3.5, 1204),
        (embedded(totalRating=4.6).replace('"', "&quot;"), 4.6, None), ("totalRating: 77, totalRating: 4.7", 4.7, None),
        ('"employerReviews": {"rating": 3', None, None), ("<p>none</p>", None, None), ("", None, None), (None, None, None),
        (embedded(totalRating=8) + '<b data-qa="employer-rating-value">4,8</b>', 4.8, None),
    ]
    out = pages.extract_employer_fields(rows("url string, html string", *[(str(i), h[0]) for i, h in enumerate(html)]))
    got = {int(r["employer_url"]): (r["employer_rating"], r["employer_reviews_count"]) for r in out.collect()}
    assert got == {i: h[1:] for i, h in enumerate(html)}


def test_digest_compares_untrimmed_values(rows):
    posts = rows("title string, primary_role string, grade_final string, published_at timestamp, url string",
                 ("a", "Data", "x", dt.datetime(2026, 1, 1), "u1"), ("b", "data ", None, dt.datetime(2026, 1, 2), "u2"), ("c", " ", "X", None, "u3"))
    people = rows("user_id int, target_role string, target_grade string, since timestamp",
                  (1, "DATA", None, None), (2, "data ", "", None), (3, " ", None, None), (4, "", "x", None), (5, "  ", None, None))
    got = {}
    for r in matching.digest_matches(people, posts).collect():
        got.setdefault(r["user_id"], []).append(r["url"])
    assert {u: sorted(v) for u, v in got.items()} == {1: ["u1"], 2: ["u2"], 3: ["u3"], 4: ["u1", "u3"]}


def test_unknown_zones_fail_no_other_subscription(rows):
    now = dt.datetime(2026, 5, 18, 9, 30)  # a Monday
    zones = ["UTC", "Europe/Moscow", "Not/AZone", "", None, "Asia/Tokyo"]
    subs = rows("user_id int, active boolean, weekday int, time_local string, timezone string, last_sent_at timestamp",
                *[(i, True, 0, "09:00", z, None) for i, z in enumerate(zones)])
    due = product.due_subscriptions(subs, F.lit(now.isoformat(" ")).cast("timestamp"))
    assert sorted(r["user_id"] for r in due.collect()) == [0, 1, 5]


def test_latest_rows_carry_their_source(rows):
    days = rows("id string, ordinal int, day string", ("1", 0, "2000-01-01"), ("1", 1, "2000-01-02")).withColumn("day", F.col("day").cast("date"))
    out = deltas.materialize_latest(days, "day", "id", ["ordinal"], F.lit("2000-01-03").cast("date"), prefix="raw/").collect()
    assert [r["backfill_source_key"] for r in out] == ["raw/date=2000-01-02/snapshot.csv"]


def test_partition_values_come_from_folder_names(spark, tmp_path):
    path = str(tmp_path / "t")
    assert postings.partition_values(spark, path, "date") == []
    spark.createDataFrame([(1, "2000-01-02"), (2, "a/b c")], "i int, date string").write.partitionBy("date").parquet(path)
    assert postings.partition_values(spark, path, "date") == ["2000-01-02", "a/b c"]


def test_one_conflicting_day_among_many(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    for i in range(1, 10):
        kind = "string" if i == 5 else "int"
        df = spark.range(2).select(F.col("id").cast(kind).alias("v"), F.lit(f"2000-01-0{i}").alias("date"))
        df.write.mode("append").partitionBy("date").parquet(source)
    days = [f"2000-01-0{i}" for i in range(1, 10)]
    groups = postings._same_schema_days(spark, source, days)
    assert sorted(d for _, g in groups for d in g) == days and ["2000-01-05"] in [g for _, g in groups]
    assert postings.compact_monthly(spark, source, target) == ["2000-01"]
    assert sorted(r["v"] for r in spark.read.parquet(target).collect()) == ["0"] * 9 + ["1"] * 9


def test_readers_find_the_old_run_until_the_new_one_is_published(spark, rows, tmp_path):
    root = str(tmp_path / "runs")
    passed = rows("name string, passed boolean", ("a", True))
    publish.write_run({"t": spark.range(1)}, root, "r2")
    publish.publish_run(spark, root, "r2", passed)
    first = sorted(p.name for p in (tmp_path / "runs" / "latest").glob("part-*"))
    publish.write_run({"t": spark.range(2)}, root, "r1")
    assert publish.read_latest(spark, root, "t").count() == 1
    with pytest.raises(publish.GateFailed):
        publish.publish_run(spark, root, "r1", rows("name string, passed boolean", ("a", False)))
    assert publish.latest_run(spark, root) == "r2"
    publish.publish_run(spark, root, "r1", passed)
    assert publish.latest_run(spark, root) == "r1" and publish.read_latest(spark, root, "t").count() == 2
    assert set(first) < {p.name for p in (tmp_path / "runs" / "latest").glob("part-*")}


def test_partition_overlaps_by_brute_force(spark, rows):
    dice = random.Random(5)
    data = [(dice.choice([None, " ", *"abcdefgh"]), f"2000-0{dice.randrange(1, 7)}") for _ in range(60)]
    out = {(r["section"], r["name"]): r["value"] for r in gates.cross_partition_duplicates(rows("id string, part string", *data), "part", "id").collect()}
    named = [(i, p) for i, p in data if i and i.strip()]
    parts = sorted({p for _, p in data})
    ids = {i: sorted({p for j, p in named if j == i}) for i, _ in named}
    assert out["summary", "raw_rows"] == 60 and out["summary", "missing_id_rows"] == 60 - len(named)
    assert out["summary", "unique_ids"] == len(ids) and out["summary", "duplicate_rows"] == len(named) - len(ids)
    for a, b in zip(parts, parts[1:]):
        assert out["adjacent_overlap", f"{a}..{b}"] == sum(a in p and b in p for p in ids.values())
    for n in {len(p) for p in ids.values()}:
        assert out["partitions_per_id", str(n)] == sum(len(p) == n for p in ids.values())
    empty = gates.cross_partition_duplicates(rows("id string, part string", ("a", "b")).limit(0), "part", "id")
    assert {r["name"]: r["value"] for r in empty.collect()} == dict.fromkeys(
        ["raw_rows", "missing_id_rows", "unique_ids", "repeated_id_count", "duplicate_rows"], 0)
