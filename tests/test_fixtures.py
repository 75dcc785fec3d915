"""Small literal inputs with known results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postmill.functions import features, normalize, text
from postmill.operators import career, cleaning, deltas, gates, market, matching, persona, product, stats, trends

DAY = dt.date


def test_segment_view(rows):
    schema = """primary_role string, grade_final string, city_tier string, country string, region string, city_normalized string,
      geo_scope string, salary_mid_rub_capped double, is_junior_friendly boolean, is_remote boolean, tech_stack_size int, skill_sql boolean"""
    key = ("analyst", "junior", "Moscow", "Russia", "Moscow", "Moscow", "local")
    df = rows(schema, (*key, 100000.0, True, True, 2, True), (*key, None, False, False, 4, True), (*key, 160000.0, None, None, 3, False))
    r = market.market_view(df).first()
    assert (r["vacancy_count"], r["salary_sample_size"], r["salary_median"], r["confidence"]) == (3, 2, 130000.0, "low")
    assert r["salary_coverage_share"] == pytest.approx(2 / 3)
    assert r["median_tech_stack_size"] == 3.0 and r["top_skills"] == "sql (67%)"
    masked = df.withColumn("salary_disclosed", F.col("tech_stack_size") == 2).withColumn(
        "salary_mid_rub_capped", F.when(F.col("tech_stack_size") == 4, 200000.0).otherwise(F.col("salary_mid_rub_capped")))
    r = market.market_view(masked).first()
    assert (r["salary_sample_size"], r["salary_median"]) == (1, 100000.0)


def test_segment_view_drops_null_keys(rows):
    df = rows("primary_role string, grade_final string, city_tier string, salary_mid_rub_capped double",
              ("a", "junior", None, 1.0), ("a", "junior", "SPb", None))
    out = market.market_view(df).collect()
    assert len(out) == 1 and out[0]["salary_median"] is None and out[0]["confidence"] == "low"


@pytest.mark.parametrize("n, s, c, label", [(100, 40, 0.4, "high"), (25, 6, 0.24, "medium"), (10, 10, 1.0, "low"), (100, None, None, "low")])
def test_market_confidence(rows, n, s, c, label):
    df = rows("n int, s int, c double", (n, s, c))
    assert df.select(market.market_confidence(F.col("n"), F.col("s"), F.col("c"))).first()[0] == label


def test_persona_demand_and_gap(rows):
    df = rows("primary_role string, grade string, skill_sql boolean, has_python boolean, skill_statistics boolean",
              ("analyst", "junior", True, True, True), ("analyst", "junior", True, False, True), ("ml", "senior", False, True, False))
    p = rows("persona_id int, current_skills array<string>, target_role string, target_grade string, min_market_n int",
             (1, ["skill_sql", "skill_statistics"], "analyst", "junior", 1))
    demand = [(r["skill_name"], r["market_share"]) for r in persona.skill_demand(df, p).collect()]
    assert demand == [("skill_sql", 1.0), ("skill_statistics", 1.0), ("has_python", 0.5)]
    gap = {r["skill_name"]: (r["persona_has"], r["gap"]) for r in persona.skill_gap(df, p).collect()}
    assert gap == {"skill_sql": (True, False), "has_python": (False, True), "skill_statistics": (True, False)}


def test_whitelist_may_name_skills_left_out_by_default(rows):
    df = rows("primary_role string, skill_sql boolean, has_metro boolean, skill_git boolean", ("a", True, True, True), ("a", True, False, True))
    p = rows("persona_id int, current_skills array<string>, target_role string, skill_whitelist array<string>, min_market_n int",
             (1, [], "a", ["has_metro", "absent"], 1), (2, [], "a", ["absent"], 1), (3, [], "a", None, 1))
    out = sorted((r["persona_id"], r["skill_name"], r["market_share"]) for r in persona.skill_demand(df, p).collect())
    assert out == [(1, "has_metro", 0.5), (2, "skill_sql", 1.0), (3, "skill_sql", 1.0)]


def test_relaxation_needs_a_large_table_and_reports_absent_columns(rows):
    df = rows("primary_role string, grade_final string", *[("analyst", "junior")] * 3, *[("analyst", "senior")] * 5)
    p = rows("persona_id int, current_skills array<string>, target_role string, target_grade string, target_country string, min_market_n int",
             (1, [], "analyst", "junior", "Russia", 6), (2, [], "analyst", "junior", None, 50), (3, [], "pilot", None, None, 4))
    out = {r["persona_id"]: r for r in persona.relax_filters(df, p).collect()}
    # the table has no country: dropping it changes nothing, yet it is reported
    assert out[1]["relaxed_filters"] == ["country", "grade_final"] and out[1]["market_n"] == 8
    assert out[2]["relaxed_filters"] == [] and out[2]["market_n"] == 3 and "small_segment" in out[2]["warnings"]
    assert out[3]["relaxed_filters"] == ["primary_role"] and "empty_segment" in out[3]["warnings"]


def test_features(rows):
    df = rows("city string", ("Москва",), ("Санкт-Петербург",), ("Казань",), ("Алматы",))
    assert [r[0] for r in df.select(features.city_tier(F.col("city"))).collect()] == ["Moscow", "SPb", "Million+", "KZ/Other"]
    geo = rows("city string, search_area_id int, work_mode string", ("Москва", 1, "office"), ("Алматы", 159, "remote"), ("Минск", 40, "hybrid"), ("", 113, "unknown"))
    out = features.add_geography(geo).collect()
    assert [r["country"] for r in out] == ["Russia", "Kazakhstan", "Belarus", "Russia"]
    assert [r["city_normalized"] for r in out] == ["Moscow", "Almaty", "Minsk", "unknown"]
    assert [r["geo_scope"] for r in out] == ["local", "remote", "mixed", "unknown"]
    assert [r["remote_geo_eligible"] for r in out] == [False, True, True, False]
    flags = rows("role_ml boolean, role_analyst boolean, role_backend boolean", (False, True, False), (True, True, False), (False, False, True))
    assert [r["primary_role"] for r in features.add_primary_role(flags).collect()] == ["analyst", "ml", "backend"]
    titles = rows("title string", ("Python Developer",), ("ML Engineer",), ("Системный аналитик",))
    assert [r["primary_role"] for r in features.add_primary_role(titles).collect()] == ["backend", "ml", "analyst"]


def test_cleaning(rows):
    df = rows("salary_gross string, salary_from double", ("True", 1.0), ("False", 1.0), ("unknown", 1.0), ("yes", 1.0), ("no", None))
    out = cleaning.ensure_salary_gross_boolean(df).collect()
    assert [r["salary_gross"] for r in out] == [True, False, None, True, False] and out[4]["salary_from"] is None


def test_all_null_text_stays_text_and_counters_are_no_flags(rows):
    df = rows("note string, role_count int, is_x int, role_a string", (None, 1, 1, "yes"), (None, 0, 0, "maybe"))
    out, names = cleaning.coerce_boolean_columns(df)
    assert set(names) == {"is_x", "role_a"} and dict(out.dtypes)["role_count"] == "int" and dict(out.dtypes)["note"] == "string"
    assert [r["role_a"] for r in out.collect()] == [True, None]


def test_null_ids_are_one_id(rows):
    df = rows("vacancy_id string", ("a",), ("a",), (None,), (None,))
    assert tuple(cleaning.check_unique_id(df).first()) == (False, 2)


def test_negative_age_floors(rows):
    df = rows("published_at_iso string, scraped_at_utc string", ("2026-01-02T12:00:00Z", "2026-01-02T00:00:00Z"), ("bad", "2026-01-02"))
    assert [r["vacancy_age_days"] for r in cleaning.parse_dates(df).collect()] == [-1, None]


def test_salary_bucket_with_equal_edges(rows):
    df = rows("salary_mid_rub_capped double", *[(1.0,)] * 5, (2.0,), (None,))
    assert [r["salary_bucket"] for r in features.add_salary_bucket(df).orderBy("salary_mid_rub_capped").collect()] == [None] + ["low"] * 5 + ["high"]
    few = rows("salary_mid_rub_capped double", (1.0,), (2.0,))
    assert {r["salary_bucket"] for r in features.add_salary_bucket(few).collect()} == {None}


@pytest.fixture
def weekly(rows):
    schema = """primary_role string, grade_final string, city_tier string, work_mode string, domain_finance boolean, domain_it_product boolean,
      salary_mid_rub_capped int, skill_sql boolean, has_python boolean, skill_excel boolean"""
    return rows(schema, ("analyst", "junior", "Moscow", "remote", True, False, 100000, True, False, True),
                ("analyst", "junior", "Moscow", "remote", True, False, 140000, True, True, True),
                ("ml", "senior", None, "office", False, True, None, False, True, False), (None, None, "SPb", None, False, False, 90000, False, False, False))


def test_weekly_snapshot(weekly):
    out = {(r["role"], r["grade"]): r for r in trends.weekly_snapshot(weekly, F.lit("2026-05-19").cast("date")).collect()}
    r = out["analyst", "junior"]
    assert (r["week_start"], r["vacancy_count"], r["salary_p50"], r["domain"]) == (DAY(2026, 5, 18), 2, 120000.0, "finance")
    assert r["skill_top10"] == ["excel", "sql", "python"]
    assert out["unknown", "unknown"]["work_mode"] == "unknown" and out["ml", "senior"]["salary_p50"] is None


def test_trends(rows):
    h = rows("week_start date, role string, grade string, vacancy_count long, skill_top10 array<string>, salary_p50 double",
             (DAY(2026, 5, 4), "analyst", "junior", 3, ["sql"], 120000.0), (DAY(2026, 5, 4), "analyst", "junior", 1, ["excel"], 160000.0),
             (DAY(2026, 5, 11), "analyst", "junior", 7, ["SQL", "python"], 160000.0), (DAY(2026, 5, 11), "ml", "junior", 9, [], None))
    assert [tuple(r) for r in trends.skill_demand_trend(h, "skill_sql", "analyst").collect()] == [(DAY(2026, 5, 4), 3), (DAY(2026, 5, 11), 7)]
    assert [tuple(r) for r in trends.salary_trend(h, "analyst", "junior", 1).collect()] == [(DAY(2026, 5, 11), 160000.0)]
    assert trends.salary_trend(h, "analyst", "junior", 12).first()["salary_p50"] == 130000.0
    text_history = h.withColumn("skill_top10", F.to_json("skill_top10"))
    assert trends.skill_demand_trend(text_history, "python").first()["vacancy_count"] == 7
    with pytest.raises(ValueError):
        trends.vacancy_count_trend(h, None, None, 0)


def test_career_path(rows):
    schema = "primary_role string, grade_final string, salary_mid_rub_capped int, skill_sql boolean, skill_excel boolean, has_python boolean, skill_tableau boolean, has_git boolean, skill_airflow boolean"
    df = rows(schema, ("data", "junior", 100000, True, True, False, False, True, False), ("analyst", "junior", 120000, True, True, False, False, True, False),
              ("analyst", "middle", 200000, True, False, True, True, True, False), ("data", "middle", 200000, True, False, True, False, True, True),
              ("data", "senior", 300000, True, False, True, False, True, True), ("data", "guru", 1, True, True, True, True, True, True))
    out = career.career_graph(df, ["Data Analyst"]).orderBy("salary_delta_pct").collect()
    assert len(out) == 2
    step = next(r for r in out if r["from_grade"] == "junior")
    assert (step["to_grade"], round(step["salary_delta_pct"], 2), step["skills_to_add"]) == ("middle", 81.82, ["python", "airflow", "tableau"])
    users = rows("user_id int, role string, grade string, skills array<string>", (1, "Data Analyst", "Junior", ["has_python"]), (2, "Data Analyst", "senior", []))
    history = rows("week_start date, role string, grade string, vacancy_count long", (DAY(2026, 5, 4), "data", "middle", 5), (DAY(2026, 5, 11), "analyst", "middle", 8))
    steps = {r["user_id"]: r for r in career.recommend_next_step(career.career_nodes(df, ["Data Analyst"]), users, history).collect()}
    assert (steps[1]["next_grade"], steps[1]["demand_trend"], steps[1]["skills_to_add"]) == ("middle", "growing", ["airflow", "tableau"])
    assert steps[2]["next_grade"] is None and steps[2]["vacancy_count_next"] == 0


def test_quality_gates(rows):
    df = rows("vacancy_id string, title string, primary_role string, grade_final string, city_tier string, work_mode string, salary_mid double",
              ("1", "a", "analyst", "junior", "Moscow", "remote", 1.0), ("2", "b", "analyst", "junior", "Moscow", "remote", 2.0),
              ("3", "c", "analyst", "junior", "Moscow", "remote", None))
    view = rows("x int", (1,))
    checked = gates.processed_gates(df, view, {"min_rows": 3})
    assert tuple(gates.gate_status(checked).first()) == ("passed", [])
    assert {r["name"]: r["value"] for r in checked.collect()}["salary_known_share"] == 0.666667
    worse = df.withColumn("primary_role", F.when(F.col("vacancy_id") == "3", "unknown").otherwise(F.col("primary_role")))
    assert gates.segment_status(gates.segment_quality(worse, {"min_segment_rows": 2})).first()["segment_status"] == "warning"
    dated = rows("published_at_iso string", *[(f"2025-{m:02d}-01",) for m in range(1, 9)])
    assert gates.observed_periods(dated).first()[0] == 8


def test_date_semantics_and_partitions(rows):
    df = rows("vacancy_id string, published_at_iso string", ("1", "2025-12-01"), ("2", "2025-12-02T12:00:00+03:00"))
    r = gates.date_semantics(df, F.lit("2025-12-01"), F.lit("2025-12-02")).first()
    assert (r["status"], str(r["observed_published_at_from"]), str(r["observed_published_at_to"])) == ("passed", "2025-12-01", "2025-12-02")
    parts = rows("vacancy_id string, part string", ("1", "a"), ("2", "a"), ("2", "b"), ("3", "b"))
    out = {(r["section"], r["name"]): r["value"] for r in gates.cross_partition_duplicates(parts, "part").collect()}
    assert (out["summary", "raw_rows"], out["summary", "unique_ids"], out["summary", "duplicate_rows"], out["adjacent_overlap", "a..b"]) == (4, 3, 1, 1)


def test_duplicate_conflicts(rows):
    df = rows("source_id string, source_vacancy_id string, published_at_iso string, n int",
              ("hh", "1", "2026-01-01", 1), ("hh", "1", "2026-01-02", 2), ("hh", "2", "2026-01-01", 3))
    r = gates.duplicate_conflicts(df, "n").first()
    assert (r["duplicate_count"], r["conflict_count"], r["duplicate_share"]) == (1, 1, 0.333333)


def test_serving_rows_and_reconcile(rows):
    df = rows("hh_vacancy_id double, title string, n int, skills array<string>", (133052423.0, "old", 1, ["a"]), (133052423.0, "new", 2, ["b"]), (None, "x", 3, []), (5.0, " ", 4, []))
    out = deltas.posting_serving_rows(df, [F.desc("n")]).collect()
    assert [(r["hh_vacancy_id"], r["title"], r["skills"]) for r in out] == [("133052423", "new", ["b"])]
    old = rows("hh_vacancy_id string, title string", ("v001", "old"), ("stale", "s"))
    new = rows("hh_vacancy_id string, title string", ("v001", "new"), ("v002", "n"))
    assert tuple(deltas.reconcile_counts(deltas.reconcile(old, new)).first()) == (1, 1, 1, 0, 2)


def test_raw_gates_treat_blank_ids_apart(rows):
    df = rows("vacancy_id string, title string", ("1", "a"), ("1", ""), ("", "b"), (None, "c"))
    r = gates.raw_quality(df).first()
    assert (r["row_count"], r["duplicate_count"], r["title_completeness"]) == (4, 1, 0.75)


def test_education_and_experience(rows):
    df = rows("exp_min_years int, exp_max_years int, salary_mid_rub_capped double", (None, None, 1.0), (None, 5, 2.0), (1, 3, 3.0))
    out = {r["exp_bucket"]: r["n"] for r in stats.salary_by_experience_bucket(df).collect()}
    assert out == {"0-1": 2, "3-6": 1}


def test_text_signals(rows):
    df = rows("t string", ("от 100 000 до 150 000 руб. на руки",), ("от 90 000 ₽ до вычета налогов",), ("до 5 000 $",), ("",))
    out = [tuple(r["s"]) for r in df.select(text.salary_text(F.col("t")).alias("s")).collect()]
    assert out == [(100000, 150000, "RUB", False), (90000, None, "RUB", True), (None, 5000, "USD", None), (None, None, None, None)]
    spaced = rows("t string", ("от 100 000 ₽",))
    assert spaced.select(text.salary_text(F.col("t"))["salary_from"]).first()[0] == 100000
    sections = text.split_sections(rows("id int, d string", (1, "intro\nОбязанности:\n- a\n\nТребования\n- b\nУсловия"), (2, None)), "d").orderBy("id").collect()
    assert (sections[0]["duties"], sections[0]["requirements"], sections[0]["conditions"]) == ("- a\n\n", "- b\n", "")
    assert sections[1]["duties"] == ""
    stats_row = rows("d string", ("a b\n\n- x\n* y\n\n\n• z",)).select(text.description_stats(F.col("d")).alias("s")).first()["s"]
    assert (stats_row["description_len_words"], stats_row["description_bullets_count"], stats_row["description_paragraphs_count"]) == (8, 3, 3)
    now = F.lit("2026-03-01 10:00:00").cast("timestamp")
    dates = rows("t string", ("5 дней назад",), ("3 февраля",), ("31.02.2026",), ("1 мая 2025",), ("вчера",))
    out = [tuple(r["s"]) for r in dates.select(text.published_date(F.col("t"), now).alias("s")).collect()]
    assert out == [("2026-02-24", 5), ("2026-02-03", 26), (None, None), ("2025-05-01", 304), ("2026-02-28", 1)]


def test_tokens_do_not_touch_word_characters(rows):
    df = rows("t string", ("I know C++, .NET and go-lang; Java.",), ("навык sql и python3",))
    out = [r[0] for r in df.select(normalize.known_skills_in_text(F.col("t"), ["c++", "c", ".net", "go", "java", "sql", "python"])).collect()]
    assert out == [["c++", ".net"], ["sql"]]


def test_match_score_rounds_half_even_and_caps(rows):
    schema = """target_role string, target_grade string, target_country string, target_region string, target_city string, target_geo_scope string,
      current_skills array<string>, open_actions array<struct<title:string,skill_name:string,action_type:string>>, posting_primary_role string, posting_grade string, posting_country string,
      posting_region string, posting_city_normalized string, posting_geo_scope string, posting_skills array<string>, posting_title string"""
    full = ("Analyst", "junior", "Russia", "M", "M", "local")
    df = rows(schema, (*full, ["SQL", "excel"], [("Learn", "sql", "learning")], *full, ["sql", "Excel"], "t"),
              (*full, ["a"], None, "other", "x", None, None, None, None, ["a", "b"], "t"), (None, None, None, None, None, None, [], None, *full, ["a"], "t"))
    out = matching.match_score(df).collect()
    assert (out[0]["match_score"], out[0]["match_level"], out[0]["matched_skills"], out[0]["plan_relevance"]["kind"]) == (100, "high", ["Excel", "sql"], "skill")
    # 35 * 1/2 = 17.5 rounds to 18 (even)
    assert (out[1]["match_score"], out[1]["missing_skills"]) == (38, ["b"])
    assert (out[2]["match_score"], out[2]["match_level"]) == (None, "unknown")


def test_newest_per_profile_against_brute_force(spark, rows):
    import random
    rng = random.Random(3)
    posts = [(str(i), rng.choice("ab"), rng.choice("xy"), dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randrange(400)), f"u{i}") for i in range(300)]
    people = [(i, rng.choice(["A", "b", None]), rng.choice(["x", "", None]), dt.datetime(2026, 1, 10) if i % 2 else None) for i in range(20)]
    postings = rows("title string, primary_role string, grade_final string, published_at timestamp, url string", *posts)
    profiles = rows("user_id int, target_role string, target_grade string, since timestamp", *people)
    got = {}
    for r in matching.digest_matches(profiles, postings).collect():
        got.setdefault(r["user_id"], []).append((r["position"], r["url"]))
    for uid, role, grade, since in people:
        hits = [p for p in posts if (not role or p[1] == role.lower()) and (not grade or p[2] == grade) and (since is None or p[3] >= since)]
        hits.sort(key=lambda p: (-p[3].timestamp(), p[0], p[4]))
        assert [u for _, u in sorted(got.get(uid, []))] == [p[4] for p in hits[:3]]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i, *[0] * len(b)]
        for j, y in enumerate(b, 1):
            row[j] = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_suggestions_against_all_pairs(rows):
    known = ["python", "pytorch", "postgres", "tableau", "c", "go", "c++", "матлаб", "a b"]
    dice = random.Random(4)
    names = ["pyton", "tablo", "python", "zzz", "", "матла", None, "pyton"] + ["".join(dice.choice("pythonacgo+ ") for _ in range(dice.randrange(1, 9))) for _ in range(150)]
    df = rows("s string", *[(x,) for x in names])
    found = matching.suggest_names(df, "s", [f"skill_{k}" for k in known], n=3)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    out = {r["s"]: r["suggestions"] for r in found.collect()}
    want = {}
    for s in {x for x in names if x is not None and x not in known}:
        scored = sorted((-(1 - edits(s, k) / max(len(s), len(k))), k) for k in known)
        want[s] = [k for score, k in scored if -score >= 0.4][:3]
    assert out == want and out["pyton"] == ["python", "pytorch"] and out[""] == []


def test_blocks_with_blocks_of_their_own_tag(rows):
    from postmill.sources import pages
    html = [
        "<div>no</div><div data-qa='x'>a<DIV class=y>b<div/>c</div></div >d</div>e", "<div data-qa='x'>never <div>closed</div>", "<p>none</p>", None, "",
        "<div data-qa='x'></div>", "<divan data-qa='x'>t</divan><div data-qa='x'><divan></divan>u</div>", "<div\ndata-qa='x'>" + "<div>" * 300 + "z" + "</div>" * 300 + "</div>q",
    ]
    df = rows("i int, h string", *enumerate(html))
    out = df.select("i", pages.block_html(F.col("h"), "div", "x").alias("b"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: r["b"] for r in out.collect()}
    assert got == {
        0: "a<DIV class=y>b<div/>c</div></div >d", 1: "never <div>closed</div>", 2: "", 3: "", 4: "", 5: "", 6: "<divan></divan>u", 7: "<div>" * 300 + "z" + "</div>" * 300,
    }


def test_cohort_suppression(rows):
    members = rows("cohort_id int, user_id long, status string", (1, 1, "active"), (2, 1, "active"), (2, 2, "active"), (2, 3, "active"), (2, 4, "left"))
    cohorts = rows("cohort_id int", (1,), (2,))
    profiles = rows("user_id long, target_role string", (1, "a"), (2, "a"), (4, "b"))
    plans = rows("id long, user_id long", (10, 1), (20, 2), (30, 3))
    actions = rows("plan_id long, action_type string, status string, skill_name string, recommendation_source string",
                   (10, "learning", "planned", "python", "skill_gap"), (20, "learning", "done", "sql", "skill_gap"), (20, "learning", "in_progress", "python", "skill_gap"))
    none = rows("user_id long, status string", (99, "x"))
    subs = rows("user_id long, active boolean", (1, True))
    events = rows("user_id long, event_type string, occurred_at timestamp", (1, "weekly_return", dt.datetime(2026, 1, 2)))
    sizes = {r["cohort_id"]: r["bucket"] for r in product.cohort_sizes(cohorts, members, 3).collect()}
    assert sizes == {1: "<3", 2: "3"}
    out = product.cohort_analytics(cohorts, members, profiles, plans, actions, none, subs, events, F.lit("2026-01-01").cast("timestamp"), 3)
    assert "user_id" not in out.columns
    rates = {r["metric"]: r["rate"] for r in out.collect()}
    assert len(rates) == 12 and rates["profile_completion_rate"] == 0.6667 and rates["plan_action_done_rate"] == 0.3333
    heat = product.cohort_skill_heatmap(cohorts, members, profiles, plans, actions, 3, 2).collect()
    assert [(r["cohort_id"], r["skill"], r["users"], r["target_role"]) for r in heat] == [(2, "python", 2, "a")]


def test_outcomes_fold(rows):
    actions = rows("id long, status string, application_status string, completed_at timestamp", (1, "planned", None, None), (2, "planned", None, None), (3, "done", "offer", None))
    t0 = dt.datetime(2026, 1, 1)
    outcomes = rows("id long, action_id long, status string, occurred_at timestamp", (1, 1, "offer", t0), (2, 1, "rejected", t0 + dt.timedelta(1)), (3, 1, "applied", t0 + dt.timedelta(2)),
                    (4, 2, "interview", t0))
    out = {r["id"]: (r["status"], r["application_status"], r["completed_at"]) for r in product.apply_outcomes(actions, outcomes).collect()}
    assert out == {1: ("skipped", "applied", t0), 2: ("in_progress", "interview", None), 3: ("done", "offer", None)}


def test_late_billing_event_does_not_change_the_state(rows):
    t0 = dt.datetime(2026, 1, 1)
    e = rows("event_id long, user_id long, provider string, provider_event_id string, provider_subscription_id string, occurred_at timestamp, processed_at timestamp, plan string, subscription_state string",
             (1, 1, "p", "a", "s", t0, t0, "trial", "trialing"), (2, 1, "p", "b", "s", t0 + dt.timedelta(5), t0 + dt.timedelta(5), "pro", "active"),
             (3, 1, "p", "c", "s", t0 + dt.timedelta(2), t0 + dt.timedelta(9), "trial", "canceled"), (4, 1, "p", "b", "s", t0, t0 + dt.timedelta(10), "free", "none"))
    assert {r["event_id"]: r["out_of_order"] for r in product.billing_history(e).collect()} == {1: False, 2: False, 3: True}
    assert tuple(product.subscription_state(e).first()) == (1, "pro", "active", 2)
