"""Work that must not be repeated or meet in one task, seen in plans and on small rows."""

import datetime as dt
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postmill import session
from postmill.llm import context_trees
from postmill.operators import career, cleaning, deltas, gates, matching, persona
from postmill.plans import refresh
from postmill.queries import load, registry


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_digest_query_gives_every_role_its_matches(spark, tmp_path):
    load()
    day = dt.datetime(2001, 6, 1)
    tables = {
        "region": ("r_regionkey long, r_name string", [(0, "R")]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "nation_0", 0)]),
        "customer": ("c_custkey long, c_nationkey long, c_mktsegment string", [(2, 0, "BUILDING"), (10, 0, "BUILDING")]),
        "supplier": ("s_suppkey long, s_name string, s_acctbal double", [(1, "s", 1.0)]),
        "part": ("p_partkey long, p_name string, p_type string, p_size int", [(1, "red ring", "LARGE", 1)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp", [
            (1, 2, "2-HIGH", day), (2, 2, "3-MEDIUM", day), (3, 2, "1-URGENT", day)]),
        "lineitem": ("""l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double,
          l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp""", [
              (k, 1, 1, 1, 5.0, 10.0, 0.1, 0.01, "A", day) for k in (1, 2, 3)]),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = registry.SPARK["digest_matches"](spark, str(tmp_path)).collect()
    # both ask for "LARGE " and a grade; 2 is a lead, 10 a middle one
    assert {r["user_id"] for r in got} & {2, 10}


def test_missing_values_choose_columns_in_one_pass(rows, monkeypatch):
    df = rows("id int, note string, is_remote string, flag string, title string, seen_count int",
              *[(i, None if i else "x", "yes", "0" if i % 2 else "1", f"t{i}", None) for i in range(100)])
    want, report = cleaning.handle_missingness(df)
    want, passes, kind = want.orderBy("id").collect(), [], type(df)
    once = kind.agg
    monkeypatch.setattr(kind, "agg", lambda self, *a: passes.append(1) or once(self, *a))
    got, _ = cleaning.handle_missingness(df)
    assert len(passes) == 1
    monkeypatch.undo()
    step = cleaning.standardize_unknown_markers(df)
    step, dropped, retained = cleaning.drop_low_information(step)
    step, booleans = cleaning.coerce_boolean_columns(step)
    step = cleaning.fill_counters(cleaning.fill_categorical(step))
    assert report == {"dropped": dropped, "retained": retained, "boolean": booleans} and "note" in dropped and "flag" in booleans
    assert want == got.orderBy("id").collect() == step.orderBy("id").collect()


def test_refresh_reads_the_raw_plan_once(rows):
    raw = rows("vacancy_id int, salary_mid double, currency string, published_at_iso string, scraped_at_utc string",
               *[(i % 3, float(i), "RUB", "2001-01-01", f"2001-01-0{i}") for i in range(1, 7)])
    done = refresh.clean(raw)
    assert "/raw-" in plan(done) and "ExistingRDD" not in plan(done)
    assert sorted((r["vacancy_id"], r["salary_mid"]) for r in done.collect()) == [(0, 6.0), (1, 4.0), (2, 5.0)]


def test_rows_of_a_frequent_label_do_not_meet(rows, no_broadcast):
    df = rows("primary_role string, grade string, salary_mid double, skill_sql boolean",
              ("standard", "junior", 1.0, True), ("standard", "junior", 3.0, False), ("promo", "junior", 9.0, True))
    out = career.career_nodes(df, ["standard_role"])
    assert "BroadcastHashJoin [_label" in plan(out)
    assert [(r["role"], r["salary_p50"], r["vacancy_count"]) for r in out.collect()] == [("standard_role", 2.0, 2)]


def test_reconciliation_reads_each_table_once(rows):
    schema = "hh_vacancy_id string, title string, salary_from long, indexed_at string"
    old = rows(schema, ("1", "a", 1, "old"), ("2", "b", None, "old"), ("3", "c", 1, "old"), (None, "x", 1, "old"))
    new = rows(schema, ("1", "a", 1, "new"), ("2", "b", 5, "new"), ("4", "d", 1, "new"), (None, "x", 1, "new"))
    out = deltas.apply_reconciliation(old, new)
    assert {r["hh_vacancy_id"]: r["indexed_at"] for r in out.collect()} == {"1": "old", "2": "new", "4": "new"}
    assert out.columns == new.columns
    assert plan(out).split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1].count("Join ") == 1


def test_trend_gate_reads_the_table_once(rows):
    days = [dt.date(2024, 1, 1) + dt.timedelta(weeks=i) for i in range(9)]
    df = rows("vacancy_id int, title string, primary_role string, grade_final string, city_tier string, work_mode string, salary_mid double, published_at string",
              *[(i, "t", "a", "junior", "Moscow", "remote", 1.0, days[i % 9].isoformat()) for i in range(200)])
    view = rows("x int", (1,))
    lineage = rows("dataset_semantic_type string, date_semantics_status string, source_supported boolean",
                   ("historical_publication_facts", "passed", True))
    out = gates.trend_gate(df, view, lineage)
    assert "/gate-rows-" in plan(out) and "ExistingRDD[vacancy_id" not in plan(out)
    got = {r["name"]: (r["passed"], r["value"]) for r in out.collect()}
    assert all(p for p, _ in got.values()) and got["min_complete_periods"] == (True, 9.0) and len(got) == 8
    got = {r["name"]: r["passed"] for r in gates.trend_gate(df.drop("title"), view, lineage).collect()}
    assert got["processed_quality_passed"] is False


def test_profiles_of_one_group_are_spread(rows, no_broadcast):
    people = rows("user_id int, target_role string, current_skills array<string>", (1, "a", ["x"]), (1, "a", ["y"]), (2, None, None))
    posts = rows("hh_vacancy_id string, title string, primary_role string, skills array<string>, published_at timestamp",
                 ("1", "t", "A ", ["X", "z"], dt.datetime(2024, 1, 1)), ("2", "u", "b", ["y"], dt.datetime(2024, 1, 2)))
    out = matching.match_profiles(people, posts)
    assert "BroadcastHashJoin [_group" in plan(out)
    got = sorted((r["user_id"], r["posting_hh_vacancy_id"], r["rank"], r["match_score"], r["matched_skills"]) for r in out.collect())
    assert got == [(1, "1", 1, 58, ["X"]), (1, "1", 2, 40, []), (2, "1", 2, None, []), (2, "2", 1, None, [])]


PEOPLE = "persona_id int, current_skills array<string>, target_role string, skill_whitelist array<string>, min_market_n int"


def test_levels_are_not_joined_to_themselves(rows):
    df = rows("primary_role string, grade string, skill_sql boolean", ("a", "junior", True), ("b", "junior", False))
    p = rows(PEOPLE, (1, [], "a", None, 2), (1, [], "b", None, 1), (None, [], "a", None, 1))
    out = persona.relax_filters(df, p)
    assert plan(out).split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1].count("Join ") == 1
    assert sorted((r["persona_id"], r["market_n"]) for r in out.collect()) == [(1, 1), (1, 1)]


def test_skill_lists_equal_the_ranked_rows(rows):
    df = rows("primary_role string, grade string, skill_sql boolean, has_python boolean, has_metro boolean, skill_git boolean",
              ("a", "junior", True, True, True, False), ("a", "junior", True, False, True, False), ("b", "junior", False, True, False, True))
    p = rows(PEOPLE, (1, ["skill_sql"], "a", None, 1), (2, None, "a", ["has_metro"], 1), (3, [], "c", None, 0), (4, ["has_python"], "b", ["x"], 1),
             (5, [], "a", None, 1), (5, ["skill_sql"], "a", None, 1))
    demand = persona.skill_demand(df, p, 0.05)
    top, gaps = {}, {}
    for r in sorted(demand.collect(), key=lambda r: (-r["market_share"], r["skill_name"])):
        top.setdefault(r["persona_id"], []).append(r["skill_name"])
    for r in sorted(persona.with_gap(demand, p, 2).collect(), key=lambda r: r["position"]):
        if r["gap"]:
            gaps.setdefault(r["persona_id"], []).append(r["skill_name"])
    got = persona.analyze_personas(df, p, 2).collect()
    assert len(got) == 6
    assert all(r["top_skills"] == (top.get(r["persona_id"]) or [])[:2] or (r["top_skills"] is None and r["persona_id"] not in top) for r in got)
    assert all(r["recommended_skills"] == gaps.get(r["persona_id"], []) for r in got)


def test_report_computes_the_analysis_once(rows):
    analysis = rows("persona_id int, recommended_skills array<string>", (1, ["skill_sql", "has_sql"]), (2, []))
    resources = rows("skill string, title string, url string, type string", ("sql", "t", "u", "x"))
    out = persona.persona_report(analysis, resources)
    assert "/analysis-" in plan(out)
    assert {r["persona_id"]: r["recommended_skills"] for r in out.collect()} == {1: ["sql"], 2: []}


def test_context_trees_take_texts_in_small_pieces():
    assert context_trees.PIECE <= 1 << 18


def test_resource_lists_meet_each_skill_once(rows, monkeypatch):
    from postmill.sources import exports

    met, attach = [], exports.attach_resources
    monkeypatch.setattr(exports, "attach_resources", lambda skills, resources: met.append(skills) or attach(skills, resources))
    analysis = rows("persona_id int, recommended_skills array<string>",
                    (1, ["skill_sql", "has_git"]), (2, [" Has_GIT", "none"]), (3, ["has_sql", None]), (3, ["git"]), (4, None), (None, ["sql"]))
    resources = rows("skill string, title string, url string, type string", ("sql", "t", "u", "x"), ("has_git", "t", "u", "x"), ("Git ", "v", "u", "x"))
    got = sorted((r["persona_id"] or 0, r["recommended_skills"], r["skill_resources"])
                 for r in persona.persona_report(analysis, resources).collect())
    assert got == [(0, ["sql"], []), (1, ["sql", "git"], ["sql:1", "git:2"]), (2, ["git", "none"], ["git:2"]),
                   (3, ["git"], ["git:2", "sql:1"]), (3, ["sql", None], ["git:2", "sql:1"]), (4, None, [])]
    assert [sorted(r["skill"] or "" for r in skills.collect()) for skills in met] == [["", "git", "none", "sql"]]


def write_tables(spark, path):
    day = dt.datetime(2001, 6, 1)
    line = """l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double,
      l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"""
    lines = [(k, n, 1 + n % 2, 1, 5.0, 10.0 * n, 0.1, 0.01, "A", day) for k in (1, 2) for n in (1, 2)]
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0), (9, "M", 0)]),
        # a customer that occurs twice, two orders without one, an order without a key
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(2, 0, "BUILDING"), (2, 9, "HOUSEHOLD"), (3, 9, None)]),
        "supplier": ("s_suppkey long, s_name string, s_acctbal double", [(1, "s", 1.0)]),
        "part": ("p_partkey long, p_name string, p_type string, p_size int", [(1, "red ring", "LARGE", 1), (2, None, "SMALL", 7)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp", [
            (1, 2, "2-HIGH", day), (2, 3, "3-MEDIUM", None), (3, 7, "5-LOW", day), (None, 3, "5-LOW", day), (4, None, "5-LOW", day), (5, 3, None, day)]),
        # lines that come twice or thrice, two orders with one id, lines that miss a key or other values
        "lineitem": (line, [*lines, lines[0], lines[0], lines[3], (1, 12, 1, 1, 5.0, 10.0, 0.1, 0.01, "A", day),
                            (None, 1, 1, 1, 5.0, 10.0, 0.1, 0.01, "R", day), (5, None, 1, 1, 5.0, 10.0, 0.1, 0.01, "R", day),
                            (5, 3, 2, None, None, None, None, None, None, None), (3, 1, 1, 1, 5.0, 10.0, 0.1, 0.01, "A", day)]),
    }
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")


def test_refresh_pairs_its_postings_without_a_second_read(spark, tmp_path, no_broadcast):
    from postmill.queries import cleaning as raw_queries
    from postmill.queries import sources

    write_tables(spark, str(tmp_path))
    t = registry.Tables(spark, str(tmp_path))
    got = sources.raw_postings(t)
    want = raw_queries.raw_rows(t).join(t.postings("vacancy_id", "ordinal", "title", "city", "work_mode"), ["vacancy_id", "ordinal"])
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    steps = plan(sources.raw_postings(t)).split("== Physical Plan ==")[1]
    assert steps.count("FileScan parquet [l_") == 1
    # by part and by order; neither to meet the customers nor to meet each other
    assert steps.count("Exchange hashpartitioning(l_") == 2 and steps.count("Exchange hashpartitioning(vacancy_id") == 0


def test_refresh_leaves_no_raw_rows(spark, tmp_path, monkeypatch):
    from postmill.queries import sources

    write_tables(spark, str(tmp_path))
    raw = sources.raw_postings(registry.Tables(spark, str(tmp_path))).withColumn("primary_role", F.lit("x"))
    paths, folder = {}, session.shared_dir
    monkeypatch.setattr(session, "shared_dir", lambda spark, purpose: paths.setdefault(purpose, folder(spark, purpose)))
    done = refresh.refresh(raw, f"{tmp_path}/runs", "run-1", F.lit("2024-02-15").cast("date"), ties=(F.col("ordinal"),), publish=False)
    assert [done[k].count() for k in ("clean", "features")] == [raw.select("vacancy_id").distinct().count()] * 2
    path = Path(paths["raw"].removeprefix("file:"))
    assert path.parent.exists() and not path.exists()


def test_written_tables_leave_no_shuffle_files(spark):
    local = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f.name for d in local for f in d.glob("*/shuffle_*.data")}

    before = shuffles()
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(r["n"] for r in session.materialize(counted, "counted").collect()) == [142] + [143] * 6
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    # the plan itself can run again
    assert counted.count() == 7
