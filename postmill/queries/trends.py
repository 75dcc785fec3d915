"""Weekly snapshots, trends, career paths and trend readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.fixed_values import GRADE_RANK
from postmill.operators import career, trends
from postmill.queries.registry import query
from postmill.sources.bindings import SKILL_FLAGS

S = "salary_mid_rub_capped"
KEYS = "week_start, role, grade, city_tier, work_mode, domain"


def labels(c):
    return c.split("_", 1)[1]


def top_sql(n, skills=SKILL_FLAGS):
    entries = ", ".join(f"{{'k': -n_{s}, 'l': '{labels(s)}'}}" for s in skills)
    return f"list_transform(list_sort(list_filter([{entries}], lambda e: e.k < 0))[1:{n}], lambda e: e.l)"


SUMS = ", ".join(f"sum({s}::INT) AS n_{s}" for s in SKILL_FLAGS)


def snapshot_sql(week, tier="'unknown'", mode="'unknown'", domain="'unknown'"):
    return f"""SELECT week_start, role, grade, city_tier, work_mode, domain, vacancy_count, salary_p25, salary_p50, salary_p75,
    array_to_string({top_sql(10)}, '|') AS skill_top10 FROM (SELECT strftime({week}, '%Y-%m-%d') AS week_start, primary_role AS role,
    grade_final AS grade, {tier} AS city_tier, {mode} AS work_mode, {domain} AS domain, count(*) AS vacancy_count,
    round(quantile_cont({S}, 0.25), 6) AS salary_p25, round(quantile_cont({S}, 0.5), 6) AS salary_p50,
    round(quantile_cont({S}, 0.75), 6) AS salary_p75, {SUMS} FROM postings GROUP BY ALL)"""


@query("weekly_snapshot", snapshot_sql("DATE '2026-05-18'", "coalesce(city_tier, 'unknown')", "work_mode", "domain"))
def _(t):
    rows = t.postings("primary_role", "grade_final", "city_tier", "work_mode", "domain", S, *SKILL_FLAGS)
    return trends.weekly_snapshot(rows, F.lit("2026-05-21").cast("date"))


HISTORY_SQL = snapshot_sql("date_trunc('week', published_at)")


def history(t):
    rows = t.postings("primary_role", "grade_final", S, "published_at", *SKILL_FLAGS)
    return trends.weekly_snapshot(rows, F.col("published_at"))


@query("weekly_history", HISTORY_SQL)
def _(t):
    return history(t)


@query("upsert_snapshots", """WITH old AS (SELECT strftime(date_trunc('week', published_at), '%Y-%m-%d') AS week_start, primary_role AS role,
  count(*) AS n FROM postings WHERE quantity < 30 OR primary_role = 'promo' GROUP BY ALL), new AS (SELECT strftime(date_trunc('week', published_at), '%Y-%m-%d') AS week_start,
  primary_role AS role, 1000 + count(*) AS n FROM postings WHERE quantity >= 30 AND primary_role <> 'promo' GROUP BY ALL)
  SELECT week_start, role, n AS vacancy_count FROM old ANTI JOIN new USING (week_start, role) UNION ALL SELECT week_start, role, n FROM new""")
def _(t):
    rows = t.postings("primary_role", "quantity", "published_at")

    def part(df, extra):
        g = df.groupBy(F.date_trunc("week", "published_at").cast("date").alias("week_start"), F.col("primary_role").alias("role")).agg(
            (F.count(F.lit(1)) + extra).alias("vacancy_count"))
        return g.withColumns({k: F.lit("unknown") for k in trends.SNAPSHOT_KEYS[2:]})

    old = part(rows.where("quantity < 30 OR primary_role = 'promo'"), 0)
    new = part(rows.where("quantity >= 30 AND primary_role <> 'promo'"), 1000)
    return trends.upsert_snapshots(old, new).select("week_start", "role", "vacancy_count")


@query("skill_demand_trend", f"""WITH h AS ({HISTORY_SQL}) SELECT week_start, sum(vacancy_count)::BIGINT AS vacancy_count FROM h
  WHERE list_contains(string_split(skill_top10, '|'), 'ring') AND role = 'promo' GROUP BY week_start ORDER BY week_start DESC LIMIT 12""")
def _(t):
    return trends.skill_demand_trend(history(t), " skill_RING ", role="promo")


@query("salary_trend", f"""WITH h AS ({HISTORY_SQL}) SELECT week_start, round(sum(salary_p50 * vacancy_count) /
  sum(CASE WHEN salary_p50 IS NOT NULL THEN vacancy_count END), 6) AS salary_p50 FROM h WHERE role = 'small' AND grade = 'senior'
  GROUP BY week_start ORDER BY week_start DESC LIMIT 26""")
def _(t):
    return trends.salary_trend(history(t), "small", "senior", 26)


@query("vacancy_count_trend", f"""WITH h AS ({HISTORY_SQL}) SELECT week_start, sum(vacancy_count)::BIGINT AS vacancy_count FROM h
  WHERE grade = 'lead' GROUP BY week_start ORDER BY week_start DESC LIMIT 104""")
def _(t):
    return trends.vacancy_count_trend(history(t), None, "lead", 104)


@query("annotate_points", f"""WITH h AS ({HISTORY_SQL}), p AS (SELECT week_start, sum(vacancy_count)::BIGINT AS vacancy_count FROM h
  WHERE role = 'small' AND grade = 'senior' GROUP BY week_start) SELECT week_start, vacancy_count, vacancy_count AS source_row_count,
  week_start < '2001-07-16' AS is_complete, CASE WHEN week_start < '2001-07-16' THEN 'complete' ELSE 'partial' END AS completeness,
  CASE WHEN vacancy_count >= 100 THEN 'high' WHEN vacancy_count >= 30 THEN 'medium' ELSE 'low' END AS confidence FROM p
  ORDER BY week_start DESC LIMIT 104""")
def _(t):
    h = history(t)
    points = trends.vacancy_count_trend(h, "small", "senior", 104)
    return trends.annotate_points(points, h, "small", "senior", F.lit("2001-07-18").cast("date"))


RANK = "CASE grade " + " ".join(f"WHEN '{g}' THEN {r}" for g, r in GRADE_RANK.items()) + " END"
NODES_SQL = f"""nodes AS (SELECT role, grade, {RANK} AS grade_rank, salary_p50, vacancy_count, {top_sql('{n}')} AS top_skills FROM (
  SELECT {{role}} AS role, grade_final AS grade, count(*) AS vacancy_count, quantile_cont({S}, 0.5) AS salary_p50, {SUMS}
  FROM postings {{where}} GROUP BY ALL))"""


def nodes_sql(n=10, role="primary_role", where=""):
    return NODES_SQL.replace("{n}", str(n)).replace("{role}", role).replace("{where}", where)


def career_rows(t):
    return t.postings("primary_role", "grade_final", S, *SKILL_FLAGS)


@query("career_nodes", f"""WITH {nodes_sql()} SELECT role, grade, grade_rank, round(salary_p50, 6) AS salary_p50, vacancy_count,
  array_to_string(top_skills, '|') AS top_skills FROM nodes""")
def _(t):
    return career.career_nodes(career_rows(t))


@query("career_nodes_fuzzy", f"""WITH {nodes_sql(10, "'standard_role'", "WHERE primary_role = 'standard'")} SELECT role, grade, grade_rank,
  round(salary_p50, 6) AS salary_p50, vacancy_count, array_to_string(top_skills, '|') AS top_skills FROM nodes""")
def _(t):
    return career.career_nodes(career_rows(t), ["standard_role"])


GRAPH_SQL = """, g AS (SELECT role, grade AS from_grade, lead(grade) OVER w AS to_grade, lead(salary_p50) OVER w AS p2, salary_p50 AS p1,
  top_skills AS s1, lead(top_skills) OVER w AS s2 FROM nodes WINDOW w AS (PARTITION BY role ORDER BY grade_rank, grade))
  SELECT role, from_grade, to_grade, array_to_string(list_filter(s2, lambda x: NOT list_contains(s1, x))[1:5], '|') AS skills_to_add,
  {delta} AS salary_delta_pct, 'stable' AS demand_trend FROM g WHERE to_grade IS NOT NULL"""


@query("career_graph", f"WITH {nodes_sql()} {GRAPH_SQL.replace('{delta}', 'round((p2 - p1) / p1 * 100, 6)')}")
def _(t):
    return career.career_graph(career_rows(t))


@query("unranked_graph", f"""WITH {nodes_sql(10).replace(RANK, "CASE grade WHEN 'junior' THEN 0 WHEN 'middle' THEN 2 WHEN 'senior' THEN 3 WHEN 'lead' THEN 4 ELSE 999 END")
  .replace("'l': '", "'f': 'x', 'l': '")} {GRAPH_SQL.replace('{delta}', 'round_even((p2 - p1) / p1 * 100, 2)')}""")
def _(t):
    return career.unranked_graph(career_rows(t).withColumnsRenamed({c: f"skill_{labels(c)}" for c in SKILL_FLAGS if c.startswith("has_")}))


_WORD = """CASE WHEN points < 2 THEN 'stable' WHEN f <= 0 THEN 'growing' WHEN (l - f) / f > 0.05 THEN 'growing'
  WHEN (l - f) / f < -0.05 THEN 'declining' ELSE 'stable' END"""
TREND_SQL = f"""h AS ({HISTORY_SQL}), wk AS (SELECT role, grade, week_start, sum(vacancy_count) AS n FROM h GROUP BY ALL),
  tr AS (SELECT role, grade, {_WORD} AS demand_trend FROM (SELECT role, grade, count(*) AS points, arg_min(n, week_start) AS f,
  arg_max(n, week_start) AS l FROM (SELECT *, row_number() OVER (PARTITION BY role, grade ORDER BY week_start DESC) AS i FROM wk)
  WHERE i <= 12 GROUP BY ALL))"""


@query("demand_trends", f"WITH {TREND_SQL} SELECT * FROM tr")
def _(t):
    h = history(t)
    return career.demand_trends(h, h.select("role", "grade").distinct())


@query("demand_trend", f"WITH {TREND_SQL} SELECT * FROM tr WHERE role = 'promo' AND grade = 'senior'")
def _(t):
    return career.demand_trend(history(t), "promo", "senior")


USERS_SQL = """users AS (SELECT c_custkey AS user_id, (['promo', 'small', 'large', 'pilot'])[c_custkey % 4 + 1] AS role,
  (['intern', 'junior', 'middle', 'senior', 'lead', 'guru'])[c_custkey % 6 + 1] AS grade, CASE WHEN c_custkey % 3 = 0 THEN 'ring' ELSE 'old' END AS own FROM customer)"""


def users(t):
    k = F.col("c_custkey")

    def cycle(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))

    return t.customer.select(
        k.alias("user_id"), cycle(["promo", "small", "large", "pilot"]).alias("role"),
        cycle(["intern", "junior", "middle", "senior", "lead", "guru"]).alias("grade"),
        F.array(F.when(k % 3 == 0, "Skill_Ring").otherwise("has_old")).alias("skills"))


@query("recommend_next_step", f"""WITH {nodes_sql(4)}, {USERS_SQL}, {TREND_SQL}, u AS (SELECT users.*, {RANK.replace('CASE grade', 'CASE users.grade')} AS r FROM users),
  nx AS (SELECT user_id, arg_min(n.grade, n.grade_rank) AS ng FROM u JOIN nodes n ON n.role = u.role AND n.grade_rank > u.r GROUP BY user_id)
  SELECT u.user_id, u.role AS current_role, u.grade AS current_grade, ng AS next_grade, round(c.salary_p50, 6) AS salary_current_p50,
  round(x.salary_p50, 6) AS salary_next_p50, round((x.salary_p50 - c.salary_p50) / c.salary_p50 * 100, 6) AS salary_delta_pct,
  coalesce(array_to_string(list_filter(x.top_skills, lambda s: s <> own AND NOT list_contains(coalesce(c.top_skills, []), s))[1:5], '|'), '') AS skills_to_add,
  coalesce(c.vacancy_count, 0) AS vacancy_count_current, coalesce(x.vacancy_count, 0) AS vacancy_count_next,
  coalesce(demand_trend, 'stable') AS demand_trend FROM u LEFT JOIN nx USING (user_id)
  LEFT JOIN nodes c ON c.role = u.role AND c.grade = u.grade LEFT JOIN nodes x ON x.role = u.role AND x.grade = ng
  LEFT JOIN tr ON tr.role = u.role AND tr.grade = ng""")
def _(t):
    return career.recommend_next_step(career.career_nodes(career_rows(t), top_n=4), users(t), history(t))


RUNS_SQL = """runs AS (SELECT 'd' || o_custkey % 40 AS dataset, o_orderkey AS run_id, o_orderdate AS generated_at,
  CASE WHEN o_orderkey % 5 < 3 THEN 'current_market_snapshot' ELSE 'historical_publication_facts' END AS semantic,
  CASE o_orderkey % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'crawl' END AS source_kind, o_orderstatus <> 'F' AS passed,
  o_orderpriority < '4' AS dates, o_totalprice > 100000 AS gate FROM orders)"""


def runs(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        F.concat(F.lit("d"), F.col("o_custkey") % 40).alias("dataset"), k.alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("generated_at"),
        F.when(k % 5 < 3, "current_market_snapshot").otherwise("historical_publication_facts").alias("dataset_semantic_type"),
        F.when(k % 3 == 0, "api").when(k % 3 == 1, "crawl").alias("source_kind"),
        F.when(F.col("o_orderstatus") != "F", "passed").otherwise("failed").alias("quality_status"),
        F.when(F.col("o_orderpriority") < "4", "passed").alias("date_semantics_status"),
        (F.col("o_totalprice") > 100000).alias("trend_gate_eligible"))


@query("forward_window_readiness", f"""WITH {RUNS_SQL}, w AS (SELECT *, passed AND semantic = 'current_market_snapshot' AS cur,
  passed AND semantic <> 'current_market_snapshot' AND dates AND gate AS ready, date_trunc('week', generated_at)::DATE AS wk FROM runs),
  a AS (SELECT dataset, count(*) FILTER (WHERE cur) AS quality_current_snapshot_runs, count(*) FILTER (WHERE ready) AS historical_ready_runs,
  count(DISTINCT wk) FILTER (WHERE cur) AS generated_weeks_observed, count(DISTINCT wk) FILTER (WHERE cur AND wk < DATE '2001-07-30') AS complete_weeks_observed,
  min(wk) FILTER (WHERE cur AND wk < DATE '2001-07-30') AS f, max(wk) FILTER (WHERE cur AND wk < DATE '2001-07-30') AS l,
  arg_max({{'id': run_id, 'facts': semantic <> 'current_market_snapshot', 'dates': dates, 'gate': gate, 'ready': ready}}, {{'a': generated_at, 'b': run_id}}) AS x
  FROM w GROUP BY dataset), b AS (SELECT *, CASE WHEN x.ready THEN 'historical_trend_ready' WHEN complete_weeks_observed >= 8 THEN 'forward_window_ready_for_review'
  WHEN generated_weeks_observed > 0 THEN 'forward_accumulating' ELSE 'blocked_no_evidence' END AS status, greatest(8 - complete_weeks_observed, 0) AS weeks_remaining FROM a)
  SELECT dataset, status, CASE WHEN x.ready THEN 'ready' ELSE 'blocked' END AS claim_status, quality_current_snapshot_runs, historical_ready_runs,
  generated_weeks_observed, complete_weeks_observed, weeks_remaining, strftime(f, '%G-W%V') AS first_complete_week, strftime(l, '%G-W%V') AS latest_complete_week,
  x.id AS latest_run_id, CASE WHEN x.ready THEN '' ELSE array_to_string(list_filter(['latest_dataset_is_not_public_trend_ready_historical_facts',
  CASE WHEN NOT x.facts THEN 'latest_dataset_semantic_type_is_not_historical_publication_facts' END, CASE WHEN NOT x.dates THEN 'latest_date_semantics_not_passed' END,
  CASE WHEN NOT x.gate THEN 'latest_trend_ready_gate_not_eligible' END,
  CASE WHEN status = 'forward_accumulating' AND weeks_remaining > 0 THEN 'forward_current_snapshot_history_has_too_few_complete_weeks' END,
  CASE WHEN status = 'forward_window_ready_for_review' THEN 'forward_history_needs_explicit_product_and_data_model_review_before_claim_unlock' END],
  lambda s: s IS NOT NULL), '|') END AS blocked_reasons FROM b""")
def _(t):
    return trends.forward_window_readiness(runs(t), F.lit("2001-08-01").cast("date"))


@query("runs_by_source", f"""WITH {RUNS_SQL} SELECT dataset, coalesce(source_kind, 'unknown') AS source_kind, count(*) AS runs FROM runs
  WHERE passed AND semantic = 'current_market_snapshot' GROUP BY ALL""")
def _(t):
    return trends.runs_by_source(runs(t))


@query("trend_claim_status", f"""WITH {RUNS_SQL} SELECT run_id, CASE WHEN ok THEN 'ready' ELSE 'blocked' END AS claim_status,
  CASE WHEN NOT ok THEN CASE WHEN run_id % 4 = 0 THEN 'gate says no' WHEN run_id % 3 = 0 THEN 'wait' ELSE
  'trend claims are blocked until the trend gates pass' END END AS warning FROM (SELECT *, passed AND gate AND dates AND
  semantic <> 'current_market_snapshot' AS ok FROM runs)""")
def _(t):
    k = F.col("run_id")
    meta = runs(t).withColumns({
        "trends_eligible": F.col("quality_status") == "passed", "gate_message": F.when(k % 4 == 0, "gate says no"),
        "trends_reason": F.when(k % 2 == 1, "r").otherwise(F.when(k % 3 == 0, "r")), "trends_message": F.when(k % 3 == 0, "wait"),
    })
    return trends.trend_claim_status(meta).select("run_id", "claim_status", "warning")


@query("gated_points", f"""WITH h AS ({HISTORY_SQL}) SELECT week_start, sum(vacancy_count)::BIGINT AS vacancy_count FROM h
  WHERE grade = 'lead' GROUP BY week_start ORDER BY week_start DESC LIMIT 20""")
def _(t):
    meta = t.orders.agg(
        F.lit(True).alias("trends_eligible"), (F.count(F.lit(1)) > 0).alias("trend_gate_eligible"),
        F.lit("historical_publication_facts").alias("dataset_semantic_type"), F.lit("passed").alias("date_semantics_status"),
        F.lit("").alias("trends_reason"), F.lit("").alias("trends_message"), F.lit("").alias("gate_message"))
    points = trends.vacancy_count_trend(history(t), None, "lead", 20)
    return trends.gated_points(points, trends.trend_claim_status(meta))
