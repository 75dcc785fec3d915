"""Segment summaries, filters, listings, trust labels and personas."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import market, persona
from postmill.queries.market import CONFIDENCE, VIEW_SQL, segment_view
from postmill.queries.registry import query
from postmill.sources.bindings import SKILL_FLAGS
from postmill.sources.exports import attach_resources, export_skill_gap

S = "salary_mid_rub_capped"
DIMS = ["primary_role", "grade_final", "city_tier", "work_mode", "country", "region", "city_normalized", "geo_scope"]


@query("market_confidence", f"""SELECT company, n, s, {CONFIDENCE.format(n='n', s='s', c='s / n')} AS confidence FROM (
  SELECT company, count(*) AS n, count({S}) FILTER (WHERE quantity < 10) AS s FROM postings GROUP BY company)""")
def _(t):
    rows = t.postings("company", S, "quantity")
    g = rows.groupBy("company").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("quantity") < 10, F.col(S))).alias("s"))
    return g.withColumn("confidence", market.market_confidence(F.col("n"), F.col("s"), F.col("s") / F.col("n")))


_SUM = """sum(vacancy_count_total)::BIGINT AS vacancy_count, sum(vacancy_count_salary)::BIGINT AS salary_sample_size,
  round(avg(salary_median), 6) AS salary_median, round(avg(salary_q25), 6) AS salary_q25, round(avg(salary_q75), 6) AS salary_q75,
  round(avg(junior_friendly_share), 6) AS junior_friendly_share, round(avg(remote_share), 6) AS remote_share,
  round(avg(median_tech_stack_size), 6) AS median_tech_stack_size,
  CASE WHEN min(geo_scope) = max(geo_scope) THEN min(geo_scope) ELSE 'mixed' END AS geo_scope,
  round_even(sum(vacancy_count_salary) / sum(vacancy_count_total), 6) AS salary_coverage_share"""
_SKILLS = "replace(arg_min(top_skills, {'a': -vacancy_count_total, 'b': top_skills}), ', ', '|') AS top_skills"
_LOW = "CASE WHEN confidence = 'low' THEN 'low_confidence' ELSE '' END AS warnings"


@query("segment_summary_view", f"""WITH {VIEW_SQL} SELECT *, {_LOW} FROM (SELECT *, vacancy_count AS sample_size, {CONFIDENCE.format(
  n='vacancy_count', s='salary_sample_size', c='salary_coverage_share')} AS confidence
  FROM (SELECT {_SUM}, {_SKILLS} FROM mv WHERE primary_role = 'promo' AND grade_final IN ('junior', 'middle')))""")
def _(t):
    return market.segment_summary_from_view(
        segment_view(t), {"primary_role": "promo", "grade_final": ["junior", "middle"], "absent": "x", "region": None})


@query("segment_summary_weighted", f"""WITH {VIEW_SQL}, part AS (SELECT * FROM mv WHERE country = 'C1')
  SELECT sum(vacancy_count_total)::BIGINT AS vacancy_count, {", ".join(
  f"round(sum({c} * vacancy_count_total) / sum(CASE WHEN {c} IS NOT NULL THEN vacancy_count_total END), 6) AS {c}"
  for c in ("salary_median", "salary_q25", "remote_share"))}, 'local' AS geo_scope FROM part""")
def _(t):
    out = market.segment_summary_from_view(segment_view(t).withColumn("geo_scope", F.lit("local")), {"country": "C1", "geo_scope": "local"}, weighted=True)
    return out.select("vacancy_count", "salary_median", "salary_q25", "remote_share", "geo_scope")


@query("segment_summary_empty", """SELECT 0::BIGINT AS vacancy_count, NULL::BIGINT AS salary_sample_size, NULL::DOUBLE AS salary_median,
  NULL::VARCHAR AS confidence, NULL::VARCHAR AS geo_scope, NULL::VARCHAR AS top_skills, 'unknown_grade_final:chief|empty_segment' AS warnings
  FROM (SELECT count(*) FROM postings)""")
def _(t):
    out = market.segment_summary_from_view(segment_view(t), {"primary_role": "promo", "grade_final": "chief", "geo_scope": "local"})
    return out.select("vacancy_count", "salary_sample_size", "salary_median", "confidence", "geo_scope", "top_skills", "warnings")


@query("segment_summary_postings", f"""WITH {VIEW_SQL} SELECT *, {_LOW} FROM (SELECT *, vacancy_count AS sample_size, {CONFIDENCE.format(
  n='vacancy_count', s='salary_sample_size', c='salary_coverage_share')} AS confidence FROM (SELECT count(*) AS vacancy_count, count({S}) AS salary_sample_size,
  round(avg(is_junior_friendly::INT), 6) AS junior_friendly_share, round(avg((work_mode = 'remote')::INT), 6) AS remote_share,
  'mixed' AS geo_scope, round(quantile_cont({S}, 0.5), 6) AS salary_median, round(quantile_cont({S}, 0.25), 6) AS salary_q25,
  round(quantile_cont({S}, 0.75), 6) AS salary_q75, round(quantile_cont(tech_stack_size, 0.5), 6) AS median_tech_stack_size,
  round_even(count({S}) / count(*), 6) AS salary_coverage_share, (SELECT {_SKILLS} FROM mv WHERE primary_role = 'small' AND geo_scope = 'mixed') AS top_skills
  FROM postings WHERE work_mode = 'hybrid' AND primary_role = 'small' AND geo_scope = 'mixed'))""")
def _(t):
    rows = t.postings("primary_role", "work_mode", "geo_scope", "is_junior_friendly", "tech_stack_size", S)
    return market.segment_summary_from_postings(
        rows, {"work_mode": "hybrid", "primary_role": "small", "geo_scope": "mixed"}, view=segment_view(t))


@query("filter_warnings", """SELECT 'primary_role' AS dimension, 'pilot' AS requested,
  string_agg(primary_role, '|' ORDER BY primary_role) AS available FROM (SELECT DISTINCT primary_role FROM postings)""")
def _(t):
    return market.filter_warnings(
        t.postings("primary_role", "grade_final"), {"primary_role": "pilot", "grade_final": "junior"})


@query("validate_dimension", """SELECT c_custkey, value, value IS NULL OR value <> 'ECO' AS accepted, NULL::VARCHAR AS warning FROM (
  SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' Promo' WHEN 1 THEN 'ECO' END AS value FROM customer)""")
def _(t):
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.when(k % 3 == 0, " Promo").when(k % 3 == 1, "ECO").alias("value"))
    return market.validate_dimension(rows, "value", t.postings("primary_role"), "primary_role")


@query("geo_scope_label", """SELECT company, CASE WHEN min(g) = max(g) THEN min(g) WHEN min(g) <> max(g) THEN 'mixed' END AS scope
  FROM (SELECT company, CASE WHEN quantity > 48 THEN geo_scope ELSE 'unknown' END AS g0,
  CASE WHEN quantity > 48 THEN geo_scope END AS g FROM postings) GROUP BY company""")
def _(t):
    rows = t.postings("company", "geo_scope", "quantity")
    scope = F.when(F.col("quantity") > 48, F.col("geo_scope")).otherwise("unknown")
    return rows.withColumn("g", scope).groupBy("company").agg(market.scope_label(F.col("g")).alias("scope"))


@query("apply_filters", """SELECT company, count(*) AS n FROM postings WHERE primary_role = 'promo' AND grade_final IN ('junior', 'lead')
  GROUP BY company""")
def _(t):
    rows = market.apply_filters(t.postings("company", "primary_role", "grade_final"),
                                {"primary_role": "promo", "grade_final": {"lead", "junior"}, "absent": 1, "company": None})
    return rows.groupBy("company").agg(F.count(F.lit(1)).alias("n"))


@query("dimension_values", " UNION ".join(
    f"SELECT '{d}' AS dimension, {d} AS value FROM postings WHERE {d} IS NOT NULL" for d in DIMS + ["domain"]))
def _(t):
    return market.dimension_values(t.postings(*DIMS, "domain"), [*DIMS, "domain", "absent"])


@query("skills_listing", """WITH s AS (SELECT DISTINCT w AS skill FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)
  WHERE contains(w, 'o')) SELECT skill, (SELECT count(*) FROM s) AS total FROM s ORDER BY skill LIMIT 4 OFFSET 2""")
def _(t):
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("w")).select(
        F.concat(F.lit("skill_"), F.initcap("w")).alias("name"))
    return market.skills_listing(words, "name", " O ", 4, 2)


@query("trust_columns", f"""SELECT company, n, s, strftime(d, '%Y-%m-%d %H:%M:%S') AS trust_updated_at,
  CASE WHEN age <= 7 THEN 'fresh' WHEN age <= 30 THEN 'aging' ELSE 'stale' END AS trust_freshness, n AS trust_sample_size,
  round(s / n, 6) AS trust_salary_coverage, CASE WHEN n % 2 = 0 THEN 'high' ELSE 'unknown' END AS trust_confidence FROM (
  SELECT company, count(*) AS n, count({S}) AS s, max(scraped_at) AS d, date_diff('day', max(scraped_at), TIMESTAMP '2001-11-20') AS age
  FROM postings GROUP BY company)""")
def _(t):
    g = t.postings("company", S, "scraped_at").groupBy("company").agg(
        F.count(F.lit(1)).alias("n"), F.count(S).alias("s"), F.max("scraped_at").alias("d"))
    g = g.withColumn("c", F.when(F.col("n") % 2 == 0, "high"))
    return market.with_trust(g, F.lit("2001-11-20").cast("timestamp"), "d", "n", "s", "c").drop("d", "c")


def _pairs(counts):
    """A map as ``label:n`` texts."""
    return F.transform(F.map_entries(counts), lambda e: F.concat_ws(":", e["key"], e["value"]))


@query("dataset_trust", f"""WITH {VIEW_SQL}, v AS (SELECT *, CASE WHEN confidence <> 'high' THEN confidence ELSE 'unknown' END AS label FROM mv)
  SELECT sum(vacancy_count)::BIGINT AS vacancy_count, sum(salary_sample_size)::BIGINT AS salary_sample_size,
  round_even(sum(salary_sample_size) / sum(vacancy_count), 6) AS salary_coverage_share,
  (SELECT string_agg(label || ':' || n, '|' ORDER BY label) FROM (SELECT label, count(*) AS n FROM v GROUP BY label)) AS confidence_counts FROM v""")
def _(t):
    view = segment_view(t).withColumn("confidence", F.when(F.col("confidence") != "high", F.col("confidence")))
    return market.dataset_trust(view).withColumn("confidence_counts", _pairs(F.col("confidence_counts")))


@query("dataset_scope", """WITH p AS (SELECT *, CASE WHEN quantity > 30 THEN 'salary_disclosed' WHEN quantity > 5 THEN 'all_vacancies' ELSE 'unknown' END AS label FROM postings)
  SELECT count(*) AS row_count, count(*) FILTER (WHERE salary_disclosed) AS salary_disclosed_count, round_even(avg(salary_disclosed::INT), 6) AS salary_disclosure_share,
  (SELECT string_agg(label || ':' || n, '|' ORDER BY label) FROM (SELECT label, count(*) AS n FROM p GROUP BY label)) AS dataset_scope_counts FROM p""")
def _(t):
    n = F.col("quantity")
    rows = t.postings("quantity", "salary_disclosed").withColumn(
        "dataset_scope", F.when(n > 30, "salary_disclosed").when(n > 5, "all_vacancies"))
    return market.dataset_scope(rows).withColumn("dataset_scope_counts", _pairs(F.col("dataset_scope_counts")))


@query("dataset_warning", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'quality_not_passed'
  WHEN o_orderkey % 2 = 0 THEN 'date_semantics_not_passed' WHEN o_orderdate < TIMESTAMP '2001-01-01' THEN 'stale' END AS dataset_warning
  FROM orders""")
def _(t):
    meta = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "passed")
        .alias("quality_status"),
        F.when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("passed").alias("date_semantics_status"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return market.dataset_warning(meta, F.lit("2001-01-31").cast("timestamp")).select("o_orderkey", "dataset_warning")


# --- personas --------------------------------------------------------------

ROLES = ["promo", "small", "large", "pilot"]
GRADES = ["junior", "middle", "lead"]


def personas(t):
    """One persona per customer: targets and skills follow from the key."""
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("persona_id"),
        F.element_at(F.array(*[F.lit(r) for r in ROLES]), (k % 4 + 1).cast("int")).alias("target_role"),
        F.when(k % 5 != 0, F.element_at(F.array(*[F.lit(g) for g in GRADES]), (k % 3 + 1).cast("int"))).alias("target_grade"),
        F.when(k % 2 == 0, F.concat(F.lit("NATION_"), F.col("c_nationkey"))).alias("target_city"),
        F.when(k % 7 == 0, "remote").alias("target_work_mode"),
        F.when(k % 11 == 0, "mixed").alias("target_geo_scope"),
        F.array(F.concat(F.lit("skill_"), F.lower(F.lit("ring"))), F.when(k % 2 == 0, "has_red").otherwise("x")).alias("current_skills"),
        (F.lit(100) + k % 500).cast("int").alias("min_market_n"),
    )


PERSONA_SQL = """personas AS (SELECT c_custkey AS persona_id, (['promo', 'small', 'large', 'pilot'])[c_custkey % 4 + 1] AS target_role,
  CASE WHEN c_custkey % 5 <> 0 THEN (['junior', 'middle', 'lead'])[c_custkey % 3 + 1] END AS target_grade,
  CASE WHEN c_custkey % 2 = 0 THEN 'NATION_' || c_nationkey END AS target_city,
  CASE WHEN c_custkey % 7 = 0 THEN 'remote' END AS target_work_mode, CASE WHEN c_custkey % 11 = 0 THEN 'mixed' END AS target_geo_scope,
  100 + c_custkey % 500 AS min_market_n, ['skill_ring', CASE WHEN c_custkey % 2 = 0 THEN 'has_red' ELSE 'x' END] AS current_skills
  FROM customer)"""
# all target combinations x dimension combinations, for the SQL side only
_ORDER = ["geo_scope", "city", "work_mode", "grade", "role"]
_COL = {"geo_scope": "geo_scope", "city": "city_normalized", "work_mode": "work_mode", "grade": "grade_final", "role": "primary_role"}
_FAIL = "greatest(" + ", ".join(
    f"CASE WHEN target_{d} IS NOT NULL AND target_{d} <> {_COL[d]} THEN {i + 1} ELSE 0 END" for i, d in enumerate(_ORDER)) + ")"
_TARGETS = ", ".join(f"target_{d}" for d in _ORDER)
_FLAG_SUM = ", ".join(f"sum({s}::INT) AS {s}" for s in SKILL_FLAGS)
RELAX_SQL = f"""{PERSONA_SQL}, targets AS (SELECT DISTINCT {_TARGETS} FROM personas),
  combos AS (SELECT {', '.join(_COL.values())}, count(*) AS n FROM postings GROUP BY ALL),
  lv AS (SELECT {_TARGETS}, {_FAIL} AS lvl, sum(n) AS n FROM targets, combos GROUP BY ALL),
  cum AS (SELECT t.*, l.lvl, coalesce((SELECT sum(n) FROM lv x WHERE {' AND '.join(f'x.target_{d} IS NOT DISTINCT FROM t.target_{d}' for d in _ORDER)}
    AND x.lvl <= l.lvl), 0) AS n FROM targets t, (SELECT unnest(range(0, 6)) AS lvl) l),
  sized AS (SELECT persona_id, min_market_n, lvl, n FROM personas p JOIN cum c ON
    {' AND '.join(f'p.target_{d} IS NOT DISTINCT FROM c.target_{d}' for d in _ORDER)}),
  pick AS (SELECT persona_id, min_market_n, CASE WHEN max(n) FILTER (WHERE lvl = 5) >= min_market_n AND
    max(n) FILTER (WHERE lvl = 0) < min_market_n THEN min(lvl) FILTER (WHERE n >= min_market_n) ELSE 0 END AS lvl,
    max(n) FILTER (WHERE lvl = 0) AS n0 FROM sized GROUP BY persona_id, min_market_n),
  segs AS (SELECT s.persona_id, s.min_market_n, s.lvl, s.n::BIGINT AS market_n, n0, {_TARGETS}, current_skills FROM sized s
    JOIN pick USING (persona_id, lvl) JOIN personas USING (persona_id))"""


def _dropped(keep):
    op = ">" if keep == "relaxed" else "<="
    order = list(enumerate(_ORDER)) if keep == "relaxed" else list(reversed(list(enumerate(_ORDER))))
    return "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN target_{d} IS NOT NULL AND lvl {op} {i} THEN '{_COL[d]}' END" for i, d in order
    ) + "], lambda x: x IS NOT NULL), '|')"


_WARN = f"""array_to_string(list_filter([CASE WHEN n0 = 0 THEN 'empty_segment' END,
  CASE WHEN market_n < min_market_n THEN 'small_segment' END, CASE WHEN {_dropped('relaxed')} <> '' THEN 'filters_relaxed' END,
  CASE WHEN target_grade IS NOT NULL AND lvl > 3 THEN 'grade_filter_relaxed' END], lambda x: x IS NOT NULL), '|')"""


@query("relax_filters", f"""WITH {RELAX_SQL} SELECT persona_id, min_market_n, market_n, {_dropped('relaxed')} AS relaxed_filters,
  {_dropped('used')} AS filters_used, {_WARN} AS warnings FROM segs""")
def _(t):
    return persona.relax_filters(t.postings(*_COL.values()), personas(t)).drop("_key")


_MATCH = " AND ".join(f"(target_{d} IS NULL OR lvl > {i} OR target_{d} = {_COL[d]})" for i, d in enumerate(_ORDER))
DEMAND_SQL = f"""{RELAX_SQL}, fl AS (SELECT {', '.join(_COL.values())}, count(*) AS n, {_FLAG_SUM} FROM postings GROUP BY ALL),
  st AS (SELECT DISTINCT {_TARGETS}, lvl FROM segs), tot AS (SELECT {_TARGETS}, lvl, sum(n) AS n, {', '.join(f'sum({s}) AS {s}' for s in SKILL_FLAGS)}
    FROM st, fl WHERE {_MATCH} GROUP BY ALL),
  shares AS (SELECT {_TARGETS}, lvl, unnest([{', '.join(f"{{'skill_name': '{s}', 'market_share': {s} / n}}" for s in SKILL_FLAGS)}], recursive := true) FROM tot),
  demand AS (SELECT persona_id, skill_name, market_share, current_skills FROM segs g JOIN shares h ON
    {' AND '.join(f'g.target_{d} IS NOT DISTINCT FROM h.target_{d}' for d in _ORDER)} AND g.lvl = h.lvl)"""


@query("skill_demand", f"""WITH {DEMAND_SQL} SELECT persona_id, skill_name, round(market_share, 6) AS market_share FROM demand
  WHERE market_share >= 0.12""")
def _(t):
    return persona.skill_demand(t.postings(*_COL.values(), *SKILL_FLAGS), personas(t), 0.12)


GAP_SQL = f"""{DEMAND_SQL}, gap AS (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY gap DESC, market_share DESC, skill_name)
  AS position FROM (SELECT persona_id, skill_name, market_share, list_contains(current_skills, skill_name) AS persona_has,
  NOT list_contains(current_skills, skill_name) AS gap FROM demand WHERE market_share >= {{share}}))"""


@query("skill_gap", f"""WITH {GAP_SQL.replace("{share}", "0.1")} SELECT persona_id, skill_name, round(market_share, 6) AS market_share, persona_has, gap,
  position FROM gap WHERE position <= 6""")
def _(t):
    return persona.skill_gap(t.postings(*_COL.values(), *SKILL_FLAGS), personas(t), 0.1, 6)


ANALYZE_COLUMNS = ["is_remote", "is_junior_friendly", S, "salary_disclosed"]
ANALYZE_SQL = f"""{GAP_SQL.replace("{share}", "0.05")}, q AS (SELECT {_TARGETS}, lvl, count(*) AS n, count(v) AS ns,
  quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, avg(is_remote::INT) AS r,
  avg(is_junior_friendly::INT) AS j, CASE WHEN min(geo_scope) = max(geo_scope) THEN min(geo_scope) WHEN min(geo_scope) <> max(geo_scope)
  THEN 'mixed' END AS sc FROM st, (SELECT *, CASE WHEN salary_disclosed THEN {S} END AS v FROM postings) WHERE {_MATCH} GROUP BY ALL),
  tops AS (SELECT persona_id, array_to_string(list(skill_name ORDER BY market_share DESC, skill_name)[1:4], '|') AS top_skills FROM demand
    WHERE market_share >= 0.05 GROUP BY persona_id),
  recs AS (SELECT persona_id, string_agg(skill_name, '|' ORDER BY position) FILTER (WHERE gap) AS rec FROM gap WHERE position <= 4 GROUP BY 1),
  ana AS (SELECT g.persona_id, coalesce(n, 0) AS vacancy_count, coalesce(ns, 0) AS salary_sample_size, round(ns / n, 6) AS salary_coverage_share,
  min_market_n, round(m, 6) AS salary_median, round(a, 6) AS salary_q25, round(b, 6) AS salary_q75, round(r, 6) AS remote_share,
  round(j, 6) AS junior_friendly_share, sc AS geo_scope, top_skills, coalesce(rec, '') AS recommended_skills
  FROM segs g LEFT JOIN q ON {' AND '.join(f'g.target_{d} IS NOT DISTINCT FROM q.target_{d}' for d in _ORDER)} AND g.lvl = q.lvl
  LEFT JOIN tops USING (persona_id) LEFT JOIN recs USING (persona_id))"""


def analysis(t):
    return persona.analyze_personas(t.postings(*_COL.values(), *ANALYZE_COLUMNS, *SKILL_FLAGS), personas(t), 4)


@query("analyze_personas", f"""WITH {ANALYZE_SQL} SELECT *, {CONFIDENCE.format(n='vacancy_count', s='salary_sample_size',
  c='coalesce(salary_coverage_share, 0)')} AS confidence FROM ana""")
def _(t):
    return analysis(t).drop("filters_used", "relaxed_filters", "warnings")


def resources(t):
    return t.part.select(
        F.concat(F.lit(" Has_"), F.split("p_name", " ")[0]).alias("skill"), F.col("p_brand").alias("title"),
        F.concat(F.lit("https://example.org/"), F.lower("p_type")).alias("url"), F.lower("p_type").alias("type")).distinct()


RESOURCES_SQL = """res AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS skill, p_brand AS title, 'https://example.org/' || lower(p_type) AS url,
  lower(p_type) AS type FROM part)"""


@query("attach_resources", f"""WITH {RESOURCES_SQL} SELECT skill, string_agg(title || ' ' || url, '|' ORDER BY title, url) AS resources
  FROM res JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS s FROM part) ON s = skill GROUP BY skill""")
def _(t):
    skills = t.part.select(F.split("p_name", " ")[0].alias("skill")).distinct()
    out = attach_resources(skills, resources(t))
    return out.withColumn("resources", F.transform("resources", lambda r: F.concat_ws(" ", r["title"], r["url"])))


@query("persona_report", f"""WITH {ANALYZE_SQL}, {RESOURCES_SQL}, names AS (SELECT persona_id, list_transform(
  list_filter(string_split(recommended_skills, '|'), lambda x: x <> ''), lambda x: regexp_replace(x, '^(skill_|has_)', '')) AS l FROM ana),
  cnt AS (SELECT skill, count(*) AS c FROM res GROUP BY skill), ex AS (SELECT persona_id, unnest(l) AS skill, generate_subscripts(l, 1) AS i FROM names)
  SELECT n.persona_id, array_to_string(l, '|') AS recommended_skills, coalesce(r, '') AS skill_resources, 'run-1' AS dataset_run_id
  FROM names n LEFT JOIN (SELECT persona_id, string_agg(skill || ':' || c, '|' ORDER BY i) AS r FROM ex JOIN cnt USING (skill) GROUP BY 1) x
  USING (persona_id)""")
def _(t):
    trust = t.region.agg(F.concat(F.lit("run-"), F.count(F.lit(1)) - 4).alias("dataset_run_id"))
    out = persona.persona_report(analysis(t), resources(t), trust)
    return out.select("persona_id", "recommended_skills", "skill_resources", "dataset_run_id")


@query("export_skill_gap", f"""WITH {GAP_SQL.replace("{share}", "0.1")} SELECT persona_id, skill_name, round(market_share, 6) AS market_share,
  persona_has, gap, position, (SELECT count(*) FROM postings) AS sample_size, 'run-1' AS dataset_run_id FROM gap WHERE position <= 2""")
def _(t):
    rows = t.postings(*_COL.values(), *SKILL_FLAGS)
    trust = rows.agg(F.count(F.lit(1)).alias("sample_size"), F.lit("run-1").alias("dataset_run_id"))
    return export_skill_gap(persona.skill_gap(rows, personas(t), 0.1, 2), trust)
