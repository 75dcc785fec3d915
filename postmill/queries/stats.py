"""Grouped statistics and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import stats
from postmill.queries.registry import query
from postmill.sources.bindings import BENEFIT_FLAGS, DOMAIN_FLAGS, SKILL_FLAGS, SOFT_FLAGS

S = "salary_mid_rub_capped"
GRADES = ["intern", "junior", "middle", "senior", "lead"]
MODES = ["hybrid", "office", "remote"]
MED = f"round(quantile_cont({S}, 0.5), 6)"
Q25 = f"round(quantile_cont({S}, 0.25), 6)"
Q75 = f"round(quantile_cont({S}, 0.75), 6)"
SKILLS_SORTED = sorted(SKILL_FLAGS)


def long_sql(flags, how, keys=(), where="", label="skill", value="share"):
    """One SELECT per flag, for statements that unpivot aggregated flags."""
    key_list = "".join(f"{k}, " for k in keys)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    return " UNION ALL ".join(
        f"SELECT {key_list}'{c}' AS {label}, {how.format(c=c)} AS {value} FROM postings {where}{group}" for c in flags
    )


@query("salary_by_group", f"""SELECT city_tier, count({S}) AS n, {MED} AS median, round(avg({S}), 6) AS mean,
  min({S}) AS min, max({S}) AS max FROM postings WHERE city_tier IS NOT NULL GROUP BY city_tier
  ORDER BY quantile_cont({S}, 0.5) DESC, city_tier LIMIT 3""")
def _(t):
    return stats.salary_by_group(t.postings("city_tier", S), "city_tier", top_n=3)


@query("salary_pivot", "SELECT primary_role, " + ", ".join(
    f"round(quantile_cont({S}, 0.5) FILTER (WHERE work_mode = '{m}'), 6) AS {m}" for m in MODES
) + " FROM postings GROUP BY primary_role")
def _(t):
    return stats.salary_pivot(t.postings("primary_role", "work_mode", S), "primary_role", "work_mode", MODES)


@query("salary_pivot_mean", "SELECT primary_role, " + ", ".join(
    f"round(avg({S}) FILTER (WHERE work_mode = '{m}'), 6) AS {m}" for m in MODES
) + " FROM postings GROUP BY primary_role")
def _(t):
    return stats.salary_pivot(t.postings("primary_role", "work_mode", S), "primary_role", "work_mode", MODES, agg="avg")


SUMMARY = f"count({S}) AS n, {MED} AS median, round(avg({S}), 6) AS mean, round(stddev_samp({S}), 6) AS std"

for _name, _column in {
    "salary_summary_city_tier": "city_tier", "salary_summary_grade": "grade_final",
    "salary_summary_role": "primary_role", "salary_summary_english": "lang_english_level",
}.items():
    @query(_name, f"SELECT {_column}, {SUMMARY} FROM postings WHERE {_column} IS NOT NULL GROUP BY {_column}")
    def _(t, _column=_column):
        return stats.salary_summary(t.postings(_column, S), _column)


@query("salary_summary_all_categories", f"""WITH cats AS (SELECT DISTINCT 'C' || n_nationkey % 5 AS country FROM nation)
  SELECT c.country, coalesce(n, 0) AS n, median, mean, std FROM cats c LEFT JOIN (
  SELECT country, {SUMMARY} FROM postings GROUP BY country) p ON p.country = c.country""")
def _(t):
    cats = t.nation.select(F.concat(F.lit("C"), F.col("n_nationkey") % 5).alias("country"))
    return stats.salary_summary(t.postings("country", S), "country", categories=cats)


@query("salary_by_experience_bucket", f"""SELECT CASE WHEN y <= 1 THEN '0-1' WHEN y <= 3 THEN '1-3' WHEN y <= 6
  THEN '3-6' ELSE '6+' END AS exp_bucket, {SUMMARY}
  FROM (SELECT *, coalesce(exp_min_years, exp_max_years, -1) AS y FROM postings) GROUP BY 1""")
def _(t):
    return stats.salary_by_experience_bucket(t.postings("exp_min_years", "exp_max_years", S))


@query("salary_by_stack_size", f"""SELECT CASE WHEN tech_stack_size < 3 THEN '0-3' WHEN tech_stack_size < 6 THEN '3-6'
  WHEN tech_stack_size < 10 THEN '6-10' ELSE '>=10' END AS tech_stack_bin, {SUMMARY} FROM postings GROUP BY 1""")
def _(t):
    return stats.salary_by_stack_size(t.postings("tech_stack_size", S))


REQUIREMENT = f"""count({S}) AS vacancy_count, {Q25} AS salary_q25, {MED} AS salary_median, {Q75} AS salary_q75,
  round(count({S}) / (SELECT count(*) FROM postings), 6) AS share"""


@query("english_requirement_stats", f"""SELECT CASE lang_english_level WHEN 'none' THEN 'no_english'
  WHEN 'basic' THEN 'a2' WHEN 'intermediate' THEN 'b1' WHEN 'upper_intermediate' THEN 'b2'
  WHEN 'advanced' THEN 'c1_plus' ELSE 'unknown' END AS english_level, {REQUIREMENT} FROM postings GROUP BY 1""")
def _(t):
    return stats.english_requirement_stats(t.postings("lang_english_level", S))


@query("education_requirement_stats", f"""SELECT CASE WHEN edu_level IN ('any_he', 'bachelor_or_higher',
  'partial_higher') THEN 'any_degree' ELSE 'no_degree_required' END AS education_level, {REQUIREMENT}
  FROM postings GROUP BY 1""")
def _(t):
    return stats.education_requirement_stats(t.postings("edu_level", S))


@query("salary_by_domain", f"SELECT domain, {REQUIREMENT} FROM postings GROUP BY domain")
def _(t):
    return stats.salary_by_domain(t.postings(*DOMAIN_FLAGS, S), priorities=["machinery", "building"])


@query("salary_by_grade_and_city", f"""SELECT grade_final, city_tier, count({S}) AS count, {MED} AS median, {Q25} AS q1,
  {Q75} AS q3 FROM postings WHERE city_tier IS NOT NULL GROUP BY ALL""")
def _(t):
    return stats.salary_by_grade_and_city(t.postings("grade_final", "city_tier", S))


@query("salary_by_role_and_work_mode", f"""SELECT primary_role, work_mode, {MED} AS salary_median FROM postings
  GROUP BY ALL""")
def _(t):
    return stats.salary_by_role_and_work_mode(t.postings("primary_role", "work_mode", S))


_NUM = [S, "employer_rating", "exp_min_years", "tech_stack_size", "quantity"]


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS left, '{b}' AS right, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS corr FROM postings"
    for a in _NUM for b in _NUM
))
def _(t):
    return stats.correlation_matrix(t.postings(*_NUM))


@query("soft_skill_correlation", " UNION ALL ".join(
    f"""SELECT '{a}' AS left, '{b}' AS right,
    round(corr(coalesce({a}, false)::INT, coalesce({b}, false)::INT), 6) AS corr FROM postings"""
    for a in SOFT_FLAGS for b in SOFT_FLAGS
))
def _(t):
    return stats.soft_skill_correlation(t.postings(*SOFT_FLAGS))


@query("top_values", "SELECT company, count(*) AS count FROM postings GROUP BY company ORDER BY count DESC, company LIMIT 15")
def _(t):
    return stats.top_values(t.postings("company"), "company")


@query("skill_frequency", f"SELECT skill, round(share, 6) AS share FROM ({long_sql(SKILLS_SORTED, 'avg({c}::INT)')}) "
       "ORDER BY share DESC, skill LIMIT 15")
def _(t):
    return stats.skill_frequency(t.postings(*SKILL_FLAGS))


@query("skill_share_by_grade", " UNION ALL ".join(
    f"SELECT '{c}' AS skill, " + ", ".join(
        f"round(avg({c}::INT) FILTER (WHERE grade_final = '{g}'), 6) AS {g}" for g in GRADES
    ) + " FROM postings" for c in SKILL_FLAGS
))
def _(t):
    return stats.skill_share_by_grade(t.postings("grade_final", *SKILL_FLAGS), GRADES)


@query("junior_friendly_share", """SELECT primary_role, round(avg(is_junior_friendly::INT), 6) AS is_junior_friendly,
  round(avg(battle_experience::INT), 6) AS battle_experience FROM postings GROUP BY primary_role""")
def _(t):
    return stats.junior_friendly_share(t.postings("primary_role", "is_junior_friendly", "battle_experience"))


@query("junior_share_by_segment", long_sql(
    [*SOFT_FLAGS, "is_junior_friendly"], "round(avg({c}::INT), 6)", ["primary_role", "grade_final"], label="flag"))
def _(t):
    flags = [*SOFT_FLAGS, "is_junior_friendly"]
    rows = t.postings("primary_role", "grade_final", *flags)
    return stats.junior_share_by_segment(rows, flags, ["primary_role", "grade_final"])


@query("remote_share_by_role", "SELECT primary_role, round(avg(is_remote::INT), 6) AS remote_share FROM postings GROUP BY 1")
def _(t):
    return stats.remote_share_by_role(t.postings("primary_role", "is_remote"))


TOP10 = "SELECT company FROM postings GROUP BY company ORDER BY count(*) DESC, company LIMIT 10"
BEN = ", ".join(f"round(avg({c}::INT), 6) AS {c}" for c in BENEFIT_FLAGS)
PER_ROW = "round(avg(" + " + ".join(f"{c}::INT" for c in BENEFIT_FLAGS) + "), 6) AS benefits_per_vacancy"
SOFT = ", ".join(f"round(avg(coalesce({c}, false)::INT), 6) AS {c}" for c in SOFT_FLAGS)


@query("benefits_by_company", f"""SELECT company, {BEN}, {PER_ROW}, count(*) AS n_vacancies FROM postings
  WHERE company IN ({TOP10}) GROUP BY company""")
def _(t):
    return stats.benefits_by_company(t.postings("company", *BENEFIT_FLAGS))


@query("benefits_by_grade", f"""SELECT grade_final, {BEN}, {PER_ROW}, count(*) AS n_vacancies FROM postings
  GROUP BY grade_final""")
def _(t):
    return stats.benefits_by_grade(t.postings("grade_final", *BENEFIT_FLAGS))


@query("soft_skills_overall", " UNION ALL ".join(
    f"""SELECT '{c}' AS soft_skill, sum(coalesce({c}, false)::INT)::BIGINT AS count,
    round(avg(coalesce({c}, false)::INT), 6) AS share FROM postings""" for c in SOFT_FLAGS
))
def _(t):
    return stats.soft_skills_overall(t.postings(*SOFT_FLAGS))


@query("soft_skills_by_employer", f"""SELECT company, {SOFT}, count(*) AS n_vacancies FROM postings
  WHERE company IN ({TOP10}) GROUP BY company""")
def _(t):
    return stats.soft_skills_by_employer(t.postings("company", *SOFT_FLAGS))


@query("top_employers", f"""SELECT company, count(*) AS vacancy_count, {MED} AS salary_median,
  round(avg(employer_rating), 6) AS rating_mean, round(count(*) / (SELECT count(*) FROM postings), 6) AS share
  FROM postings GROUP BY company ORDER BY vacancy_count DESC, company LIMIT 15""")
def _(t):
    return stats.top_employers(t.postings("company", "employer_rating", S))


_PREMIUM = " UNION ALL ".join(
    f"""SELECT '{c}' AS skill, sum({c}::INT)::BIGINT AS count_with_skill,
    quantile_cont({S}, 0.5) FILTER (WHERE {c}) AS a, quantile_cont({S}, 0.5) FILTER (WHERE NOT {c}) AS b
    FROM postings""" for c in SKILL_FLAGS
)


@query("skill_premium", f"""SELECT skill, count_with_skill, round(a, 6) AS median_with, round(b, 6) AS median_without,
  round(a - b, 6) AS premium_abs, round((a - b) / b, 6) AS premium_pct FROM ({_PREMIUM}) WHERE count_with_skill >= 30""")
def _(t):
    return stats.skill_premium(t.postings(S, *SKILL_FLAGS), SKILL_FLAGS)


@query("median_and_count", f"""SELECT city, round(avg({S}), 6) AS mean, count({S}) AS count, {MED} AS median
  FROM postings GROUP BY city ORDER BY count DESC, city LIMIT 10""")
def _(t):
    return stats.median_and_count(t.postings("city", S), "city")


@query("median_and_count_stack", f"""SELECT CASE WHEN tech_stack_size <= 2 THEN '0-2' WHEN tech_stack_size <= 5 THEN '3-5'
  WHEN tech_stack_size <= 10 THEN '6-10' ELSE '10+' END AS stack_bucket, round(avg({S}), 6) AS mean,
  count({S}) AS count, {MED} AS median FROM postings GROUP BY 1""")
def _(t):
    rows = t.postings("tech_stack_size", S).withColumn("stack_bucket", stats.stack_bucket(F.col("tech_stack_size")))
    return stats.median_and_count(rows, "stack_bucket")


FIVE = f"""round(min({S}), 6) AS min, {Q25} AS q25, {MED} AS median, {Q75} AS q75, round(max({S}), 6) AS max"""


@query("box_stats", f"""SELECT primary_role, count({S}) AS n, {FIVE} FROM postings WHERE primary_role <> 'promo'
  GROUP BY primary_role ORDER BY count(*) DESC, primary_role LIMIT 4""")
def _(t):
    return stats.box_stats(t.postings("primary_role", S), "primary_role", top_n=4, exclude=["promo"])


@query("multilabel_box_stats", " UNION ALL ".join(
    f"""SELECT '{c}' AS role, count(*) AS n_total, count({S}) AS n_salary, {FIVE}, count({S}) = 0 AS left_out
    FROM postings WHERE {c}""" for c in DOMAIN_FLAGS
))
def _(t):
    return stats.multilabel_box_stats(t.postings(S, *DOMAIN_FLAGS), DOMAIN_FLAGS)


@query("share_crosstab", "SELECT city_tier, " + ", ".join(
    f"round(avg((work_mode = '{m}')::INT), 6) AS {m}" for m in MODES
) + " FROM postings WHERE city_tier IS NOT NULL GROUP BY city_tier")
def _(t):
    return stats.share_crosstab(t.postings("city_tier", "work_mode"), "city_tier", "work_mode", MODES)


@query("top_skills_for_role", "SELECT skill, c AS count, round(share, 6) AS share FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS skill, sum({c}::INT)::BIGINT AS c, avg({c}::INT) AS share FROM postings
    WHERE contains(primary_role, 'dar')""" for c in SKILL_FLAGS
) + ") ORDER BY c DESC, skill LIMIT 10")
def _(t):
    return stats.top_skills_for_role(t.postings("primary_role", *SKILL_FLAGS), "DAR", 10)


@query("skill_heatmap", f"""WITH top AS (SELECT skill FROM ({long_sql(SKILL_FLAGS, 'avg({c}::INT)')})
  ORDER BY share DESC, skill LIMIT 6)
  SELECT * FROM ({long_sql(SKILL_FLAGS, 'round(avg({c}::INT), 6)', ['grade_final'])})
  WHERE skill IN (SELECT skill FROM top)""")
def _(t):
    return stats.skill_heatmap(t.postings("grade_final", *SKILL_FLAGS), "grade_final", 6)


def _heat(flags, label, n):
    mean = "avg(coalesce({c}, false)::INT)"
    rows = long_sql(flags, mean, ["company"], f"WHERE company IN ({TOP10})", label=label)
    return f"""WITH h AS ({rows}), top AS (SELECT {label} FROM h GROUP BY 1 ORDER BY avg(share) DESC, 1 LIMIT {n})
      SELECT company, {label}, round(share, 6) AS share FROM h WHERE {label} IN (SELECT {label} FROM top)"""


@query("benefit_heatmap", _heat(BENEFIT_FLAGS, "benefit", 2))
def _(t):
    return stats.benefit_heatmap(t.postings("company", *BENEFIT_FLAGS), 10, 2)


@query("soft_heatmap", _heat(SOFT_FLAGS, "soft_skill", 2))
def _(t):
    return stats.soft_heatmap(t.postings("company", *SOFT_FLAGS), 10, 2)


@query("histogram", f"""WITH e AS (SELECT min({S}) AS lo, max({S}) AS hi FROM postings),
  b AS (SELECT least(floor(({S} - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS count
        FROM postings, e WHERE {S} IS NOT NULL GROUP BY 1)
  SELECT bin, round(lo + bin * ((hi - lo) / 30), 6) AS left_edge, round(lo + (bin + 1) * ((hi - lo) / 30), 6)
    AS right_edge, count FROM b, e""")
def _(t):
    return stats.histogram(t.postings(S), S)


@query("segment_share", """SELECT city_tier, count(*) AS count, round(count(*) / (SELECT count(*) FROM postings), 6) AS share
  FROM postings GROUP BY city_tier ORDER BY count DESC LIMIT 5""")
def _(t):
    return stats.segment_share(t.postings("city_tier"), "city_tier")
