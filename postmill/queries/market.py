"""Segment view and segment summaries."""

from __future__ import annotations

from postmill.operators import market
from postmill.queries.registry import Tables, query
from postmill.sources.bindings import DOMAIN_FLAGS, SKILL_FLAGS

KEYS = "primary_role, city_tier, grade_final, country, region, city_normalized, geo_scope, domain"
CONFIDENCE = """CASE WHEN {n} >= 80 AND {s} >= 30 AND {c} >= 0.30 THEN 'high'
  WHEN {n} >= 20 AND {s} >= 5 AND {c} >= 0.10 THEN 'medium' ELSE 'low' END"""
VIEW_COLUMNS = (
    "primary_role", "city_tier", "grade_final", "country", "region", "city_normalized", "geo_scope",
    "salary_mid_rub_capped", "salary_disclosed", "is_junior_friendly", "is_remote", "tech_stack_size",
)

_SHARES = ", ".join(f"sum({s}::INT) AS n_{s}" for s in SKILL_FLAGS)
_LIST = ", ".join(f"{{'k': -n_{s} / vacancy_count_total, 'l': '{s.split('_', 1)[1]}'}}" for s in SKILL_FLAGS)

# the segment view, shared by several statements
VIEW_SQL = f"""seg AS (
SELECT {KEYS}, count(*) AS vacancy_count_total, count(s) AS vacancy_count_salary,
  quantile_cont(s, 0.5) AS salary_median, quantile_cont(s, 0.25) AS salary_q25, quantile_cont(s, 0.75) AS salary_q75,
  avg(is_junior_friendly::INT) AS junior_friendly_share, avg(is_remote::INT) AS remote_share,
  quantile_cont(tech_stack_size, 0.5) AS median_tech_stack_size, {_SHARES}
FROM (SELECT *, CASE WHEN salary_disclosed THEN salary_mid_rub_capped END AS s FROM postings
      WHERE city_tier IS NOT NULL)
GROUP BY {KEYS}),
mv AS (SELECT {KEYS}, vacancy_count_total, vacancy_count_salary, salary_median, salary_q25, salary_q75,
  junior_friendly_share, remote_share, median_tech_stack_size,
  vacancy_count_total AS vacancy_count, vacancy_count_total AS sample_size,
  vacancy_count_salary AS salary_sample_size, vacancy_count_salary / vacancy_count_total AS salary_coverage_share,
  {CONFIDENCE.format(n="vacancy_count_total", s="vacancy_count_salary",
                     c="vacancy_count_salary / vacancy_count_total")} AS confidence,
  array_to_string(list_transform(list_sort(list_filter([{_LIST}], lambda e: e.k < 0))[1:5],
    lambda e: e.l || ' (' || round_even(-e.k * 100, 0)::INT || '%)'), ', ') AS top_skills
  FROM seg)"""

ROUNDED = """* REPLACE (round(salary_median, 6) AS salary_median, round(salary_q25, 6) AS salary_q25,
  round(salary_q75, 6) AS salary_q75, round(junior_friendly_share, 6) AS junior_friendly_share,
  round(remote_share, 6) AS remote_share, round(median_tech_stack_size, 6) AS median_tech_stack_size,
  round(salary_coverage_share, 6) AS salary_coverage_share)"""


def segment_view(t: Tables):
    return market.market_view(t.postings(*VIEW_COLUMNS, *SKILL_FLAGS, *DOMAIN_FLAGS))


@query("market_view", f"WITH {VIEW_SQL} SELECT {ROUNDED} FROM mv")
def _(t):
    return segment_view(t)
