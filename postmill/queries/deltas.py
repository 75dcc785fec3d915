"""Snapshot deltas, latest rows and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import deltas
from postmill.queries.registry import query

S = "salary_mid_rub_capped"
SIDES = """prev AS (SELECT DISTINCT vacancy_id::VARCHAR AS id FROM postings WHERE day < DATE '1998-06-01'),
  cur AS (SELECT DISTINCT vacancy_id::VARCHAR AS id FROM postings WHERE day >= DATE '1997-06-01'),
  dl AS (SELECT id, 'new' AS change FROM cur ANTI JOIN prev USING (id) UNION ALL SELECT id, 'removed' FROM prev ANTI JOIN cur USING (id))"""


def delta(t):
    rows = t.postings("vacancy_id", "day")
    previous = rows.where(F.col("day") < "1998-06-01")
    current = rows.where(F.col("day") >= "1997-06-01")
    return deltas.snapshot_delta(previous, current)


@query("snapshot_delta", f"WITH {SIDES} SELECT id, change FROM dl")
def _(t):
    return delta(t)


@query("delta_counts", f"""WITH {SIDES} SELECT count(*) FILTER (WHERE change = 'new') AS new_count,
  count(*) FILTER (WHERE change = 'removed') AS removed_count FROM dl""")
def _(t):
    return deltas.delta_counts(delta(t))


def days(t):
    rows = t.postings("vacancy_id", "ordinal", "quantity", "day")
    return rows.withColumn("id", F.when(F.col("quantity") > 48, " ").otherwise(F.col("vacancy_id").cast("string")))


@query("materialize_latest", """SELECT id, ordinal, strftime(day, '%Y-%m-%d') AS backfill_snapshot_date,
  'raw/date=' || strftime(day, '%Y-%m-%d') || '/snapshot.csv' AS backfill_source_key FROM (SELECT *,
  row_number() OVER (PARTITION BY id ORDER BY day DESC, ordinal) AS rn FROM (SELECT *, vacancy_id::VARCHAR AS id FROM postings WHERE quantity <= 48 AND day <= DATE '2000-01-31'))
  WHERE rn = 1""")
def _(t):
    out = deltas.materialize_latest(days(t), "day", "id", ["ordinal"], F.lit("2000-01-31").cast("date"), min_days=30, prefix="raw/")
    return out.select("id", "ordinal", "backfill_snapshot_date", "backfill_source_key")


@query("materialization_report", """SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (WHERE quantity > 48) AS skipped_missing_id
  FROM postings WHERE day <= DATE '2000-01-31' GROUP BY 1""")
def _(t):
    return deltas.materialization_report(days(t), "day", "id", F.lit("2000-01-31").cast("date"))


def feature_rows(t, since, until):
    rows = t.postings("vacancy_id", "ordinal", "title", "primary_role", "grade_final", "city", "work_mode", "geo_scope", S, "published_at", "day")
    rows = rows.where((F.col("day") >= since) & (F.col("day") < until))
    return rows.select(
        F.col("vacancy_id").cast("double").alias("vacancy_id"), "ordinal", "title", "primary_role", "grade_final", "city", "geo_scope",
        F.col(S).alias("salary_from"), F.replace("title", F.lit(" "), F.lit(", ,")).alias("skills"), "published_at",
        F.concat(F.lit("https://example.org/vacancy/"), "vacancy_id").alias("vacancy_url"), F.when(F.col("vacancy_id") % 100 == 0, F.repeat("title", 1000)).otherwise(F.col("title")).alias("description"), "day")


def served(t, since, until):
    order = [F.desc("day"), F.col("ordinal")]
    return deltas.posting_serving_rows(feature_rows(t, since, until), order, "run-1")


def served_sql(since, until):
    return f"""SELECT vacancy_id::VARCHAR AS hh_vacancy_id, title, primary_role, grade_final AS grade, city, geo_scope, floor({S})::BIGINT AS salary_from,
    replace(title, ' ', '|') AS skills, CASE WHEN vacancy_id % 100 = 0 THEN repeat(title, 1000)[1:5000] ELSE title END AS description_snippet, 'https://example.org/vacancy/' || vacancy_id AS url,
    strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM (SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY day DESC, ordinal) AS rn
    FROM postings WHERE day >= DATE '{since}' AND day < DATE '{until}') WHERE rn = 1"""


@query("posting_serving_rows", f"""SELECT * EXCLUDE (description_snippet), length(description_snippet) AS snippet_length, url AS hh_url, 'run-1' AS dataset_run_id
  FROM ({served_sql('1900-01-01', '2100-01-01')})""")
def _(t):
    out = served(t, "1900-01-01", "2100-01-01").withColumn("snippet_length", F.length("description_snippet"))
    return out.drop("description_snippet", "city_tier", "country", "region", "city_normalized", "salary_to")


_FIELDS = ["title", "primary_role", "grade", "city", "geo_scope", "salary_from", "skills", "published_at"]
RECONCILE = f"""o AS ({served_sql('1900-01-01', '1998-06-01')}), n AS ({served_sql('1997-06-01', '2100-01-01')}),
  r AS (SELECT coalesce(o.hh_vacancy_id, n.hh_vacancy_id) AS hh_vacancy_id, o.hh_vacancy_id IS NULL AS ins, n.hh_vacancy_id IS NULL AS del,
  array_to_string(list_filter([{', '.join(f"CASE WHEN o.{f} IS DISTINCT FROM n.{f} THEN '{f}' END" for f in deltas.COMPARED_FIELDS if f in [*_FIELDS, 'description_snippet'])}],
  lambda x: x IS NOT NULL), '|') AS ch FROM o FULL JOIN n ON o.hh_vacancy_id = n.hh_vacancy_id),
  act AS (SELECT hh_vacancy_id, CASE WHEN ins THEN 'insert' WHEN del THEN 'delete' WHEN ch <> '' THEN 'update' ELSE 'unchanged' END AS action,
  CASE WHEN ins OR del THEN '' ELSE ch END AS changed_fields FROM r)"""


def actions(t):
    return deltas.reconcile(served(t, "1900-01-01", "1998-06-01"), served(t, "1997-06-01", "2100-01-01"))


@query("reconcile", f"WITH {RECONCILE} SELECT * FROM act")
def _(t):
    return actions(t)


@query("reconcile_counts", f"""WITH {RECONCILE} SELECT count(*) FILTER (WHERE action = 'insert') AS inserted, count(*) FILTER (WHERE action = 'update') AS updated,
  count(*) FILTER (WHERE action = 'delete') AS deleted, count(*) FILTER (WHERE action = 'unchanged') AS unchanged,
  count(*) FILTER (WHERE action <> 'delete') AS expected FROM act""")
def _(t):
    return deltas.reconcile_counts(actions(t))


@query("apply_reconciliation", f"""WITH {RECONCILE} SELECT hh_vacancy_id, CASE WHEN action = 'unchanged' THEN '2001-01-01 00:00:00' ELSE '2002-01-01 00:00:00' END AS indexed_at
  FROM act WHERE action <> 'delete'""")
def _(t):
    old = served(t, "1900-01-01", "1998-06-01").withColumn("indexed_at", F.lit("2001-01-01").cast("timestamp"))
    new = served(t, "1997-06-01", "2100-01-01").withColumn("indexed_at", F.lit("2002-01-01").cast("timestamp"))
    return deltas.apply_reconciliation(old, new).select("hh_vacancy_id", "indexed_at")


@query("day_metadata", """WITH d AS (SELECT day, CASE WHEN quantity = 7 THEN NULL WHEN quantity = 8 THEN day - 1 ELSE day END AS p FROM postings),
  a AS (SELECT day, count(*) AS n, count(p) AS k, count(*) FILTER (WHERE p <> day) AS o, min(p) AS f, max(p) AS l FROM d GROUP BY day)
  SELECT strftime(day, '%Y-%m-%d') AS day, n AS row_count, k AS known_published_at_count, o AS out_of_window_count, n - k AS unknown_published_at_count,
  strftime(f, '%Y-%m-%d') AS observed_published_at_from, strftime(l, '%Y-%m-%d') AS observed_published_at_to, round((n - k) / n, 6) AS unknown_date_share,
  round(o / n, 6) AS out_of_window_share, CASE WHEN (n - k) / n > 0.05 OR o > 0 THEN 'failed' ELSE 'passed' END AS status, n >= 25 AS hit_limit FROM a""")
def _(t):
    q = F.col("quantity")
    rows = t.postings("quantity", "day").select("day", F.date_format(
        F.when(q == 8, F.date_sub("day", 1)).when(q != 7, F.col("day")), "yyyy-MM-dd").alias("published_at_iso"))
    return deltas.day_metadata(rows, "day", 25).drop("failures")
