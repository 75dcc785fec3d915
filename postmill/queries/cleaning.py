"""Cleaning, profiling and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.fixed_values import UNKNOWN_MARKERS
from postmill.operators import cleaning
from postmill.queries.market import VIEW_SQL, segment_view
from postmill.queries.registry import query

MARKERS = ", ".join(f"'{m}'" for m in UNKNOWN_MARKERS)

# a raw-looking posting: markers in text, flags as text, gaps in counters
RAW_SQL = """SELECT vacancy_id, ordinal,
  CASE WHEN city_tier = 'KZ/Other' THEN ' Unknown ' WHEN city_tier = 'SPb' THEN 'N/A' ELSE city_tier END AS city_tier,
  CASE WHEN quantity < 48 THEN CASE WHEN quantity < 20 THEN '-' END ELSE title END AS rare_note,
  CASE WHEN quantity > 49 THEN work_mode END AS schedule,
  CASE WHEN is_remote THEN ' Yes' WHEN domain = 'building' THEN 'unknown' ELSE 'no' END AS is_remote,
  CASE WHEN is_junior_friendly THEN 'TRUE' WHEN quantity > 45 THEN 'maybe' ELSE '0' END AS salary_gross,
  CASE WHEN domain = 'building' THEN '1' WHEN domain = 'furniture' THEN 'n/a' ELSE '0' END AS accepts_handicapped,
  CASE WHEN quantity % 2 = 0 THEN tech_stack_size END AS metro_count,
  salary_mid_rub_capped AS salary_mid, currency, published_at AS published_at_iso, scraped_at AS scraped_at_utc
  FROM postings"""


RAW_COLUMNS = [
    "vacancy_id", "ordinal", "city_tier", "title", "quantity", "work_mode", "is_remote", "domain",
    "is_junior_friendly", "tech_stack_size", "salary_mid_rub_capped", "currency", "published_at", "scraped_at",
]


def raw_rows(t):
    return as_raw(t.postings(*RAW_COLUMNS))


def as_raw(rows, *kept):
    """Rows with RAW_COLUMNS made to look raw; ``kept`` come along."""
    q = F.col("quantity")
    return rows.select(
        "vacancy_id", "ordinal",
        F.when(F.col("city_tier") == "KZ/Other", " Unknown ").when(F.col("city_tier") == "SPb", "N/A")
        .otherwise(F.col("city_tier")).alias("city_tier"),
        F.when(q < 48, F.when(q < 20, "-")).otherwise(F.col("title")).alias("rare_note"),
        F.when(q > 49, F.col("work_mode")).alias("schedule"),
        F.when(F.col("is_remote"), " Yes").when(F.col("domain") == "building", "unknown").otherwise("no")
        .alias("is_remote"),
        F.when(F.col("is_junior_friendly"), "TRUE").when(q > 45, "maybe").otherwise("0").alias("salary_gross"),
        F.when(F.col("domain") == "building", "1").when(F.col("domain") == "furniture", "n/a").otherwise("0")
        .alias("accepts_handicapped"),
        F.when(q % 2 == 0, F.col("tech_stack_size")).alias("metro_count"),
        F.col("salary_mid_rub_capped").alias("salary_mid"), "currency",
        F.col("published_at").alias("published_at_iso"), F.col("scraped_at").alias("scraped_at_utc"), *kept,
    )


def raw(sql: str) -> str:
    return f"WITH raw AS ({RAW_SQL}) {sql}"


def per_value(column: str, expression: str) -> str:
    return raw(f"SELECT {expression} AS {column}, count(*) AS n FROM raw GROUP BY 1")


def counted(df, column):
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


@query("standardize_unknown_markers",
       per_value("city_tier", f"CASE WHEN NOT coalesce(trim(lower(city_tier)) IN ({MARKERS}), false) THEN city_tier END"))
def _(t):
    return counted(cleaning.standardize_unknown_markers(raw_rows(t)), "city_tier")


_TEXT = ["ordinal", "city_tier", "rare_note", "schedule", "is_remote", "salary_gross", "accepts_handicapped", "currency"]


@query("marker_counts", raw("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE trim(lower({c})) IN ({MARKERS})) AS rows FROM raw" for c in _TEXT
) + ") WHERE rows > 0"))
def _(t):
    return cleaning.marker_counts(raw_rows(t))


_ALL = {
    "vacancy_id": "bigint", "ordinal": "string", "city_tier": "string", "rare_note": "string", "schedule": "string",
    "is_remote": "string", "salary_gross": "string", "accepts_handicapped": "string", "metro_count": "int",
    "salary_mid": "double", "currency": "string", "published_at_iso": "timestamp", "scraped_at_utc": "timestamp",
}
_HEALTH = "WITH raw AS (" + RAW_SQL + "), h AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, '{k}' AS dtype, avg(({c} IS NULL)::INT) AS a, "
    + (f"avg(coalesce(trim(lower({c})) IN ({MARKERS}), false)::INT)" if k == "string" else "0.0::DOUBLE")
    + " AS b FROM raw" for c, k in _ALL.items()
) + "), e AS (SELECT *, least(a + b, 1.0) AS miss, greatest(1 - least(a + b, 1.0), 0.0) AS cov FROM h) "


@query("data_health", _HEALTH + """SELECT 'raw_' || col AS "column", dtype, round(a, 6) AS share_nan,
  round(b, 6) AS share_unknown_marker, round(miss, 6) AS effective_missing_share, round(cov, 6) AS coverage_share,
  CASE WHEN cov >= 0.85 THEN 'high' WHEN cov >= 0.6 THEN 'medium' WHEN cov >= 0.3 THEN 'low' ELSE 'critical' END
    AS quality_bucket,
  CASE WHEN cov >= 0.85 THEN 'ok_for_conclusions' WHEN cov >= 0.6 THEN 'ok_with_disclaimer'
    WHEN cov >= 0.3 THEN 'only_hypothesis' ELSE 'ignore' END AS recommended_use FROM e""")
def _(t):
    return cleaning.data_health(raw_rows(t), prefix="raw_").drop("comment")


@query("low_information_columns", _HEALTH + """SELECT col AS "column", dtype, round(a, 6) AS na_share,
  round(b, 6) AS unknown_share, round(miss, 6) AS effective_missing_share FROM e WHERE miss >= 0.9""")
def _(t):
    return cleaning.low_information_columns(raw_rows(t), 0.9)


@query("drop_low_information", _HEALTH + """SELECT col AS "column", col NOT IN (
  SELECT col FROM e WHERE miss >= 0.9 AND col NOT IN ('schedule', 'salary_mid', 'currency')) AS kept FROM e""")
def _(t):
    df = raw_rows(t)
    kept, _, _ = cleaning.drop_low_information(df, 0.9)
    return cleaning.data_health(df).select("column", F.col("column").isin(*kept.columns).alias("kept"))


@query("drop_mostly_missing", _HEALTH + """SELECT col AS "column", a < 0.95 AS kept FROM e""")
def _(t):
    df = raw_rows(t)
    kept, _ = cleaning.drop_mostly_missing(df, 0.95)
    return cleaning.data_health(df).select("column", F.col("column").isin(*kept.columns).alias("kept"))


def _bool_sql(c):
    return f"CASE WHEN trim(lower({c})) IN ('true', '1', 'yes') THEN true WHEN trim(lower({c})) IN ('false', '0', 'no') THEN false END"


_BOOLS = ["is_remote", "salary_gross", "accepts_handicapped"]


@query("coerce_boolean_columns", raw(
    "SELECT " + ", ".join(f"{_bool_sql(c)} AS {c}" for c in _BOOLS) + ", count(*) AS n FROM raw GROUP BY ALL"))
def _(t):
    df, _ = cleaning.coerce_boolean_columns(raw_rows(t))
    return df.groupBy(*_BOOLS).agg(F.count(F.lit(1)).alias("n"))


@query("ensure_salary_gross_boolean", per_value("salary_gross", _bool_sql("salary_gross")))
def _(t):
    return counted(cleaning.ensure_salary_gross_boolean(raw_rows(t)), "salary_gross")


@query("fill_categorical", per_value("schedule", "coalesce(schedule, 'unknown')"))
def _(t):
    return counted(cleaning.fill_categorical(raw_rows(t)), "schedule")


@query("fill_counters", per_value("metro_count", "coalesce(metro_count, 0)"))
def _(t):
    return counted(cleaning.fill_counters(raw_rows(t)), "metro_count")


@query("handle_missingness", raw(f"""SELECT coalesce(CASE WHEN NOT coalesce(trim(lower(city_tier)) IN ({MARKERS}), false)
  THEN city_tier END, 'unknown') AS city_tier, coalesce(schedule, 'unknown') AS schedule,
  {_bool_sql('is_remote')} AS is_remote, {_bool_sql('salary_gross')} AS salary_gross,
  coalesce(metro_count, 0) AS metro_count, count(*) AS n FROM raw GROUP BY ALL"""))
def _(t):
    df, report = cleaning.handle_missingness(raw_rows(t))
    assert report["dropped"] == ["rare_note"], report
    return df.groupBy("city_tier", "schedule", "is_remote", "salary_gross", "metro_count").agg(F.count(F.lit(1)).alias("n"))


@query("parse_dates", """SELECT CASE WHEN contains(props, '7') THEN s END AS published_at_iso, s AS scraped_at_utc,
  CASE WHEN contains(props, '7') THEN 0 END AS vacancy_age_days, event_id FROM (
  SELECT event_id, props, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events)""")
def _(t):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    df = t.events.select(
        "event_id", F.when(F.col("props").contains("7"), text).otherwise("yesterday").alias("published_at_iso"),
        text.alias("scraped_at_utc"),
    )
    return cleaning.parse_dates(df)


@query("vacancy_age_days", raw("""SELECT date_diff('day', published_at_iso::DATE, scraped_at_utc::DATE) AS vacancy_age_days,
  count(*) AS n FROM raw GROUP BY 1"""))
def _(t):
    return counted(cleaning.parse_dates(raw_rows(t)), "vacancy_age_days")


@query("prepare_salary", raw("""SELECT vacancy_id, ordinal, m AS salary_mid_rub, m IS NOT NULL AS salary_known,
  round(CASE WHEN m IS NOT NULL THEN least(greatest(m, lo), hi) END, 6) AS salary_mid_rub_capped
  FROM (SELECT *, CASE WHEN currency = 'RUB' THEN salary_mid END AS m FROM raw),
  (SELECT quantile_cont(salary_mid, 0.01) AS lo, quantile_cont(salary_mid, 0.99) AS hi FROM raw WHERE currency = 'RUB')"""))
def _(t):
    out = cleaning.prepare_salary(raw_rows(t))
    return out.select("vacancy_id", "ordinal", "salary_mid_rub", "salary_known", "salary_mid_rub_capped")


@query("non_rub_share", raw("""SELECT round(avg((coalesce(currency, '') <> 'RUB')::INT), 6) AS non_rub_share FROM raw"""))
def _(t):
    return cleaning.non_rub_share(raw_rows(t))


@query("deduplicate_latest", """SELECT vacancy_id, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at, ordinal
  FROM (SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY scraped_at DESC NULLS LAST, ordinal) AS rn
  FROM postings) WHERE rn = 1""")
def _(t):
    rows = t.postings("vacancy_id", "scraped_at", "ordinal")
    return cleaning.deduplicate_latest(rows, scraped="scraped_at", ties=[F.col("ordinal")])


@query("check_unique_id", """SELECT count(*) = count(DISTINCT vacancy_id) AS is_unique,
  count(*) - count(DISTINCT vacancy_id) AS duplicates FROM postings""")
def _(t):
    return cleaning.check_unique_id(t.postings("vacancy_id"))


@query("missing_share", _HEALTH + """SELECT col AS "column", round(a, 6) AS missing_share FROM e
  ORDER BY a DESC, col LIMIT 5""")
def _(t):
    return cleaning.missing_share(raw_rows(t), 5)


@query("basic_profile", raw("""SELECT (SELECT count(*) FROM raw) AS rows, 13 AS columns_total, dtype, columns FROM (
  VALUES ('bigint', 1), ('string', 8), ('int', 1), ('double', 1), ('timestamp', 2)) v(dtype, columns)"""))
def _(t):
    return cleaning.basic_profile(raw_rows(t))


@query("stage_profile", f"""WITH {VIEW_SQL}, raw AS ({RAW_SQL}) SELECT 'raw' AS stage, count(*) AS rows, 13 AS columns,
  round(avg((salary_mid IS NOT NULL)::INT), 6) AS salary_share,
  round(avg((coalesce(currency, '') = 'RUB')::INT), 6) AS rub_share, NULL::DOUBLE AS remote_share,
  NULL::DOUBLE AS unknown_role_share FROM raw
  UNION ALL SELECT 'market_view', count(*), 22, round(avg((salary_median IS NOT NULL)::INT), 6), NULL,
  round(sum(remote_share * vacancy_count_total) / sum(vacancy_count_total), 6), 0.0 FROM mv""")
def _(t):
    return cleaning.stage_profile({"raw": raw_rows(t).drop("is_remote").withColumn("x", F.lit(1)),
                                   "market_view": segment_view(t)})
