"""Readers, writers, compaction, pages, manifests and the whole refresh."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.operators import deltas
from postmill.plans import publish, refresh
from postmill.queries.cleaning import RAW_COLUMNS, RAW_SQL, as_raw, raw_rows
from postmill.queries.deltas import SIDES, delta
from postmill.queries.registry import query
from postmill.queries.trends import HISTORY_SQL, history
from postmill.session import shared_dir
from postmill.sources import pages, postings

S = "salary_mid_rub_capped"


@query("read_raw_postings", """SELECT doc_id::VARCHAR AS doc_id, text, n_chars AS salary_from, lang = 'en' AS is_remote FROM documents""")
def _(t):
    path = shared_dir(t.spark, "raw-csv")
    rows = t.documents.select("doc_id", "text", F.col("n_chars").alias("salary_from"), F.when(F.col("lang") == "en", "yes").otherwise("0").alias("is_remote"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return postings.read_raw_postings(t.spark, path)


@query("write_processed", """SELECT city_tier, is_remote, salary_gross, count(*) AS n, sum(metro_count)::BIGINT AS metro FROM (SELECT city_tier,
  CASE trim(lower(is_remote)) WHEN 'yes' THEN true WHEN 'no' THEN false END AS is_remote, salary_gross, metro_count FROM (""" + RAW_SQL + ")) GROUP BY ALL")
def _(t):
    path = shared_dir(t.spark, "processed")
    postings.write_processed(raw_rows(t).select("city_tier", "is_remote", "salary_gross", "metro_count"), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("city_tier", "is_remote", "salary_gross").agg(F.count(F.lit(1)).alias("n"), F.sum("metro_count").alias("metro"))


DAILY_SQL = "SELECT vacancy_id::VARCHAR AS vacancy_id, title, strftime(day, '%Y-%m-%d') AS date FROM postings WHERE day IS NOT NULL"


@query("write_daily_snapshot", f"SELECT date, count(*) AS n, count(DISTINCT vacancy_id) AS ids, min(title) AS title FROM ({DAILY_SQL}) GROUP BY date")
def _(t):
    path = shared_dir(t.spark, "daily")
    every = t.postings("vacancy_id", "title", "day").where(F.col("day").isNotNull())
    postings.write_daily_snapshot(every, path, F.col("day"))
    back = t.spark.read.parquet(path).withColumn("date", F.col("date").cast("string"))
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vacancy_id").alias("ids"), F.min("title").alias("title"))


@query("compact_monthly", """SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, count(CASE WHEN day >= DATE '1998-03-01' THEN work_mode END) AS modes,
  sum(quantity)::DOUBLE AS quantity FROM postings WHERE day IS NOT NULL GROUP BY 1""")
def _(t):
    """Two snapshots a month, the 1st and the 15th."""
    source, target = shared_dir(t.spark, "days"), shared_dir(t.spark, "months")
    rows = t.postings("vacancy_id", "work_mode", "quantity", "day").where(F.col("day").isNotNull())
    day = F.concat(F.date_format("day", "yyyy-MM"), F.when(F.dayofmonth("day") < 15, "-01").otherwise("-15")).alias("date")

    def write(df):
        df.repartition("date").write.mode("append").partitionBy("date").parquet(source)

    # schemas change over time: whole quantities, text quantities within the same month, one more column
    write(rows.where("day < DATE '1998-02-15'").select("vacancy_id", F.col("quantity").cast("int").alias("quantity"), day))
    write(rows.where("day >= DATE '1998-02-15' AND day < DATE '1998-03-01'").select("vacancy_id", F.col("quantity").cast("string").alias("quantity"), day))
    write(rows.where("day >= DATE '1998-03-01'").select("vacancy_id", "quantity", "work_mode", day))
    postings.compact_monthly(t.spark, source, target)
    assert postings.compact_monthly(t.spark, source, target) == []  # existing months are skipped
    back = t.spark.read.parquet(target)
    return back.groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count("work_mode").alias("modes"), F.sum(F.col("quantity").cast("double")).alias("quantity"))


@query("union_all_partitions", """SELECT CASE WHEN day < DATE '1998-02-01' THEN '1998-01-31' ELSE '2001-12-31' END AS backfill_snapshot_date,
  'p/date=' || CASE WHEN day < DATE '1998-02-01' THEN '1998-01-31' ELSE '2001-12-31' END || '/snapshot.csv' AS backfill_source_key,
  coalesce(day < DATE '1998-02-01', false) = false AS no_title, coalesce(day < DATE '1998-02-01', false) AS no_quantity, count(*) AS n FROM postings GROUP BY ALL""")
def _(t):
    rows = t.postings("vacancy_id", "title", "quantity", "day")
    early = F.coalesce(F.col("day") < F.lit("1998-02-01").cast("date"), F.lit(False))
    days = [("1998-01-31", early, ["vacancy_id", "title"]), ("2001-12-31", ~early, ["vacancy_id", "quantity"])]
    out = postings.union_all_partitions([
        (d, f"p/date={d}/snapshot.csv", rows.where(inside).select(*names)) for d, inside, names in days])
    return out.groupBy("backfill_snapshot_date", "backfill_source_key", F.col("title").isNull().alias("no_title"),
                       F.col("quantity").isNull().alias("no_quantity")).agg(F.count(F.lit(1)).alias("n"))


@query("flatten_api_items", """SELECT o_orderkey::VARCHAR AS vacancy_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey::DOUBLE END AS salary_from,
  CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 2::DOUBLE END AS salary_to, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN o_custkey * 1.5::DOUBLE
  WHEN o_orderkey % 3 <> 0 THEN o_custkey::DOUBLE WHEN o_orderkey % 2 = 0 THEN o_custkey * 2::DOUBLE END AS salary_mid,
  CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN o_custkey END AS salary_range_width, (o_orderkey % 3 <> 0) <> (o_orderkey % 2 = 0) AS salary_is_exact,
  o_orderstatus = 'F' AS is_remote, CASE WHEN o_orderstatus = 'F' THEN 'remote' ELSE '' END AS schedule, strftime(o_orderdate, '%Y-%m-%d') AS published_at_iso,
  o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 AS salary_disclosed, false AS has_python, 'n' || o_custkey AS company FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    items = t.orders.select(F.struct(
        k.cast("string").alias("id"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
        F.struct(F.when(k % 3 != 0, F.col("o_custkey").cast("double")).alias("from"), F.when(k % 2 == 0, F.col("o_custkey") * 2.0).alias("to")).alias("salary"),
        F.struct(F.concat(F.lit("n"), "o_custkey").alias("name")).alias("employer"),
        F.when(F.col("o_orderstatus") == "F", F.struct(F.lit("remote").alias("id"))).alias("schedule")).alias("item"))
    path = shared_dir(t.spark, "items")
    items.select(F.to_json("item").alias("value")).write.text(path)
    out = postings.flatten_api_items(postings.read_api_items(t.spark, path), 113, "all_vacancies")
    return out.select("vacancy_id", "salary_from", "salary_to", "salary_mid", "salary_range_width", "salary_is_exact", "is_remote", "schedule",
                      "published_at_iso", "salary_disclosed", "has_python", "company")


@query("load_snapshot_history", f"SELECT week_start, role, sum(vacancy_count)::BIGINT AS n FROM ({HISTORY_SQL}) GROUP BY ALL")
def _(t):
    path = shared_dir(t.spark, "weeks")
    postings.write_weekly_snapshot(history(t), path)
    return postings.load_snapshot_history(t.spark, path).groupBy("week_start", "role").agg(F.sum("vacancy_count").alias("n"))


PAGE_MARKS = {"title": ("h1", None)}


@query("extract_page_fields")
def _(t):
    out = pages.extract_page_fields(
        t.pages, F.lit("2024-02-15").cast("timestamp"), PAGE_MARKS, ("article", None), carry=["page_id"], area_id=113)
    return out.select("page_id", "title", "description_len_chars", "description_len_words", "description_paragraphs_count", "grade", "tech_stack_size")


@query("page_blocks", r"""SELECT page_id, regexp_extract(replace(replace(html, '<h1>', '<ARTICLE class="x"><h1>'), '</h1>', '</h1></article >'),
  '(?is)<article\b[^>]*>(.*)</article\s*>', 1) AS block FROM pages""")
def _(t):
    """Blocks that hold a block of their own tag."""
    nested = F.replace(F.replace(F.col("html"), F.lit("<h1>"), F.lit('<ARTICLE class="x"><h1>')), F.lit("</h1>"), F.lit("</h1></article >"))
    return t.pages.select("page_id", pages.block_html(nested, "article").alias("block"))


@query("page_titles", r"""SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1),
  '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS title FROM pages""")
def _(t):
    return t.pages.select("page_id", pages.element_text(F.col("html"), "h1").alias("title"))


@query("extract_listing_links", r"""SELECT page_id, position, link FROM (SELECT page_id, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS href, host FROM (SELECT page_id,
  regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref=[''"]([^''"]+)[''"]', 1) AS l, regexp_extract(url, '^(https?://[^/]+)', 1) AS host FROM pages)),
  LATERAL (SELECT string_split(replace(CASE WHEN starts_with(href, '/') THEN host || href ELSE href END, '&amp;', '&'), '?')[1] AS link)""")
def _(t):
    return pages.extract_listing_links(t.pages, F.regexp_extract("url", "^(https?://[^/]+)", 1), mark=None, carry=["page_id"])


EMPLOYER_HTML = """<html><body><div data-qa="employer-rating-value">{r}</div><a data-qa="employer-reviews-link">{n} отзывов</a>
<p data-qa="employer-type">{t}</p><p>{x}</p></body></html>"""


def employers(t):
    k = F.col("s_suppkey")
    html = F.lit(EMPLOYER_HTML)
    parts = {"{r}": F.concat(k % 7, F.lit(",5")), "{n}": F.concat(k, F.lit(" 204")), "{t}": F.when(k % 2 == 0, "Прямой работодатель").otherwise("Кадровое агентство"),
             "{x}": F.when(k % 3 == 0, "Аккредитованная IT-компания: ДМС").when(k % 3 == 1, "гибкий график, курсы").otherwise("удалёнка")}
    for name, value in parts.items():
        html = F.replace(html, F.lit(name), value)
    return pages.extract_employer_fields(t.supplier.select(F.col("s_name").alias("url"), html.alias("html")))


EMPLOYERS_SQL = """em AS (SELECT s_name AS employer_url, CASE WHEN s_suppkey % 7 < 5 THEN s_suppkey % 7 + 0.5::DOUBLE END AS employer_rating, s_suppkey * 1000 + 204 AS employer_reviews_count,
  CASE WHEN s_suppkey % 3 = 0 THEN true END AS employer_accredited_it, CASE WHEN s_suppkey % 2 = 0 THEN 'direct' ELSE 'agency' END AS employer_type,
  s_suppkey % 3 = 2 AS employer_has_remote, s_suppkey % 3 = 1 AS employer_has_flexible_schedule, s_suppkey % 3 = 0 AS employer_has_med_insurance,
  s_suppkey % 3 = 1 AS employer_has_education FROM supplier)"""


@query("extract_employer_fields", f"WITH {EMPLOYERS_SQL} SELECT * FROM em")
def _(t):
    return employers(t)


@query("attach_employers", f"""WITH {EMPLOYERS_SQL} SELECT company, employer_type, round(any_value(r), 6) AS employer_rating, employer_has_remote, employer_has_education, count(*) AS n FROM (
  SELECT company, e.employer_type, e.employer_rating AS r, coalesce(e.employer_has_remote, false) AS employer_has_remote, coalesce(e.employer_has_education, false) AS employer_has_education
  FROM postings LEFT JOIN em e ON employer_url = CASE WHEN quantity > 5 THEN company END) GROUP BY ALL""")
def _(t):
    rows = t.postings("company", "quantity").withColumn("employer_url", F.when(F.col("quantity") > 5, F.col("company")))
    out = pages.attach_employers(rows, employers(t))
    return out.groupBy("company", "employer_type", "employer_has_remote", "employer_has_education").agg(
        F.count(F.lit(1)).alias("n"), F.first("employer_rating").alias("employer_rating"))


@query("run_manifest", f"""WITH {SIDES} SELECT 'run-1' AS run_id, 'success' AS status, (SELECT count(*) FROM postings) AS row_count, 3 AS column_count,
  'vacancy_id|title|day' AS columns, (SELECT count(*) FROM dl WHERE change = 'new') AS new_count, (SELECT count(*) FROM dl WHERE change = 'removed') AS removed_count,
  'crawl' AS source_kind, NULL::VARCHAR AS error, '1' AS schema_version""")
def _(t):
    path = shared_dir(t.spark, "manifest")
    manifest = publish.run_manifest(t.postings("vacancy_id", "title", "day"), deltas.delta_counts(delta(t)), "run-1", source_kind="crawl")
    publish.append_manifest(manifest, path)
    return t.spark.read.schema(manifest.schema).json(path)


def raw_postings(t):
    """Raw rows, each joined to the title, city and work mode of every posting with its id and ordinal.

    An ordinal holds the key of its order, so postings that are dealt by their order need not be dealt again to meet.
    """
    rows = t.postings(*RAW_COLUMNS, "city", by_order=True).where(F.col("vacancy_id").isNotNull() & F.col("ordinal").isNotNull())
    same = Window.partitionBy("_order", "vacancy_id", "ordinal")
    rows = rows.withColumn("_met", F.collect_list(F.struct("title", "city", "work_mode")).over(same))
    return as_raw(rows, F.explode("_met").alias("_met")).select("*", "_met.*").drop("_met")


@query("refresh_run", f"""SELECT 'latest' AS section, 'run-2' AS name, count(DISTINCT vacancy_id) AS rows FROM postings
  UNION ALL SELECT 'gates', 'passed', 10 FROM (SELECT count(*) FROM postings)""")
def _(t):
    root = shared_dir(t.spark, "runs")
    raw = raw_postings(t).drop("rare_note", "schedule")
    raw = raw.withColumns({"work_format": F.col("work_mode"), "experience": F.lit("1-3"), "primary_role": F.lit("x")}).drop("work_mode", "primary_role")
    done = refresh.refresh(raw, root, "run-2", F.lit("2024-02-15").cast("date"), {"max_unknown_role_share": 1.0}, (F.col("ordinal"),))
    latest = publish.read_latest(t.spark, root, "features").agg(F.count(F.lit(1)).alias("rows"))
    names = latest.select(F.lit("latest").alias("section"), F.lit(publish.latest_run(t.spark, root)).alias("name"), "rows")
    passed = done["gates"].where("passed").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("gates").alias("section"), F.lit("passed").alias("name"), "rows")
    return names.unionByName(passed)
