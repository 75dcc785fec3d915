"""Quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import gates
from postmill.queries.market import VIEW_SQL, segment_view
from postmill.queries.registry import query

S = "salary_mid_rub_capped"
COLUMNS = ["vacancy_id", "title", "primary_role", "grade_final", "city_tier", "work_mode", "domain", S, "published_at"]
UNKNOWN = "('', 'unknown', 'other', 'none', 'nan', 'n/a')"


def unknown(c):
    return f"avg((lower(trim(coalesce({c}, ''))) IN {UNKNOWN})::INT)"


METRICS = f"""m AS (SELECT count(*) AS n, count(*) - count(DISTINCT vacancy_id) AS dup, (count(*) - count(DISTINCT vacancy_id)) / count(*) AS dup_share,
  avg(({S} IS NOT NULL)::INT) AS salaried, {unknown('primary_role')} AS role, {unknown('grade_final')} AS grade,
  {unknown('city_tier')} AS geo, {unknown('work_mode')} AS mode FROM postings)"""


def features(t):
    return t.postings(*COLUMNS)


def gate_rows(entries, source):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS name, {p} AS passed, round_even(({v})::DOUBLE, 6) AS value, {th}::DOUBLE AS threshold FROM {source}"
        for n, p, v, th in entries)


@query("processed_metrics", f"""WITH {METRICS} SELECT n AS features_rows, dup AS duplicate_count, round_even(dup_share, 6) AS duplicate_share,
  round_even(salaried, 6) AS salary_known_share, round_even(role, 6) AS unknown_role_share, round_even(grade, 6) AS unknown_grade_share,
  round_even(geo, 6) AS unknown_geo_share, round_even(mode, 6) AS unknown_work_mode_share, 25 AS market_view_rows FROM m""")
def _(t):
    return gates.processed_metrics(features(t), t.nation)


GATES = [
    ("non_empty_features", "n > 0", "n", 0), ("min_rows", "n >= 100", "n", 100), ("required_columns", "true", "0", 0),
    ("duplicate_share", "dup_share <= 0", "dup_share", 0), ("salary_known_share", "salaried >= 0.01", "salaried", 0.01),
    ("unknown_role_share", "role <= 0.8", "role", 0.8), ("unknown_grade_share", "grade <= 0.95", "grade", 0.95),
    ("unknown_geo_share", "geo <= 0.95", "geo", 0.95), ("unknown_work_mode_share", "mode <= 0.95", "mode", 0.95),
    ("min_market_view_rows", "v >= 1", "v", 1),
]


@query("processed_gates", f"WITH {METRICS}, {VIEW_SQL}, x AS (SELECT m.*, (SELECT count(*) FROM mv) AS v FROM m) {gate_rows(GATES, 'x')}")
def _(t):
    return gates.processed_gates(features(t), segment_view(t))


@query("gate_status", """SELECT 'failed' AS status, CASE WHEN (SELECT count(*) = count(DISTINCT vacancy_id) FROM postings) THEN 'min_rows'
  ELSE 'duplicate_share|min_rows' END AS failed_gates""")
def _(t):
    return gates.gate_status(gates.processed_gates(features(t), t.nation, {"min_rows": 10**12}))


SEGMENTS = " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS dimension, coalesce({c}, 'unknown') AS value, count(*) AS row_count,
    avg(({S} IS NOT NULL)::INT) AS share FROM p GROUP BY 3""" for i, c in enumerate(gates.SEGMENT_COLUMNS))
SEGMENT_SQL = f"""p AS (SELECT * REPLACE (CASE WHEN quantity > 49 THEN 'other' ELSE primary_role END AS primary_role) FROM postings), s AS (
  SELECT *, row_count >= {{n}} AND share >= 0.05 AND lower(value) NOT IN {UNKNOWN} AS passed FROM ({SEGMENTS}))"""


def segmented(t, **limits):
    rows = t.postings(*COLUMNS, "quantity").withColumn(
        "primary_role", F.when(F.col("quantity") > 49, "other").otherwise(F.col("primary_role")))
    return gates.segment_quality(rows, limits)


@query("segment_quality", f"""WITH {SEGMENT_SQL.replace('{n}', '20')} SELECT position, dimension, value, row_count, round_even(share, 6) AS salary_known_share,
  passed, CASE WHEN passed THEN 'usable' ELSE 'low' END AS confidence FROM s""")
def _(t):
    return segmented(t)


@query("low_segments", f"""WITH {SEGMENT_SQL.replace('{n}', '13000')} SELECT dimension, value, row_count, round_even(share, 6) AS salary_known_share,
  passed, 'low' AS confidence FROM s WHERE NOT passed ORDER BY position, value LIMIT 50""")
def _(t):
    return gates.low_segments(segmented(t, min_segment_rows=13000))


@query("observed_periods", "SELECT count(DISTINCT date_trunc('week', published_at)) AS complete_periods FROM postings")
def _(t):
    return gates.observed_periods(features(t))


@query("publication_range", """SELECT strftime(min(published_at), '%Y-%m-%d') AS observed_published_at_from,
  strftime(max(published_at), '%Y-%m-%d') AS observed_published_at_to FROM postings""")
def _(t):
    return gates.publication_range(features(t))


_TREND = [
    ("processed_quality_passed", "dup_share <= 0", "NULL", "NULL"), ("historical_publication_facts", "true", "NULL", "NULL"),
    ("date_semantics_passed", "false", "NULL", "NULL"), ("source_capability_supported", "true", "NULL", "NULL"),
    ("min_complete_periods", "weeks >= 8", "weeks", 8), ("duplicate_share", "dup_share <= 0", "dup_share", 0),
    ("salary_known_share", "salaried >= 0.1", "salaried", 0.1), ("segment_coverage", "low = 0", "low", 0),
]


@query("trend_gate", f"""WITH {METRICS}, {SEGMENT_SQL.replace('{n}', '20').replace("CASE WHEN quantity > 49 THEN 'other' ELSE primary_role END", 'primary_role')},
  x AS (SELECT m.*, (SELECT count(DISTINCT date_trunc('week', published_at)) FROM postings) AS weeks,
  (SELECT count(*) FROM s WHERE NOT passed) AS low FROM m) {gate_rows(_TREND, 'x')}""")
def _(t):
    lineage = t.region.agg(
        F.lit("historical_publication_facts").alias("dataset_semantic_type"), F.lit("failed").alias("date_semantics_status"),
        (F.count(F.lit(1)) > 0).alias("source_supported"))
    return gates.trend_gate(features(t), t.nation, lineage)


@query("product_eligibility", f"""WITH {METRICS} SELECT unnest(['search', 'salary', 'trends', 'recommendations']) AS product,
  unnest([dup_share <= 0, dup_share <= 0 AND salaried >= 0.1, false, dup_share <= 0 AND role <= 0.5 AND grade <= 0.5]) AS eligible,
  unnest([CASE WHEN dup_share <= 0 THEN 'processed quality gates passed' ELSE 'processed quality gates failed' END,
  CASE WHEN salaried >= 0.1 THEN 'salary coverage is usable' ELSE 'salary coverage is too low' END, 'trend-ready gates not passed',
  CASE WHEN role <= 0.5 AND grade <= 0.5 THEN 'role and grade coverage are usable' ELSE 'role or grade coverage is too weak' END]) AS reason FROM m""")
def _(t):
    rows = features(t)
    quality = gates.gate_status(gates.processed_gates(rows, t.nation))
    trend = t.region.agg((F.count(F.lit(1)) < 0).alias("ok")).select(F.when(F.col("ok"), "passed").otherwise("blocked").alias("status"))
    return gates.product_eligibility(gates.processed_metrics(rows, t.nation), quality, trend)


@query("lineage", """SELECT o_orderkey, CASE k WHEN 0 THEN 'minio_backfill_completed' WHEN 1 THEN 'crawl' WHEN 2 THEN 'api' ELSE 'unknown' END AS source_kind,
  CASE WHEN o_orderstatus = 'P' THEN 'stated' WHEN k = 0 AND o_orderpriority < '4' THEN 'historical_publication_facts'
  ELSE 'current_market_snapshot' END AS dataset_semantic_type FROM (SELECT *, o_orderkey % 4 AS k FROM orders)""")
def _(t):
    k = F.col("o_orderkey") % 4
    meta = t.orders.select(
        "o_orderkey", F.when(k == 0, "minio_backfill_completed").otherwise("").alias("source_kind"),
        F.when(k == 1, "crawl").alias("source_mode"), F.when(k == 2, "api").alias("source"),
        F.when(F.col("o_orderstatus") == "P", "stated").alias("dataset_semantic_type"),
        F.when(F.col("o_orderpriority") < "4", "passed").alias("date_semantics_status"))
    return gates.lineage(meta).select("o_orderkey", "source_kind", "dataset_semantic_type")


@query("backfill_semantic_type", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'forensic_quarantined_snapshot'
  WHEN o_orderkey % 3 <> 0 AND o_orderpriority < '4' AND o_orderkey % 2 = 0 THEN 'historical_publication_facts'
  ELSE 'current_market_snapshot' END AS dataset_semantic_type FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    meta = t.orders.select(
        "o_orderkey", (F.col("o_orderstatus") == "P").alias("quarantined"), F.when(k % 3 == 0, "unproven").alias("coverage_claim"),
        F.when(F.col("o_orderpriority") < "4", "passed").otherwise("failed").alias("date_semantics_status"),
        (k % 2 == 0).alias("source_supported"))
    return gates.backfill_semantic_type(meta).select("o_orderkey", "dataset_semantic_type")


DATED = """d AS (SELECT vacancy_id, ordinal, CASE WHEN quantity <> 7 THEN published_at::DATE END AS p FROM postings)"""


def dated(t):
    rows = t.postings("vacancy_id", "ordinal", "published_at", "quantity")
    text = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select("vacancy_id", "ordinal", F.when(F.col("quantity") != 7, text).otherwise("soon").alias("published_at_iso"))


def day(text):
    return F.lit(text).cast("date")


@query("date_semantics", f"""WITH {DATED}, a AS (SELECT count(*) AS row_count, count(p) AS known_published_at_count,
  count(*) FILTER (WHERE p < DATE '1996-01-01' OR p > DATE '2001-01-01') AS out_of_window_count, count(*) - count(p) AS unknown_published_at_count,
  strftime(min(p), '%Y-%m-%d') AS observed_published_at_from, strftime(max(p), '%Y-%m-%d') AS observed_published_at_to FROM d)
  SELECT *, round_even(unknown_published_at_count / row_count, 6) AS unknown_date_share, round_even(out_of_window_count / row_count, 6) AS out_of_window_share,
  CASE WHEN out_of_window_count > 0 THEN format('out_of_window_share {{:.6f}} > max_out_of_window_share 0.000000', out_of_window_count / row_count) ELSE '' END AS failures,
  CASE WHEN out_of_window_count > 0 THEN 'failed' ELSE 'passed' END AS status FROM a""")
def _(t):
    return gates.date_semantics(dated(t), day("1996-01-01"), day("2001-01-01"))


@query("out_of_window_examples", f"""WITH {DATED} SELECT d.vacancy_id::VARCHAR AS vacancy_id, strftime(p, '%Y-%m-%d') AS published_on FROM d
  WHERE p < DATE '1996-01-01' OR p > DATE '2001-01-01' ORDER BY d.vacancy_id, ordinal LIMIT 10""")
def _(t):
    return gates.out_of_window_examples(dated(t), day("1996-01-01"), day("2001-01-01"), ["vacancy_id", "ordinal"])


PARTED = """r AS (SELECT CASE WHEN quantity > 48 THEN NULL ELSE vacancy_id END AS id, strftime(day, '%Y-%m') AS part FROM postings)"""


@query("cross_partition_duplicates", f"""WITH {PARTED}, ids AS (SELECT id, count(*) AS n, count(DISTINCT part) AS parts FROM r WHERE id IS NOT NULL GROUP BY id),
  ps AS (SELECT part, lead(part) OVER (ORDER BY part) AS nxt FROM (SELECT DISTINCT part FROM r)), pr AS (SELECT DISTINCT id, part FROM r WHERE id IS NOT NULL)
  SELECT 'summary' AS section, unnest(['raw_rows', 'missing_id_rows', 'unique_ids', 'repeated_id_count', 'duplicate_rows']) AS name,
  unnest([a, b, c, d, a - b - c]) AS value FROM (SELECT (SELECT count(*) FROM r) AS a, (SELECT count(*) FROM r WHERE id IS NULL) AS b,
  (SELECT count(*) FROM ids) AS c, (SELECT count(*) FROM ids WHERE n > 1) AS d)
  UNION ALL SELECT 'partitions_per_id', parts::VARCHAR, count(*) FROM ids GROUP BY parts
  UNION ALL SELECT 'partition_rows', part, count(*) FROM r GROUP BY part
  UNION ALL SELECT 'partition_ids', part, count(DISTINCT id) FROM r GROUP BY part
  UNION ALL SELECT 'adjacent_overlap', part || '..' || nxt, (SELECT count(*) FROM pr a JOIN pr b USING (id) WHERE a.part = ps.part AND b.part = ps.nxt)
  FROM ps WHERE nxt IS NOT NULL""")
def _(t):
    rows = t.postings("vacancy_id", "quantity", "day").select(
        F.when(F.col("quantity") > 48, " ").otherwise(F.col("vacancy_id").cast("string")).alias("vacancy_id"),
        F.date_format("day", "yyyy-MM").alias("part"))
    return gates.cross_partition_duplicates(rows, "part")


CONFLICT = """c AS (SELECT CASE WHEN quantity > 10 THEN 'source:hh:' || vacancy_id ELSE 'url:' || sha256('u' || vacancy_id) END AS k, ordinal,
  CASE WHEN quantity % 5 <> 0 THEN strftime(scraped_at, '%Y-%m') END AS p FROM postings),
  f AS (SELECT *, first_value(p) OVER (PARTITION BY k ORDER BY ordinal) AS fp FROM c)"""


def conflicting(t):
    q = F.col("quantity")
    return t.postings("vacancy_id", "ordinal", "quantity", "scraped_at").select(
        "ordinal", F.when(q > 10, F.col("vacancy_id").cast("string")).otherwise("").alias("source_vacancy_id"),
        F.concat(F.lit("u"), "vacancy_id").alias("url"),
        F.when(q % 5 != 0, F.date_format("scraped_at", "yyyy-MM")).otherwise("").alias("published_at_iso"))


@query("duplicate_conflicts", f"""WITH {CONFLICT} SELECT count(*) AS total_rows, count(DISTINCT k) AS unique_keys,
  count(*) FILTER (WHERE p <> fp) AS conflict_count, count(*) - count(DISTINCT k) AS duplicate_count,
  round_even((count(*) - count(DISTINCT k)) / count(*), 6) AS duplicate_share FROM f""")
def _(t):
    return gates.duplicate_conflicts(conflicting(t), "ordinal")


@query("conflict_examples", f"""WITH {CONFLICT}, g AS (SELECT k, fp, p, count(*) AS n, min(ordinal) AS o FROM f WHERE p <> fp GROUP BY ALL)
  SELECT k AS canonical_key, fp AS first_published_at, p AS conflicting_published_at, n AS rows FROM g ORDER BY o, k LIMIT 100""")
def _(t):
    return gates.conflict_examples(conflicting(t), "ordinal")


RAW = """raw AS (SELECT CASE WHEN quantity > 48 THEN ' ' ELSE vacancy_id::VARCHAR END AS vacancy_id, CASE WHEN quantity % 9 = 0 THEN '' ELSE title END AS title,
  CASE WHEN quantity < 10 THEN 'http://x' END AS url, CASE WHEN quantity % 2 = 0 THEN 'http://y' END AS vacancy_url,
  strftime(published_at, '%Y-%m-%d') AS published_at_iso FROM postings)"""


def raw(t):
    q = F.col("quantity")
    return t.postings("vacancy_id", "title", "quantity", "published_at").select(
        F.when(q > 48, " ").otherwise(F.col("vacancy_id").cast("string")).alias("vacancy_id"),
        F.when(q % 9 == 0, "").otherwise(F.col("title")).alias("title"), F.when(q < 10, "http://x").alias("url"),
        F.when(q % 2 == 0, "http://y").alias("vacancy_url"), F.date_format("published_at", "yyyy-MM-dd").alias("published_at_iso"))


RAW_STATS = f"""{RAW}, q AS (SELECT count(*) AS row_count, count(*) FILTER (WHERE vacancy_id <> ' ') - count(DISTINCT CASE WHEN vacancy_id <> ' ' THEN vacancy_id END) AS dup,
  round_even(avg((title <> '')::INT), 6) AS tc, round_even(avg((vacancy_id <> ' ')::INT), 6) AS ic, round_even(avg((url IS NOT NULL)::INT), 6) AS uc,
  round_even(avg((vacancy_url IS NOT NULL)::INT), 6) AS vc, round_even(avg((published_at_iso IS NOT NULL)::INT), 6) AS pc FROM raw)"""


@query("raw_quality", f"""WITH {RAW_STATS} SELECT row_count, dup AS duplicate_count, round_even(dup / row_count, 6) AS duplicate_share,
  tc AS title_completeness, ic AS vacancy_id_completeness, uc AS url_completeness, vc AS vacancy_url_completeness, pc AS published_at_iso_completeness,
  tc AS title_group_completeness, ic AS id_group_completeness, greatest(uc, vc) AS url_group_completeness, pc AS published_at_group_completeness FROM q""")
def _(t):
    return gates.raw_quality(raw(t))


STATUSES = ["accepted", "accepted_empty", "planned", "split", "failed", "accepted", "blocked_empty"]
SHARDS = """sh AS (SELECT *, (['accepted', 'accepted_empty', 'planned', 'split', 'failed', 'accepted', 'blocked_empty'])[o_orderkey % 7 + 1] AS st,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey * 2 END AS found, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 20 END AS pages,
  CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_custkey % 50 END AS rows, o_orderkey % 20 = 0 AS ee FROM orders)"""


def shards(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        k.cast("string").alias("shard_id"),
        F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (k % 7 + 1).cast("int")).alias("status"),
        F.when(k % 11 != 0, c * 2).alias("found"), F.when(k % 13 != 0, c % 20).alias("pages"),
        F.when(k % 10 == 0, 0).otherwise(c % 50).alias("collected_rows"), (k % 20 == 0).alias("expected_empty"),
        F.when(k % 17 != 0, F.create_map(F.lit("200"), F.lit(1))).alias("status_code_summary"),
        F.when(k % 19 != 0, F.array(F.lit("key"))).alias("output_keys"), F.when(k % 23 != 0, "sum").alias("checksum"),
        F.when(k % 2 == 0, "timeout").alias("failure_reason"),
        F.when(k % 29 == 0, F.array(F.lit("HTTP 429"))).when(k % 31 == 0, F.array(F.lit("slow"), F.lit("Captcha shown")))
        .when(k % 37 == 0, F.array(F.lit("slow"))).alias("errors"),
        F.when(k % 10 == 0, 0).otherwise(c % 50).alias("records_collected"))


COLLECT = f"""{SHARDS}, cq AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 OR o_orderkey % 37 = 0) AS err,
  count(*) FILTER (WHERE o_orderkey % 29 = 0 OR o_orderkey % 31 = 0) AS blocked, count(*) FILTER (WHERE rows = 0) AS zero FROM sh)"""


@query("collection_quality", f"""WITH {COLLECT} SELECT n AS shard_count, err AS error_shards, blocked AS blocked_shards, zero AS zero_row_shards,
  n - err AS successful_shards, round_even((n - err) / n, 6) AS success_share, round_even(err / n, 6) AS error_share FROM cq""")
def _(t):
    return gates.collection_quality(shards(t))


@query("raw_gate", f"""WITH {RAW_STATS}, {COLLECT}, ow AS (SELECT avg((published_at_iso < '1996-01-01')::INT) AS o FROM raw)
  SELECT 'failed' AS status, array_to_string(list_filter([format('row_count {{}} < min_rows 1000000000', row_count - 5),
  'dataset_scope must be all_vacancies or salary_disclosed', 'salary_only must be present as boolean',
  CASE WHEN 900 / (row_count - 5 - 10 + 900) > 0.01 THEN format('removed_share {{:.4f}} > max_removed_share 0.0100', 900 / (row_count - 5 - 10 + 900)) END,
  CASE WHEN round_even(dup / row_count, 6) > 0.2 THEN format('duplicate_share {{:.4f}} > max_duplicate_share 0.2000', round_even(dup / row_count, 6)) END,
  format('csv row_count {{}} != state row_count {{}}', row_count, row_count - 5),
  CASE WHEN tc < 0.95 THEN format('title_completeness {{:.4f}} < min_critical_field_completeness 0.9500', tc) END,
  CASE WHEN ic < 0.95 THEN format('id_completeness {{:.4f}} < min_critical_field_completeness 0.9500', ic) END,
  CASE WHEN greatest(uc, vc) < 0.95 THEN format('url_completeness {{:.4f}} < min_critical_field_completeness 0.9500', greatest(uc, vc)) END,
  format('date semantics failed: out_of_window_share {{:.6f}} > max_out_of_window_share 0.000000', o), 'collection report status failed',
  CASE WHEN blocked > 0 THEN 'collection report contains blocked shards' END, format('zero_row_shards {{}} > max_zero_row_shards 0', zero),
  format('collection_error_share {{:.4f}} > max_collection_error_share 0.0000', round_even(err / n, 6)),
  format('collection_success_share {{:.4f}} < min_collection_success_share 1.0000', round_even((n - err) / n, 6))], lambda x: x IS NOT NULL), '|') AS failures,
  round_even(900 / (row_count - 5 - 10 + 900), 6) AS removed_share, row_count - 5 - 10 + 900 AS previous_row_count, round_even(dup / row_count, 6) AS duplicate_share
  FROM q, cq, ow""")
def _(t):
    rows = raw(t)
    state = rows.agg(
        (F.count(F.lit(1)) - 5).alias("row_count"), F.lit(10).cast("long").alias("new_count"), F.lit(900).cast("long").alias("removed_count"),
        F.lit("some").alias("dataset_scope"), F.lit(None).cast("boolean").alias("salary_only"), F.lit("failed").alias("collection_status"))
    return gates.raw_gate(state, rows, shards(t), first=day("1996-01-01"), last=day("2010-01-01"), min_rows=10**9, max_removed_share=0.01)


_FAIL = """list_filter([
  CASE WHEN st IN ('failed', 'blocked_empty') THEN 'blocking status ' || st || ': ' || CASE WHEN o_orderkey % 2 = 0 THEN 'timeout' ELSE 'no reason' END END,
  CASE WHEN found >= 1800 AND st <> 'split' THEN 'found ' || found || ' reaches result-depth cap' END,
  CASE WHEN pages >= 18 AND st <> 'split' THEN 'pages ' || pages || ' reaches result-depth cap' END,
  CASE WHEN acc AND found IS NULL THEN 'accepted shard has no found metadata' END,
  CASE WHEN acc AND pages IS NULL THEN 'accepted shard has no page metadata' END,
  CASE WHEN acc AND o_orderkey % 17 = 0 THEN 'accepted shard has no status_code_summary' END,
  CASE WHEN st = 'accepted' AND rows <= 0 THEN 'accepted shard has no rows' END,
  CASE WHEN st = 'accepted' AND o_orderkey % 19 = 0 THEN 'accepted shard has no output_keys' END,
  CASE WHEN st = 'accepted' AND o_orderkey % 23 = 0 THEN 'accepted shard has no checksum' END,
  CASE WHEN acc AND rows = 0 AND NOT ee THEN 'zero-row shard lacks expected_empty evidence' END], lambda x: x IS NOT NULL)"""
SHARD_FAIL = f"""{SHARDS}, fl AS (SELECT o_orderkey::VARCHAR AS shard_id, unnest({_FAIL}) AS failure FROM (SELECT *, st IN ('accepted', 'accepted_empty') AS acc FROM sh)),
  sc AS (SELECT count(*) AS shard_count, count(*) FILTER (WHERE st IN ('accepted', 'accepted_empty')) AS accepted_shards,
  count(*) FILTER (WHERE st IN ('failed', 'blocked_empty')) AS blocking_shards,
  count(*) FILTER (WHERE found >= 1800 AND st <> 'split') + count(*) FILTER (WHERE pages >= 18 AND st <> 'split') AS over_cap_shards,
  count(*) FILTER (WHERE rows = 0 AND NOT ee AND st <> 'split') AS unexplained_empty_shards, sum(rows)::BIGINT AS row_count,
  (SELECT count(*) FROM fl) AS shard_failures FROM sh)"""


@query("shard_failures", f"WITH {SHARD_FAIL} SELECT shard_id, failure FROM fl")
def _(t):
    return gates.shard_failures(shards(t))


@query("shard_completeness", f"WITH {SHARD_FAIL} SELECT *, 'failed' AS status FROM sc")
def _(t):
    return gates.shard_completeness(shards(t))


@query("shard_status_counts", f"WITH {SHARDS} SELECT st AS status, count(*) AS shards, sum(rows)::BIGINT AS collected_rows FROM sh GROUP BY st")
def _(t):
    return gates.shard_status_counts(shards(t))


@query("candidate_gate", f"""WITH {SHARD_FAIL}, {CONFLICT}, dc AS (SELECT count(*) - count(DISTINCT k) AS d, count(*) AS n, count(*) FILTER (WHERE p <> fp) AS c FROM f)
  SELECT 'blocked' AS status, 'source_capability_ref: not supported|job status is blocked: no reason|complete archive claim requires closed_archived_coverage=included|'
  || 'shard failures: ' || shard_failures || '|duplicate conflicts detected: ' || c || CASE WHEN d / n > 0.05 THEN
  format('|duplicate_share {{:.6f}} > max_duplicate_share 0.050000', round_even(d / n, 6)) ELSE '' END AS failures, '' AS warnings, shard_count, accepted_shards, row_count,
  d AS duplicate_count, c AS conflict_count FROM sc, dc""")
def _(t):
    job = t.region.agg(
        F.lit("blocked").alias("status"), F.lit(None).cast("string").alias("status_reason"), F.lit("complete_hh_archive").alias("coverage_claim"),
        F.lit("excluded").alias("closed_archived_coverage"), (F.count(F.lit(1)) < 0).alias("source_supported"))
    return gates.candidate_gate(job, shards(t), conflicting(t), "ordinal")


@query("backfill_progress", f"""WITH {SHARDS} SELECT o_orderpriority AS job, count(*) AS shard_count, count(*) FILTER (WHERE st IN ('accepted', 'accepted_empty')) AS accepted_shards,
  count(*) FILTER (WHERE st = 'planned') AS planned_shards, count(*) FILTER (WHERE st IN ('failed', 'blocked_empty')) AS blocking_shards,
  sum(rows)::BIGINT AS collected_rows FROM sh GROUP BY 1""")
def _(t):
    rows = shards(t).join(t.orders.select(F.col("o_orderkey").cast("string").alias("shard_id"), F.col("o_orderpriority").alias("job")), "shard_id")
    return gates.backfill_progress(rows, ["job"])


@query("completeness_status", """SELECT s_suppkey, CASE WHEN n % 3 = 0 THEN 'incomplete' WHEN n % 5 = 0 THEN 'not_configured'
  WHEN n % 2 = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def _(t):
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    status = gates.completeness_status(n, F.when(n % 3 != 0, n), F.when(n % 5 != 0, F.when(n % 2 == 0, n).otherwise(n + 1)))
    return g.select("s_suppkey", status.alias("status"))
