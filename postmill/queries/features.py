"""Posting features and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import features, normalize
from postmill.functions.fixed_values import AREA_DEFAULTS, COUNTRY_WORDS
from postmill.operators import market
from postmill.queries.registry import query
from postmill.sources.bindings import BENEFIT_FLAGS, DOMAIN_FLAGS, SKILL_FLAGS, SOFT_FLAGS

CITY_WORDS = [
    "Москва", "г. Санкт-Петербург", "Kazan", "Алматы", "Минск", "  Новый   Город ", "Астана, KZ", "Омск", "уфа", "Баку",
]
N_CITY = len(CITY_WORDS)
CITY_SQL = "CASE n_nationkey % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CITY_WORDS)) + " END"
AREAS = [1, 40, 159, 113, 7, 246]
AREA_SQL = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(AREAS)) + " END"


def pick(key, values):
    """Column that cycles through ``values`` by a numeric key."""
    chain = F.when(key == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], 1):
        chain = chain.when(key == i, F.lit(v))
    return chain


def customers(t):
    return t.customer.select(
        "c_custkey", pick(F.col("c_nationkey") % 12, CITY_WORDS).alias("city"),
        pick(F.col("c_custkey") % 8, AREAS).alias("search_area_id"),
    )


CUSTOMERS_SQL = f"(SELECT c_custkey, {CITY_SQL.replace('n_nationkey', 'c_nationkey')} AS city, {AREA_SQL} AS area FROM customer)"


@query("time_features", """SELECT vacancy_id, ordinal, isodow(published_at) - 1 AS published_weekday,
  month(published_at) AS published_month, isodow(published_at) > 5 AS is_weekend_post,
  date_diff('day', published_at, scraped_at) AS vacancy_age_days FROM postings""")
def _(t):
    rows = t.postings("vacancy_id", "ordinal", "published_at", "scraped_at")
    return features.add_time_features(rows, "published_at", "scraped_at").drop("published_at", "scraped_at")


TIER_SQL = """CASE WHEN city IS NULL THEN 'unknown' WHEN lower(city) LIKE '%moscow%' OR lower(city) LIKE '%моск%' THEN 'Moscow'
  WHEN lower(city) LIKE '%spb%' OR lower(city) LIKE '%петербург%' OR lower(city) LIKE '%санкт%' THEN 'SPb'
  WHEN lower(city) IN ('kazan', 'омск', 'уфа') THEN 'Million+'
  WHEN regexp_matches(lower(city), 'kazakh|kz|алматы|нур-султан|астана') THEN 'KZ/Other' ELSE 'Other RU' END"""


@query("city_tier", f"SELECT c_custkey, {TIER_SQL} AS city_tier FROM {CUSTOMERS_SQL}")
def _(t):
    return features.add_city_tier(customers(t)).select("c_custkey", "city_tier")


def _area(i):
    return "CASE area " + " ".join(f"WHEN {k} THEN '{v[i]}'" for k, v in AREA_DEFAULTS.items()) + " ELSE 'unknown' END"


_ALIAS = [("москва", "Russia", "Moscow", "Moscow"), ("петербург", "Russia", "Saint Petersburg", "Saint Petersburg"),
          ("kazan", "Russia", "Tatarstan", "Kazan"), ("омск", "Russia", "Omsk Oblast", "Omsk"),
          ("уфа", "Russia", "Bashkortostan", "Ufa"), ("алматы", "Kazakhstan", "Almaty", "Almaty"),
          ("астана", "Kazakhstan", "Astana", "Astana"), ("минск", "Belarus", "Minsk", "Minsk")]


def _geo(i, rest):
    cases = " ".join(f"WHEN contains(lower(city), '{a[0]}') THEN '{a[i]}'" for a in _ALIAS)
    return f"CASE {cases} ELSE {rest} END"


_WORDS = " ".join("WHEN " + " OR ".join(f"contains(lower(city), '{w}')" for w in ws) + f" THEN '{c}'"
                  for c, ws in COUNTRY_WORDS)


@query("geography", f"""SELECT c_custkey, {_geo(1, f"CASE {_WORDS} ELSE {_area(0)} END")} AS country,
  {_geo(2, _area(1))} AS region,
  {_geo(3, f"CASE WHEN {_area(2)} <> 'unknown' OR city IS NULL THEN {_area(2)} ELSE trim(regexp_replace(city, '[ ]+', ' ', 'g')) END")}
  AS city_normalized FROM {CUSTOMERS_SQL}""")
def _(t):
    return features.add_geography(customers(t)).select("c_custkey", "country", "region", "city_normalized")


@query("geo_scope", """SELECT work_mode, is_remote, geo_scope, geo_scope IN ('remote', 'mixed') AS remote_geo_eligible,
  count(*) AS n FROM (SELECT work_mode, is_remote AND quantity > 20 AS is_remote,
  CASE WHEN work_mode = 'remote' THEN 'remote' WHEN work_mode = 'hybrid' THEN 'mixed' ELSE 'local' END AS geo_scope
  FROM postings) GROUP BY ALL""")
def _(t):
    rows = t.postings("work_mode", "is_remote", "quantity").withColumn(
        "is_remote", F.col("is_remote") & (F.col("quantity") > 20))
    return features.add_geography(rows).groupBy("work_mode", "is_remote", "geo_scope", "remote_geo_eligible").agg(
        F.count(F.lit(1)).alias("n"))


@query("work_mode", """SELECT work_format, is_remote, is_hybrid, CASE WHEN work_format IN ('remote', 'hybrid', 'office', 'field') THEN work_format
  WHEN is_remote THEN 'remote' WHEN is_hybrid THEN 'hybrid' ELSE 'unknown' END AS work_mode, count(*) AS n FROM (
  SELECT CASE WHEN quantity < 20 THEN work_mode WHEN quantity < 30 THEN 'shift' END AS work_format,
  CASE WHEN work_mode <> 'remote' THEN is_junior_friendly END AS is_remote, quantity > 40 AS is_hybrid
  FROM postings) GROUP BY ALL""")
def _(t):
    q = F.col("quantity")
    rows = t.postings("work_mode", "quantity", "is_junior_friendly").select(
        F.when(q < 20, F.col("work_mode")).when(q < 30, "shift").alias("work_format"),
        F.when(F.col("work_mode") != "remote", F.col("is_junior_friendly")).alias("is_remote"),
        (q > 40).alias("is_hybrid"),
    )
    return features.add_work_mode(rows).groupBy("work_format", "is_remote", "is_hybrid", "work_mode").agg(
        F.count(F.lit(1)).alias("n"))


@query("experience_flags", """SELECT is_for_juniors, allows_students,
  coalesce(is_for_juniors, false) OR coalesce(allows_students, false) AS is_junior_friendly,
  NOT (coalesce(is_for_juniors, false) OR coalesce(allows_students, false)) AS battle_experience, count(*) AS n
  FROM (SELECT soft_teamwork AS is_for_juniors, soft_leadership AS allows_students FROM postings) GROUP BY ALL""")
def _(t):
    rows = t.postings("soft_teamwork", "soft_leadership").withColumnsRenamed(
        {"soft_teamwork": "is_for_juniors", "soft_leadership": "allows_students"})
    names = ["is_for_juniors", "allows_students", "is_junior_friendly", "battle_experience"]
    return features.add_experience_flags(rows).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def _sum(flags):
    return " + ".join(f"coalesce({c}, false)::INT" for c in flags)


@query("boolean_counts", f"""SELECT vacancy_id, ordinal, {_sum(BENEFIT_FLAGS)} AS benefits_count,
  {_sum(SOFT_FLAGS)} AS soft_skills_count, {_sum([c for c in SKILL_FLAGS if c.startswith('has_')])} AS hard_stack_count,
  {_sum([c for c in SKILL_FLAGS if c.startswith('skill_')])} AS skills_count FROM postings""")
def _(t):
    rows = t.postings("vacancy_id", "ordinal", *BENEFIT_FLAGS, *SOFT_FLAGS, *SKILL_FLAGS)
    return features.add_boolean_counts(rows).select(
        "vacancy_id", "ordinal", "benefits_count", "soft_skills_count", "hard_stack_count", "skills_count")


@query("stack_aggregates", """SELECT core, ml, size, count(*) AS n FROM (SELECT
  skill_ring::INT + has_red::INT AS core, has_old::INT AS ml,
  skill_ring::INT + has_red::INT + has_old::INT + skill_gear::INT AS size FROM postings) GROUP BY ALL""")
def _(t):
    rows = t.postings("skill_ring", "has_red", "has_old", "skill_gear").withColumnsRenamed(
        {"skill_ring": "skill_sql", "has_red": "has_python", "has_old": "has_kafka"})
    out = features.add_stack_aggregates(rows).select(
        F.col("core_data_skills_count").alias("core"), F.col("ml_stack_count").alias("ml"),
        F.col("tech_stack_size").alias("size"))
    return out.groupBy("core", "ml", "size").agg(F.count(F.lit(1)).alias("n"))


EXPERIENCE = ["Не требуется", "от 1–3 лет", "3-6 лет", "более 6 лет", "опыт"]
GRADE_SQL = """CASE WHEN no_exp THEN 'intern' WHEN y < 1 THEN 'intern' WHEN y < 3 THEN 'junior' WHEN y < 5 THEN 'middle'
  WHEN y < 8 THEN 'senior' WHEN y >= 8 THEN 'lead' WHEN experience LIKE 'Не треб%' THEN 'intern'
  WHEN experience LIKE '%1–3%' THEN 'junior' WHEN experience LIKE '%3-6%' THEN 'middle'
  WHEN experience LIKE '%6%' THEN 'senior' ELSE 'unknown' END"""
EXP_SQL = "CASE quantity::INT % 7 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXPERIENCE)) + " END"


@query("grades", f"""SELECT grade_from_experience, CASE WHEN grade <> 'unknown' OR grade IS NULL THEN grade
  ELSE grade_from_experience END AS grade_final, count(*) AS n FROM (SELECT *, {GRADE_SQL} AS grade_from_experience FROM (
  SELECT coalesce(exp_min_years, exp_max_years) AS y, quantity = 50 AS no_exp, {EXP_SQL} AS experience,
  CASE WHEN quantity < 10 THEN grade_final WHEN quantity < 49 THEN 'unknown' END AS grade FROM postings)) GROUP BY ALL""")
def _(t):
    q = F.col("quantity")
    rows = t.postings("exp_min_years", "exp_max_years", "quantity", "grade_final").select(
        "exp_min_years", "exp_max_years", (q == 50).alias("exp_is_no_experience"),
        pick(q.cast("int") % 7, EXPERIENCE).alias("experience"),
        F.when(q < 10, F.col("grade_final")).when(q < 49, "unknown").alias("grade"),
    )
    return features.add_grades(rows).groupBy("grade_from_experience", "grade_final").agg(F.count(F.lit(1)).alias("n"))


TITLES = ["Python Developer", "ML Engineer", "Системный аналитик", "QA lead", "React dev", "Бухгалтер", "Go developer", ""]
TITLE_ROLES = ["backend", "ml", "analyst", "qa", "frontend", "other", "backend", "other"]


@query("primary_role", "SELECT title, primary_role, count(*) AS n FROM (SELECT CASE quantity::INT % 9 " + " ".join(
    f"WHEN {i} THEN '{v}'" for i, v in enumerate(TITLES)) + " END AS title, CASE WHEN domain_machinery THEN 'ml' "
    "WHEN domain_building THEN 'devops' ELSE CASE quantity::INT % 9 " + " ".join(
    f"WHEN {i} THEN '{v}'" for i, v in enumerate(TITLE_ROLES)) + " ELSE 'other' END END AS primary_role FROM postings) GROUP BY ALL")
def _(t):
    rows = t.postings("quantity", "domain_machinery", "domain_building").select(
        pick(F.col("quantity").cast("int") % 9, TITLES).alias("title"), F.col("domain_machinery").alias("role_ml"),
        F.col("domain_building").alias("role_devops"))
    return features.add_primary_role(rows).groupBy("title", "primary_role").agg(F.count(F.lit(1)).alias("n"))


BUCKET_SQL = """CASE WHEN s <= a THEN 'low' WHEN s <= b THEN 'mid' WHEN s IS NOT NULL THEN 'high' END"""


@query("salary_bucket", f"""SELECT vacancy_id, ordinal, {BUCKET_SQL} AS salary_bucket FROM (
  SELECT *, salary_mid_rub_capped AS s FROM postings), (SELECT quantile_cont(salary_mid_rub_capped, 1/3) AS a,
  quantile_cont(salary_mid_rub_capped, 2/3) AS b FROM postings)""")
def _(t):
    rows = t.postings("vacancy_id", "ordinal", "salary_mid_rub_capped")
    return features.add_salary_bucket(rows).select("vacancy_id", "ordinal", "salary_bucket")


@query("text_sizes", r"""SELECT doc_id, length(text) AS description_len_chars,
  len(list_filter(regexp_split_to_array(text, '[\s\x{a0}\x{85}\x{2028}\x{3000}\x{2000}-\x{200a}\x{202f}]+'), lambda w: w <> '')) AS description_len_words
  FROM documents""")
def _(t):
    rows = t.documents.select("doc_id", F.col("text").alias("description"))
    return features.add_text_sizes(rows).drop("description")


@query("ensure_feature_columns", """SELECT country, city_tier, primary_role, tech_stack_size, salary_bucket,
  is_junior_friendly, count(*) AS n FROM (SELECT 'unknown' AS country, city_tier, 'other' AS primary_role,
  0 AS tech_stack_size, NULL::VARCHAR AS salary_bucket, is_junior_friendly FROM postings) GROUP BY ALL""")
def _(t):
    out = features.ensure_feature_columns(t.postings("city_tier", "is_junior_friendly"))
    names = ["country", "city_tier", "primary_role", "tech_stack_size", "salary_bucket", "is_junior_friendly"]
    return out.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def feature_input(t):
    """Clean-looking postings before features."""
    q = F.col("quantity")
    rows = t.postings(
        "vacancy_id", "ordinal", "title", "quantity", "work_mode", "is_remote", "exp_min_years", "exp_max_years",
        "salary_mid_rub_capped", "published_at", "scraped_at", *SKILL_FLAGS, *DOMAIN_FLAGS, *BENEFIT_FLAGS, *SOFT_FLAGS,
    )
    return rows.select(
        "*", pick(q.cast("int") % 12, CITY_WORDS).alias("city"), F.col("published_at").alias("published_at_iso"),
        F.col("scraped_at").alias("scraped_at_utc"), F.col("work_mode").alias("work_format"),
        F.when(q < 10, "senior").otherwise("unknown").alias("grade"), F.col("title").alias("description"),
        F.col("soft_leadership").alias("is_for_juniors"),
    ).drop("work_mode", "quantity", "published_at", "scraped_at")


CITY_Q = "CASE quantity::INT % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CITY_WORDS)) + " END"


@query("assemble_features", f"""SELECT *, {TIER_SQL} AS city_tier FROM (SELECT vacancy_id, ordinal, {CITY_Q} AS city,
  isodow(published_at) - 1 AS published_weekday, date_diff('day', published_at, scraped_at) AS vacancy_age_days,
  work_mode, geo_scope, {_sum(BENEFIT_FLAGS)} AS benefits_count, {_sum(SOFT_FLAGS)} AS soft_skills_count,
  {_sum(SKILL_FLAGS)} AS tech_stack_size, soft_leadership AS is_junior_friendly,
  CASE WHEN quantity < 10 THEN 'senior' ELSE {GRADE_SQL.replace('no_exp', 'false').replace('y <', 'coalesce(exp_min_years, exp_max_years) <').replace('y >=', 'coalesce(exp_min_years, exp_max_years) >=').replace('experience LIKE', "'' LIKE")} END AS grade_final,
  'other' AS primary_role, {BUCKET_SQL.replace('s <=', 'salary_mid_rub_capped <=').replace('s IS', 'salary_mid_rub_capped IS')} AS salary_bucket,
  length(title) AS description_len_chars, 2 AS description_len_words FROM postings,
  (SELECT quantile_cont(salary_mid_rub_capped, 1/3) AS a, quantile_cont(salary_mid_rub_capped, 2/3) AS b FROM postings))""")
def _(t):
    return features.assemble_features(feature_input(t)).select(
        "vacancy_id", "ordinal", "city", "city_tier", "published_weekday", "vacancy_age_days", "work_mode", "geo_scope",
        "benefits_count", "soft_skills_count", "tech_stack_size", "is_junior_friendly", "grade_final", "primary_role",
        "salary_bucket", "description_len_chars", "description_len_words",
    )


# --- C31-C41 ---------------------------------------------------------------

def skill_text():
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    return F.concat(F.lit(" Skill_"), F.initcap(first), F.lit(", "), second, F.lit(", has_"), first, F.lit(", ,"),
                    F.lower("p_type"))


SKILL_TEXT_SQL = """(SELECT p_partkey, ' Skill_' || upper(w[1][1]) || w[1][2:] || ', ' || w[2] || ', has_' || w[1] || ', ,' ||
  lower(p_type) AS s, w, lower(p_type) AS ty FROM (SELECT *, string_split(p_name, ' ') AS w FROM part))"""


@query("clean_skill_array", f"""SELECT p_partkey, w[1] || '|' || w[2] ||
  CASE WHEN ty <> w[1] THEN '|' || ty ELSE '' END AS skills FROM {SKILL_TEXT_SQL}""")
def _(t):
    return t.part.select("p_partkey", normalize.clean_skill_array(F.split(skill_text(), ",")).alias("skills"))


@query("split_known_skills", f"""SELECT p_partkey, array_to_string(list_filter([w[1], w[2], nullif(ty, w[1])], lambda x: x IN
  ('red', 'ring', 'promo')), '|') AS valid, array_to_string(list_filter([w[1], w[2], nullif(ty, w[1])], lambda x: x NOT IN
  ('red', 'ring', 'promo')), '|') AS invalid FROM {SKILL_TEXT_SQL}""")
def _(t):
    known = F.array(*[F.lit(x) for x in ("red", "ring", "promo")])
    valid, invalid = normalize.split_known_skills(F.split(skill_text(), ","), known)
    return t.part.select("p_partkey", valid.alias("valid"), invalid.alias("invalid"))


@query("parse_skill_list", f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(
  ['Skill_' || upper(w[1][1]) || w[1][2:], w[2], w[1], ty], '|') ELSE w[2] || '|' || w[1] END AS skills
  FROM {SKILL_TEXT_SQL}""")
def _(t):
    as_json = F.to_json(F.array(F.split("p_name", " ")[1], F.concat(F.lit("skill_"), F.split("p_name", " ")[0]), F.lit(" ")))
    text = F.when(F.col("p_partkey") % 2 == 0, skill_text()).otherwise(as_json)
    return t.part.select("p_partkey", normalize.parse_skill_list(text).alias("skills"))


@query("primary_domain", """SELECT CASE WHEN soft_communication AND domain_household THEN 'household'
  WHEN domain_building THEN 'building' ELSE 'unknown' END AS domain, count(*) AS n FROM postings GROUP BY 1""")
def _(t):
    rows = t.postings("soft_communication", "domain_household", "domain_building").withColumn(
        "domain_household", F.when(F.col("soft_communication"), F.col("domain_household")))
    return rows.select(market.primary_domain(["domain_household", "domain_building"]).alias("domain")).groupBy(
        "domain").agg(F.count(F.lit(1)).alias("n"))


@query("domain_priorities", " UNION ALL ".join(
    f"SELECT '{c}' AS domain, sum({c}::INT)::BIGINT AS count FROM postings" for c in DOMAIN_FLAGS))
def _(t):
    return market.domain_priorities(t.postings(*DOMAIN_FLAGS))


@query("normalize_english_level", """SELECT lang_english_level, required, CASE WHEN NOT required THEN 'no_english'
  ELSE CASE lang_english_level WHEN 'none' THEN 'no_english' WHEN 'basic' THEN 'a2' WHEN 'intermediate' THEN 'b1'
  WHEN 'upper_intermediate' THEN 'b2' WHEN 'advanced' THEN 'c1_plus' ELSE 'unknown' END END AS english_level,
  count(*) AS n FROM (SELECT lang_english_level, soft_teamwork AS required FROM postings) GROUP BY ALL""")
def _(t):
    rows = t.postings("lang_english_level", "soft_teamwork").withColumnRenamed("soft_teamwork", "required")
    level = normalize.normalize_english_level(F.upper("lang_english_level"), F.col("required"))
    return rows.withColumn("english_level", level).groupBy("lang_english_level", "required", "english_level").agg(
        F.count(F.lit(1)).alias("n"))


@query("normalize_education_level", """SELECT edu_level, required, technical, CASE WHEN technical THEN 'technical_only'
  WHEN required OR edu_level IN ('any_he', 'bachelor_or_higher', 'partial_higher') THEN 'any_degree'
  ELSE 'no_degree_required' END AS education_level, count(*) AS n FROM (SELECT edu_level, soft_teamwork AS required,
  soft_leadership AS technical FROM postings) GROUP BY ALL""")
def _(t):
    rows = t.postings("edu_level", "soft_teamwork", "soft_leadership").withColumnsRenamed(
        {"soft_teamwork": "required", "soft_leadership": "technical"})
    level = normalize.normalize_education_level(F.col("edu_level"), F.col("required"), F.col("technical"))
    names = ["edu_level", "required", "technical", "education_level"]
    return rows.withColumn("education_level", level).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


@query("parse_date_value", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS d
  FROM events""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    text = pick(F.col("event_id") % 4, ["soon", "", "", ""])
    text = F.when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd")).when(
        F.col("event_id") % 4 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+03:00'")).when(
        F.col("event_id") % 4 == 3, F.date_format(ts, " yyyyMMdd")).otherwise(text)
    return t.events.select("event_id", normalize.first_date(F.lit("n/a"), text).alias("d"))


@query("canonical_key", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'source:hh:' || c_custkey
  WHEN 1 THEN 'url:' || sha256('http://x/' || c_custkey) ELSE 'content:' || sha256(c_name || '||' || c_mktsegment) END AS key
  FROM customer""")
def _(t):
    k = F.col("c_custkey")
    key = normalize.canonical_key(
        F.lit("hh"), F.when(k % 3 == 0, k.cast("string")).otherwise(""),
        F.when(k % 3 == 1, F.concat(F.lit("http://x/"), k)), [F.col("c_name"), F.lit(None).cast("string"), F.col("c_mktsegment")],
    )
    return t.customer.select("c_custkey", key.alias("key"))


@query("normalize_schema_aliases", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 2 = 0
  THEN 'x' END AS title FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    title = normalize.from_aliases(F.when(k % 3 == 0, F.col("s_name")).otherwise(" "), F.when(k % 2 == 0, "x"))
    return t.supplier.select("s_suppkey", title.alias("title"))


@query("normalize_id", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR
  ELSE o_orderkey || '.5' END AS id FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    text = F.concat(F.lit(" "), k, F.when(k % 2 == 0, ".0").otherwise(".5"))
    return t.orders.select("o_orderkey", normalize.normalize_id(text).alias("id"))


@query("order_categories", """SELECT grade_final, CASE grade_final WHEN 'intern' THEN 1 WHEN 'junior' THEN 2
  WHEN 'middle' THEN 4 WHEN 'senior' THEN 5 WHEN 'lead' THEN 6 END AS position, count(*) AS n FROM postings GROUP BY 1""")
def _(t):
    counts = t.postings("grade_final").groupBy("grade_final").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("position", normalize.category_rank(F.col("grade_final"), normalize.GRADE_ORDER))


KNOWN = ["the", "and", "tion", "elle", "und", "on", "c++", ".net"]


def _token(word):
    import re
    quoted = re.sub(r"([+.])", r"\\\1", word)
    edge = r"[^\pL\pN\pM_+.#-]"
    return f"regexp_matches(lower(text), '(^|{edge}){quoted}($|{edge})')"


@query("known_skills_in_text", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {_token(w)} THEN '{w}' END" for w in KNOWN) + "], lambda x: x IS NOT NULL), '|') AS skills FROM documents")
def _(t):
    return t.documents.select("doc_id", normalize.known_skills_in_text(F.col("text"), KNOWN).alias("skills"))


@query("known_tokens_in_text", """WITH known AS (SELECT min(p_partkey) AS position, 'the' || p_name[1] AS skill
  FROM part GROUP BY 2), hits AS (SELECT DISTINCT doc_id, position, skill FROM (SELECT doc_id,
  unnest(regexp_split_to_array(lower(text), '[^\\pL\\pN\\pM_+.#-]+')) AS tok FROM documents), known WHERE tok = skill)
  SELECT doc_id, string_agg(skill, '|' ORDER BY position) AS skills FROM hits GROUP BY doc_id""")
def _(t):
    known = t.part.groupBy(F.concat(F.lit("the"), F.substring("p_name", 1, 1)).alias("skill")).agg(F.min("p_partkey").alias("position"))
    return normalize.known_tokens_in_text(t.documents, "doc_id", "text", known)
