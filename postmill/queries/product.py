"""Funnels, cohorts, plans, digests, subscriptions and event sanitising."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import product
from postmill.queries.features import pick
from postmill.queries.registry import query
from postmill.queries.text import sql_pick
from postmill.sources import exports
from postmill.streaming import events as streaming

EVENT_TYPES = ["profile_completed", "first_value_reached", "weekly_return", "digest_opened", "market_fit_viewed",
               "vacancy_search_performed", "next_action_viewed", "search_degraded_warning_shown", "skill_gap_viewed", "weekly_returned"]
SOURCES = ["web", "bot", "digest", "user", "api"]
ACTION_TYPES = ["learning", "application", "portfolio", "saved_vacancy", "other"]
ACTION_STATUS = ["planned", "in_progress", "done", "skipped", "planned", "done"]
SKILLS = ["ring", "gear", "rod", "bolt", "anvil", "plate", " Ring "]
OUTCOMES = ["applied", "interview", "offer", "rejected", "saved", "withdrawn", "applied"]
ZONES = ["UTC", "Europe/Moscow", "America/New_York", "Asia/Tokyo"]

VIEWS = {
    "users": "SELECT c_custkey AS id, TIMESTAMP '1998-01-01' + to_days((c_custkey % 200)::INT) AS created_at FROM customer",
    "ev": f"""SELECT o_orderkey AS id, o_custkey AS user_id, {sql_pick('(o_orderkey // 6) % 10', EVENT_TYPES)} AS event_type,
      {sql_pick('o_orderkey % 6', SOURCES)} AS source, o_orderdate AS occurred_at FROM orders""",
    "profiles": """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 <> 0 THEN lower(c_mktsegment) END AS target_role,
      CASE WHEN c_custkey % 6 < 4 THEN 'junior' ELSE '' END AS target_grade, CASE WHEN c_custkey % 7 < 5 THEN 'x' END AS target_city,
      CASE WHEN c_custkey % 3 < 2 THEN 'remote' END AS target_work_mode, CASE WHEN c_custkey % 8 < 7 THEN 'it' END AS target_domain,
      CASE WHEN c_custkey % 9 = 0 THEN [] ELSE ['ring'] END AS current_skills FROM customer WHERE c_custkey % 4 <> 0""",
    "plans": "SELECT c_custkey + 100000 AS id, c_custkey AS user_id FROM customer WHERE c_custkey % 3 <> 0",
    "actions": f"""SELECT o_orderkey AS id, o_custkey + 100000 AS plan_id, 'a' || o_orderkey % 50 AS title,
      {sql_pick('(o_orderkey // 3) % 5', ACTION_TYPES)} AS action_type, {sql_pick('(o_orderkey // 7) % 6', ACTION_STATUS)} AS status,
      (o_orderkey % 9 * 10)::INT AS priority, {sql_pick('o_orderkey % 8', SKILLS)} AS skill_name,
      CASE o_orderkey % 4 WHEN 0 THEN 'manual' WHEN 3 THEN NULL ELSE 'skill_gap' END AS recommendation_source,
      CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS due_date, o_orderdate AS updated_at,
      CASE o_orderkey % 5 WHEN 0 THEN 'saved' WHEN 1 THEN 'applied' END AS application_status,
      CASE WHEN o_orderkey % 100 = 0 THEN o_orderdate END AS completed_at FROM orders""",
    "outcomes": f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS user_id, l_orderkey AS action_id,
      {sql_pick('(l_orderkey * 10 + l_linenumber) % 7', OUTCOMES)} AS status, l_shipdate AS occurred_at FROM lineitem""",
    "subs": f"""SELECT c_custkey AS user_id, c_custkey % 2 = 0 AS active, (c_custkey % 7)::INT AS weekday,
      lpad((c_custkey % 24)::VARCHAR, 2, '0') || ':30' AS time_local, {sql_pick('c_custkey % 4', ZONES)} AS timezone,
      CASE WHEN c_custkey % 6 = 0 THEN TIMESTAMP '2001-08-02 20:00:00' END AS last_sent_at FROM customer WHERE c_custkey % 5 <> 0""",
    "digests": "SELECT o_custkey AS user_id, o_orderdate - INTERVAL 400 DAYS AS sent_at FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 <> 0",
    "members": """SELECT CASE WHEN c_custkey % 300 = 1 THEN 99 ELSE c_nationkey END AS cohort_id, c_custkey AS user_id,
      CASE WHEN c_custkey % 10 = 0 THEN 'left' ELSE 'active' END AS status FROM customer""",
    "cohorts": "SELECT n_nationkey AS cohort_id FROM nation UNION ALL SELECT 99",
}


def with_product(*names, then=""):
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + f" {then}"


def ts(c):
    return F.col(c).cast("timestamp")


class Product:
    """Product tables derived from the given ones."""

    def __init__(self, t):
        k, o, c = F.col("o_orderkey"), t.orders, F.col("c_custkey")
        start = F.lit("1998-01-01").cast("date")
        self.users = t.customer.select(c.alias("id"), F.date_add(start, (c % 200).cast("int")).cast("timestamp").alias("created_at"))
        self.events = o.select(
            k.alias("id"), F.col("o_custkey").alias("user_id"), pick(F.floor(k / 6) % 10, EVENT_TYPES).alias("event_type"),
            pick(k % 6, SOURCES).alias("source"), ts("o_orderdate").alias("occurred_at"))
        self.profiles = t.customer.where("c_custkey % 4 <> 0").select(
            c.alias("user_id"), F.when(c % 5 != 0, F.lower("c_mktsegment")).alias("target_role"),
            F.when(c % 6 < 4, "junior").otherwise("").alias("target_grade"), F.when(c % 7 < 5, "x").alias("target_city"),
            F.when(c % 3 < 2, "remote").alias("target_work_mode"), F.when(c % 8 < 7, "it").alias("target_domain"),
            F.when(c % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("ring"))).alias("current_skills"))
        self.plans = t.customer.where("c_custkey % 3 <> 0").select((c + 100000).alias("id"), c.alias("user_id"))
        self.actions = o.select(
            k.alias("id"), (F.col("o_custkey") + 100000).alias("plan_id"), F.concat(F.lit("a"), k % 50).alias("title"),
            pick(F.floor(k / 3) % 5, ACTION_TYPES).alias("action_type"), pick(F.floor(k / 7) % 6, ACTION_STATUS).alias("status"),
            (k % 9 * 10).cast("int").alias("priority"), pick(k % 8, SKILLS).alias("skill_name"),
            F.when(k % 4 == 0, "manual").when(k % 4 != 3, "skill_gap").alias("recommendation_source"),
            F.when(k % 3 != 0, F.col("o_orderdate").cast("date")).alias("due_date"), ts("o_orderdate").alias("updated_at"),
            F.when(k % 5 == 0, "saved").when(k % 5 == 1, "applied").alias("application_status"),
            F.when(k % 100 == 0, ts("o_orderdate")).alias("completed_at"))
        line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        self.outcomes = t.lineitem.select(
            line.alias("id"), F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("action_id"),
            pick(line % 7, OUTCOMES).alias("status"), ts("l_shipdate").alias("occurred_at"))
        self.subs = t.customer.where("c_custkey % 5 <> 0").select(
            c.alias("user_id"), (c % 2 == 0).alias("active"), (c % 7).cast("int").alias("weekday"),
            F.concat(F.lpad((c % 24).cast("string"), 2, "0"), F.lit(":30")).alias("time_local"), pick(c % 4, ZONES).alias("timezone"),
            F.when(c % 6 == 0, F.lit("2001-08-02 20:00:00").cast("timestamp")).alias("last_sent_at"))
        self.digests = o.where("o_orderstatus = 'F' AND o_custkey % 3 <> 0").select(
            F.col("o_custkey").alias("user_id"), (ts("o_orderdate") - F.expr("INTERVAL 400 DAYS")).alias("sent_at"))
        self.members = t.customer.select(
            F.when(c % 300 == 1, 99).otherwise(F.col("c_nationkey")).alias("cohort_id"), c.alias("user_id"),
            F.when(c % 10 == 0, "left").otherwise("active").alias("status"))
        self.cohorts = t.nation.select(F.col("n_nationkey").alias("cohort_id")).unionByName(
            t.nation.agg(F.lit(99).alias("cohort_id")))


SINCE_SQL = "TIMESTAMP '1999-01-01'"


def since():
    return F.lit("1999-01-01").cast("timestamp")


ACT = "source IN ('web', 'bot', 'digest', 'user')"


def one(metric, expression, source, where=""):
    return f"SELECT '{metric}' AS metric, '' AS key, {expression} AS value FROM {source} {where}"


def many(metric, key, source, where=""):
    return f"SELECT '{metric}', {key}, count(*) FROM {source} WHERE {key} IS NOT NULL {where} GROUP BY {key}"


@query("product_loop_summary", with_product("users", "ev", "profiles", "plans", "actions", "outcomes", "subs", then=" UNION ALL ".join([
    one("users_total", "count(*)", "users"), one("profiles_total", "count(*)", "profiles"), one("career_plans_total", "count(*)", "plans"),
    one("active_subscriptions_total", "count(*)", "subs", "WHERE active"),
    one("recent_active_users", "count(DISTINCT user_id)", "ev", f"WHERE occurred_at >= {SINCE_SQL}"),
    one("users_with_saved_vacancy", "count(DISTINCT user_id)", "plans", "WHERE id IN (SELECT plan_id FROM actions WHERE action_type = 'saved_vacancy')"),
    one("users_with_application_outcome", "count(DISTINCT user_id)", "outcomes"), one("career_actions_total", "count(*)", "actions"),
    one("completed_actions_total", "count(*)", "actions", "WHERE status = 'done'"),
    one("saved_vacancies_total", "count(*)", "actions", "WHERE action_type = 'saved_vacancy'"),
    one("application_outcomes_total", "count(*)", "outcomes"),
    one("recent_application_outcomes_total", "count(*)", "outcomes", f"WHERE occurred_at >= {SINCE_SQL}"),
    one("degraded_search_exposures", "count(*)", "ev", f"WHERE occurred_at >= {SINCE_SQL} AND event_type = 'search_degraded_warning_shown'"),
    many("recent_product_events_by_type", "event_type", "ev", f"AND occurred_at >= {SINCE_SQL}"),
    many("recent_product_events_by_source", "source", "ev", f"AND occurred_at >= {SINCE_SQL}"),
    many("activation_events_by_source", "source", "ev", f"AND occurred_at >= {SINCE_SQL} AND {ACT} AND event_type IN ('profile_completed', 'next_action_viewed')"),
    many("career_actions_by_type", "action_type", "actions"), many("career_actions_by_recommendation_source", "recommendation_source", "actions"),
    many("recent_application_outcomes_by_status", "status", "outcomes", f"AND occurred_at >= {SINCE_SQL}"),
])))
def _(t):
    p = Product(t)
    return product.product_loop_summary(p.users, p.profiles, p.plans, p.actions, p.subs, p.events, p.outcomes, since())


@query("conversion_by_source", with_product("ev", then=f"""SELECT source, count(DISTINCT CASE WHEN event_type IN ('weekly_return', 'weekly_returned') THEN user_id END) AS users,
  count(DISTINCT user_id) AS active_users, round_even(count(DISTINCT CASE WHEN event_type IN ('weekly_return', 'weekly_returned') THEN user_id END) / count(DISTINCT user_id), 4) AS rate
  FROM ev WHERE occurred_at >= {SINCE_SQL} AND {ACT} GROUP BY source"""))
def _(t):
    return product.conversion_by_source(Product(t).events, product.RETURN_EVENTS, since())


def seen(alias, *types):
    return f"count(DISTINCT CASE WHEN event_type IN ({', '.join(repr(x) for x in types)}) THEN user_id END) AS {alias}"


@query("weekly_cohorts", with_product("users", "ev", "subs", then=f""", b AS (SELECT id, date_trunc('week', created_at)::DATE AS w FROM users),
  e AS (SELECT w, ev.* FROM ev JOIN b ON b.id = user_id WHERE occurred_at >= {SINCE_SQL} AND {ACT}),
  s AS (SELECT w, count(DISTINCT user_id) AS active_users, {seen('profiles_completed_users', 'profile_completed')}, {seen('first_value_users', 'first_value_reached')},
  {seen('weekly_return_users', 'weekly_return', 'weekly_returned')}, {seen('digest_engagement_users', 'digest_engagement', 'digest_preview_viewed', 'digest_opened')} FROM e GROUP BY w),
  f AS (SELECT w, string_agg(source || ':' || n, '|' ORDER BY source) AS x FROM (SELECT w, source, count(*) AS n FROM e GROUP BY ALL) GROUP BY w),
  d AS (SELECT w, count(DISTINCT user_id) AS n FROM subs JOIN b ON b.id = user_id WHERE active GROUP BY w)
  SELECT strftime(w, '%Y-%m-%d') AS cohort_week, count(*) AS users_started, coalesce(any_value(active_users), 0) AS active_users,
  coalesce(any_value(profiles_completed_users), 0) AS profiles_completed_users, coalesce(any_value(first_value_users), 0) AS first_value_users,
  coalesce(any_value(weekly_return_users), 0) AS weekly_return_users, coalesce(any_value(digest_engagement_users), 0) AS digest_engagement_users,
  coalesce(any_value(d.n), 0) AS digest_subscribers, coalesce(any_value(x), '') AS events_by_surface
  FROM b LEFT JOIN s USING (w) LEFT JOIN f USING (w) LEFT JOIN d USING (w) GROUP BY w"""))
def _(t):
    p = Product(t)
    return product.weekly_cohorts(p.users, p.events, p.subs, since())


@query("trust_tier_distribution", """SELECT tier AS trust_tier, count(*) AS events FROM (SELECT CASE k WHEN 0 THEN 'trusted' WHEN 1 THEN 'degraded_search'
  WHEN 3 THEN 'stale_data' END AS tier FROM (SELECT event_id % 5 AS k, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND user_id % 2 = 0))
  WHERE tier IS NOT NULL GROUP BY tier""")
def _(t):
    payload = pick(F.col("event_id") % 5, ['{"trust_tier": "trusted"}', '{"search_state": "fallback"}', '{"search_state": "ready"}',
                                           '{"trust_tier": "stale_data", "search_state": "degraded"}', "{}"])
    rows = t.events.select(payload.alias("payload"), ts("ts").alias("occurred_at"),
                           F.when(F.col("user_id") % 2 == 0, "web").otherwise("worker").alias("source"))
    return product.trust_tier_distribution(rows, F.lit("2024-01-10").cast("timestamp"))


MEMBERS = """am AS (SELECT DISTINCT cohort_id, user_id FROM members WHERE status = 'active'),
  sz AS (SELECT c.cohort_id, count(user_id) AS member_count FROM cohorts c LEFT JOIN am USING (cohort_id) GROUP BY 1)"""


@query("cohort_sizes", with_product("members", "cohorts", then=f""", {MEMBERS} SELECT cohort_id, member_count, CASE WHEN member_count < 10 THEN '<10'
  ELSE member_count::VARCHAR END AS bucket, member_count < 10 AS suppressed, CASE WHEN member_count < 10 THEN 'small_cohort' END AS reason FROM sz"""))
def _(t):
    p = Product(t)
    return product.cohort_sizes(p.cohorts, p.members, 10)


def fact(metric, source, where="true"):
    return f"SELECT user_id, '{metric}' AS metric FROM {source} WHERE {where}"


_PA = "plans JOIN actions ON actions.plan_id = plans.id"
FACTS = "fa AS (" + " UNION ".join([
    fact("profile_completion_rate", "profiles"), fact("plan_created_rate", "plans"),
    fact("plan_action_started_rate", _PA, "status IN ('planned', 'in_progress', 'done')"), fact("plan_action_done_rate", _PA, "status = 'done'"),
    fact("saved_vacancy_rate", _PA, "action_type = 'saved_vacancy'"), fact("application_outcome_rate", "outcomes"),
    fact("digest_subscription_rate", "subs", "active"),
    *[fact(m, "ev", f"occurred_at >= {SINCE_SQL} AND event_type IN ({', '.join(repr(x) for x in types)})") for m, types in product.EVENT_METRICS.items()],
]) + ")"


@query("cohort_analytics", with_product("members", "cohorts", "profiles", "plans", "actions", "outcomes", "subs", "ev", then=f""", {MEMBERS}, {FACTS},
  ct AS (SELECT cohort_id, metric, count(*) AS n FROM am JOIN fa USING (user_id) GROUP BY ALL)
  SELECT sz.cohort_id, m.metric, coalesce(n, 0) AS count, member_count AS denominator, round_even(coalesce(n, 0) / member_count, 4) AS rate
  FROM sz, (SELECT unnest({product.COHORT_METRICS}) AS metric) m LEFT JOIN ct ON ct.cohort_id = sz.cohort_id AND ct.metric = m.metric WHERE member_count >= 10"""))
def _(t):
    p = Product(t)
    return product.cohort_analytics(p.cohorts, p.members, p.profiles, p.plans, p.actions, p.outcomes, p.subs, p.events, since(), 10)


HEAT = f""", {MEMBERS}, pr AS (SELECT DISTINCT user_id, skill_name FROM {_PA} WHERE recommendation_source = 'skill_gap' AND skill_name IS NOT NULL
  AND status IN ('planned', 'in_progress')), ce AS (SELECT cohort_id, skill_name, count(*) AS n FROM am JOIN pr USING (user_id) GROUP BY ALL),
  ro AS (SELECT cohort_id, arg_min(target_role, {{'a': -n, 'b': target_role}}) AS target_role FROM (SELECT cohort_id, target_role, count(*) AS n FROM am
  JOIN profiles USING (user_id) WHERE target_role IS NOT NULL GROUP BY ALL) GROUP BY 1),
  hm AS (SELECT *, row_number() OVER (PARTITION BY cohort_id ORDER BY n DESC, skill_name) AS position FROM ce)"""


def heatmap(t, min_cell):
    p = Product(t)
    return product.cohort_skill_heatmap(p.cohorts, p.members, p.profiles, p.plans, p.actions, 10, min_cell)


@query("cohort_skill_heatmap", with_product("members", "cohorts", "profiles", "plans", "actions", then=HEAT + """ SELECT cohort_id, position, skill_name AS skill,
  member_count, CASE WHEN n >= 18 THEN n END AS users, CASE WHEN n >= 18 THEN round_even(n / member_count, 4) END AS share, target_role, n < 18 AS suppressed
  FROM hm JOIN sz USING (cohort_id) LEFT JOIN ro USING (cohort_id) WHERE member_count >= 10 AND position <= 25"""))
def _(t):
    return heatmap(t, 18)


@query("export_cohort_report", with_product("members", "cohorts", "profiles", "plans", "actions", "outcomes", "subs", "ev", then=HEAT + f""", {FACTS},
  ct AS (SELECT cohort_id, metric, count(*) AS n FROM am JOIN fa USING (user_id) GROUP BY ALL)
  SELECT 'metric' AS section, sz.cohort_id, m.metric AS name, coalesce(n, 0)::VARCHAR AS value
  FROM sz, (SELECT unnest({product.COHORT_METRICS}) AS metric) m LEFT JOIN ct ON ct.cohort_id = sz.cohort_id AND ct.metric = m.metric WHERE member_count >= 10
  UNION ALL SELECT 'skill_heatmap', cohort_id, skill_name, CASE WHEN n >= 18 THEN n::VARCHAR END FROM hm JOIN sz USING (cohort_id) WHERE member_count >= 10 AND position <= 25
  UNION ALL SELECT 'suppression', cohort_id, 'small_cohort', '<10' FROM sz WHERE member_count < 10"""))
def _(t):
    p = Product(t)
    metrics = product.cohort_analytics(p.cohorts, p.members, p.profiles, p.plans, p.actions, p.outcomes, p.subs, p.events, since(), 10)
    small = product.cohort_sizes(p.cohorts, p.members, 10).where("suppressed")
    return exports.cohort_report(metrics.withColumn("value", F.col("count")), heatmap(t, 18), small)


@query("user_overview", with_product("users", "profiles", "subs", then="""SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  id IN (SELECT user_id FROM profiles) AS has_profile, id IN (SELECT user_id FROM subs) AS has_subscription FROM users ORDER BY id LIMIT 50 OFFSET 30"""))
def _(t):
    p = Product(t)
    return product.user_overview(p.users, p.profiles, p.subs, 50, 30)


LAST = "ls AS (SELECT user_id, max(sent_at) AS last_sent_at FROM digests GROUP BY user_id)"


@query("activity_since_last_digest", with_product("ev", "digests", then=f""", {LAST} SELECT user_id, event_type, count(*) AS events FROM ev LEFT JOIN ls USING (user_id)
  WHERE last_sent_at IS NULL OR occurred_at > last_sent_at GROUP BY ALL"""))
def _(t):
    p = Product(t)
    return product.activity_since_last_digest(p.events, p.digests)


@query("outcomes_since_last_digest", with_product("outcomes", "digests", then=f""", {LAST} SELECT user_id, id, status, position FROM (SELECT user_id, id, status,
  row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, id DESC) AS position FROM outcomes LEFT JOIN ls USING (user_id)
  WHERE last_sent_at IS NULL OR occurred_at > last_sent_at) WHERE position <= 5"""))
def _(t):
    p = Product(t)
    return product.outcomes_since_last_digest(p.outcomes, p.digests).select("user_id", "id", "status", "position")


@query("stale_actions", with_product("actions", "plans", then="""SELECT * FROM (SELECT plan_id, user_id, actions.id, row_number() OVER (PARTITION BY plan_id
  ORDER BY due_date NULLS LAST, updated_at NULLS LAST, actions.id) AS position FROM actions JOIN plans ON plan_id = plans.id WHERE status IN ('planned', 'in_progress')
  AND (due_date < DATE '1999-06-01' OR updated_at <= TIMESTAMP '1999-06-01 12:00:00' - INTERVAL 14 DAYS)) WHERE position <= 3"""))
def _(t):
    p = Product(t)
    out = product.stale_actions(p.actions, p.plans, F.lit("1999-06-01 12:00:00").cast("timestamp"))
    return out.select("plan_id", "user_id", "id", "position")


RECOMMENDED_SQL = """rec AS (SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 1 THEN ['gear', 'Ring', 'hammer', 'rod', 'saw', 'nail', 'bolt']
  ELSE ['saw', 'plate', 'saw', 'anvil'] END AS skills, CASE WHEN c_custkey % 2 = 0 THEN 'promo' END AS target_role FROM customer)"""


def recommended(t):
    k = F.col("c_custkey")

    def names(*values):
        return F.array(*[F.lit(v) for v in values])

    return t.customer.select(
        k.alias("user_id"), F.when(k % 3 == 1, names("gear", "Ring", "hammer", "rod", "saw", "nail", "bolt"))
        .otherwise(names("saw", "plate", "saw", "anvil")).alias("recommended_skills"),
        F.when(k % 2 == 0, "promo").alias("target_role"), F.create_map(F.lit("saw"), F.lit(0.5), F.lit("rod"), F.lit(0.25)).alias("evidence"))


@query("plan_refresh_gaps", with_product("actions", "plans", then=f""", {RECOMMENDED_SQL}, cov AS (SELECT DISTINCT user_id, lower(trim(coalesce(skill_name, ''))) AS k
  FROM {_PA} WHERE recommendation_source = 'skill_gap' AND status NOT IN ('done', 'skipped')),
  ex AS (SELECT user_id, unnest(skills[1:5]) AS s, generate_subscripts(skills[1:5], 1) AS i FROM rec)
  SELECT user_id, array_to_string(list(s ORDER BY i)[1:3], '|') AS missing_skills FROM ex WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.user_id = ex.user_id AND k = lower(s)) GROUP BY user_id"""))
def _(t):
    p = Product(t)
    return product.plan_refresh_gaps(recommended(t), p.plans, p.actions)


QUALITY = """(target_role <> '') AS a, (target_grade <> '') AS b, (target_city <> '') AS c, (target_work_mode <> '') AS d, (target_domain <> '') AS e, len(current_skills) > 0 AS f"""
_NAMES = ["target_role", "target_grade", "target_geo", "target_work_mode", "target_domain", "current_skills"]
_DONE = " + ".join(f"coalesce({x}, false)::INT" for x in "abcdef")


def _listed(flag):
    return "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {'NOT ' if flag else ''}coalesce({x}, false) THEN '{n}' END" for x, n in zip("abcdef", _NAMES)) + "], lambda z: z IS NOT NULL), '|')"


@query("profile_quality", with_product("profiles", then=f"""SELECT user_id, round_even(({_DONE}) / 6 * 100, 0)::BIGINT AS score, ({_DONE}) = 6 AS is_complete,
  {_listed(False)} AS completed_fields, {_listed(True)} AS missing_fields FROM (SELECT user_id, {QUALITY} FROM profiles)"""))
def _(t):
    return product.profile_quality(Product(t).profiles).select("user_id", "score", "is_complete", "completed_fields", "missing_fields")


@query("next_best_action", with_product("users", "profiles", "plans", "actions", "subs", then=f""", q AS (SELECT user_id, ({_DONE}) = 6 AS complete,
  round_even(({_DONE}) / 6 * 100, 0)::BIGINT AS score FROM (SELECT user_id, {QUALITY} FROM profiles)),
  op AS (SELECT plan_id, arg_min(id, {{'a': priority, 'b': id}}) AS id FROM actions WHERE action_type <> 'saved_vacancy' AND status IN ('planned', 'in_progress') GROUP BY 1),
  sv AS (SELECT plan_id, arg_min({{'id': id, 's': application_status}}, {{'a': priority, 'b': id}}) AS x FROM actions WHERE action_type = 'saved_vacancy' GROUP BY 1),
  j AS (SELECT users.id AS user_id, complete, score, plans.id AS plan, op.id AS oid, x, active FROM users LEFT JOIN q ON q.user_id = users.id
  LEFT JOIN plans ON plans.user_id = users.id LEFT JOIN op ON op.plan_id = plans.id LEFT JOIN sv ON sv.plan_id = plans.id LEFT JOIN subs ON subs.user_id = users.id),
  st AS (SELECT *, CASE WHEN complete IS NULL THEN 'create_profile' WHEN NOT complete THEN 'complete_profile' WHEN plan IS NULL THEN 'create_plan'
  WHEN oid IS NULL THEN 'generate_plan_actions' WHEN x IS NULL THEN 'find_vacancy' WHEN coalesce(x.s, 'saved') = 'saved' THEN 'update_application_outcome'
  WHEN NOT coalesce(active, false) THEN 'enable_digest' ELSE 'continue_plan' END AS state FROM j)
  SELECT user_id, state, CASE state WHEN 'update_application_outcome' THEN x.id WHEN 'continue_plan' THEN oid END AS action_id, coalesce(score, 0) AS profile_score FROM st"""))
def _(t):
    p = Product(t)
    return product.next_best_action(p.users, p.profiles, p.plans, p.actions, p.subs, F.lit(True))


@query("generate_plan_actions", with_product("actions", "plans", then=f""", {RECOMMENDED_SQL}, busy AS (SELECT DISTINCT plan_id, lower(trim(skill_name)) AS k FROM actions
  WHERE status NOT IN ('done', 'skipped') AND skill_name <> ''), ex AS (SELECT plans.id AS plan_id, target_role, unnest(skills[1:4]) AS s, generate_subscripts(skills[1:4], 1) AS i
  FROM rec JOIN plans USING (user_id)), fr AS (SELECT *, row_number() OVER (PARTITION BY plan_id, lower(s) ORDER BY i) AS rn FROM ex
  WHERE NOT EXISTS (SELECT 1 FROM busy WHERE busy.plan_id = ex.plan_id AND k = lower(s)))
  SELECT plan_id, 'Close ' || s || ' skill gap' AS title, 'learning' AS action_type, 'planned' AS status, i * 10 AS priority, s AS skill_name, 'skill_gap' AS recommendation_source,
  'run-1' AS dataset_run_id, s || ' is a recommended gap for ' || coalesce(target_role, 'the target role') || '.' AS reason,
  strftime(DATE '2024-02-01' + (i * 14)::INT, '%Y-%m-%d') AS due_date, CASE s WHEN 'saw' THEN 0.5::DOUBLE WHEN 'rod' THEN 0.25::DOUBLE END AS market_share FROM fr WHERE rn = 1"""))
def _(t):
    p = Product(t)
    out = product.generate_plan_actions(recommended(t), p.plans, p.actions, F.lit("2024-02-01").cast("date"), 4, "run-1")
    return out.withColumn("market_share", F.col("evidence.market_share").cast("double")).drop("evidence")


@query("apply_outcomes", with_product("actions", "outcomes", then=""", fo AS (SELECT action_id, arg_max(status, {'a': occurred_at, 'b': id}) AS last,
  arg_max(status, {'a': occurred_at, 'b': id}) FILTER (WHERE status IN ('offer', 'rejected', 'withdrawn')) AS term,
  min(occurred_at) FILTER (WHERE status IN ('offer', 'rejected', 'withdrawn')) AS done_at, bool_or(status IN ('applied', 'interview')) AS moving FROM outcomes GROUP BY 1)
  SELECT id, coalesce(last, application_status) AS application_status, CASE WHEN term = 'offer' THEN 'done' WHEN term IS NOT NULL THEN 'skipped'
  WHEN moving AND status = 'planned' THEN 'in_progress' ELSE status END AS status, strftime(coalesce(completed_at, done_at), '%Y-%m-%d %H:%M:%S') AS completed_at
  FROM actions LEFT JOIN fo ON action_id = id"""))
def _(t):
    p = Product(t)
    return product.apply_outcomes(p.actions, p.outcomes).select("id", "application_status", "status", "completed_at")


@query("due_subscriptions", with_product("subs", then=""", l AS (SELECT *, TIMESTAMP '2001-08-03 01:10:00' + to_hours(h) AS loc, last_sent_at + to_hours(h) AS sent FROM (
  SELECT *, CASE timezone WHEN 'UTC' THEN 0 WHEN 'Europe/Moscow' THEN 4 WHEN 'America/New_York' THEN -4 ELSE 9 END AS h FROM subs))
  SELECT user_id, weekday::BIGINT AS weekday, time_local, timezone, strftime(last_sent_at, '%Y-%m-%d %H:%M:%S') AS last_sent_at FROM l
  WHERE active AND isodow(loc) - 1 = weekday AND strftime(loc, '%H:%M') >= time_local AND (sent IS NULL OR sent::DATE <> loc::DATE)"""))
def _(t):
    return product.due_subscriptions(Product(t).subs, F.lit("2001-08-03 01:10:00").cast("timestamp"))


EVIDENCE_SQL = """an AS (SELECT c_custkey AS user_id, c_custkey * 3 AS vacancy_count, CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'low' END AS confidence
  FROM customer), gp AS (SELECT o_custkey AS user_id, 'Skill ' || o_orderkey % 40 || '!' AS skill_name, (o_orderkey % 97) / 97 AS market_share,
  o_orderkey % 3 <> 0 AS gap FROM orders), ss AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN 'fallback' ELSE 'ready' END AS search_state FROM customer)"""


@query("evidence_rows", with_product("actions", "plans", then=f""", {EVIDENCE_SQL} SELECT user_id, 'market:segment_sample' AS evidence_id, 'market_summary' AS evidence_type,
  vacancy_count::VARCHAR AS value, confidence FROM an
  UNION ALL SELECT user_id, 'skill_gap:skill_' || regexp_extract(skill_name, '[0-9]+'), 'skill_gap', skill_name, confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY market_share DESC, lower(skill_name)) AS rn FROM gp WHERE gap) JOIN an USING (user_id) WHERE rn <= 8
  UNION ALL SELECT user_id, 'plan_action:' || a.id, 'plan_action', title, confidence FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY priority, id) AS rn FROM actions
  WHERE status IN ('planned', 'in_progress') AND action_type <> 'saved_vacancy') a JOIN plans ON plans.id = plan_id JOIN an USING (user_id) WHERE rn <= 3
  UNION ALL SELECT user_id, 'search:runtime_state', 'search_runtime', search_state, 'high' FROM ss SEMI JOIN an USING (user_id) WHERE search_state <> 'ready'"""))
def _(t):
    p, c, k = Product(t), F.col("c_custkey"), F.col("o_orderkey")
    analysis = t.customer.select(
        c.alias("user_id"), (c * 3).alias("vacancy_count"), F.when(c % 2 == 0, "high").otherwise("low").alias("confidence"))
    gaps = t.orders.select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("Skill "), k % 40, F.lit("!")).alias("skill_name"),
                           ((k % 97) / 97).alias("market_share"), (k % 3 != 0).alias("gap"))
    states = t.customer.select(c.alias("user_id"), F.when(c % 4 == 0, "fallback").otherwise("ready").alias("search_state"))
    return product.evidence_rows(analysis, gaps, p.plans, p.actions, states)


@query("blocked_claims", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 OR dates THEN 'historical_trend_claims' END,
  CASE WHEN o_orderkey % 2 = 0 THEN 'salary_claims' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'strong_recommendation_claims' END,
  CASE WHEN o_orderstatus = 'P' THEN 'strong_vacancy_fit_claims' END], lambda x: x IS NOT NULL), '|') AS blocked FROM (SELECT *, o_orderpriority = '5-LOW' AS dates FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    claims = product.blocked_claims(
        {"salary": k % 2 != 0, "trends": k % 3 != 0, "recommendations": F.when(k % 5 == 0, True)},
        F.when(F.col("o_orderpriority") == "5-LOW", "failed").when(F.col("o_orderpriority") == "1-URGENT", "passed"),
        F.when(F.col("o_orderstatus") == "P", "degraded").otherwise("ready"))
    return t.orders.select("o_orderkey", claims.alias("blocked"))


BILLING_SQL = """be AS (SELECT event_id, user_id, 'fake' AS provider, 'e' || event_id % 9000 AS provider_event_id,
  CASE WHEN event_id % 10 <> 0 THEN 's' || user_id % 3 END AS sub, CASE WHEN event_id % 13 <> 0 THEN ts - to_minutes((value * 7)::INT) END AS occurred_at, ts AS processed_at,
  event_type AS plan FROM events), on1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, provider_event_id ORDER BY processed_at, event_id) AS rn FROM be) WHERE rn = 1),
  hi AS (SELECT *, sub IS NOT NULL AND coalesce(occurred_at < max(occurred_at) OVER (PARTITION BY user_id, provider, sub ORDER BY processed_at, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ooo FROM on1)"""


def billing(t):
    k = F.col("event_id")
    stamp = F.col("ts").cast("timestamp")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.round(F.col("value") * 7).cast("int"))
    return t.events.select(
        "event_id", "user_id", F.lit("fake").alias("provider"), F.concat(F.lit("e"), k % 9000).alias("provider_event_id"),
        F.when(k % 10 != 0, F.concat(F.lit("s"), F.col("user_id") % 3)).alias("provider_subscription_id"),
        F.when(k % 13 != 0, stamp - minutes).alias("occurred_at"), stamp.alias("processed_at"), F.col("event_type").alias("plan"),
        F.lit("active").alias("subscription_state"))


@query("billing_history", f"WITH {BILLING_SQL} SELECT event_id, user_id, provider_event_id, ooo AS out_of_order FROM hi")
def _(t):
    return product.billing_history(billing(t)).select("event_id", "user_id", "provider_event_id", "out_of_order")


@query("subscription_state", f"""WITH {BILLING_SQL} SELECT user_id, arg_max(plan, {{'a': processed_at, 'b': event_id}}) AS plan, 'active' AS subscription_state,
  arg_max(event_id, {{'a': processed_at, 'b': event_id}}) AS event_id FROM hi WHERE NOT ooo GROUP BY user_id""")
def _(t):
    return product.subscription_state(billing(t))


@query("plan_progress", with_product("actions", then="""SELECT plan_id, any_value(n) AS actions, any_value(d)::BIGINT AS done,
  coalesce(string_agg(title, '|' ORDER BY rn) FILTER (WHERE rn <= 3 AND op), '') AS next_actions FROM (SELECT *, count(*) OVER (PARTITION BY plan_id) AS n,
  sum((status = 'done')::INT) OVER (PARTITION BY plan_id) AS d, status NOT IN ('done', 'skipped') AS op, row_number() OVER (PARTITION BY plan_id, status NOT IN ('done', 'skipped')
  ORDER BY priority, id) AS rn FROM actions) GROUP BY plan_id"""))
def _(t):
    return product.plan_progress(Product(t).actions)


# --- sanitised product events ----------------------------------------------

EVENT_NAMES = ["Profile_Completed ", "vacancy_saved", "hacked", "weekly_return", "login_succeeded"]


def raw_events(t):
    """Events with a JSON payload holding allowed and forbidden keys."""
    k = F.col("event_id")
    payload = F.concat(
        F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "userEmail": "a@b", "api-key": "x", "title": "'), F.repeat(F.lit("t"), (k % 400).cast("int")),
        F.lit('", "tags": ['), F.array_join(F.transform(F.sequence(F.lit(1), (k % 40 + 1).cast("int")), lambda i: i.cast("string")), ","),
        F.lit('], "inner": {"phone": 1, "step": "s", "gone": null}, "empty": null}'))
    return t.events.select(
        "event_id", "user_id", pick(k % 5, EVENT_NAMES).alias("event_type"), pick(k % 4, [" WEB", "bot", "fax", ""]).alias("source"),
        F.concat(F.lit(" "), F.repeat(F.lit("r"), (k % 200).cast("int"))).alias("request_id"), F.col("ts").cast("timestamp").alias("occurred_at"),
        payload.alias("payload"))


@query("sanitize_events", """SELECT event_id, user_id, event_type, source, CASE WHEN event_id % 200 > 0 THEN repeat('r', least(event_id % 200, 128)) END AS request_id,
  '{"api-key":"[redacted]","inner":{"phone":"[redacted]","step":"s"},"k":' || json_extract_string(props, '$.k') || ',"tags":[' ||
  array_to_string(range(1, least(event_id % 40 + 1, 25) + 1), ',') || '],"title":"' || repeat('t', least(event_id % 400, 256)) || '","userEmail":"[redacted]"}' AS payload
  FROM (SELECT * EXCLUDE (event_type), CASE event_id % 5 WHEN 0 THEN 'profile_completed' WHEN 1 THEN 'vacancy_saved' WHEN 3 THEN 'weekly_return' WHEN 4 THEN 'login_succeeded' END AS event_type,
  CASE event_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'bot' ELSE 'api' END AS source FROM events) WHERE event_type IS NOT NULL""")
def _(t):
    return streaming.sanitize_events(raw_events(t)).select("event_id", "user_id", "event_type", "source", "request_id", "payload")


@query("rejected_events", """SELECT event_id, 'hacked' AS event_type FROM events WHERE event_id % 5 = 2""")
def _(t):
    return streaming.rejected_events(raw_events(t)).select("event_id", "event_type")
