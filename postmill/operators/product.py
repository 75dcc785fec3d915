"""J: funnels, cohorts, plans, digests and subscription state.

Distinct users are never counted by a plain multi-distinct: events fold to one
row per user (or per user and key) first, which also spreads a user with a very
large share of the events.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.columns import flag, monday
from postmill.functions.normalize import clean_skill

# --- fixed values ----------------------------------------------------------

ACTIVATION_SOURCES = ["web", "bot", "digest", "user"]
ACTIVATION_EVENTS = ["profile_completed", "next_action_viewed", "first_session_step_clicked"]
ACTIVATION_COUNTED = ["profile_completed", "next_action_viewed"]
FIRST_VALUE_EVENTS = ["first_value_reached"]
RETURN_EVENTS = ["weekly_return", "weekly_returned"]
DIGEST_EVENTS = ["digest_engagement", "digest_preview_viewed", "digest_opened"]
OPEN_STATUSES = ["planned", "in_progress"]
CLOSED_STATUSES = ["done", "skipped"]
STALE_DAYS = 14
GENERATED_STEP_DAYS = 14
HEATMAP_SKILLS = 25
COHORT_METRICS = [
    "profile_completion_rate", "market_view_rate", "skill_gap_view_rate", "plan_created_rate",
    "plan_action_started_rate", "plan_action_done_rate", "vacancy_search_rate", "saved_vacancy_rate",
    "application_outcome_rate", "digest_subscription_rate", "digest_engagement_rate", "weekly_return_rate",
]
EVENT_METRICS = {
    "market_view_rate": ["market_fit_viewed"], "skill_gap_view_rate": ["skill_gap_viewed"],
    "vacancy_search_rate": ["vacancy_search_performed"], "digest_engagement_rate": DIGEST_EVENTS,
    "weekly_return_rate": RETURN_EVENTS,
}

# ---------------------------------------------------------------------------


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("key"), "value")


def _users(df: DataFrame, name: str, user: str = "user_id") -> DataFrame:
    return _count(df.where(F.col(user).isNotNull()).select(user).distinct(), name)


def _by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("value")).select(
        F.lit(name).alias("metric"), F.col("key").cast("string").alias("key"), "value")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def product_loop_summary(
    users: DataFrame, profiles: DataFrame, plans: DataFrame, actions: DataFrame, subscriptions: DataFrame, events: DataFrame,
    outcomes: DataFrame, since: Column,
) -> DataFrame:
    """J1 as (metric, key, value): totals have an empty key, grouped counts one row per key."""
    recent, told = events.where(F.col("occurred_at") >= since), outcomes.where(F.col("occurred_at") >= since)
    saved = actions.where(F.col("action_type") == "saved_vacancy")
    activation = recent.where(F.col("source").isin(*ACTIVATION_SOURCES) & F.col("event_type").isin(*ACTIVATION_COUNTED))
    savers = plans.join(saved.select(F.col("plan_id").alias("id")).distinct(), "id", "left_semi")
    return _union([
        _count(users, "users_total"), _count(profiles, "profiles_total"), _count(plans, "career_plans_total"),
        _count(subscriptions.where(flag("active")), "active_subscriptions_total"),
        _users(recent, "recent_active_users"), _users(savers, "users_with_saved_vacancy"),
        _users(outcomes, "users_with_application_outcome"), _count(actions, "career_actions_total"),
        _count(actions.where(F.col("status") == "done"), "completed_actions_total"), _count(saved, "saved_vacancies_total"),
        _count(outcomes, "application_outcomes_total"), _count(told, "recent_application_outcomes_total"),
        _count(recent.where(F.col("event_type") == "search_degraded_warning_shown"), "degraded_search_exposures"),
        _by(recent, "event_type", "recent_product_events_by_type"), _by(recent, "source", "recent_product_events_by_source"),
        _by(activation, "source", "activation_events_by_source"), _by(actions, "action_type", "career_actions_by_type"),
        _by(actions, "recommendation_source", "career_actions_by_recommendation_source"),
        _by(told, "status", "recent_application_outcomes_by_status"),
    ])


def conversion_by_source(events: DataFrame, event_types: Sequence[str], since: Column) -> DataFrame:
    """Users with one of the events over active users, per activation source."""
    rows = events.where((F.col("occurred_at") >= since) & F.col("source").isin(*ACTIVATION_SOURCES) & F.col("user_id").isNotNull())
    per_user = rows.groupBy("source", "user_id").agg(F.max(F.col("event_type").isin(*event_types)).alias("_hit"))
    out = per_user.groupBy("source").agg(
        F.sum(F.col("_hit").cast("long")).alias("users"), F.count(F.lit(1)).alias("active_users"))
    return out.where(F.col("users") > 0).withColumn("rate", F.bround(F.col("users") / F.col("active_users"), 4))


def weekly_cohorts(users: DataFrame, events: DataFrame, subscriptions: DataFrame, since: Column) -> DataFrame:
    """One row per week of user creation; weeks without events stay."""
    rows = events.where((F.col("occurred_at") >= since) & F.col("source").isin(*ACTIVATION_SOURCES))

    def saw(types: Sequence[str]) -> Column:
        return F.sum(F.col("event_type").isin(*types).cast("long"))

    per_user = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_events"), saw(["profile_completed"]).alias("_profile"), saw(FIRST_VALUE_EVENTS).alias("_value"),
        saw(RETURN_EVENTS).alias("_return"), saw(DIGEST_EVENTS).alias("_digest"),
        *[F.sum((F.col("source") == s).cast("long")).alias(f"_s_{s}") for s in ACTIVATION_SOURCES])
    active = subscriptions.where(flag("active")).select("user_id").distinct().withColumn("_sub", F.lit(1))
    born = users.select(F.col("id").alias("user_id"), monday(F.col("created_at")).alias("cohort_week"))
    joined = born.join(per_user, "user_id", "left").join(active, "user_id", "left")

    def some(name: str, alias: str) -> Column:
        return F.count(F.when(F.col(name) > 0, 1)).alias(alias)

    out = joined.groupBy("cohort_week").agg(
        F.count(F.lit(1)).alias("users_started"), some("_events", "active_users"),
        some("_profile", "profiles_completed_users"), some("_value", "first_value_users"),
        some("_return", "weekly_return_users"), some("_digest", "digest_engagement_users"), some("_sub", "digest_subscribers"),
        *[F.sum(f"_s_{s}").alias(f"_s_{s}") for s in ACTIVATION_SOURCES])
    surfaces = F.array_compact(F.array(*[
        F.when(F.col(f"_s_{s}") > 0, F.concat(F.lit(f"{s}:"), F.col(f"_s_{s}"))) for s in sorted(ACTIVATION_SOURCES)]))
    return out.withColumn("events_by_surface", surfaces).drop(*[f"_s_{s}" for s in ACTIVATION_SOURCES]).orderBy(
        F.desc("cohort_week"))


def trust_tier_distribution(events: DataFrame, since: Column) -> DataFrame:
    """Stated tier, else degraded search when the search state was not ready."""
    rows = events.where((F.col("occurred_at") >= since) & F.col("source").isin(*ACTIVATION_SOURCES))
    stated, state = F.get_json_object("payload", "$.trust_tier"), F.get_json_object("payload", "$.search_state")
    tier = F.when(stated != "", stated).when(state != "ready", "degraded_search")
    tiers = rows.select(tier.alias("trust_tier")).where(F.col("trust_tier").isNotNull())
    return tiers.groupBy("trust_tier").agg(F.count(F.lit(1)).alias("events"))


def _active_members(members: DataFrame) -> DataFrame:
    return members.where(F.col("status") == "active").select("cohort_id", "user_id").distinct()


def _cohort_sizes(cohorts: DataFrame, members: DataFrame) -> DataFrame:
    sizes = _active_members(members).groupBy("cohort_id").agg(F.count(F.lit(1)).alias("member_count"))
    return cohorts.select("cohort_id").join(sizes, "cohort_id", "left").withColumn(
        "member_count", F.coalesce("member_count", F.lit(0)))


def cohort_sizes(cohorts: DataFrame, members: DataFrame, min_cohort: int) -> DataFrame:
    """Size, shown bucket and suppression of each cohort."""
    n = F.col("member_count")
    return _cohort_sizes(cohorts, members).withColumns({
        "bucket": F.when(n < min_cohort, f"<{min_cohort}").otherwise(n.cast("string")), "suppressed": n < min_cohort,
        "reason": F.when(n < min_cohort, "small_cohort"),
    })


def _metric_users(profiles, plans, actions, outcomes, subscriptions, events, since: Column) -> DataFrame:
    """Distinct (user_id, metric) over all sources."""
    def tag(df: DataFrame, metric: str) -> DataFrame:
        return df.select("user_id", F.lit(metric).alias("metric"))

    by_plan = actions.groupBy("plan_id").agg(
        F.max(F.col("status").isin("planned", "in_progress", "done")).alias("_started"),
        F.max(F.col("status") == "done").alias("_done"), F.max(F.col("action_type") == "saved_vacancy").alias("_saved"))
    planned = plans.join(by_plan, plans["id"] == by_plan["plan_id"], "left")
    names = F.array_compact(F.array(
        F.lit("plan_created_rate"), F.when(F.col("_started"), "plan_action_started_rate"),
        F.when(F.col("_done"), "plan_action_done_rate"), F.when(F.col("_saved"), "saved_vacancy_rate")))
    of_event = F.array_compact(F.array(*[F.when(F.col("event_type").isin(*types), m) for m, types in EVENT_METRICS.items()]))
    seen = events.where(F.col("occurred_at") >= since).select("user_id", F.explode(of_event).alias("metric"))
    return _union([
        tag(profiles, "profile_completion_rate"), planned.select("user_id", F.explode(names).alias("metric")),
        tag(outcomes, "application_outcome_rate"), tag(subscriptions.where(flag("active")), "digest_subscription_rate"), seen,
    ]).distinct()


def cohort_analytics(
    cohorts: DataFrame, members: DataFrame, profiles: DataFrame, plans: DataFrame, actions: DataFrame, outcomes: DataFrame,
    subscriptions: DataFrame, events: DataFrame, since: Column, min_cohort: int,
) -> DataFrame:
    """Twelve metric rows per cohort that is large enough; no user identifier leaves the operator."""
    facts = _metric_users(profiles, plans, actions, outcomes, subscriptions, events, since)
    counts = _active_members(members).join(facts, "user_id").groupBy("cohort_id", "metric").agg(F.count(F.lit(1)).alias("count"))
    shown = cohort_sizes(cohorts, members, min_cohort).where(~F.col("suppressed"))
    grid = shown.select("cohort_id", "member_count", F.explode(F.array(*[F.lit(m) for m in COHORT_METRICS])).alias("metric"))
    out = grid.join(counts, ["cohort_id", "metric"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rate = F.when(F.col("member_count") > 0, F.bround(F.col("count") / F.col("member_count"), 4)).otherwise(0.0)
    return out.select("cohort_id", "metric", "count", F.col("member_count").alias("denominator"), rate.alias("rate"))


def cohort_skill_heatmap(
    cohorts: DataFrame, members: DataFrame, profiles: DataFrame, plans: DataFrame, actions: DataFrame, min_cohort: int, min_cell: int
) -> DataFrame:
    """Users per open skill-gap skill, top 25 per cohort; small cells are nulled."""
    open_gaps = actions.where(
        (F.col("recommendation_source") == "skill_gap") & F.col("skill_name").isNotNull() & F.col("status").isin(*OPEN_STATUSES))
    pairs = open_gaps.join(plans.select(F.col("id").alias("plan_id"), "user_id"), "plan_id").select("user_id", "skill_name").distinct()
    people = _active_members(members)
    cells = people.join(pairs, "user_id").groupBy("cohort_id", "skill_name").agg(F.count(F.lit(1)).alias("_n"))
    rank = Window.partitionBy("cohort_id").orderBy(F.desc("_n"), "skill_name")
    top = cells.withColumn("position", F.row_number().over(rank)).where(F.col("position") <= HEATMAP_SKILLS)
    aims = profiles.where(F.col("target_role").isNotNull()).select("user_id", "target_role").distinct()
    roles = people.join(aims, "user_id").groupBy("cohort_id", "target_role").agg(F.count(F.lit(1)).alias("_r"))
    modal = roles.groupBy("cohort_id").agg(F.min_by("target_role", F.struct(-F.col("_r"), F.col("target_role"))).alias("target_role"))
    shown = cohort_sizes(cohorts, members, min_cohort).where(~F.col("suppressed")).select("cohort_id", "member_count")
    small = F.col("_n") < min_cell
    return top.join(shown, "cohort_id").join(modal, "cohort_id", "left").select(
        "cohort_id", "position", F.col("skill_name").alias("skill"), "member_count", F.when(~small, F.col("_n")).alias("users"),
        F.when(~small, F.bround(F.col("_n") / F.col("member_count"), 4)).alias("share"), "target_role", small.alias("suppressed"))


def user_overview(users: DataFrame, profiles: DataFrame, subscriptions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of users with their flags; only the page is joined."""
    page = users.orderBy("id").offset(offset).limit(limit)
    has = profiles.select(F.col("user_id").alias("id")).distinct().withColumn("_p", F.lit(True))
    subs = subscriptions.select(F.col("user_id").alias("id")).distinct().withColumn("_s", F.lit(True))
    return page.join(has, "id", "left").join(subs, "id", "left").select(
        "id", "created_at", flag("_p").alias("has_profile"), flag("_s").alias("has_subscription"))


def _last_sent(digests: DataFrame) -> DataFrame:
    return digests.groupBy("user_id").agg(F.max("sent_at").alias("last_sent_at"))


def _since_digest(rows: DataFrame, digests: DataFrame) -> DataFrame:
    joined = rows.join(_last_sent(digests), "user_id", "left")
    return joined.where(F.col("last_sent_at").isNull() | (F.col("occurred_at") > F.col("last_sent_at")))


def activity_since_last_digest(events: DataFrame, digests: DataFrame) -> DataFrame:
    """Events per user and type after the last digest, all of them if there was none."""
    return _since_digest(events, digests).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("events"))


def outcomes_since_last_digest(outcomes: DataFrame, digests: DataFrame, n: int = 5) -> DataFrame:
    """The latest outcomes per user after the last digest."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("occurred_at"), F.desc("id"))
    rows = _since_digest(outcomes, digests).withColumn("position", F.row_number().over(newest))
    return rows.where(F.col("position") <= n)


def stale_actions(actions: DataFrame, plans: DataFrame, now: Column, n: int = 3) -> DataFrame:
    """Open actions past due or untouched for two weeks, the first by due date per plan."""
    untouched = F.coalesce(F.col("updated_at") <= now - F.expr(f"INTERVAL {STALE_DAYS} DAYS"), F.lit(False))
    late = F.coalesce(F.col("due_date") < now.cast("date"), F.lit(False))
    rows = actions.where(F.col("status").isin(*OPEN_STATUSES) & (late | untouched))
    rows = rows.join(plans.select(F.col("id").alias("plan_id"), "user_id"), "plan_id")
    order = Window.partitionBy("plan_id").orderBy(F.asc_nulls_last("due_date"), F.asc_nulls_last("updated_at"), "id")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def plan_refresh_gaps(recommended: DataFrame, plans: DataFrame, actions: DataFrame) -> DataFrame:
    """Of the first five recommended skills those without an active generated action, first three.

    ``recommended``: user_id, recommended_skills.
    """
    first = recommended.select("user_id", F.posexplode(F.slice("recommended_skills", 1, 5)).alias("_pos", "skill"))
    active = actions.where((F.col("recommendation_source") == "skill_gap") & ~F.col("status").isin(*CLOSED_STATUSES))
    covered = active.join(plans.select(F.col("id").alias("plan_id"), "user_id"), "plan_id").select(
        "user_id", F.lower(F.trim(F.coalesce("skill_name", F.lit("")))).alias("_key")).distinct()
    left = first.withColumn("_key", F.lower(F.trim("skill"))).join(covered, ["user_id", "_key"], "left_anti")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "skill"))), lambda e: e["skill"])
    return left.groupBy("user_id").agg(F.slice(listed, 1, 3).alias("missing_skills"))


_PROFILE_CHECKS = {
    "target_role": ["target_role"], "target_grade": ["target_grade"],
    "target_geo": ["target_city_tier", "target_country", "target_region", "target_city", "target_geo_scope"],
    "target_work_mode": ["target_work_mode"], "target_domain": ["target_domain"],
}


def profile_quality(profiles: DataFrame) -> DataFrame:
    """Score and missing fields of six checks."""
    def filled(names: Sequence[str]) -> Column:
        present = [F.coalesce(F.col(n) != "", F.lit(False)) for n in names if n in profiles.columns]
        out = F.lit(False)
        for p in present:
            out = out | p
        return out

    checks = {name: filled(columns) for name, columns in _PROFILE_CHECKS.items()}
    checks["current_skills"] = F.coalesce(F.size("current_skills") > 0, F.lit(False))
    missing = F.array_compact(F.array(*[F.when(~c, n) for n, c in checks.items()]))
    done = F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))
    out = profiles.withColumns({"missing_fields": missing, "completed_fields": done})
    return out.withColumns({
        "score": F.bround(F.size("completed_fields") / len(checks) * 100, 0).cast("int"),
        "is_complete": F.size("missing_fields") == 0,
    })


def next_best_action(
    users: DataFrame, profiles: DataFrame, plans: DataFrame, actions: DataFrame, subscriptions: DataFrame, data_ready: Column
) -> DataFrame:
    """The first state of nine that applies to each user."""
    quality = profile_quality(profiles).select("user_id", "score", "is_complete")
    order = F.struct("priority", "id")
    is_open = (F.col("action_type") != "saved_vacancy") & F.col("status").isin(*OPEN_STATUSES)
    is_saved = F.col("action_type") == "saved_vacancy"
    first = actions.groupBy(F.col("plan_id").alias("_plan")).agg(
        F.min(F.when(is_open, F.struct(order.alias("o"), F.col("id").alias("id"), F.col("title").alias("title")))).alias("_open"),
        F.min(F.when(is_saved, F.struct(order.alias("o"), F.col("id").alias("id"), F.col("application_status").alias("state")))).alias("_saved"))
    planned = plans.select(F.col("id").alias("_plan"), "user_id").join(first, "_plan", "left")
    subs = subscriptions.groupBy("user_id").agg(F.max(flag("active")).alias("_active"))
    rows = (
        users.select(F.col("id").alias("user_id")).join(quality, "user_id", "left").join(planned, "user_id", "left")
        .join(subs, "user_id", "left"))
    waiting = F.col("_saved.state").isNull() | (F.col("_saved.state") == "saved")
    state = (
        F.when(F.col("is_complete").isNull(), "create_profile").when(~F.col("is_complete"), "complete_profile")
        .when(~data_ready, "data_unavailable").when(F.col("_plan").isNull(), "create_plan")
        .when(F.col("_open").isNull(), "generate_plan_actions").when(F.col("_saved").isNull(), "find_vacancy")
        .when(waiting, "update_application_outcome").when(~flag("_active"), "enable_digest").otherwise("continue_plan"))
    target = F.when(F.col("state") == "update_application_outcome", F.col("_saved.id")).when(
        F.col("state") == "continue_plan", F.col("_open.id"))
    return rows.withColumn("state", state).select(
        "user_id", "state", target.alias("action_id"), F.coalesce("score", F.lit(0)).alias("profile_score"))


def generate_plan_actions(
    gaps: DataFrame, plans: DataFrame, actions: DataFrame, today: Column, limit: int, run_id: str | None = None
) -> DataFrame:
    """New action rows for recommended skills that are not already open.

    ``gaps``: user_id, recommended_skills, target_role and evidence
    (map skill -> market share). The position in the list sets priority and due date.
    """
    owned = plans.select(F.col("id").alias("plan_id"), "user_id")
    asked = gaps.join(owned, "user_id").select(
        "plan_id", "target_role", "evidence", F.posexplode(F.slice("recommended_skills", 1, limit)).alias("_i", "skill_name"))
    asked = asked.withColumn("_key", F.lower(F.trim("skill_name"))).where(F.col("_key") != "")
    busy = actions.where(~F.col("status").isin(*CLOSED_STATUSES) & (F.col("skill_name") != "")).select(
        "plan_id", F.lower(F.trim("skill_name")).alias("_key")).distinct()
    # a skill named twice in one list is added once, at its first place; the list has at most ``limit`` entries
    first = Window.partitionBy("plan_id", "_key").orderBy("_i")
    fresh = asked.join(busy, ["plan_id", "_key"], "left_anti").withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    index = F.col("_i") + 1
    return fresh.select(
        "plan_id", F.format_string("Close %s skill gap", "skill_name").alias("title"), F.lit("learning").alias("action_type"),
        F.lit("planned").alias("status"), (index * 10).alias("priority"), "skill_name",
        F.lit("skill_gap").alias("recommendation_source"), F.lit(run_id).cast("string").alias("dataset_run_id"),
        F.format_string("%s is a recommended gap for %s.", F.col("skill_name"),
                        F.coalesce(F.when(F.col("target_role") != "", F.col("target_role")), F.lit("the target role"))).alias("reason"),
        F.date_add(today, index * GENERATED_STEP_DAYS).alias("due_date"),
        F.struct(F.col("skill_name"), F.col("evidence")[F.col("skill_name")].alias("market_share")).alias("evidence"))


def apply_outcomes(actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The fold of outcome events in time order, as aggregates per action.

    A terminal event fixes the status whatever follows it without another
    terminal one; ``applied`` and ``interview`` only move a planned action.
    """
    terminal = F.col("status").isin("offer", "rejected", "withdrawn")
    moving = F.col("status").isin("applied", "interview")
    order = F.struct("occurred_at", "id")
    folded = outcomes.groupBy("action_id").agg(
        F.max_by("status", order).alias("_last"),
        F.max(F.when(terminal, F.struct("occurred_at", "id", "status"))).alias("_terminal"),
        F.min(F.when(terminal, F.col("occurred_at"))).alias("_first_terminal"), F.max(moving).alias("_moving"))
    rows = actions.join(folded, actions["id"] == folded["action_id"], "left").drop("action_id")
    status = (
        F.when(F.col("_terminal.status") == "offer", "done").when(F.col("_terminal").isNotNull(), "skipped")
        .when(flag("_moving") & (F.col("status") == "planned"), "in_progress").otherwise(F.col("status")))
    return rows.withColumns({
        "application_status": F.coalesce("_last", "application_status"), "status": status,
        "completed_at": F.coalesce("completed_at", "_first_terminal"),
    }).drop("_last", "_terminal", "_first_terminal", "_moving")


def due_subscriptions(subscriptions: DataFrame, now: Column) -> DataFrame:
    """Active, right local weekday, local time reached, not sent on that local day.

    A subscription whose zone is NULL or not known is not due; it fails no others.
    """
    # a time with a zone is read only where the zone is known
    named = F.when(F.trim("timezone") != "", F.trim("timezone"))
    zone = F.when(F.concat(F.lit("2000-01-01 00:00:00 "), named).try_cast("timestamp").isNotNull(), named)
    local = F.from_utc_timestamp(now, zone)
    sent = F.from_utc_timestamp(F.col("last_sent_at"), zone)
    due = (
        flag("active") & (F.weekday(local) == F.col("weekday")) & (F.date_format(local, "HH:mm") >= F.col("time_local"))
        & (F.col("last_sent_at").isNull() | (sent.cast("date") != local.cast("date"))))
    return subscriptions.where(due).select("user_id", "weekday", "time_local", "timezone", "last_sent_at")


def slug(text: Column) -> Column:
    """Letters and digits joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-zA-Z0-9а-яА-ЯёЁ]+", "_"), "^_+|_+$", "")


def evidence_rows(
    analysis: DataFrame, gaps: DataFrame, plans: DataFrame, actions: DataFrame, states: DataFrame
) -> DataFrame:
    """J16 as (user_id, evidence_id, evidence_type, value, confidence).

    ``analysis``: user_id, vacancy_count, confidence. ``gaps``: user_id,
    skill_name, market_share, gap. ``states``: user_id, search_state.
    """
    sample = analysis.select(
        "user_id", F.lit("market:segment_sample").alias("evidence_id"), F.lit("market_summary").alias("evidence_type"),
        F.col("vacancy_count").cast("string").alias("value"), "confidence")
    by_share = Window.partitionBy("user_id").orderBy(F.desc("market_share"), F.lower("skill_name"))
    top = gaps.where("gap").withColumn("_rn", F.row_number().over(by_share)).where("_rn <= 8")
    label = analysis.select("user_id", "confidence")
    skills = top.join(label, "user_id").select(
        "user_id", F.concat(F.lit("skill_gap:"), slug(F.col("skill_name"))).alias("evidence_id"),
        F.lit("skill_gap").alias("evidence_type"), F.col("skill_name").alias("value"), "confidence")
    is_open = F.col("status").isin(*OPEN_STATUSES) & (F.col("action_type") != "saved_vacancy")
    by_priority = Window.partitionBy("plan_id").orderBy("priority", "id")
    following = actions.where(is_open).withColumn("_rn", F.row_number().over(by_priority)).where("_rn <= 3")
    steps = following.join(plans.select(F.col("id").alias("plan_id"), "user_id"), "plan_id").join(label, "user_id").select(
        "user_id", F.concat(F.lit("plan_action:"), F.col("id")).alias("evidence_id"), F.lit("plan_action").alias("evidence_type"),
        F.col("title").alias("value"), "confidence")
    search = states.where(F.col("search_state") != "ready").join(label, "user_id", "left_semi").select(
        "user_id", F.lit("search:runtime_state").alias("evidence_id"), F.lit("search_runtime").alias("evidence_type"),
        F.col("search_state").alias("value"), F.lit("high").alias("confidence"))
    return _union([sample, skills, steps, search])


def blocked_claims(eligible: Mapping[str, Column], date_status: Column, search_state: Column) -> Column:
    """Sorted claims that may not be made. ``eligible``: salary, trends, recommendations."""
    def no(name: str) -> Column:
        return ~F.coalesce(eligible[name], F.lit(False))

    return F.array_sort(F.array_compact(F.array(
        F.when(no("salary"), "salary_claims"),
        F.when(no("trends") | F.coalesce(date_status != "passed", F.lit(False)), "historical_trend_claims"),
        F.when(no("recommendations"), "strong_recommendation_claims"),
        F.when(search_state != "ready", "strong_vacancy_fit_claims"))))


def billing_history(events: DataFrame) -> DataFrame:
    """First copy of each provider event, marked when older than one already processed.

    The running maximum is taken per day of processing first: a subscription with
    very many events is cut into days, and only its daily maxima share a window.
    """
    seen = Window.partitionBy("provider", "provider_event_id").orderBy("processed_at", "event_id")
    once = events.withColumn("_rn", F.row_number().over(seen)).where("_rn = 1").drop("_rn")
    once = once.withColumn("_day", F.col("processed_at").cast("date"))
    key = ["user_id", "provider", "provider_subscription_id"]
    daily = once.where(F.col("provider_subscription_id").isNotNull()).groupBy(*key, "_day").agg(F.max("occurred_at").alias("_max"))
    before = Window.partitionBy(*key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.withColumn("_before", F.max("_max").over(before)).drop("_max")
    inside = Window.partitionBy(*key, "_day").orderBy("processed_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = once.withColumn("_today", F.max("occurred_at").over(inside)).join(daily, [*key, "_day"], "left")
    latest = F.when(F.col("provider_subscription_id").isNotNull(), F.greatest("_before", "_today"))
    late = F.coalesce(F.col("occurred_at") < latest, F.lit(False))
    return rows.withColumn("out_of_order", late).drop("_day", "_before", "_today")


def subscription_state(events: DataFrame) -> DataFrame:
    """The last accepted event of each user is the state."""
    accepted = billing_history(events).where(~F.col("out_of_order"))
    last = F.max(F.struct("processed_at", "event_id", "plan", "subscription_state")).alias("_last")
    return accepted.groupBy("user_id").agg(last).select("user_id", "_last.plan", "_last.subscription_state", "_last.event_id")


def plan_progress(actions: DataFrame, n: int = 3) -> DataFrame:
    """Done and all actions per plan, and its next open ones."""
    counts = actions.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("actions"), F.sum((F.col("status") == "done").cast("long")).alias("done"))
    order = Window.partitionBy("plan_id").orderBy("priority", "id")
    following = actions.where(~F.col("status").isin(*CLOSED_STATUSES)).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= n)
    names = F.transform(F.array_sort(F.collect_list(F.struct("_i", "title"))), lambda e: e["title"])
    ahead = following.groupBy("plan_id").agg(names.alias("next_actions"))
    return counts.join(ahead, "plan_id", "left").withColumn(
        "next_actions", F.coalesce("next_actions", F.array().cast("array<string>")))


def canonical_recommendations(analysis: DataFrame) -> DataFrame:
    """Recommended skills of persona analyses under the names plans use."""
    return analysis.select(F.col("persona_id").alias("user_id"), F.transform("recommended_skills", clean_skill).alias("recommended_skills"))
