"""Target segments with filter relaxation, skill demand and gaps for many personas at once.

A persona states up to eight target values; the segment is widened by dropping
filters in a fixed order until it is large enough. Instead of refiltering per
persona, postings are counted once per combination of target dimensions, rolled
up to the filter masks in use, and joined to the personas on (mask, values).
No posting is ever paired with a persona.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.columns import (
    GRADE_COLUMNS, SALARY_COLUMNS, first_existing, flag_int, market_skills, prefixed_flags, skill_label,
)
from postmill.functions.fixed_values import NOT_HARD_SKILLS
from postmill.operators.market import market_confidence, salary_metric
from postmill.operators.quantiles import quantiles_of_counts
from postmill.session import materialize

MIN_MARKET_ROWS = 80
SALARY_QUANTILES = {"salary_median": 0.5, "salary_q25": 0.25, "salary_q75": 0.75}

# persona column, posting column, in the order in which filters are dropped
RELAX_ORDER = (
    ("target_geo_scope", "geo_scope"), ("target_city", "city_normalized"), ("target_region", "region"),
    ("target_country", "country"), ("target_work_mode", "work_mode"), ("target_city_tier", "city_tier"),
    ("target_grade", "grade_final"), ("target_role", "primary_role"),
)


@dataclass(frozen=True)
class Dimension:
    target: str
    column: str
    present: bool


def _dimensions(df: DataFrame, constraints: Mapping[str, str]) -> list[Dimension]:
    grade = first_existing(df, *GRADE_COLUMNS) or "grade_final"
    pairs = [*constraints.items(), *RELAX_ORDER]
    return [
        Dimension(t, grade if c == "grade_final" else c, (grade if c == "grade_final" else c) in df.columns)
        for t, c in pairs
    ]


def _mask(dims: Sequence[Dimension], is_set) -> Column:
    bits = F.lit(0)
    for i, d in enumerate(dims):
        if d.present:
            bits = bits + F.when(is_set(d), F.lit(1 << i)).otherwise(0)
    return bits


def _key(dims: Sequence[Dimension], mask: Column, value) -> Column:
    """Struct of the mask and the values it keeps; equal structs are equal segments."""
    kept = [
        F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, value(d).cast("string")).alias(f"d{i}")
        for i, d in enumerate(dims) if d.present
    ]
    return F.struct(mask.alias("mask"), *kept)


def _with_targets(personas: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    missing = {d.target: F.lit(None).cast("string") for d in dims if d.target not in personas.columns}
    if "min_market_n" not in personas.columns:
        missing["min_market_n"] = F.lit(MIN_MARKET_ROWS)
    return personas.withColumns(missing) if missing else personas


def _levels(personas: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """One row per persona and number of dropped dimensions, with the masked segment key."""
    level = F.explode(F.sequence(F.lit(0), F.lit(len(dims)))).alias("_level")
    # spread first: a row becomes one per level, and a small table may be read by few tasks
    spread = personas.select("persona_id", "min_market_n", *[d.target for d in dims]).repartition("persona_id")
    out = spread.select("*", level)
    full = _mask(dims, lambda d: F.col(d.target).isNotNull())
    # clearing the lowest bits drops the filters that come first in the order
    out = out.withColumn("_mask", full.bitwiseAND(_power_complement(len(dims))))
    return out.withColumn("_key", _key(dims, F.col("_mask"), lambda d: F.col(d.target))).drop("_mask")


def _power_complement(n: int) -> Column:
    """Bits at or above the level."""
    whole = (1 << n) - 1
    chain = F.when(F.col("_level") == 0, F.lit(whole))
    for level in range(1, n + 1):
        chain = chain.when(F.col("_level") == level, F.lit(whole & ~((1 << level) - 1)))
    return chain


def _masks_in_use(levels: DataFrame) -> list[int]:
    """At most 2^dimensions small integers, whatever the number of personas."""
    return sorted(r[0] for r in levels.select(F.col("_key.mask")).distinct().collect())


def _roll_up(counts: DataFrame, dims: Sequence[Dimension], masks: Sequence[int]) -> DataFrame:
    """Repeat pre-aggregated rows per mask and attach the masked key."""
    repeated = counts.withColumn("_m", F.explode(F.array(*[F.lit(m) for m in masks])))
    return repeated.withColumn("_key", _key(dims, F.col("_m"), lambda d: F.col(d.column))).drop("_m")


def _columns(dims: Sequence[Dimension]) -> list[str]:
    return list(dict.fromkeys(d.column for d in dims if d.present))


def _combinations(df: DataFrame, dims: Sequence[Dimension], aggregates: Mapping[str, Column] | None = None) -> DataFrame:
    """Postings per combination of target dimensions; their number does not follow the postings."""
    extra = [c.alias(n) for n, c in (aggregates or {}).items()]
    return df.groupBy(*_columns(dims)).agg(F.count(F.lit(1)).alias("_rows"), *extra)


def _choose(combos: DataFrame, personas: DataFrame, dims: Sequence[Dimension]) -> tuple[DataFrame, list[int]]:
    """Chosen segment per persona, and the masks in use."""
    levels = _levels(personas, dims)
    masks = _masks_in_use(levels)
    sizes = _roll_up(combos.select(*_columns(dims), "_rows"), dims, masks).groupBy("_key").agg(F.sum("_rows").alias("_n"))
    sized = levels.join(sizes, "_key", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    enough = F.col("_n") >= F.col("min_market_n")
    # at most |dimensions| + 1 rows per persona, met once: the levels are not joined to themselves
    levels_of = Window.partitionBy("persona_id")
    sized = sized.where(F.col("persona_id").isNotNull()).withColumns({
        "_min": F.max("min_market_n").over(levels_of),
        "_n0": F.max(F.when(F.col("_level") == 0, F.col("_n"))).over(levels_of),
        "_all": F.max(F.when(F.col("_level") == len(dims), F.col("_n"))).over(levels_of),
        "_first": F.min(F.when(enough, F.col("_level"))).over(levels_of),
    })
    can_relax = (F.col("_min") > 0) & (F.col("_all") >= F.col("_min")) & (F.col("_n0") < F.col("_min"))
    chosen = sized.where(F.col("_level") == F.when(can_relax, F.coalesce("_first", F.lit(len(dims)))).otherwise(0))
    relaxed = F.array_compact(F.array(*[
        F.when(F.col(d.target).isNotNull() & (F.col("_level") > i), F.lit(d.column)) for i, d in enumerate(dims)
    ]))
    used = F.array_compact(F.array(*[
        F.when(F.col(d.target).isNotNull() & (F.col("_level") <= i), F.lit(d.column))
        for i, d in reversed(list(enumerate(dims))) if d.present
    ]))
    grade = next(d.column for d in dims if d.target == "target_grade")
    warnings = F.array_compact(F.array(
        F.when((F.col("min_market_n") > 0) & (F.col("_n0") == 0), "empty_segment"),
        F.when((F.col("min_market_n") > 0) & (F.col("_n") < F.col("min_market_n")), "small_segment"),
        F.when(F.size("relaxed_filters") > 0, "filters_relaxed"),
        F.when(F.array_contains("relaxed_filters", grade), "grade_filter_relaxed"),
    ))
    segments = chosen.withColumn("relaxed_filters", relaxed).select(
        "persona_id", "min_market_n", F.col("_n").alias("market_n"), "relaxed_filters",
        used.alias("filters_used"), warnings.alias("warnings"), "_key",
    )
    return segments, masks


def relax_filters(
    df: DataFrame, personas: DataFrame, constraints: Mapping[str, str] | None = None
) -> DataFrame:
    """Chosen segment per persona.

    Columns: persona_id, min_market_n, market_n, relaxed_filters, filters_used,
    warnings and ``_key``, the segment the persona is read from.
    """
    dims = _dimensions(df, constraints or {})
    return _choose(_combinations(df, dims), _with_targets(personas, dims), dims)[0]


def _per_segment(
    combos: DataFrame, dims: Sequence[Dimension], segments: DataFrame, masks: Sequence[int], roll: Mapping[str, str]
) -> DataFrame:
    """Combination aggregates rolled up to the chosen segments; ``roll`` is column -> sum, min or max."""
    wanted = segments.select("_key").distinct()
    rolled = _roll_up(combos.select(*_columns(dims), *roll), dims, masks).join(wanted, "_key", "left_semi")
    return rolled.groupBy("_key").agg(*[F.expr(f"{how}({n})").alias(n) for n, how in roll.items()])


def demand_skills(df: DataFrame, skills: Sequence[str] | None = None) -> list[str]:
    if skills is not None:
        return [c for c in skills if c in df.columns]
    return sorted(c for c in market_skills(df) if c not in NOT_HARD_SKILLS)


def _flag_sums(skills: Sequence[str]) -> dict[str, Column]:
    return {f"_s{i}": F.sum(flag_int(c)) for i, c in enumerate(skills)}


def _demand(
    df: DataFrame, combos: DataFrame, personas: DataFrame, segments: DataFrame, dims: Sequence[Dimension], masks: Sequence[int],
    skills: Sequence[str], min_share: float,
) -> DataFrame:
    names = {f"_s{i}": c for i, c in enumerate(skills)}
    flags = _per_segment(combos, dims, segments, masks, dict.fromkeys(["_rows", *names], "sum"))
    entries = F.array(*[
        F.struct(F.lit(c).alias("skill_name"), (F.col(k) / F.col("_rows")).alias("market_share"))
        for k, c in names.items()
    ])
    per_segment = flags.select("_key", F.explode(entries).alias("e")).select("_key", "e.*")
    per_segment = per_segment.where(F.col("market_share") >= min_share)
    out = segments.select("persona_id", "_key").join(per_segment, "_key").drop("_key")
    usual = F.col("skill_name").isin(*demand_skills(df)) if any(c not in demand_skills(df) for c in skills) else F.lit(True)
    if "skill_whitelist" in personas.columns:
        known = F.filter("skill_whitelist", lambda s: s.isin(*skills))
        out = out.join(personas.select("persona_id", known.alias("_allowed")), "persona_id").where(
            F.when(F.coalesce(F.size("_allowed"), F.lit(0)) > 0, F.array_contains("_allowed", F.col("skill_name"))).otherwise(usual)
        ).drop("_allowed")
    return out


def _skills_for(df: DataFrame, personas: DataFrame, skills: Sequence[str] | None) -> list[str]:
    """Flags to count; a whitelist may name skills that are left out by default."""
    if skills is None and "skill_whitelist" in personas.columns:
        return prefixed_flags(df, "skill_", "has_")
    return demand_skills(df, skills)


def skill_demand(
    df: DataFrame, personas: DataFrame, min_share: float = 0.05, skills: Sequence[str] | None = None,
    constraints: Mapping[str, str] | None = None,
) -> DataFrame:
    """(persona_id, skill_name, market_share) in the chosen segment."""
    dims = _dimensions(df, constraints or {})
    personas, names = _with_targets(personas, dims), _skills_for(df, personas, skills)
    combos = materialize(_combinations(df, dims, _flag_sums(names)), "combinations")
    segments, masks = _choose(combos, personas, dims)
    found = _demand(df, combos, personas, segments, dims, masks, names, min_share)
    return found.orderBy("persona_id", F.desc("market_share"), "skill_name")


def with_gap(demand: DataFrame, personas: DataFrame, top_n: int | None) -> DataFrame:
    """Has / gap flags; gaps first, then share; a persona has at most one row per skill column."""
    own = personas.select("persona_id", "current_skills")
    has = F.coalesce(F.array_contains("current_skills", F.col("skill_name")), F.lit(False))
    out = demand.join(own, "persona_id").withColumn("persona_has", has)
    out = out.withColumn("gap", ~F.col("persona_has")).drop("current_skills")
    order = Window.partitionBy("persona_id").orderBy(F.desc("gap"), F.desc("market_share"), "skill_name")
    out = out.withColumn("position", F.row_number().over(order))
    return out.where(F.col("position") <= top_n) if top_n is not None else out


def skill_gap(
    df: DataFrame, personas: DataFrame, min_share: float = 0.1, top_n: int | None = 20,
    skills: Sequence[str] | None = None, constraints: Mapping[str, str] | None = None,
) -> DataFrame:
    """E11."""
    return with_gap(skill_demand(df, personas, min_share, skills, constraints), personas, top_n)


def _skill_lists(
    df: DataFrame, personas: DataFrame, segments: DataFrame, stats: DataFrame, skills: Sequence[str], top_k: int
) -> DataFrame:
    """(persona_id, top_skills, recommended_skills) as ``_demand`` and ``with_gap`` rank them, from one short array per segment.

    ``stats`` has ``_offered``, the segment's demanded skills as (negative share, name): a persona's rows carry
    an array of at most one entry per flag instead of becoming one row per skill.
    """
    own = {"current_skills": F.col("current_skills")}
    if "skill_whitelist" in personas.columns:
        own["allowed"] = F.coalesce(F.filter("skill_whitelist", lambda s: s.isin(*skills)), F.array().cast("array<string>"))
    owned = personas.where(F.col("persona_id").isNotNull()).groupBy("persona_id").agg(
        F.collect_list(F.struct(*[c.alias(n) for n, c in own.items()])).alias("_own"))
    offered = segments.select("persona_id", "_key").join(stats.select("_key", "_offered"), "_key").groupBy("persona_id").agg(
        F.flatten(F.collect_list("_offered")).alias("_offered"))
    out = offered.join(owned, "persona_id")
    if "allowed" in own:
        usual = demand_skills(df)

        def wanted(o: Column) -> Column:
            return F.filter("_offered", lambda e: F.when(
                F.size(o["allowed"]) > 0, F.array_contains(o["allowed"], e["n"])).otherwise(e["n"].isin(*usual)))

        out = out.withColumn("_offered", F.flatten(F.transform("_own", wanted)))

    def missing(o: Column) -> Column:
        return F.filter("_offered", lambda e: ~F.coalesce(F.array_contains(o["current_skills"], e["n"]), F.lit(False)))

    def first_names(entries: Column) -> Column:
        return F.transform(F.slice(F.array_sort(entries), 1, top_k), lambda e: e["n"])

    # gaps come first among a persona's skills, so the first top_k gaps are the gaps of the first top_k
    return out.where(F.size("_offered") > 0).select(
        "persona_id", first_names(F.col("_offered")).alias("top_skills"),
        first_names(F.flatten(F.transform("_own", missing))).alias("recommended_skills"))


def analyze_personas(
    df: DataFrame, personas: DataFrame, top_k: int = 10, constraints: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per persona with segment summary, demanded and recommended skills."""
    dims = _dimensions(df, constraints or {})
    personas, skills = _with_targets(personas, dims), _skills_for(df, personas, None)
    salary = first_existing(df, *SALARY_COLUMNS)
    df = df.withColumn("_salary", salary_metric(df, salary) if salary else F.lit(None).cast("double"))
    scope = F.when(~F.col("geo_scope").isin("", "unknown"), F.col("geo_scope")) if "geo_scope" in df.columns else F.lit(
        None).cast("string")

    def flagged(name: str) -> Column:
        return F.sum(flag_int(name)) if name in df.columns else F.lit(None).cast("long")

    # the combinations serve sizes, shares and skills, so they are written once
    combos = materialize(_combinations(df, dims, {
        "_salaried": F.count("_salary"), "_remote": flagged("is_remote"), "_junior": flagged("is_junior_friendly"),
        "_scope_lo": F.min(scope), "_scope_hi": F.max(scope), **_flag_sums(skills),
    }), "combinations")
    segments, masks = _choose(combos, personas, dims)
    segments = materialize(segments, "segments")
    # only masks that were chosen, not those of every level
    masks = _masks_in_use(segments)
    flags = {f"_s{i}": c for i, c in enumerate(skills)}
    stats = _per_segment(combos, dims, segments, masks, {
        "_rows": "sum", "_salaried": "sum", "_remote": "sum", "_junior": "sum", "_scope_lo": "min", "_scope_hi": "max",
        **dict.fromkeys(flags, "sum"),
    })
    entries = F.array(*[F.struct((-F.col(k) / F.col("_rows")).alias("s"), F.lit(c).alias("n")) for k, c in flags.items()])
    stats = stats.withColumn("_offered", F.filter(entries, lambda e: -e["s"] >= 0.05)) if flags else stats.withColumn(
        "_offered", F.array().cast("array<struct<s:double,n:string>>"))
    # read by the quartiles' join and by the skill lists; one row per segment
    stats = materialize(stats.drop(*flags), "segment-stats")
    values = df.where(F.col("_salary").isNotNull()).groupBy(*_columns(dims), F.col("_salary").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    wanted = segments.select("_key").distinct()
    in_segment = _roll_up(values, dims, masks).join(wanted, "_key", "left_semi")
    quartiles = quantiles_of_counts(
        in_segment.groupBy("_key", "_v").agg(F.sum("_n").alias("_n")), SALARY_QUANTILES)
    lists = _skill_lists(df, personas, segments, stats, skills, top_k)
    rows, salaried = F.coalesce("_rows", F.lit(0)), F.coalesce("_salaried", F.lit(0))
    coverage = F.when(rows > 0, F.bround(salaried / rows, 6))
    label = market_confidence(rows, salaried, coverage)
    out = (
        segments.join(stats.drop("_offered").join(quartiles, "_key", "left"), "_key", "left")
        .join(lists, "persona_id", "left")
    )
    return out.select(
        "persona_id", rows.alias("vacancy_count"), salaried.alias("salary_sample_size"),
        coverage.alias("salary_coverage_share"), label.alias("confidence"), "min_market_n", *SALARY_QUANTILES,
        (F.col("_remote") / F.col("_rows")).alias("remote_share"),
        (F.col("_junior") / F.col("_rows")).alias("junior_friendly_share"),
        F.when(F.col("_scope_lo") == F.col("_scope_hi"), F.col("_scope_lo"))
        .when(F.col("_scope_lo") != F.col("_scope_hi"), "mixed").alias("geo_scope"),
        "top_skills", F.coalesce("recommended_skills", F.array().cast("array<string>")).alias("recommended_skills"),
        "filters_used", "relaxed_filters",
        F.when(label == "low", F.array_append("warnings", F.lit("low_confidence"))).otherwise(F.col("warnings"))
        .alias("warnings"),
    )


def canonical(name: Column) -> Column:
    """Skill name as shown to users."""
    return F.regexp_replace(F.lower(F.trim(name)), "^(skill_|has_)", "")


def persona_report(analysis: DataFrame, resources: DataFrame, trust: DataFrame | None = None) -> DataFrame:
    """Canonical, deduplicated recommendations with resources and trust columns.

    ``resources`` has skill, title, url, type; ``trust`` is a one-row table.
    """
    from postmill.sources.exports import attach_resources

    names = F.array_distinct(F.transform("recommended_skills", canonical))
    # read for its skills and for its rows, so the analysis is written once instead of computed twice
    shown = materialize(analysis.withColumn("recommended_skills", names), "analysis")
    # resource lists meet each name once, not each persona: only their sizes, one map of names, reach the rows
    skills = shown.select(F.explode("recommended_skills").alias("skill")).distinct()
    sizes = attach_resources(skills, resources).agg(
        F.map_from_entries(F.collect_list(F.struct("skill", F.size("resources")))).alias("_sizes"))
    entries = F.transform("recommended_skills", lambda s, i: F.struct(
        i.alias("_pos"), s.alias("skill"), F.try_element_at("_sizes", s).alias("n")))
    found = F.filter(entries, lambda e: e["n"].isNotNull())
    of_persona = F.when(F.col("persona_id").isNotNull(), F.flatten(F.collect_list("_found").over(Window.partitionBy("persona_id"))))
    linked = F.transform(F.array_sort(of_persona), lambda e: F.concat(e["skill"], F.lit(":"), e["n"]))
    out = shown.join(F.broadcast(sizes)).withColumn("_found", found).drop("_sizes").withColumn(
        "skill_resources", F.coalesce(linked, F.array().cast("array<string>"))).drop("_found")
    return out.join(F.broadcast(trust)) if trust is not None else out


def validate_persona_skills(personas: DataFrame, known: Sequence[str]) -> DataFrame:
    """C31 for personas: canonical skills split into valid and unknown names."""
    from postmill.functions.normalize import split_known_skills

    labels = F.array(*[F.lit(skill_label(k)) for k in known])
    valid, invalid = split_known_skills(F.col("current_skills"), labels)
    return personas.withColumns({"valid_skills": valid, "invalid_skills": invalid})
