"""Normalisation of names, identifiers, levels, dates and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.columns import first_match

# --- fixed values ----------------------------------------------------------

GRADE_ORDER = ["intern", "junior", "junior+", "middle", "senior", "lead", "architect", "unknown"]
ENGLISH_ORDER = ["no_english", "a2", "b1", "b2", "c1_plus", "unknown"]
ENGLISH_LEVELS = [
    ("no_english", ["none", "no"]),
    ("a2", ["basic", "a2", "elementary", "pre-intermediate"]),
    ("b1", ["intermediate", "b1"]),
    ("b2", ["upper_intermediate", "upper-intermediate", "upper intermediate", "b2"]),
    ("c1_plus", ["advanced", "fluent", "c1", "c2", "native", "proficient"]),
]
ID_ALIASES = ("hh_vacancy_id", "vacancy_id", "id")

# ---------------------------------------------------------------------------


def clean_skill(name: Column) -> Column:
    """Trimmed, lower case, without the flag prefix."""
    return F.regexp_replace(F.lower(F.trim(name)), "^(skill_|has_)", "")


def clean_skill_array(names: Column) -> Column:
    """Cleaned, blanks removed, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(names, clean_skill), lambda s: s != ""))


def split_known_skills(names: Column, known: Column) -> tuple[Column, Column]:
    """(valid, invalid) cleaned names against an array of known names."""
    cleaned = clean_skill_array(names)
    return F.array_intersect(cleaned, known), F.array_except(cleaned, known)


def parse_skill_list(value: Column) -> Column:
    """JSON array text or comma list -> array of names without blanks."""
    text = F.trim(value)
    decoded = F.from_json(F.when(text.startswith("["), text), "array<string>")
    parts = F.coalesce(decoded, F.split(text, ","))
    named = F.transform(parts, lambda s: F.regexp_replace(F.trim(s), "^(skill_|has_)", ""))
    return F.coalesce(F.filter(named, lambda s: s != ""), F.array().cast("array<string>"))


def normalize_english_level(level: Column, required: Column) -> Column:
    """A requirement that is explicitly false wins."""
    text = F.lower(F.trim(level))
    return first_match(
        [(F.coalesce(~required, F.lit(False)), "no_english")]
        + [(F.coalesce(text.isin(*names), F.lit(False)), bucket) for bucket, names in ENGLISH_LEVELS],
        "unknown",
    )


def normalize_education_level(level: Column, required: Column, technical: Column) -> Column:
    """C35."""
    text = F.coalesce(F.lower(F.trim(level)), F.lit(""))
    return first_match([
        (text == "master_or_higher", "master_phd"),
        (F.coalesce(technical, F.lit(False)), "technical_only"),
        (F.coalesce(required, F.lit(False)) | text.isin("any_he", "bachelor_or_higher", "partial_higher"), "any_degree"),
    ], "no_degree_required")


def parse_date_value(value: Column) -> Column:
    """The leading ISO date of a text, or a compact yyyyMMdd, else NULL."""
    text = F.trim(value.cast("string"))
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    compact = F.regexp_extract(text, r"^(\d{8})($|T)", 1)
    return F.coalesce(
        F.try_to_timestamp(F.when(iso != "", iso), F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(F.when(compact != "", compact), F.lit("yyyyMMdd")),
    ).cast("date")


def first_date(*values: Column) -> Column:
    """First value that is a date."""
    return F.coalesce(*[parse_date_value(v) for v in values])


def canonical_key(source: Column, source_id: Column, url: Column, content: Sequence[Column]) -> Column:
    """Source and id, else hashed address, else hashed content; only "" counts as absent."""
    def some(c: Column) -> Column:
        return F.when(c != "", c)

    by_id = F.concat(F.lit("source:"), some(source), F.lit(":"), some(source_id))
    by_url = F.concat(F.lit("url:"), F.sha2(some(url), 256))
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in content])
    return F.coalesce(by_id, by_url, F.concat(F.lit("content:"), F.sha2(text, 256)))


def from_aliases(*values: Column) -> Column:
    """First value that is neither NULL nor blank."""
    return F.coalesce(*[F.when(F.trim(v.cast("string")) != "", v) for v in values])


def normalize_id(value: Column) -> Column:
    """Trimmed, digits lose a trailing ``.0``."""
    return F.regexp_replace(F.trim(value.cast("string")), r"^(\d+)\.0$", "$1")


def id_text(value: Column) -> Column:
    """C39 for numeric ids: whole numbers as digits, never in scientific notation."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def category_rank(value: Column, order: Sequence[str]) -> Column:
    """Position in the fixed order, values outside of it last."""
    position = F.array_position(F.array(*[F.lit(o) for o in order]), F.coalesce(value, F.lit("")))
    return F.when(position > 0, position).otherwise(F.lit(len(order) + 1))


def known_skills_in_text(text: Column, known: Sequence[str]) -> Column:
    """Known names found as whole tokens, in list order."""
    lowered = F.lower(text)
    found = []
    for name in known:
        quoted = "\\Q" + name.strip().lower() + "\\E"
        pattern = r"(?U)(?<![\w+.#-])" + quoted + r"(?![\w+.#-])"
        found.append(F.when(lowered.rlike(pattern), F.lit(name)))
    return F.array_compact(F.array(*found))


def known_tokens_in_text(texts, key: str, text: str, known):
    """C41 for long lists: tokenise and join, so the list may have any size.

    Only names without blanks can match a single token; ``known`` has columns
    ``skill`` and ``position``.
    """
    tokens = F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"(?U)[^\w+.#-]+")))
    pairs = texts.select(key, tokens.alias("_token")).where(F.col("_token") != "")
    names = known.select("skill", "position", F.lower(F.trim("skill")).alias("_token"))
    hits = pairs.join(names, "_token")
    ordered = F.array_sort(F.collect_list(F.struct("position", "skill")))
    return hits.groupBy(key).agg(F.transform(ordered, lambda e: e["skill"]).alias("skills"))
