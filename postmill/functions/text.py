r"""Signals read from posting text.

Java regular expressions are ASCII-only by default; every pattern that meets
Cyrillic text carries ``(?U)``. Text is always processed whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.columns import contains_any, first_match, flag, flag_int, total
from postmill.functions.features import word_count
from postmill.functions.fixed_values import (
    CURRENCY_HINTS, DATA_SKILL_WORDS, EDUCATION_LEVELS, EDUCATION_MATH_WORDS, EDUCATION_OPTIONAL_WORDS,
    EDUCATION_REQUIRED_WORDS, EDUCATION_TECHNICAL_WORDS, ENGLISH_LEVEL_PATTERNS, ENGLISH_WORDS, GRADE_PATTERNS,
    JUNIOR_WORDS, LEAD_STOP_PHRASES, MONTH_STEMS, OTHER_LANGUAGE_WORDS, SECTION_HEADINGS,
)

SPACES = "[\u00a0\u202f]"


def _found(value: Column) -> Column:
    """Regex group as text, NULL when nothing matched."""
    return F.when(value != "", value)


def strip(text: Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def salary_text(text: Column) -> Column:
    """struct(salary_from, salary_to, currency, salary_gross)."""
    clean = F.regexp_replace(text, SPACES, " ")
    lowered = F.lower(clean)
    gross = F.when(lowered.contains("на руки"), False).when(lowered.contains("до вычета"), True)
    currency = first_match([(clean.contains(hint), code) for hint, code in CURRENCY_HINTS], None)
    numbers = F.transform(
        F.regexp_extract_all(clean, F.lit(r"([0-9][0-9 ]*)"), F.lit(1)),
        lambda n: F.regexp_replace(n, "[^0-9]", "").try_cast("bigint"),
    )
    n = F.size(numbers)
    first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    low, high = clean.contains("от"), clean.contains("до")
    both = (low & high & (n >= 2)) | (~low & ~high & (n == 2))
    only_to = ~low & high
    salary_from = F.when(both, first).when(only_to, None).when(low | (n == 1), first)
    salary_to = F.when(both, second).when(only_to, first)
    return F.struct(
        salary_from.alias("salary_from"), salary_to.alias("salary_to"), currency.cast("string").alias("currency"),
        gross.alias("salary_gross"),
    )


def salary_features(low: Column, high: Column) -> Column:
    """struct(salary_mid, salary_range_width, salary_is_exact)."""
    both = low.isNotNull() & high.isNotNull()
    one = F.coalesce(low, high).cast("double")
    return F.struct(
        F.when(both, (low + high) / 2).otherwise(one).alias("salary_mid"),
        F.when(both, high - low).when(one.isNotNull(), 0).alias("salary_range_width"),
        (~both & one.isNotNull()).alias("salary_is_exact"),
    )


def address_features(address: Column) -> Column:
    """C17: struct(has_metro, metro_primary, metro_count, address_has_district)."""
    stations = F.transform(
        F.regexp_extract_all(address, F.lit(r"(?iu)(?:м\.|метро)\s*([^,;]+)"), F.lit(1)), strip
    )
    return F.struct(
        (F.size(stations) > 0).alias("has_metro"),
        F.coalesce(F.get(stations, F.lit(0)), F.lit("")).alias("metro_primary"),
        F.size(stations).alias("metro_count"),
        address.rlike("(?iu)(р-н|район|АО)").alias("address_has_district"),
    )


def experience_range(text: Column) -> Column:
    """struct(exp_min_years, exp_max_years, exp_is_no_experience)."""
    lowered = F.lower(text)
    none = lowered.contains("не требуется")
    one = contains_any(lowered, ["1–3", "1-3"])
    three = contains_any(lowered, ["3–6", "3-6"])
    six = contains_any(lowered, ["более 6", "6+"])
    return F.struct(
        F.when(none, 0).when(one, 1).when(three, 3).when(six, 6).alias("exp_min_years"),
        F.when(none, 0).when(one, 3).when(three, 6).alias("exp_max_years"),
        none.alias("exp_is_no_experience"),
    )


def detect_grade(text: Column) -> Column:
    """C19."""
    lowered = F.lower(text)
    for phrase in LEAD_STOP_PHRASES:
        lowered = F.replace(lowered, F.lit(phrase), F.lit(""))
    return first_match(
        [(lowered.rlike("(?U)" + "|".join(patterns)), grade) for grade, patterns in GRADE_PATTERNS], "unknown"
    )


def keyword_flags(text: Column, words: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """C20: flag -> any of its words occurs in the lower-cased text."""
    lowered = F.lower(text)
    return {name: contains_any(lowered, [w.lower() for w in ws]) for name, ws in words.items()}


def data_skill_counts(tech: Sequence[str], data: Sequence[str], skills: Column) -> dict[str, Column]:
    """Counters over existing flag columns; unlike C8, BI and languages count once."""
    def has(name: str) -> Column:
        return flag(name) if name in (*tech, *data) else F.lit(False)

    core = [
        has("skill_sql"), has("skill_excel"), has("skill_powerbi") | has("skill_tableau"),
        has("has_python") | has("skill_r"),
    ]
    ml = [
        has("has_sklearn"), has("has_pytorch"), has("has_tensorflow"), has("has_airflow") | has("skill_airflow"),
        has("has_spark"), has("has_kafka"),
    ]
    return {
        "skills_count": F.size(skills),
        "core_data_skills_count": total(c.cast("int") for c in core),
        "ml_stack_count": total(c.cast("int") for c in ml),
        "tech_stack_size": total(flag_int(c) for c in [*tech, *data]),
    }


def data_skill_flags(title: Column, description: Column, skills: Column) -> dict[str, Column]:
    """Flags over title, description and the skill list."""
    return keyword_flags(F.concat_ws("\n", title, description, F.array_join(skills, " ")), DATA_SKILL_WORDS)


def education_signals(text: Column) -> Column:
    """struct(edu_required, edu_level, edu_technical, edu_math_or_cs)."""
    lowered = F.lower(text)
    required = (
        F.when(contains_any(lowered, EDUCATION_REQUIRED_WORDS), True)
        .when(contains_any(lowered, EDUCATION_OPTIONAL_WORDS), False)
    )
    level = first_match(
        [(lowered.contains(word), name) for word, name in EDUCATION_LEVELS]
        + [(F.coalesce(~required, F.lit(False)), "none")], None,
    )
    return F.struct(
        required.alias("edu_required"),
        level.cast("string").alias("edu_level"),
        F.when(contains_any(lowered, EDUCATION_TECHNICAL_WORDS), True).alias("edu_technical"),
        F.when(contains_any(lowered, EDUCATION_MATH_WORDS), True).alias("edu_math_or_cs"),
    )


def language_signals(text: Column) -> Column:
    """struct(lang_english_required, lang_english_level, lang_other_count)."""
    lowered = F.lower(text)
    english = contains_any(lowered, ENGLISH_WORDS)
    level = first_match([(lowered.rlike(p), name) for p, name in ENGLISH_LEVEL_PATTERNS], None).cast("string")
    return F.struct(
        english.alias("lang_english_required"),
        F.when(~english, "none").otherwise(level).alias("lang_english_level"),
        total(lowered.contains(w).cast("int") for w in OTHER_LANGUAGE_WORDS).alias("lang_other_count"),
    )


def split_sections(
    df: DataFrame, text: str, headings: Sequence[tuple[str, Sequence[str]]] = SECTION_HEADINGS
) -> DataFrame:
    """A heading line switches the section, other lines join the current one.

    Heading positions are found first and the lines between two headings are
    sliced out, so the work is linear in the text and needs no shuffle.
    """
    def kind(line: Column) -> Column:
        lowered = F.lower(line)
        return first_match([(contains_any(lowered, words), name) for name, words in headings], None).cast("string")

    marked = F.transform("_lines", lambda line, i: F.struct(i.alias("at"), kind(line).alias("kind")))
    df = df.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    df = df.withColumn("_heads", F.filter(marked, lambda h: h["kind"].isNotNull()))
    df = df.withColumn("_blocks", F.transform("_heads", lambda h, j: F.struct(
        h["kind"].alias("kind"),
        F.slice("_lines", h["at"] + 2,
                F.coalesce(F.get("_heads", j + 1)["at"], F.size("_lines")) - h["at"] - 1).alias("lines"),
    )))
    out = {}
    for name, _ in headings:
        own = F.flatten(F.transform(F.filter("_blocks", lambda b: b["kind"] == name), lambda b: b["lines"]))
        out[name] = F.array_join(F.transform(own, lambda line: F.concat(line, F.lit("\n"))), "")
    return df.withColumns(out).drop("_lines", "_heads", "_blocks")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\R")


def bullet_count(text: Column) -> Column:
    """Lines that start with a dash, an asterisk or a bullet."""
    return F.size(F.filter(_lines(text), lambda line: line.rlike(r"(?U)^\s*[-*•]")))


def description_stats(text: Column) -> Column:
    """struct(chars, words, bullets, paragraphs)."""
    lines = _lines(text)

    def blank(line: Column) -> Column:
        return ~line.rlike(r"(?U)\S")

    starts = F.size(F.filter(
        lines, lambda line, i: ~blank(line) & ((i == 0) | blank(F.coalesce(F.get(lines, i - 1), F.lit(""))))
    ))
    some = F.length(F.coalesce(text, F.lit(""))) > 0
    return F.struct(
        F.length(F.coalesce(text, F.lit(""))).alias("description_len_chars"),
        word_count(text).alias("description_len_words"),
        bullet_count(text).alias("description_bullets_count"),
        F.when((starts == 0) & some, 1).otherwise(starts).alias("description_paragraphs_count"),
    )


def skill_hits(section: Column, flags: Sequence[str]) -> Column:
    """True flags whose bare name occurs in the section."""
    lowered = F.lower(F.coalesce(section, F.lit("")))
    bare = {c: c.replace("has_", "").replace("skill_", "") for c in flags}
    return total((flag(c) & lowered.contains(name)).cast("int") for c, name in bare.items())


def published_date(text: Column, now: Column) -> Column:
    """struct(published_at_iso, vacancy_age_days) from relative and written dates."""
    lowered = F.lower(text)
    today = now.cast("date")
    ago = _found(F.regexp_extract(lowered, r"(\d+)\s+дн", 1)).try_cast("int")

    def day(y: Column, m: Column, d: Column) -> Column:
        written = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        return F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).cast("date")

    dotted = r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
    by_dots = F.when(text.rlike(dotted), day(*[F.regexp_extract(text, dotted, g) for g in (3, 2, 1)]))
    named = r"(\d{1,2})\s+([A-я]+)(?:\s+(\d{4}))?"
    word = F.regexp_extract(lowered, named, 2)
    month = first_match([(word.contains(stem), F.lit(n)) for stem, n in MONTH_STEMS], None).cast("string")
    year = F.coalesce(_found(F.regexp_extract(lowered, named, 3)), F.year(today).cast("string"))
    by_name = F.when(month.isNotNull(), day(year, month, F.regexp_extract(lowered, named, 1)))
    date = (
        F.when(text.isNull() | (text == ""), None)
        .when(lowered.contains("сегодня"), today)
        .when(lowered.contains("вчера"), F.date_sub(today, 1))
        .when(ago.isNotNull(), F.date_sub(today, ago))
        .otherwise(F.coalesce(by_dots, by_name))
    )
    return F.struct(
        F.date_format(date, "yyyy-MM-dd").alias("published_at_iso"), F.datediff(today, date).alias("vacancy_age_days")
    )


def published_text(text: Column) -> Column:
    """The date phrase of the publication line."""
    return strip(F.regexp_extract(text, r"(?U)Вакансия опубликована\s+(.+?)\s+в\s+.+", 1))


def junior_signals(text: Column, no_experience: Column) -> dict[str, Column]:
    """C28."""
    flags = keyword_flags(text, JUNIOR_WORDS)
    return {**flags, "is_for_juniors": flags["is_for_juniors"] | flag(no_experience)}


def classify_work_format(full: Column, description: Column) -> Column:
    """struct(work_format_raw, work_format, is_remote, is_hybrid, schedule)."""
    raw = strip(F.regexp_extract(full, r"(?U)Формат работы:\s*([^\n]+)", 1))
    stated = F.lower(raw)
    text = F.lower(F.concat_ws("\n", full, description))
    remote = stated.contains("удал") | text.contains("удал")
    hybrid = stated.contains("гибрид") | text.contains("hybrid")
    return F.struct(
        raw.alias("work_format_raw"),
        first_match([
            (remote, "remote"), (hybrid, "hybrid"), (stated.contains("офис") | text.contains("в офисе"), "office"),
            (contains_any(text, ["разъезд", "field"]), "field"),
        ], "unknown").alias("work_format"),
        remote.alias("is_remote"), hybrid.alias("is_hybrid"),
        strip(F.regexp_extract(full, r"(?iU)график работы:\s*([^\n]+)", 1)).alias("schedule"),
    )


def posting_code(text: Column) -> Column:
    """Code from text, "" when absent."""
    return F.regexp_extract(text, r"(?U)Код вакансии\s+([\w-]+)", 1)


def posting_id(url: Column) -> Column:
    """Id from the address, "" when absent."""
    return F.regexp_extract(url, r"vacancy/(\d+)", 1)
