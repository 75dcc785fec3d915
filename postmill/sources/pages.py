"""Posting, listing and employer fields from a table of crawled pages.

Elements without children of their own tag are read by regular expressions. A
description block may nest blocks of its own tag, which no regular expression can
balance: it is split at its tags, and one fold over them carries the depth to its end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as signals
from postmill.functions.columns import contains_any, flag, join_keys
from postmill.functions.fixed_values import (
    BENEFIT_WORDS, DOMAIN_WORDS, ROLE_WORDS, SOFT_SKILL_WORDS, TECH_WORDS,
)

# --- fixed values: marks of the elements on a posting page ------------------

MARK = "data-qa"
POSTING_MARKS = {
    "title": ("h1", "vacancy-title"), "salary_text": ("div", "vacancy-salary"), "company": ("a", "vacancy-company-name"),
    "address": ("span", "vacancy-view-raw-address|vacancy-view-location"), "experience": ("span", "vacancy-experience"),
    "employment_mode": ("p", "vacancy-view-employment-mode"), "schedule_mode": ("p", "vacancy-view-emp-mode"),
}
DESCRIPTION_MARK = ("div", "vacancy-description")
SKILL_MARK = "bloko-tag__text|skills-element"
LISTING_MARK = "serp-item__title"
DEFAULT_CITY = "Москва"
EMPLOYMENT = "(Полная занятость|Частичная занятость|Стажировка|Проектная работа|Волонтёрство)"
RATING_PATTERNS = [
    r"(?i)totalRating\s*[:=]\s*['\"]?([0-9]+(?:[.,][0-9]+)?)",
    r'(?is)"totalRating"\s*:\s*(?:\{[^}]*?"value"\s*:\s*)?[\'"]?([0-9]+(?:[.,][0-9]+)?)',
    r"(?i)totalRating[^0-9]{0,20}([0-9]+(?:[.,][0-9]+)?)",
    r"(?is)<[^>]*data-qa=['\"](?:employer-rating-value|employer-review-rating-value|employer-header-rating-value)['\"][^>]*>\s*([0-9]+(?:[.,][0-9]+)?)",
    r"(?is)<[^>]*(?:itemprop|name)=['\"]ratingValue['\"][^>]*content=['\"]([0-9]+(?:[.,][0-9]+)?)",
    r"(?is)<[^>]*itemprop=['\"]ratingValue['\"][^>]*>\s*([0-9]+(?:[.,][0-9]+)?)",
    r"(?is)<[^>]*data-qa=['\"](?:employer-rating|employer-review-rating|rating-score)['\"][^>]*>\s*([0-9]+(?:[.,][0-9]+)?)",
    r"(?i)['\"]?ratingValue['\"]?\s*[:=]\s*['\"]?([0-9]+(?:[.,][0-9]+)?)",
]
REVIEW_PATTERNS = [
    r'(?is)"employerReviews"\s*:\s*\{[^}]*?"reviewsCount"\s*:\s*"?([0-9\s]+)',
    r"(?is)<[^>]*data-qa=['\"]employer-reviews-link['\"][^>]*>[^0-9<]*([0-9][0-9\s]*)",
    r"(?iu)([0-9][0-9\s]*)\s+отзыв",
    r'(?i)"(?:ratingCount|reviewCount)"\s*:\s*"?([0-9\s]+)',
    r'"reviewsCount"\s*:\s*"?([0-9\s]+)',
]
RATING_PATHS = ["$.totalRating", "$.rating", "$.ratingInfo.value", "$.rating.value"]
REVIEW_PATHS = ["$.reviewsCount", "$.ratingInfo.reviewsCount", "$.rating.reviewsCount"]
JSON_ESCAPES = {"\\/": "/", '\\"': '"', "\\n": "\n", "\\r": "\r", "\\t": "\t", "\\b": "\b", "\\f": "\f"}
ADVANTAGES = {
    "employer_has_remote": ["удал", "remote"], "employer_has_flexible_schedule": ["гибк", "flexible"],
    "employer_has_med_insurance": ["дмс", "мед", "insurance"], "employer_has_education": ["обуч", "education", "курсы"],
}

# ---------------------------------------------------------------------------


def unescape(text: Column) -> Column:
    """The entities that occur in plain text; the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
                         ("&nbsp;", " "), ("&#160;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def page_text(html: Column, separator: str = "\n") -> Column:
    """Text nodes outside of scripts, styles and comments, trimmed, blank ones dropped."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<![^>]*>", "")
    nodes = F.transform(F.split(bare, r"<[^>]*>"), lambda n: signals.strip(unescape(n)))
    return F.array_join(F.filter(nodes, lambda n: n != ""), separator)


def element_html(html: Column, tag: str, mark: str | None = None, attribute: str = MARK) -> Column:
    """Inner HTML of the first such element that holds no element of its own tag; "" when absent."""
    marked = rf"[^>]*\b{attribute}=['\"](?:{mark})['\"]" if mark else ""
    return F.regexp_extract(html, rf"(?is)<{tag}\b{marked}[^>]*>(.*?)</{tag}\s*>", 1)


def element_text(html: Column, tag: str, mark: str | None = None, attribute: str = MARK) -> Column:
    return page_text(element_html(html, tag, mark, attribute), "")


def block_html(html: Column, tag: str, mark: str | None = None, attribute: str = MARK) -> Column:
    """Inner HTML of the first such element, nested elements of the same tag included.

    "" for a page without one and for a NULL page; a block that is never closed ends with its page.
    """
    marked = rf"[^>]*\b{attribute}=['\"](?:{mark})['\"]" if mark else ""
    step = rf"(?is)</?{tag}\b[^>]*>"
    rest = F.try_element_at(F.split(html, rf"(?is)<{tag}\b{marked}[^>]*>", 2), F.lit(2))

    def closed(now: Column, found: Column) -> Column:
        """How deep the fold is, how many tags it has seen, and the number of the tag that ends the block."""
        depth = now["depth"] + F.when(F.startswith(found, F.lit("</")), -1).otherwise(1)
        here = F.when(now["end"] < 0, F.when(depth == 0, now["seen"]).otherwise(-1)).otherwise(now["end"])
        return F.struct(depth.alias("depth"), (now["seen"] + 1).alias("seen"), here.alias("end"))

    def inner(block: Column) -> Column:
        tags, texts = block["tags"], block["texts"]
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(-1).alias("end"))
        end = F.aggregate(tags, start, closed, lambda now: F.when(now["end"] < 0, now["seen"]).otherwise(now["end"]))
        # the texts before the end and the tags between them
        return F.transform(F.array(end), lambda n: F.array_join(F.zip_with(
            F.slice(texts, F.lit(1), n + 1), F.concat(F.slice(tags, F.lit(1), n), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""))[0]

    parts = F.struct(F.regexp_extract_all(rest, F.lit(step), F.lit(0)).alias("tags"), F.split(rest, step).alias("texts"))
    return F.when(rest.isNull(), F.lit("")).otherwise(F.transform(F.array(parts), inner)[0])


def skill_tags(html: Column, mark: str = SKILL_MARK) -> Column:
    """Texts of the skill tags, first spelling of each."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<\w+[^>]*\b{MARK}=['\"](?:{mark})['\"][^>]*>(.*?)</"), F.lit(1))
    names = F.filter(F.transform(found, lambda h: page_text(h, "")), lambda s: s != "")
    lowered = F.transform(names, lambda s: F.lower(s))
    return F.filter(names, lambda s, i: F.array_position(lowered, F.lower(s)) == i + 1)


def extract_page_fields(
    pages: DataFrame, now: Column, marks: Mapping[str, tuple[str, str | None]] = POSTING_MARKS,
    description: tuple[str, str | None] = DESCRIPTION_MARK, carry: Sequence[str] = (), area_id: int | None = None,
) -> DataFrame:
    """(url, html) pages as raw postings, with all text signals.

    ``carry`` names page columns to keep next to the posting fields.
    """
    html = F.col("html")
    df = pages.select(
        *carry, "url", html, block_html(html, *description).alias("_block"), page_text(html).alias("_page"),
        *[element_text(html, tag, mark).alias(name) for name, (tag, mark) in marks.items()], skill_tags(html).alias("_skills"),
    )
    for name in POSTING_MARKS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(""))
    df = df.withColumn("description", page_text(F.col("_block"), "\n\n")).withColumn("_section_text", page_text(F.col("_block")))
    df = signals.split_sections(df, "_section_text")
    skills = F.array_join("_skills", ", ")
    df = df.withColumn("_all", F.lower(F.concat_ws("\n", "title", "description", skills)))
    brief = F.concat_ws("\n", "title", "description")
    tech = signals.keyword_flags(F.col("_all"), TECH_WORDS)
    data = signals.data_skill_flags(F.col("title"), F.col("description"), F.col("_skills"))
    plain = {}
    for words in (ROLE_WORDS, BENEFIT_WORDS, SOFT_SKILL_WORDS, DOMAIN_WORDS):
        plain |= signals.keyword_flags(F.col("_all"), words)
    df = df.withColumns({
        **tech, **data, **plain, "_salary": signals.salary_text(F.col("salary_text")),
        "_address": signals.address_features(F.col("address")), "_exp": signals.experience_range(F.col("experience")),
        "_format": signals.classify_work_format(F.col("_page"), F.col("description")),
        "_published": signals.published_date(signals.published_text(F.col("_page")), now),
        "_edu": signals.education_signals(brief), "_lang": signals.language_signals(brief),
        "_stats": signals.description_stats(F.col("description")),
    })
    df = df.withColumns({
        "_mid": signals.salary_features(F.col("_salary.salary_from"), F.col("_salary.salary_to")),
        **signals.junior_signals(F.col("_all"), F.col("_exp.exp_is_no_experience")),
    })
    known = [*tech, *data]
    stated = F.regexp_extract("_page", EMPLOYMENT, 1)
    return df.select(
        *carry, signals.posting_id(F.col("url")).alias("vacancy_id"), F.col("url").alias("vacancy_url"), "title", "company",
        "_salary.*", "_mid.*",
        F.coalesce(F.col("_salary.salary_from") != 0, F.col("_salary.salary_to") != 0, F.lit(False)).alias("salary_disclosed"),
        F.when(F.col("address") != "", F.split("address", ",")[0]).otherwise(DEFAULT_CITY).alias("city"), "address", "_address.*",
        F.lit(area_id).cast("int").alias("search_area_id"), "experience", "_exp.*",
        F.when(stated != "", stated).otherwise(F.col("employment_mode")).alias("employment_type"),
        F.col("_format.work_format_raw"), F.col("_format.work_format"),
        (F.col("_format.is_remote") | flag("benefit_remote_compensation")).alias("is_remote"), F.col("_format.is_hybrid"),
        F.when(F.col("_format.schedule") != "", F.col("_format.schedule")).otherwise(F.col("schedule_mode")).alias("schedule"),
        "description", "_stats.*", signals.bullet_count(F.col("requirements")).alias("requirements_count"),
        signals.bullet_count(F.col("duties")).alias("responsibilities_count"),
        signals.skill_hits(F.col("requirements"), known).alias("must_have_skills_count"),
        signals.skill_hits(F.col("nice_to_have"), known).alias("optional_skills_count"), skills.alias("skills"),
        "_published.*", signals.posting_code(F.col("_page")).alias("vacancy_code"), signals.detect_grade(F.col("_all")).alias("grade"),
        *[F.col(c) for c in [*plain, *known, "is_for_juniors", "allows_students", "has_mentoring", "has_test_task"]],
        *[c.alias(n) for n, c in signals.data_skill_counts(list(tech), list(data), F.col("_skills")).items()], "_edu.*", "_lang.*",
    )


def extract_listing_links(pages: DataFrame, host: Column, mark: str | None = LISTING_MARK, carry: Sequence[str] = ()) -> DataFrame:
    """Link per marked anchor, relative addresses made absolute, query string cut."""
    marked = rf"(?=[^>]*\b{MARK}=['\"](?:{mark})['\"])" if mark else ""
    hrefs = F.regexp_extract_all("html", F.lit(rf"(?is)<a\b{marked}[^>]*?\bhref=['\"]([^'\"]+)['\"]"), F.lit(1))
    links = pages.select(*carry, host.alias("_host"), F.posexplode(hrefs).alias("position", "_href"))
    absolute = F.when(F.col("_href").startswith("/"), F.concat("_host", "_href")).otherwise(F.col("_href"))
    return links.select(*carry, "position", F.split(unescape(absolute), r"\?")[0].alias("link"))


def _variants(html: Column) -> Column:
    """The page as it is, with its entities resolved, and with the escapes of a JSON string resolved."""
    plain = html
    for escape, text in JSON_ESCAPES.items():
        plain = F.replace(plain, F.lit(escape), F.lit(text))
    # a code point of the basic plane per escape; surrogate halves become replacement marks
    pieces = F.split(plain, r"\\u(?=[0-9a-fA-F]{4})")
    rest = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))),
        lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 4)), "UTF-16BE"), F.substring(p, 5, 1 << 30)))
    return F.array_distinct(F.array(html, unescape(html), F.concat(F.get(pieces, 0), F.array_join(rest, ""))))


def _review_objects(variants: Column) -> Column:
    """What follows each ``"employerReviews":``, as an object with text behind it.

    The JSON functions read one value and ignore what is behind it; an object
    that is never closed has no fields.
    """
    return F.flatten(F.transform(variants, lambda v: F.slice(
        F.split(v, r'(?i)"employerReviews"\s*:\s*(?=\{)'), 2, F.length(v) + 1)))


def _at(json: Column, *paths: str) -> Column:
    return F.array(*[F.get_json_object(json, p) for p in paths])


def _first_of(values: Column) -> Column:
    return F.get(F.array_compact(values), 0)


def _embedded_rating(variants: Column, objects: Column) -> Column:
    """The first valid rating of any embedded object, then of any plain mention of a total rating."""
    in_objects = F.flatten(F.transform(objects, lambda o: F.transform(_at(o, *RATING_PATHS), lambda v: _rating(v))))
    mentioned = F.flatten(F.transform(variants, lambda v: F.flatten(F.array(
        *[F.regexp_extract_all(v, F.lit(p), F.lit(1)) for p in RATING_PATTERNS[:3]]))))
    return F.coalesce(_first_of(in_objects), _first_of(F.transform(mentioned, lambda v: _rating(v))))


def _first_valid(text: Column, patterns: Sequence[str], convert) -> Column:
    return F.coalesce(*[convert(F.regexp_extract(text, p, 1)) for p in patterns])


def _rating(value: Column) -> Column:
    number = F.replace(value, F.lit(","), F.lit(".")).try_cast("double")
    return F.when((number >= 0) & (number <= 5), number)


def extract_employer_fields(pages: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """A10: rating, reviews, advantages, accreditation and type of an employer page.

    Ratings are looked for in every embedded review object, by path, before any
    pattern of the page; values outside 0 to 5 are passed over. A page that is
    NULL or empty has NULL fields and no advantages.
    """
    html = F.coalesce("html", F.lit(""))
    plain = F.replace(F.replace(unescape(html), F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/"))
    df = pages.select(*carry, "url", plain.alias("_html"), F.lower(page_text(html)).alias("_page"),
                      _variants(html).alias("_variants"))
    df = df.withColumn("_objects", _review_objects(F.col("_variants")))
    listed = F.lower(F.regexp_extract("_html", r'"advantages"\s*:\s*(\[[^\]]+\])', 1))
    shown = F.when(listed != "", listed).otherwise(F.col("_page"))
    kind = F.lower(element_text(F.col("_html"), r"\w+", "employer-type"))
    kind = F.when(kind != "", kind).otherwise(F.col("_page"))
    def digits(value: Column) -> Column:
        return F.regexp_replace(value, "[^0-9]", "").try_cast("bigint")

    counts = F.flatten(F.transform("_objects", lambda o: F.transform(_at(o, *REVIEW_PATHS), digits)))
    reviews = F.coalesce(_first_of(counts), _first_valid(F.col("_html"), REVIEW_PATTERNS, digits))
    rating = F.coalesce(
        _embedded_rating(F.col("_variants"), F.col("_objects")), _first_valid(F.col("_html"), RATING_PATTERNS[3:], _rating))
    return df.select(
        *carry, F.col("url").alias("employer_url"), rating.alias("employer_rating"),
        reviews.alias("employer_reviews_count"), F.when(F.col("_page").contains("аккредитован"), True).alias("employer_accredited_it"),
        F.when(kind.contains("прямой работодатель"), "direct").when(contains_any(kind, ["кадров", "агентств"]), "agency")
        .alias("employer_type"),
        *[contains_any(shown, words).alias(name) for name, words in ADVANTAGES.items()],
    )


def attach_employers(postings: DataFrame, employers: DataFrame) -> DataFrame:
    """A10: employer fields by address; absent advantages are false, the rating stays NULL."""
    joined = join_keys(postings, employers, ["employer_url"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ADVANTAGES})
