"""Signals from text: documents, conversations, and phrases derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import text
from postmill.functions.fixed_values import (
    BENEFIT_WORDS, DATA_SKILL_WORDS, DOMAIN_WORDS, ROLE_WORDS, SOFT_SKILL_WORDS, TECH_WORDS,
)
from postmill.queries.features import pick
from postmill.queries.registry import query


def quoted(s):
    return s.replace("'", "''")


def sql_pick(key, values):
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{quoted(v)}'" for i, v in enumerate(values)) + " END"


def sql_any(column, words):
    return "(" + " OR ".join(f"contains({column}, '{quoted(w)}')" for w in words) + ")"


SALARY_FORMS = ["от {a} до {b} руб. на руки", "от {a} ₽ до вычета налогов", "до {b} USD", "{a} – {b} EUR", "{a} KZT", "по договорённости"]


@query("salary_text", """SELECT o_orderkey, CASE WHEN k IN (0, 1, 3, 4) THEN a END AS salary_from,
  CASE WHEN k IN (0, 2, 3) THEN b END AS salary_to,
  CASE k WHEN 0 THEN 'RUB' WHEN 1 THEN 'RUB' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' WHEN 4 THEN 'KZT' END AS currency,
  CASE k WHEN 0 THEN false WHEN 1 THEN true END AS salary_gross
  FROM (SELECT o_orderkey, o_orderkey % 6 AS k, 1000 * (o_custkey + 1) + 7 AS a, 2000 * (o_custkey + 1) AS b FROM orders)""")
def _(t):
    a, b = 1000 * (F.col("o_custkey") + 1) + 7, 2000 * (F.col("o_custkey") + 1)

    def spaced(n):  # thousands set apart by no-break spaces
        return F.concat((n / 1000).cast("bigint").cast("string"), F.lit(" "), F.lpad((n % 1000).cast("string"), 3, "0"))

    chain = None
    for i, form in enumerate(SALARY_FORMS):
        phrase = F.replace(F.replace(F.lit(form), F.lit("{a}"), spaced(a)), F.lit("{b}"), spaced(b))
        cond = F.col("o_orderkey") % len(SALARY_FORMS) == i
        chain = F.when(cond, phrase) if chain is None else chain.when(cond, phrase)
    return t.orders.select("o_orderkey", text.salary_text(chain).alias("s")).select("o_orderkey", "s.*")


@query("salary_features", """SELECT l_orderkey, l_linenumber, l_partkey, a AS salary_from, b AS salary_to,
  round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END, 6)::DOUBLE AS salary_mid,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b - a WHEN a IS NOT NULL OR b IS NOT NULL THEN 0 END AS salary_range_width,
  (a IS NULL) <> (b IS NULL) AS salary_is_exact
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 20 THEN l_suppkey END AS a,
  CASE WHEN l_quantity < 40 THEN l_suppkey + l_linenumber END AS b FROM lineitem WHERE l_quantity <> 30
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL, NULL FROM lineitem WHERE l_quantity = 30)""")
def _(t):
    q = F.col("l_quantity")
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when((q > 20) & (q != 30), F.col("l_suppkey")).alias("salary_from"),
        F.when((q < 40) & (q != 30), F.col("l_suppkey") + F.col("l_linenumber")).alias("salary_to"),
    )
    return rows.select("*", text.salary_features(F.col("salary_from"), F.col("salary_to")).alias("s")).select(
        *rows.columns, "s.*")


ADDRESSES = ["Москва, метро Тверская, ул. 5", "м. Сокол; Метро  Аэропорт , р-н Сокол", "Район Север, 7", "САО, дом 4", "Минск"]


@query("address_features", """SELECT c_custkey, k IN (0, 1) AS has_metro, CASE k WHEN 0 THEN 'Тверская' WHEN 1 THEN 'Сокол'
  ELSE '' END AS metro_primary, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS metro_count, k IN (1, 2, 3) AS address_has_district
  FROM (SELECT c_custkey, c_custkey % 5 AS k FROM customer)""")
def _(t):
    address = pick(F.col("c_custkey") % 5, ADDRESSES)
    return t.customer.select("c_custkey", text.address_features(address).alias("s")).select("c_custkey", "s.*")


EXPERIENCES = ["Опыт не требуется", "1–3 года", "3-6 лет", "Более 6 лет", "любой"]


@query("experience_range", """SELECT p_partkey, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 6 END AS exp_min_years,
  CASE k WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 6 END AS exp_max_years, k = 0 AS exp_is_no_experience
  FROM (SELECT p_partkey, p_size % 5 AS k FROM part)""")
def _(t):
    phrase = pick(F.col("p_size") % 5, EXPERIENCES)
    return t.part.select("p_partkey", text.experience_range(phrase).alias("s")).select("p_partkey", "s.*")


GRADE_FORMS = ["Senior+ {x}", "старший {x}", "{x} lead generation", "Team  Lead {x}", "джуниор {x}", "internal {x}", "Тим-лид {x}",
               "архитектор {x}", "mid {x}", "стажёр {x}"]
GRADE_FOUND = ["senior", "senior", "unknown", "lead", "junior", "unknown", "lead", "architect", "middle", "intern"]


@query("detect_grade", f"SELECT p_partkey, {sql_pick('p_partkey % 10', GRADE_FOUND)} AS grade FROM part")
def _(t):
    phrase = F.replace(pick(F.col("p_partkey") % 10, GRADE_FORMS), F.lit("{x}"), F.col("p_name"))
    return t.part.select("p_partkey", text.detect_grade(phrase).alias("grade"))


PROSE_WORDS = {"role_a": ["tion", "und"], "has_b": [" the ", "elle"], "skill_c": ["éa", "ß"], "soft_d": ["@"], "domain_e": ["http", "license"]}
ALL_WORDS = {**ROLE_WORDS, **TECH_WORDS, **BENEFIT_WORDS, **SOFT_SKILL_WORDS, **DOMAIN_WORDS}


@query("keyword_flags", "SELECT doc_id, " + ", ".join(
    f"{sql_any('lower(text)', ws)} AS {c}" for c, ws in PROSE_WORDS.items()) + " FROM documents")
def _(t):
    flags = text.keyword_flags(F.col("text"), PROSE_WORDS)
    return t.documents.select("doc_id", *[c.alias(n) for n, c in flags.items()])


@query("keyword_flags_all", "SELECT " + ", ".join(
    f"sum({sql_any('lower(text)', ws)}::INT)::BIGINT AS {c}" for c, ws in ALL_WORDS.items()) + " FROM documents")
def _(t):
    flags = text.keyword_flags(F.col("text"), ALL_WORDS)
    rows = t.documents.select(*[c.alias(n) for n, c in flags.items()])
    return rows.agg(*[F.sum(F.col(n).cast("long")).alias(n) for n in flags])


@query("keyword_flags_by_label", "SELECT toxic, quality, count(*) AS n, " + ", ".join(
    f"round(avg({sql_any('lower(text)', ws)}::INT), 6) AS {c}" for c, ws in PROSE_WORDS.items())
    + " FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def _(t):
    flags = text.keyword_flags(F.col("text"), PROSE_WORDS)
    rows = t.documents.select("doc_id", *[c.alias(n) for n, c in flags.items()]).join(t.labels, "doc_id")
    return rows.groupBy("toxic", "quality").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(n).cast("int")).alias(n) for n in flags])


STACKS = ["python, SQL and clickhouse", "Power BI, tableau", "rstudio with excel", "airflow kafka spark", "none at all", "sklearn, язык r "]


def _stack_flags(words):
    return " + ".join(f"{sql_any('x', ws)}::INT" for ws in words.values())


@query("data_skill_counts", f"""SELECT p_partkey, 2 AS skills_count,
  {sql_any('x', DATA_SKILL_WORDS['skill_sql'])}::INT + {sql_any('x', DATA_SKILL_WORDS['skill_excel'])}::INT
  + ({sql_any('x', DATA_SKILL_WORDS['skill_powerbi'])} OR {sql_any('x', DATA_SKILL_WORDS['skill_tableau'])})::INT
  + ({sql_any('x', TECH_WORDS['has_python'])} OR {sql_any('x', DATA_SKILL_WORDS['skill_r'])})::INT AS core_data_skills_count,
  contains(x, 'sklearn')::INT + contains(x, 'airflow')::INT + contains(x, 'spark')::INT + contains(x, 'kafka')::INT AS ml_stack_count,
  {_stack_flags(TECH_WORDS)} + {_stack_flags(DATA_SKILL_WORDS)} AS tech_stack_size
  FROM (SELECT p_partkey, lower(p_name || chr(10) || {sql_pick('p_partkey % 6', STACKS)} || chr(10) || p_type || ' ' || p_brand) AS x FROM part)""")
def _(t):
    stack = pick(F.col("p_partkey") % 6, STACKS)
    skills = F.array("p_type", "p_brand")
    tech = text.keyword_flags(F.concat_ws("\n", "p_name", stack, F.array_join(skills, " ")), TECH_WORDS)
    data = text.data_skill_flags(F.col("p_name"), stack, skills)
    rows = t.part.select("p_partkey", skills.alias("skills"), *[c.alias(n) for n, c in {**tech, **data}.items()])
    counts = text.data_skill_counts(list(tech), list(data), F.col("skills"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in counts.items()])


EDUCATION = ["Высшее образование, математика", "неполное высшее", "магистр, техническое образование", "можно без диплома",
             "бакалавр информатики", "школа"]


@query("education_signals", """SELECT c_custkey, CASE WHEN k IN (0, 2, 4) THEN true WHEN k = 3 THEN false END AS edu_required,
  CASE k WHEN 0 THEN 'any_he' WHEN 1 THEN 'partial_higher' WHEN 2 THEN 'master_or_higher' WHEN 3 THEN 'none'
  WHEN 4 THEN 'bachelor_or_higher' END AS edu_level, CASE WHEN k = 2 THEN true END AS edu_technical,
  CASE WHEN k IN (0, 4) THEN true END AS edu_math_or_cs FROM (SELECT c_custkey, c_custkey % 6 AS k FROM customer)""")
def _(t):
    phrase = pick(F.col("c_custkey") % 6, EDUCATION)
    return t.customer.select("c_custkey", text.education_signals(phrase).alias("s")).select("c_custkey", "s.*")


LANGUAGES = ["Английский Upper-Intermediate", "English intermediate, немецкий (German)", "fluent english", "английский: чтение документации",
             "Китайский", "english"]


@query("language_signals", """SELECT c_custkey, k <> 4 AS lang_english_required, CASE k WHEN 0 THEN 'upper_intermediate'
  WHEN 1 THEN 'intermediate' WHEN 2 THEN 'advanced' WHEN 3 THEN 'basic' WHEN 4 THEN 'none' END AS lang_english_level,
  CASE k WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS lang_other_count FROM (SELECT c_custkey, c_custkey % 6 AS k FROM customer)""")
def _(t):
    phrase = pick(F.col("c_custkey") % 6, LANGUAGES)
    return t.customer.select("c_custkey", text.language_signals(phrase).alias("s")).select("c_custkey", "s.*")


HEADINGS = [("duties", ["tion", "der "]), ("requirements", ["elle", "ing"]), ("conditions", ["the"]), ("nice_to_have", ["und"])]
_KIND = "CASE " + " ".join(f"WHEN {sql_any('lower(line)', ws)} THEN '{n}'" for n, ws in HEADINGS) + " END"
_LAST = " ".join(f"""WHEN max(CASE WHEN kind = '{n}' THEN i END) OVER w = max(CASE WHEN kind IS NOT NULL THEN i END) OVER w
  THEN '{n}'""" for n, _ in HEADINGS)


def _sections(table, key, body):
    return f"""WITH l AS (SELECT {key}, unnest(string_split({body}, chr(10))) AS line,
  generate_subscripts(string_split({body}, chr(10)), 1) AS i FROM {table}), k AS (SELECT *, {_KIND} AS kind FROM l),
  s AS (SELECT *, CASE {_LAST} END AS section FROM k WINDOW w AS (PARTITION BY {key} ORDER BY i))
  SELECT {key}, """ + ", ".join(
        f"coalesce(string_agg(line || chr(10), '' ORDER BY i) FILTER (WHERE kind IS NULL AND section = '{n}'), '') AS {n}"
        for n, _ in HEADINGS) + f" FROM s GROUP BY {key}"


@query("split_sections", _sections("documents", "doc_id", "text"))
def _(t):
    out = text.split_sections(t.documents.select("doc_id", "text"), "text", HEADINGS)
    return out.select("doc_id", *[n for n, _ in HEADINGS])


@query("split_sections_chat", _sections("(SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)", "turn_id", "text"))
def _(t):
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return text.split_sections(rows, "text", HEADINGS).select("turn_id", *[n for n, _ in HEADINGS])


@query("description_stats", r"""WITH l AS (SELECT doc_id, length(text) AS n,
  string_split(regexp_replace(text, '\r\n|[\x0b\x0c\r\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10)) AS lines,
  len(list_filter(regexp_split_to_array(text, '[\s\x{a0}\x{85}\x{2028}\x{3000}\x{2000}-\x{200a}\x{202f}]+'), lambda w: w <> '')) AS words FROM documents),
  b AS (SELECT *, list_transform(lines, lambda x: NOT regexp_matches(x, '[^\s\x{a0}\x{3000}\x{2000}-\x{200a}\x{202f}]')) AS blank FROM l)
  SELECT doc_id, n AS description_len_chars, words AS description_len_words,
  len(list_filter(lines, lambda x: regexp_matches(x, '^[\s\x{a0}]*[-*•]'))) AS description_bullets_count,
  CASE WHEN p = 0 AND n > 0 THEN 1 ELSE p END AS description_paragraphs_count FROM (SELECT *,
  len(list_filter(range(1, len(lines) + 1), lambda i: NOT blank[i] AND (i = 1 OR blank[i - 1]))) AS p FROM b)""")
def _(t):
    return t.documents.select("doc_id", text.description_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("skill_hits", """SELECT doc_id, (contains(lower(text), 'tion') AND n_chars % 2 = 0)::INT + contains(lower(text), 'elle')::INT
  AS hits FROM documents""")
def _(t):
    rows = t.documents.select(
        "doc_id", "text", (F.col("n_chars") % 2 == 0).alias("has_tion"), F.lit(True).alias("skill_elle"))
    return rows.select("doc_id", text.skill_hits(F.col("text"), ["has_tion", "skill_elle"]).alias("hits"))


DATE_FORMS = ["сегодня", "вчера", "{d} дней назад", "dotted", "named", "named_year", "скоро"]
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]


@query("published_date", """SELECT event_id, strftime(d, '%Y-%m-%d') AS published_at_iso, date_diff('day', d, DATE '2024-02-15')
  AS vacancy_age_days FROM (SELECT event_id, CASE k WHEN 0 THEN DATE '2024-02-15' WHEN 1 THEN DATE '2024-02-14'
  WHEN 2 THEN DATE '2024-02-15' - user_id::INT WHEN 6 THEN NULL ELSE ts::DATE END AS d
  FROM (SELECT event_id, event_id % 7 AS k, user_id, ts FROM events))""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    month = pick(F.month(ts) - 1, MONTHS)
    phrase = F.element_at(F.array(
        F.lit("Сегодня"), F.lit("вчера"), F.concat("user_id", F.lit(" дней назад")), F.date_format(ts, "d.M.yyyy"),
        F.concat(F.dayofmonth(ts), F.lit(" "), month), F.concat(F.dayofmonth(ts), F.lit(" "), month, F.lit(" 2024")),
        F.lit("скоро"),
    ), (F.col("event_id") % 7 + 1).cast("int"))
    now = F.lit("2024-02-15 10:00:00").cast("timestamp")
    return t.events.select("event_id", text.published_date(phrase, now).alias("s")).select("event_id", "s.*")


@query("published_text", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '5 мая ' || p_size ELSE '' END AS phrase FROM part""")
def _(t):
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(
        F.lit("x\nВакансия опубликована 5 мая "), F.col("p_size"), F.lit(" в Москве\ny"))).otherwise("Вакансия")
    return t.part.select("p_partkey", text.published_text(line).alias("phrase"))


JUNIOR = ["Стажировка для студентов", "junior, наставничество", "есть тестовое задание", "опытный", "Intern, test task"]


@query("junior_signals", """SELECT c_custkey, k IN (0, 1, 4) OR coalesce(c_acctbal > 5000, false) AS is_for_juniors, k = 0 AS allows_students,
  k = 1 AS has_mentoring, k IN (2, 4) AS has_test_task FROM (SELECT *, c_custkey % 5 AS k FROM customer)""")
def _(t):
    signals = text.junior_signals(pick(F.col("c_custkey") % 5, JUNIOR), F.col("c_acctbal") > 5000)
    return t.customer.select("c_custkey", *[c.alias(n) for n, c in signals.items()])


FORMATS = ["Формат работы: удалённо или гибрид\nГрафик работы: 5/2", "Формат работы: гибрид", "Формат работы: на месте в офисе",
           "Разъездной характер", "hybrid field", "график работы: сменный "]


@query("classify_work_format", """SELECT s_suppkey, CASE k WHEN 0 THEN 'удалённо или гибрид' WHEN 1 THEN 'гибрид'
  WHEN 2 THEN 'на месте в офисе' ELSE '' END AS work_format_raw, CASE k WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'office'
  WHEN 3 THEN 'field' WHEN 4 THEN 'hybrid' ELSE 'unknown' END AS work_format, k = 0 AS is_remote, k IN (0, 1, 4) AS is_hybrid,
  CASE k WHEN 0 THEN '5/2' WHEN 5 THEN 'сменный' ELSE '' END AS schedule FROM (SELECT s_suppkey, s_suppkey % 6 AS k FROM supplier)""")
def _(t):
    full = pick(F.col("s_suppkey") % 6, FORMATS)
    return t.supplier.select("s_suppkey", text.classify_work_format(full, F.col("s_name")).alias("s")).select("s_suppkey", "s.*")


@query("extract_codes", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'AB-' || o_custkey ELSE '' END AS vacancy_code,
  o_orderkey::VARCHAR AS vacancy_id FROM orders""")
def _(t):
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Код вакансии  AB-"), F.col("o_custkey"), F.lit(", x"))).otherwise("")
    url = F.concat(F.lit("https://example.org/vacancy/"), F.col("o_orderkey"), F.lit("?a=1"))
    return t.orders.select(
        "o_orderkey", text.posting_code(line).alias("vacancy_code"), text.posting_id(url).alias("vacancy_id"))
