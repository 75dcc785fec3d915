"""Word lists, lookup tables, patterns and thresholds.

Results depend on these exact values, so they are stated plainly, in the order
in which rules are tried.
"""

from __future__ import annotations

# --- fixed values: cleaning ------------------------------------------------

PREFIX_GROUPS = ["is_", "has_", "skill_", "benefit_", "soft_", "domain_", "role_"]

# compared after trim and lower
UNKNOWN_MARKERS = ["unknown", "не указано", "неизвестно", "", "n/a", "nan", "-", "—"]
TRUE_MARKERS = ["true", "1", "yes"]
FALSE_MARKERS = ["false", "0", "no"]
# texts a boolean-like column may hold in place of a value
BOOL_NULL_TEXTS = ["unknown", "", "n/a", "nan"]

LOW_INFORMATION_SHARE = 0.90
MOSTLY_MISSING_SHARE = 0.95

BUSINESS_COLUMNS = [
    "salary_from", "salary_to", "salary_mid", "salary_mid_rub", "salary_mid_rub_capped",
    "salary_known", "salary_gross", "currency", "grade", "grade_final", "primary_role",
    "work_format", "work_mode", "employment_type", "schedule", "city", "city_tier",
    "country", "region", "city_normalized", "geo_scope", "experience",
    "lang_english_level", "lang_english_required", "edu_level", "edu_required",
    "published_at_iso", "scraped_at_utc", "vacancy_age_days",
]

UNKNOWN_FILLED = [
    "grade", "work_format", "work_mode", "employment_type", "schedule", "city_tier",
    "country", "region", "city_normalized", "geo_scope", "lang_english_level", "employer_type",
]

ZERO_FILLED = [
    "employer_reviews_count", "description_bullets_count", "description_paragraphs_count",
    "requirements_count", "responsibilities_count", "must_have_skills_count",
    "optional_skills_count", "role_count", "skills_count", "benefits_count",
    "soft_skills_count", "hard_stack_count", "core_data_skills_count", "ml_stack_count",
    "tech_stack_size", "metro_count", "lang_other_count",
]

# lowest coverage, bucket, recommended use
COVERAGE_BUCKETS = [
    (0.85, "high", "ok_for_conclusions"),
    (0.60, "medium", "ok_with_disclaimer"),
    (0.30, "low", "only_hypothesis"),
]
COVERAGE_REST = ("critical", "ignore")

COLUMN_NOTES = {
    "salary_from": "salary is not stated in the posting",
    "salary_to": "salary is not stated in the posting",
    "employer_rating": "no reviews or rating at the source",
    "salary_mid": "derived from the stated range",
    "work_mode": '"unknown" = work format not recognised',
    "work_format": '"unknown" = work format not recognised',
    "grade": '"unknown" = grade not recognised',
    "lang_english_level": '"unknown" = no stated English level',
}

NOISY_SKILLS = [
    "has_test_task", "has_relocation", "has_metro", "has_mentoring", "skill_php",
    "skill_javascript", "skill_html", "skill_css", "skill_git",
]
NOT_HARD_SKILLS = ["has_metro", "has_mentoring", "has_test_task"]

# --- fixed values: features ------------------------------------------------

MILLION_CITIES = [
    "novosibirsk", "yekaterinburg", "ekaterinburg", "nizhny novgorod", "нижний новгород", "nn",
    "kazan", "казань", "chelyabinsk", "челябинск", "samara", "самара", "omsk", "омск",
    "rostov-on-don", "rostov-na-donu", "ростов-на-дону", "ufa", "уфа", "krasnoyarsk",
    "красноярск", "perm", "пермь", "voronezh", "воронеж", "volgograd", "волгоград",
    "krasnodar", "краснодар",
]
MOSCOW_WORDS = ["moscow", "моск"]
PETERSBURG_WORDS = ["spb", "петербург", "санкт"]
KAZAKH_WORDS = ["kazakhstan", "kazakh", "kz", "алматы", "нур-султан", "астана"]

# area id -> country, region, city
AREA_DEFAULTS = {
    1: ("Russia", "Moscow", "Moscow"),
    2: ("Russia", "Saint Petersburg", "Saint Petersburg"),
    5: ("Ukraine", "unknown", "unknown"),
    40: ("Belarus", "unknown", "unknown"),
    51: ("Georgia", "unknown", "unknown"),
    111: ("Moldova", "unknown", "unknown"),
    113: ("Russia", "unknown", "unknown"),
    159: ("Kazakhstan", "unknown", "unknown"),
    160: ("Armenia", "unknown", "unknown"),
    194: ("Tajikistan", "unknown", "unknown"),
    204: ("Azerbaijan", "unknown", "unknown"),
    218: ("Turkmenistan", "unknown", "unknown"),
    237: ("Uzbekistan", "unknown", "unknown"),
    246: ("Kyrgyzstan", "unknown", "unknown"),
}

# country, region, city, aliases found in the raw city
CITY_ALIASES = [
    ("Russia", "Moscow", "Moscow", ["moscow", "москва", "моск"]),
    ("Russia", "Saint Petersburg", "Saint Petersburg",
     ["saint petersburg", "st petersburg", "spb", "санкт-петербург", "петербург", "спб"]),
    ("Russia", "Tatarstan", "Kazan", ["kazan", "казань"]),
    ("Russia", "Novosibirsk Oblast", "Novosibirsk", ["novosibirsk", "новосибирск"]),
    ("Russia", "Sverdlovsk Oblast", "Yekaterinburg", ["yekaterinburg", "ekaterinburg", "екатеринбург"]),
    ("Russia", "Nizhny Novgorod Oblast", "Nizhny Novgorod", ["nizhny novgorod", "нижний новгород"]),
    ("Russia", "Chelyabinsk Oblast", "Chelyabinsk", ["chelyabinsk", "челябинск"]),
    ("Russia", "Samara Oblast", "Samara", ["samara", "самара"]),
    ("Russia", "Omsk Oblast", "Omsk", ["omsk", "омск"]),
    ("Russia", "Rostov Oblast", "Rostov-on-Don", ["rostov-on-don", "rostov-na-donu", "ростов-на-дону"]),
    ("Russia", "Bashkortostan", "Ufa", ["ufa", "уфа"]),
    ("Russia", "Krasnoyarsk Krai", "Krasnoyarsk", ["krasnoyarsk", "красноярск"]),
    ("Russia", "Perm Krai", "Perm", ["perm", "пермь"]),
    ("Russia", "Voronezh Oblast", "Voronezh", ["voronezh", "воронеж"]),
    ("Russia", "Volgograd Oblast", "Volgograd", ["volgograd", "волгоград"]),
    ("Russia", "Krasnodar Krai", "Krasnodar", ["krasnodar", "краснодар"]),
    ("Kazakhstan", "Almaty", "Almaty", ["almaty", "алматы"]),
    ("Kazakhstan", "Astana", "Astana", ["astana", "nursultan", "nur-sultan", "нур-султан", "астана"]),
    ("Belarus", "Minsk", "Minsk", ["minsk", "минск"]),
    ("Armenia", "Yerevan", "Yerevan", ["yerevan", "ереван"]),
    ("Georgia", "Tbilisi", "Tbilisi", ["tbilisi", "тбилиси"]),
    ("Uzbekistan", "Tashkent", "Tashkent", ["tashkent", "ташкент"]),
]

COUNTRY_WORDS = [
    ("Kazakhstan", ["kazakhstan", "kazakh", "казахстан", "кз", "kz"]),
    ("Belarus", ["belarus", "беларус", "белорус", "минск"]),
    ("Armenia", ["armenia", "армения", "ереван"]),
    ("Georgia", ["georgia", "грузия", "тбилиси"]),
    ("Uzbekistan", ["uzbekistan", "узбекистан", "ташкент"]),
    ("Kyrgyzstan", ["kyrgyzstan", "киргиз", "кыргыз"]),
    ("Azerbaijan", ["azerbaijan", "азербайджан", "баку"]),
    ("Russia", ["russia", "россия", "москва", "петербург"]),
]

ROLE_PRIORITY = [
    "role_ml", "role_data", "role_devops", "role_backend", "role_frontend", "role_fullstack",
    "role_mobile", "role_qa", "role_product", "role_manager", "role_analyst",
]

# role, words looked for in the title
ROLE_TITLE_WORDS = [
    ("ml", ["machine learning", "ml engineer", "ml-", "ml ", "deep learning"]),
    ("data", ["data engineer", "data scientist", "data science", "dwh", "etl"]),
    ("devops", ["devops", "sre", "site reliability", "platform engineer", "infrastructure"]),
    ("backend", ["backend", "back-end", "back end", "server", "python developer", "java developer",
                 "go developer", ".net", "node.js", "nodejs"]),
    ("frontend", ["frontend", "front-end", "front end", "javascript", "react", "vue", "angular"]),
    ("fullstack", ["fullstack", "full-stack", "full stack"]),
    ("mobile", ["android", "ios", "mobile", "swift", "kotlin"]),
    ("qa", ["qa", "quality assurance", "test engineer", "testing", "тестиров"]),
    ("product", ["product manager", "product owner", "продакт", "product lead"]),
    ("manager", ["project manager", "delivery manager", "program manager", "руководитель",
                 "team lead", "tech lead"]),
    ("analyst", ["analyst", "аналитик", "business intelligence", "bi analyst", "system analyst",
                 "product analyst"]),
]

CORE_DATA_SKILLS = [
    "skill_sql", "skill_excel", "skill_powerbi", "skill_tableau", "skill_r", "has_python",
    "skill_clickhouse", "skill_bigquery",
]
ML_SKILLS = ["has_sklearn", "has_pytorch", "has_tensorflow", "has_airflow", "has_spark", "has_kafka"]

# upper bound of years (exclusive), grade
GRADE_BY_YEARS = [(1, "intern"), (3, "junior"), (5, "middle"), (8, "senior")]
GRADE_BY_TEXT = [
    (["не треб", "no experience", "без опыта"], "intern"),
    (["1-3", "1–3", "1 to 3"], "junior"),
    (["3-6", "3–6", "3 to 6"], "middle"),
    (["6"], "senior"),
]

# --- fixed values: text signals --------------------------------------------

CURRENCY_HINTS = [
    ("руб", "RUB"), ("₽", "RUB"), ("USD", "USD"), ("EUR", "EUR"), ("$", "USD"), ("€", "EUR"), ("KZT", "KZT"),
]

LEAD_STOP_PHRASES = ["lead generation", "лидогенера"]
GRADE_PATTERNS = [
    ("intern", [r"\bintern\b", r"\bстаж[её]р\b"]),
    ("junior", [r"\bjunior\b", r"\bмладший\b", r"\bджуниор\b", r"\bджун\b"]),
    ("middle", [r"\bmiddle\+?\b", r"\bмидл\b", r"\bmid\b"]),
    ("senior", [r"\bsenior\+?\b", r"\bсеньор\b", r"\bсиньор\b", r"\bстарший\b"]),
    ("lead", [r"\bteam\s*lead\b", r"\btech(nical)?\s*lead\b", r"\bтим[- ]?лид\b", r"\bведущ(ий|ая)\b"]),
    ("architect", [r"\barchitect\b", r"\bархитектор\b"]),
]

ROLE_WORDS = {
    "role_backend": ["backend", "back-end", "бекенд", "бэкенд"],
    "role_frontend": ["frontend", "front-end", "фронтенд", "frontend-разработчик"],
    "role_fullstack": ["fullstack", "full-stack", "фуллстек", "фул-стек"],
    "role_mobile": ["android", "ios", "mobile", "мобиль", "swift", "kotlin"],
    "role_data": ["data engineer", "etl", "dwh", "bi-", "bi ", "dwh "],
    "role_ml": ["machine learning", "ml ", "ml-", "data scientist", "нейросет"],
    "role_devops": ["devops", "sre", "site reliability", "platform engineer"],
    "role_qa": ["qa", "тестир", "quality assurance", "тестиров"],
    "role_manager": ["project manager", "delivery", "scrum", "agile coach", "pm "],
    "role_product": ["product manager", "продакт", "product owner", "po "],
    "role_analyst": ["аналитик", "analyst", "bi", "системный аналитик", "бизнес-аналитик"],
}

TECH_WORDS = {
    "has_python": ["python"],
    "has_java": [" java"],
    "has_kotlin": ["kotlin"],
    "has_csharp": ["c#", ".net", "dotnet"],
    "has_cpp": ["c++"],
    "has_go": [" golang", " go "],
    "has_php": ["php"],
    "has_javascript": ["javascript", " js"],
    "has_typescript": ["typescript", " ts"],
    "has_scala": ["scala"],
    "has_rust": ["rust"],
    "has_ruby": ["ruby", "rails"],
    "has_django": ["django"],
    "has_flask": ["flask"],
    "has_fastapi": ["fastapi"],
    "has_dotnet": [".net", "dotnet"],
    "has_spring": ["spring"],
    "has_nodejs": ["node.js", "nodejs", "node js"],
    "has_express": ["express"],
    "has_nestjs": ["nestjs"],
    "has_react": ["react"],
    "has_vue": ["vue"],
    "has_angular": ["angular"],
    "has_nextjs": ["next.js", "nextjs"],
    "has_nuxt": ["nuxt"],
    "has_svelte": ["svelte"],
    "has_pandas": ["pandas"],
    "has_numpy": ["numpy"],
    "has_sklearn": ["sklearn", "scikit"],
    "has_pytorch": ["pytorch"],
    "has_tensorflow": ["tensorflow"],
    "has_airflow": ["airflow"],
    "has_spark": ["spark"],
    "has_kafka": ["kafka"],
    "has_docker": ["docker"],
    "has_kubernetes": ["kubernetes", "k8s"],
    "has_terraform": ["terraform"],
    "has_ansible": ["ansible"],
    "has_jenkins": ["jenkins"],
    "has_gitlab_ci": ["gitlab ci", "gitlab-ci"],
    "has_cicd": ["ci/cd", "ci cd", "continuous integration", "continuous delivery"],
}

BENEFIT_WORDS = {
    "benefit_dms": ["дмс", "медицинск", "медстрах"],
    "benefit_insurance": ["страховка", "страхование"],
    "benefit_sick_leave_paid": ["оплачиваемые больничные", "оплачиваемый больничный"],
    "benefit_vacation_paid": ["оплачиваемый отпуск", "оплачиваемые отпуска"],
    "benefit_relocation": ["релокац", "переезд"],
    "benefit_sport": ["спорт", "фитнес", "спортзал", "доступ в фитнес"],
    "benefit_education": ["обучени", "курсы", "конференц", "митап"],
    "benefit_remote_compensation": ["компенсац", "интернет", "электричества"],
    "benefit_stock": ["опционы", "rsu", "акци", "опцион"],
}

DATA_SKILL_WORDS = {
    "skill_sql": [" sql", "postgres", "postgresql", "mysql", "mariadb", "mssql", "sql server",
                  "oracle", "clickhouse", "bigquery"],
    "skill_excel": ["excel", "ms excel"],
    "skill_powerbi": ["powerbi", "power bi"],
    "skill_tableau": ["tableau"],
    "skill_clickhouse": ["clickhouse"],
    "skill_bigquery": ["bigquery"],
    "skill_r": [" язык r", " r ", " r,", " r.", "rstudio"],
    "skill_airflow": ["airflow"],
    "skill_ab_testing": ["a/b", "ab test", "a/b тест", "a/b-тест"],
    "skill_product_metrics": ["продуктов", "метрик", "конверси", "воронк", "ltv", "retention", "unit-эконом"],
}

SOFT_SKILL_WORDS = {
    "soft_communication": ["коммуникац", "общени"],
    "soft_teamwork": ["команд", "team"],
    "soft_leadership": ["лидер", "leadership", "руководств"],
    "soft_result_oriented": ["результат", "result oriented", "ориентаци"],
    "soft_structured_thinking": ["структур", "структурное мышление"],
    "soft_critical_thinking": ["критическ", "critical thinking"],
}

DOMAIN_WORDS = {
    "domain_finance": ["банк", "финтех", "финансов"],
    "domain_ecommerce": ["ecommerce", "маркетплейс", "marketplace", "e-commerce"],
    "domain_telecom": ["телеком", "operator", "оператор связи"],
    "domain_state": ["госкомпания", "государствен"],
    "domain_retail": ["ритейл", "retail", "магазин"],
    "domain_it_product": ["saas", "продуктов", "it-продукт", "digital product"],
}

EDUCATION_REQUIRED_WORDS = ["высшее образование", "бакалавр", "магистр", "степень", "образование"]
EDUCATION_OPTIONAL_WORDS = ["без образования", "можно без"]
EDUCATION_LEVELS = [
    ("неполное высшее", "partial_higher"),
    ("бакалавр", "bachelor_or_higher"),
    ("магистр", "master_or_higher"),
    ("высшее", "any_he"),
]
EDUCATION_TECHNICAL_WORDS = ["техническое"]
EDUCATION_MATH_WORDS = ["математ", "информат", "кибернет"]

ENGLISH_WORDS = ["англий", "english"]
ENGLISH_LEVEL_PATTERNS = [
    ("upper[- ]?intermediate|upper intermediate|b2", "upper_intermediate"),
    ("intermediate|b1", "intermediate"),
    ("advanced|fluent|свободн", "advanced"),
    ("документац", "basic"),
]
OTHER_LANGUAGE_WORDS = [
    "немец", "german", "китай", "chinese", "француз", "french", "испан", "spanish", "итальян", "italian",
]

# section, words of its heading line, in order of test
SECTION_HEADINGS = [
    ("duties", ["обязанности", "что делать", "responsibilit"]),
    ("requirements", ["требован", "requirements"]),
    ("conditions", ["услови", "conditions", "we offer"]),
    ("nice_to_have", ["будет плюсом", "nice to have", "желательно"]),
]

MONTH_STEMS = [
    ("январ", 1), ("феврал", 2), ("март", 3), ("апрел", 4), ("мая", 5), ("май", 5), ("июн", 6),
    ("июл", 7), ("август", 8), ("сентябр", 9), ("октябр", 10), ("ноябр", 11), ("декабр", 12),
]

JUNIOR_WORDS = {
    "is_for_juniors": ["junior", "стаж", "intern", "младший", "джун"],
    "allows_students": ["студент", "подходит для студентов", "без полного высшего"],
    "has_mentoring": ["ментор", "наставнич"],
    "has_test_task": ["тестовое задание", "test task", "coding challenge"],
}

# --- fixed values: market, trends, career ----------------------------------

# label, rows, salaried rows, salary coverage
CONFIDENCE_LEVELS = [("high", 80, 30, 0.30), ("medium", 20, 5, 0.10)]

GRADE_RANK = {
    "intern": -1, "jun": 0, "junior": 0, "middle": 1, "mid": 1, "senior": 2, "lead": 3, "principal": 4,
}

CAREER_ROLE_ALIASES = {
    "data analyst": ["data", "analyst", "data analyst"],
    "business analyst": ["analyst", "business analyst"],
    "bi analyst": ["analyst", "bi analyst"],
    "data scientist": ["data", "ml", "data scientist"],
    "ml engineer": ["ml", "ml engineer"],
}
