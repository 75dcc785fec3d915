"""Benchmark tables seen as postings, product events, users and profiles.

``postings`` joins only the tables whose columns are asked for. No side is
forced into a broadcast: Catalyst and AQE choose it by measured size.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FIRST_WORDS = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
SECOND_WORDS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; its footer is read once per process to learn the schema."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _word(name: str) -> Column:
    return F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).contains(f" {name} ")


def _flag_columns() -> dict[str, tuple[str, Column]]:
    flags = {f"skill_{w}": ("part", _word(w)) for w in SECOND_WORDS}
    flags |= {f"has_{w}": ("part", _word(w)) for w in FIRST_WORDS}
    flags |= {f"domain_{s}": ("customer", F.lower("c_mktsegment") == s) for s in SEGMENTS}
    flags |= {
        "benefit_sport": ("lineitem", F.col("l_quantity") >= 25),
        "benefit_stock": ("lineitem", F.col("l_quantity") % 7 == 0),
        "benefit_education": ("lineitem", F.col("l_tax") >= 0.04),
        "soft_teamwork": ("lineitem", F.when(F.col("l_linenumber") != 7, F.col("l_linenumber") % 2 == 0)),
        "soft_leadership": ("lineitem", F.col("l_quantity") > 40),
        "soft_communication": ("lineitem", F.col("l_quantity") % 3 == 0),
    }
    return flags


_built: dict[int, dict[str, tuple[str, Column]]] = {}


def _columns() -> dict[str, tuple[str, Column]]:
    """Expressions of the posting view, built once per JVM."""
    jvm = id(SparkContext._gateway)
    if jvm not in _built:
        _built[jvm] = _build_columns()
    return _built[jvm]


def _build_columns() -> dict[str, tuple[str, Column]]:
    nation = F.col("n_nationkey")
    grade = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "lead")
        .when(F.col("o_orderpriority") == "2-HIGH", "senior")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "middle")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "junior")
        .when(F.col("o_orderpriority") == "5-LOW", "intern")
    )
    mode = F.col("l_returnflag")
    flags = _flag_columns()
    return {
        "vacancy_id": ("lineitem", F.col("l_orderkey") * 10 + F.col("l_linenumber")),
        "ordinal": (
            "lineitem",
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"),
                        F.round(F.col("l_extendedprice") * 100).cast("long")),
        ),
        "title": ("part", F.col("p_name")),
        "primary_role": ("part", F.lower("p_type")),
        "grade_final": ("orders", grade),
        "city": ("nation", F.col("n_name")),
        "city_normalized": ("nation", F.col("n_name")),
        "city_tier": (
            "nation",
            F.when(nation == 0, "Moscow").when(nation == 1, "SPb").when(nation < 8, "Million+")
            .when(nation < 12, "KZ/Other").when(nation < 24, "Other RU"),
        ),
        "region": ("region", F.col("r_name")),
        "country": ("region", F.concat(F.lit("C"), F.col("r_regionkey") % 3)),
        "work_mode": ("lineitem", F.when(mode == "A", "remote").when(mode == "R", "hybrid").otherwise("office")),
        "geo_scope": ("lineitem", F.when(mode == "A", "remote").when(mode == "R", "mixed").otherwise("local")),
        "is_remote": ("lineitem", mode == "A"),
        "is_junior_friendly": ("orders", F.col("o_orderpriority") >= "4"),
        "battle_experience": ("orders", F.col("o_orderpriority") < "4"),
        "domain": ("customer", F.lower("c_mktsegment")),
        "company": ("supplier", F.col("s_name")),
        "employer_rating": ("supplier", F.when(F.col("s_acctbal") > 0, F.round(F.col("s_acctbal") / 2000, 1))),
        "salary_mid_rub_capped": ("lineitem", F.when(F.col("l_discount") > 0, F.col("l_extendedprice"))),
        "salary_disclosed": ("lineitem", F.col("l_discount") > 0.02),
        "currency": ("lineitem", F.when(F.col("l_tax") < 0.07, "RUB").when(F.col("l_tax") < 0.08, "USD")),
        "exp_min_years": ("part", F.when(F.col("p_size") % 6 != 0, F.col("p_size") % 10)),
        "exp_max_years": ("part", F.when(F.col("p_size") % 12 != 0, F.col("p_size") % 10 + 3)),
        "lang_english_level": (
            "part",
            F.when(F.col("p_size") < 10, "none").when(F.col("p_size") < 20, "basic")
            .when(F.col("p_size") < 30, "intermediate").when(F.col("p_size") < 40, "upper_intermediate")
            .when(F.col("p_size") < 45, "advanced"),
        ),
        "edu_level": (
            "part",
            F.when(F.col("p_size") % 5 == 0, "any_he").when(F.col("p_size") % 5 == 1, "none")
            .when(F.col("p_size") % 5 == 2, "bachelor_or_higher").when(F.col("p_size") % 5 == 3, "partial_higher"),
        ),
        # a part name is always two words, so two skill flags are set
        "tech_stack_size": ("part", F.col("p_size") % 12 + 2),
        "quantity": ("lineitem", F.col("l_quantity")),
        "published_at": ("orders", F.col("o_orderdate").cast("timestamp")),
        "scraped_at": ("lineitem", F.col("l_shipdate").cast("timestamp")),
        "day": ("lineitem", F.col("l_shipdate").cast("date")),
        **flags,
    }


# table -> (join key on the posting side, key, table it hangs on)
_PARENTS = {
    "orders": ("l_orderkey", "o_orderkey", None),
    "part": ("l_partkey", "p_partkey", None),
    "supplier": ("l_suppkey", "s_suppkey", None),
    "customer": ("o_custkey", "c_custkey", "orders"),
    "nation": ("c_nationkey", "n_nationkey", "customer"),
    "region": ("n_regionkey", "r_regionkey", "nation"),
}

SKILL_FLAGS = [f"skill_{w}" for w in SECOND_WORDS] + [f"has_{w}" for w in FIRST_WORDS]
DOMAIN_FLAGS = [f"domain_{s}" for s in SEGMENTS]
BENEFIT_FLAGS = ["benefit_sport", "benefit_stock", "benefit_education"]
SOFT_FLAGS = ["soft_teamwork", "soft_leadership", "soft_communication"]


def postings(spark: SparkSession, sf_dir: str, *names: str, by_order: bool = False) -> DataFrame:
    """Posting-shaped view with the asked columns (all of them by default).

    ``by_order`` joins for large tables: orders meet their customers before they meet the postings, last of all
    tables, so that the postings are dealt out twice and end up dealt by their order, which is a column ``_order`` then.
    """
    columns = _columns()
    wanted = list(dict.fromkeys(names)) or list(columns)
    needed: list[str] = []

    def need(source: str | None) -> None:
        if source and source != "lineitem" and source not in needed:
            need(_PARENTS[source][2])
            needed.append(source)

    for n in wanted:
        need(columns[n][0])
    if by_order:
        need("orders")
        order = F.col("l_orderkey").alias("_order")
        return _joined(spark, sf_dir, "lineitem", needed).select(order, *[columns[n][1].alias(n) for n in wanted])
    df = table(spark, sf_dir, "lineitem")
    for source in needed:
        here, there, _ = _PARENTS[source]
        df = df.join(table(spark, sf_dir, source), F.col(here) == F.col(there))
    return df.select(*[columns[n][1].alias(n) for n in wanted])


def _joined(spark: SparkSession, sf_dir: str, name: str, needed: list[str]) -> DataFrame:
    """A table with the needed ones that hang on it, each with its own already joined; orders come last."""
    df = table(spark, sf_dir, name)
    for source in sorted(needed, key=lambda s: s == "orders"):
        here, there, parent = _PARENTS[source]
        if (parent or "lineitem") == name:
            df = df.join(_joined(spark, sf_dir, source, needed), F.col(here) == F.col(there))
    return df


def _sql_flags() -> list[str]:
    flags = [f"contains(' ' || p_name || ' ', ' {w} ') AS skill_{w}" for w in SECOND_WORDS]
    flags += [f"contains(' ' || p_name || ' ', ' {w} ') AS has_{w}" for w in FIRST_WORDS]
    flags += [f"lower(c_mktsegment) = '{s}' AS domain_{s}" for s in SEGMENTS]
    return flags


# the same view for the SQL side
POSTINGS_SQL = f"""
SELECT l_orderkey * 10 + l_linenumber AS vacancy_id,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT,
            round(l_extendedprice * 100)::BIGINT) AS ordinal,
  p_name AS title, lower(p_type) AS primary_role,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'lead' WHEN '2-HIGH' THEN 'senior' WHEN '3-MEDIUM' THEN 'middle'
    WHEN '4-NOT SPECIFIED' THEN 'junior' WHEN '5-LOW' THEN 'intern' END AS grade_final,
  n_name AS city, n_name AS city_normalized,
  CASE WHEN n_nationkey = 0 THEN 'Moscow' WHEN n_nationkey = 1 THEN 'SPb' WHEN n_nationkey < 8 THEN 'Million+'
    WHEN n_nationkey < 12 THEN 'KZ/Other' WHEN n_nationkey < 24 THEN 'Other RU' END AS city_tier,
  r_name AS region,
  'C' || (r_regionkey % 3) AS country,
  CASE l_returnflag WHEN 'A' THEN 'remote' WHEN 'R' THEN 'hybrid' ELSE 'office' END AS work_mode,
  CASE l_returnflag WHEN 'A' THEN 'remote' WHEN 'R' THEN 'mixed' ELSE 'local' END AS geo_scope,
  l_returnflag = 'A' AS is_remote, o_orderpriority >= '4' AS is_junior_friendly,
  o_orderpriority < '4' AS battle_experience,
  lower(c_mktsegment) AS domain, s_name AS company,
  CASE WHEN s_acctbal > 0 THEN round(s_acctbal / 2000, 1) END AS employer_rating,
  CASE WHEN l_discount > 0 THEN l_extendedprice END AS salary_mid_rub_capped,
  l_discount > 0.02 AS salary_disclosed,
  CASE WHEN l_tax < 0.07 THEN 'RUB' WHEN l_tax < 0.08 THEN 'USD' END AS currency,
  CASE WHEN p_size % 6 <> 0 THEN p_size % 10 END AS exp_min_years,
  CASE WHEN p_size % 12 <> 0 THEN p_size % 10 + 3 END AS exp_max_years,
  CASE WHEN p_size < 10 THEN 'none' WHEN p_size < 20 THEN 'basic' WHEN p_size < 30 THEN 'intermediate'
    WHEN p_size < 40 THEN 'upper_intermediate' WHEN p_size < 45 THEN 'advanced' END AS lang_english_level,
  CASE p_size % 5 WHEN 0 THEN 'any_he' WHEN 1 THEN 'none' WHEN 2 THEN 'bachelor_or_higher'
    WHEN 3 THEN 'partial_higher' END AS edu_level,
  p_size % 12 + 2 AS tech_stack_size,
  l_quantity AS quantity, o_orderdate AS published_at, l_shipdate AS scraped_at, l_shipdate::DATE AS day,
  {", ".join(_sql_flags())},
  l_quantity >= 25 AS benefit_sport, l_quantity % 7 = 0 AS benefit_stock, l_tax >= 0.04 AS benefit_education,
  CASE WHEN l_linenumber <> 7 THEN l_linenumber % 2 = 0 END AS soft_teamwork,
  l_quantity > 40 AS soft_leadership, l_quantity % 3 = 0 AS soft_communication
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
"""
