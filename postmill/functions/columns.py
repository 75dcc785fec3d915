"""Small helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.fixed_values import NOISY_SKILLS, PREFIX_GROUPS

SALARY_COLUMNS = ("salary_mid_rub_capped", "salary_mid_rub", "salary_mid")
GRADE_COLUMNS = ("grade_final", "grade")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def first_existing(df: DataFrame, *names: str) -> str | None:
    """First of ``names`` that is a column of ``df``."""
    return next((n for n in names if n in df.columns), None)


def require(df: DataFrame, *names: str) -> str:
    found = first_existing(df, *names)
    if found is None:
        raise ValueError(f"expected one of the columns {', '.join(names)}")
    return found


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def columns_of(df: DataFrame, kind) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def flag(name: str | Column) -> Column:
    """Boolean column with NULL read as false."""
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(False))


def flag_int(name: str | Column) -> Column:
    return flag(name).cast("int")


def share(name: str | Column) -> Column:
    """Mean of a flag, NULL read as false."""
    return F.avg(flag_int(name).cast("double"))


def prefixed_flags(df: DataFrame, *prefixes: str) -> list[str]:
    """Boolean columns by prefix; counters that share a prefix are not flags."""
    return [c for c in columns_of(df, T.BooleanType) if c.startswith(prefixes)]


def column_groups(df: DataFrame) -> dict[str, list[str]]:
    """Business prefix -> columns, from metadata alone."""
    return {p: [c for c in df.columns if c.startswith(p)] for p in PREFIX_GROUPS}


def skill_label(column: str) -> str:
    """Flag name without its skill prefix."""
    name = column.strip()
    for prefix in ("skill_", "has_"):
        if name.startswith(prefix):
            return name[len(prefix):]
    return name


def market_skills(df: DataFrame) -> list[str]:
    """Skill flags without the reference list of noisy names."""
    noisy = {skill_label(s) for s in NOISY_SKILLS}
    return [c for c in prefixed_flags(df, "skill_", "has_") if skill_label(c) not in noisy]


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def any_of(conditions: Iterable[Column]) -> Column:
    conditions = list(conditions)
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: Iterable[Column]) -> Column:
    conditions = list(conditions)
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def first_match(cases: Sequence[tuple[Column, Column | str]], otherwise: Column | str | None) -> Column:
    """Ordered rules as one ``when`` chain."""
    chain = None
    for condition, value in cases:
        value = F.lit(value) if isinstance(value, str) else value
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    last = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    return last if chain is None else chain.otherwise(last)


def contains_any(text: Column, keywords: Iterable[str]) -> Column:
    return any_of(text.contains(k) for k in keywords)


def whole_days(later: Column, earlier: Column) -> Column:
    """Days between two timestamps, floored toward minus infinity."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)).cast("int")


def monday(value: Column) -> Column:
    return F.date_trunc("week", value).cast("date")


def not_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(all_of(F.col(k).isNotNull() for k in keys)) if keys else df


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on keys where NULL equals NULL; the key columns of ``left`` stay."""
    if not keys:
        return left.join(right, F.lit(True), how)
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = all_of(F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys)
    return left.join(right, on, how).drop(*[f"_right_{k}" for k in keys])


def not_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(all_of(F.col(k).isNotNull() for k in keys)) if keys else df


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on keys where NULL equals NULL; the key columns of ``left`` stay."""
    if not keys:
        return left.join(right, F.lit(True), how)
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = all_of(F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys)
    return left.join(right, on, how).drop(*[f"_right_{k}" for k in keys])


def blank_to_null(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(trimmed != "", trimmed)


def wide_to_long(df: DataFrame, ids: Sequence[str], names: Sequence[str], label: str, value: str) -> DataFrame:
    """Unpivot already aggregated columns."""
    return df.unpivot([F.col(i) for i in ids], [F.col(n) for n in names], label, value)
