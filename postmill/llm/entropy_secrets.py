"""Secrets in texts: fixed patterns, and windows of high Shannon entropy.

All work is column expressions. Positions are code points from 0, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the patterns of the base kinds
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# shorter matches are dropped, and none of these can be hidden by a shorter one
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
VALUE_LENGTH = 6


@dataclass(frozen=True)
class CharacterClass:
    """Strings over ``alphabet`` of ``window`` or more characters hide a secret where a window has ``bits`` or more per character."""

    name: str
    alphabet: str
    pattern: str
    window: int
    bits: float


_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("hexadecimal", _DIGITS + "abcdefABCDEF", r"[0-9a-fA-F]{20,}", 20, 2.9),
    CharacterClass("capitals", _DIGITS + _LOWER.upper(), r"[0-9A-Z]{20,}", 20, 3.4),
    CharacterClass("base64", _DIGITS + _LOWER + _LOWER.upper() + "+/=_-", r"[0-9A-Za-z+/=_-]{24,}", 24, 3.9),
)

# strings that are known not to be secrets
ALLOWED = (
    r"^[A-Za-z_/=+-]+$",  # words and paths without a digit
    r"^[0-9_/=+-]+$",  # numbers, dates and telephone numbers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # identifiers
    r"(?i:example|sample|placeholder|dummy|changeme|xxxx|0{8}|12345678|abcdefgh)",
)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _found(text: Column, pattern: str) -> Column:
    """Matches of a pattern that is never empty, leftmost first: array<struct<start, end, match>>."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<start: int, end: int, match: string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return _let(F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match")), lambda s: F.struct(
            s["end"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out")
        ))

    # what lies between the matches gives their places; the piece after the last has no match
    both = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match")), lambda x: x["match"].isNotNull())
    places = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), places).otherwise(none)


def assignments(text: Column) -> Column:
    """Names of secrets with a value of six or more characters; a shorter value uses its match up."""
    return F.filter(_found(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= VALUE_LENGTH)


def access_keys(text: Column) -> Column:
    return _found(text, ACCESS_LONG)


def hex_runs(text: Column) -> Column:
    return _found(text, HEX_LONG)


def _put(counts: Column, place: Column, value: Column) -> Column:
    return F.concat(F.slice(counts, F.lit(1), place - 1), F.array(value), F.slice(counts, place + 1, F.size(counts)))


def _entropic(chars: Column, kind: CharacterClass) -> Column:
    """Ranges covered by windows of high entropy: array<struct<start, end>> inside one candidate.

    Counts of the window's characters, and the sum of n × log2(n) over them, are kept
    up to date for the one character that enters and the one that leaves.
    """
    size, least = kind.window, (math.log2(kind.window) - kind.bits) * kind.window + 1e-9
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(size + 2)])
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    zero = F.array_repeat(F.lit(0), len(kind.alphabet))

    def moved(acc: Column, char: Column, by: int) -> Column:
        place = F.instr(F.lit(kind.alphabet), char)
        return _let(F.struct(place.alias("k"), F.element_at(acc["counts"], place).alias("n")), lambda x: F.struct(
            _put(acc["counts"], x["k"], x["n"] + by).alias("counts"),
            (acc["sum"] + F.get(weight, x["n"] + by) - F.get(weight, x["n"])).alias("sum"), acc["out"].alias("out"),
        ))

    def covered(acc: Column, i: Column) -> Column:
        last = F.element_at(acc["out"], -1)
        joins = (F.size(acc["out"]) > 0) & (F.try_element_at(acc["out"], F.lit(-1))["end"] >= i - size)
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(last["start"].alias("start"), i.alias("end"))))
        opened = F.concat(acc["out"], F.array(F.struct((i - size).alias("start"), i.alias("end"))))
        out = F.when((i < size) | (acc["sum"] > least), acc["out"]).when(joins, grown).otherwise(opened)
        return F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum"), out.alias("out"))

    def step(acc: Column, i: Column) -> Column:
        entered = moved(acc, F.element_at(chars, i), 1)
        left = _let(entered, lambda a: F.when(i > size, moved(a, F.element_at(chars, F.greatest(i - size, F.lit(1))), -1)).otherwise(a))
        return _let(left, lambda a: covered(a, i))

    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda acc: acc["out"])


def entropy_runs(text: Column) -> Column:
    """Ranges of high entropy in strings of each character class that the allow-list does not know: array<struct<start, end>>."""
    def ranges(kind: CharacterClass) -> Column:
        unknown = F.filter(_found(text, kind.pattern), lambda m: ~m["match"].rlike("|".join(ALLOWED)))
        return F.flatten(F.transform(unknown, lambda m: F.transform(
            _let(F.split(m["match"], ""), lambda chars: _entropic(chars, kind)),
            lambda r: F.struct((m["start"] + r["start"]).alias("start"), (m["start"] + r["end"]).alias("end")),
        )))

    return F.array_distinct(F.concat(*[ranges(kind) for kind in CLASSES]))


def scanned(text: Column) -> dict[str, Column]:
    """Columns ``assign``, ``access``, ``hex`` (base kinds) and ``entropy`` (what the method adds) for a text, NULL as empty.

    An entropy range inside a base match adds nothing and is left out. Text is
    scanned as a whole; a range is reported for each place it occurs at.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    return {"assign": assignments(text), "access": access_keys(text), "hex": hex_runs(text), "entropy": entropy_runs(text)}


def labelled(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def outside(spans: Column, base: Column) -> Column:
    """Ranges that no base match contains."""
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
