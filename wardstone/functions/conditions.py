"""Conditions, rule trees and globs compiled to Columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Rules:
    """all / any / none_of, each holding conditions or nested rules; empty means true."""

    all: tuple = ()
    any: tuple = ()
    none_of: tuple = ()


def glob_regex(pattern: str, escape_dots: bool = True, question_mark: bool = True) -> str:
    out = pattern.replace(".", "\\.") if escape_dots else pattern
    out = out.replace("*", ".*")
    return "^" + (out.replace("?", ".") if question_mark else out) + "$"


def glob_match(value: Column, pattern: str, escape_dots: bool = True) -> Column:
    return value.rlike(glob_regex(pattern, escape_dots))


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _ipv4(c: Column) -> Column:
    parts = F.split(c, "\\.")
    n = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * 256 ** (3 - i) for i in range(4)), F.lit(0))
    return F.when(F.size(parts) == 4, n)


def in_network(ip: Column, network: str) -> Column:
    base, _, bits = network.partition("/")
    size = 2 ** (32 - int(bits or 32))
    octets = [int(x) for x in base.split(".")]
    start = sum(o * 256 ** (3 - i) for i, o in enumerate(octets)) // size * size
    return _ipv4(ip).between(start, start + size - 1)


def compile_condition(c: Condition, attribute=F.col) -> Column:
    """One comparison; a missing attribute makes it false (not_in on a scalar list too)."""
    left, v = attribute(c.field), c.value
    text = left.cast("string")
    values = list(v) if isinstance(v, (list, tuple)) else [v]
    ops = {
        "eq": lambda: left == F.lit(v),
        "ne": lambda: left != F.lit(v),
        "lt": lambda: _number(left) < float(v),
        "le": lambda: _number(left) <= float(v),
        "gt": lambda: _number(left) > float(v),
        "ge": lambda: _number(left) >= float(v),
        "between": lambda: _number(left).between(float(v[0]), float(v[1])),
        "contains": lambda: text.contains(str(v)),
        "list_contains": lambda: F.array_contains(left, v),
        "starts_with": lambda: text.startswith(str(v)),
        "ends_with": lambda: text.endswith(str(v)),
        "matches": lambda: text.rlike(str(v)),
        "like": lambda: reduce(lambda a, b: a | b, [glob_match(text, x) for x in values]),
        "in": lambda: left.isin(values),
        "not_in": lambda: ~left.isin(values),
        "ip": lambda: reduce(lambda a, b: a | b, [in_network(text, x) for x in values]),
        "before": lambda: left.cast("timestamp") < F.lit(v).cast("timestamp"),
        "after": lambda: left.cast("timestamp") > F.lit(v).cast("timestamp"),
        "bool": lambda: F.coalesce(text.try_cast("boolean"), F.lit(False)) == F.lit(bool(v)),
    }
    return F.coalesce(ops[c.op](), F.lit(False))


def compile_rules(r: Rules | Condition | None, attribute=F.col) -> Column:
    if r is None:
        return F.lit(True)
    if isinstance(r, Condition):
        return compile_condition(r, attribute)
    out = F.lit(True)
    for x in r.all:
        out = out & compile_rules(x, attribute)
    if r.any:
        out = out & reduce(lambda a, b: a | b, [compile_rules(x, attribute) for x in r.any])
    for x in r.none_of:
        out = out & ~compile_rules(x, attribute)
    return out
