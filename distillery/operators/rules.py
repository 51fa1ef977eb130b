"""Row validation rules with quarantine.

A rule is a named predicate on one column. Every failed rule adds its
reason to an ``errors`` array; rows with no errors are valid, the rest are
quarantined with their reasons. A null value fails a rule unless the rule
is optional. All rules are one projection: no shuffle, codegen'd.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distillery import options as O


@dataclass(frozen=True)
class Rule:
    column: str
    kind: str  # min_length max_length gt ge lt le enum required type
    value: Any = None
    optional: bool = False
    name: str | None = None

    @property
    def reason(self) -> str:
        if self.name:
            return self.name
        if self.kind == "required":
            return f"{self.column}:required"
        if self.kind == "enum":
            return f"{self.column}:enum"
        return f"{self.column}:{self.kind}:{self.value}"


def min_length(c, n, **kw):
    return Rule(c, "min_length", n, **kw)


def max_length(c, n, **kw):
    return Rule(c, "max_length", n, **kw)


def gt(c, v, **kw):
    return Rule(c, "gt", v, **kw)


def ge(c, v, **kw):
    return Rule(c, "ge", v, **kw)


def lt(c, v, **kw):
    return Rule(c, "lt", v, **kw)


def le(c, v, **kw):
    return Rule(c, "le", v, **kw)


def one_of(c, values, **kw):
    return Rule(c, "enum", tuple(values), **kw)


def required(c, **kw):
    return Rule(c, "required", None, **kw)


def of_type(c, type_name, **kw):
    return Rule(c, "type", type_name, **kw)


def _predicate(rule: Rule) -> Column:
    c = F.col(rule.column)
    k, v = rule.kind, rule.value
    if k == "min_length":
        return F.length(c) >= F.lit(v)
    if k == "max_length":
        return F.length(c) <= F.lit(v)
    if k == "gt":
        return c > F.lit(v)
    if k == "ge":
        return c >= F.lit(v)
    if k == "lt":
        return c < F.lit(v)
    if k == "le":
        return c <= F.lit(v)
    if k == "enum":
        return c.isin(list(v))
    if k == "required":
        return F.lit(True)
    if k == "type":
        return c.try_cast(v).isNotNull()
    raise ValueError(f"unknown rule kind {k!r}")


def passes(rule: Rule) -> Column:
    """Boolean column, never null: does the row satisfy ``rule``?"""
    c = F.col(rule.column)
    return F.when(c.isNull(), F.lit(bool(rule.optional) and rule.kind != "required")) \
            .otherwise(F.coalesce(_predicate(rule), F.lit(False)))


def errors(rules: list[Rule]) -> Column:
    """``ARRAY<STRING>`` of the reasons of all failed rules, in rule order."""
    return F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.reason)) for r in rules]))


def validate(df: DataFrame, rules: list[Rule], out: str = "errors") -> DataFrame:
    """Add ``errors`` and ``is_valid`` columns."""
    return (df.withColumn(out, errors(rules))
              .withColumn("is_valid", F.size(F.col(out)) == F.lit(0)))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``errors``)."""
    v = validate(df, rules)
    return (v.filter("is_valid").drop("errors", "is_valid"),
            v.filter(~F.col("is_valid")).drop("is_valid"))


def system_prompt_rules(column: str = "system") -> list[Rule]:
    """A system prompt holds 20 to 1024 characters."""
    return [min_length(column, O.SYSTEM_PROMPT_MIN_CHARS), max_length(column, O.SYSTEM_PROMPT_MAX_CHARS)]


def check_system_prompt(text: str) -> str:
    """E6 at plan time for a literal prompt; raises ValueError when out of bounds."""
    if not isinstance(text, str):
        raise TypeError("system prompt must be a string")
    if not O.SYSTEM_PROMPT_MIN_CHARS <= len(text) <= O.SYSTEM_PROMPT_MAX_CHARS:
        raise ValueError(f"system prompt length {len(text)} outside "
                         f"[{O.SYSTEM_PROMPT_MIN_CHARS}, {O.SYSTEM_PROMPT_MAX_CHARS}]")
    return text
