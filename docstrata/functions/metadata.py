"""Metadata of mixed shape as VARIANT (F4, S11, S24, S27, S29): typed values, filters on paths, what keys there are.

A value that a path lacks, or that is of another kind than asked for, is null and
fits no filter. Text that is no JSON is null as a whole. Parquet keeps the type;
paths that a query takes are read by the scan itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scalar = bool | int | float | str
TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}
COMPARISONS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def from_json(text: Column) -> Column:
    """JSON as a variant; null if it is none."""
    return F.try_parse_json(text)


def typed(facts: Column) -> Column:
    """A map of strings as a variant object: whole numbers of up to 18 digits, decimals, truth values and None by what they say, all else as text."""
    text = lambda v: F.trim(v)

    def one(_: Column, v: Column) -> Column:
        whole = F.when(text(v).rlike(r"^-?(0|[1-9][0-9]{0,17})\z"), text(v).try_cast("bigint").cast("variant"))
        decimal = F.when(text(v).rlike(r"^-?[0-9]{1,15}\.[0-9]{1,15}\z"), text(v).try_cast("double").cast("variant"))
        truth = F.when(F.lower(text(v)).isin("true", "false"), F.lower(text(v)).try_cast("boolean").cast("variant"))
        nothing = F.when(v.isNull() | (text(v) == "None"), F.parse_json(F.lit("null")))
        return F.coalesce(whole, decimal, truth, nothing, v.cast("variant"))

    return F.to_variant_object(F.transform_values(facts, one))


def value(facts: Column, path: str, kind: str) -> Column:
    """What stands at a path such as ``user.id`` or ``tags[0]``."""
    return F.try_variant_get(facts, f"$.{path}", kind)


def _fits(facts: Column, path: str, asked: Scalar | Sequence) -> Column:
    how, what = asked if isinstance(asked, tuple) else ("in", asked) if isinstance(asked, list) else ("=", asked)
    first = what[0] if isinstance(what, list) and what else what
    if type(first) not in TYPES or how not in {*COMPARISONS, "in"}:
        raise ValueError(f"{path}: no filter {asked!r}")
    found = value(facts, path, TYPES[type(first)])
    return F.coalesce(found.isin(what) if how == "in" else COMPARISONS[how](found, F.lit(what)), F.lit(False))


def matches(facts: Column, filters: Mapping[str, Scalar | Sequence]) -> Column:
    """All of some filters: ``{"chip": "X", "page": (">", 3), "user.tag": ["a", "b"]}``; true without any."""
    return reduce(lambda a, b: a & b, (_fits(facts, p, x) for p, x in filters.items()), F.lit(True))


def profile(rows: DataFrame, column: str) -> DataFrame:
    """(key, kind, n): how many rows have a key with a value of a kind, the top keys of objects."""
    spark = rows.sparkSession
    each = rows.select(column).where(F.col(column).isNotNull()).lateralJoin(spark.tvf.variant_explode(F.col(column).outer()))
    kind = F.lower(F.regexp_extract(F.schema_of_variant("value"), r"^[A-Z]+", 0))
    return each.where("key is not null").groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"))
