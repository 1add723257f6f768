"""Keyword relevance, sections and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stem, strip

# Words that say nothing about a peripheral, and words that tell of its use.
STOPWORDS = (
    "the and for are but not you all can had her was one our out has his how its may new now old see way who did get let say she too use with this that from "
    "they been have will each make like long look many some them than into only when also after should could would there their what about which other these "
    "then just more over such where most very does must being before between through register offset size access reset description field bits value name type "
    "table note reserved"
).split()
USAGE_WORDS = ("initialization", "configuration", "procedure", "setup", "programming", "enable", "how to")
REGISTER_CELL = r"(?m)^\|\s*([A-Z][A-Z0-9_]+)\s*\|"
SEPARATOR = " > "


def tokenize(c: Column) -> Column:
    """distinct words of two letters or digits at least that begin with a letter, without stopwords."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z][a-zA-Z0-9]++(?![\p{L}\p{N}_])"), F.lit(0))
    return F.array_except(F.transform(F.array_distinct(found), F.lower), F.array(*map(F.lit, STOPWORDS)))


def keywords(name: Column, register_map: Column, description: Column) -> Column:
    """the name, its base without digits, registers of the map's tables, words of the description."""
    own = F.lower(name)
    base = F.regexp_replace(own, r"\d+\z", "")
    cells = F.transform(F.regexp_extract_all(register_map, F.lit(REGISTER_CELL), F.lit(1)), F.lower)
    found = F.array_union(F.array_except(cells, F.array(*map(F.lit, STOPWORDS))), tokenize(description))
    return F.array_distinct(F.filter(F.concat(F.array(own, base), found), lambda w: w != ""))


def relevance(keys: Column, text_words: Column) -> Column:
    """F24."""
    return F.when(F.size(keys) > 0, F.size(F.array_intersect(keys, text_words)) / F.size(keys)).otherwise(0.0)


def sections(path: Column) -> Column:
    return F.transform(F.split(path, SEPARATOR), strip)


def peripheral_of(path: Column) -> Column:
    """second element of a section path, or nothing."""
    return F.coalesce(F.try_element_at(sections(path), F.lit(2)), F.lit(""))


def mentions(path: Column, name: Column) -> Column:
    """Some element is the name, whatever its case."""
    return F.exists(sections(path), lambda s: F.lower(s) == F.lower(name))


def is_usage(path: Column) -> Column:
    """P5."""
    return F.lower(path).rlike("|".join(USAGE_WORDS))


def task_name(path: Column) -> Column:
    """F25."""
    return F.when(F.size(sections(path)) >= 3, F.try_element_at(sections(path), F.lit(-1))).otherwise("General")


def described(register_map: Column) -> Column:
    """the description line in the first twenty lines."""
    mark = "**Description:**"
    lines = F.filter(F.transform(F.slice(F.split(register_map, "\n"), 1, 20), strip), lambda x: x.startswith(mark))
    return F.coalesce(strip(F.substring(F.try_element_at(lines, F.lit(1)), F.lit(len(mark) + 1), F.lit(1 << 30))), F.lit(""))


def build_title(path: Column, doc_id: Column) -> Column:
    """F28."""
    return F.when(F.coalesce(path, F.lit("")) == "", doc_id).otherwise(F.translate(stem(path), "_-", "  "))


def citation(title: Column, path: Column, doc_type: Column, page: Column) -> Column:
    """F27."""
    parts = F.split(path, SEPARATOR)
    brief = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), SEPARATOR)).otherwise(path)
    section = F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("§"), brief))
    at = F.when((doc_type == "pdf") & (page > 0), F.concat(F.lit("p."), page.cast("string")))
    return F.concat(F.lit("*Source: "), F.concat_ws(", ", title, section, at), F.lit("*"))
