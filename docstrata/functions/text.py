"""Text, path and formatting functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for Java patterns, and as the characters themselves.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(c, F.lit(BLANKS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w != "")


def normalize_whitespace(c: Column) -> Column:
    """no white space at line ends, at most one blank line in a row, none at the ends of the text."""
    ends = F.regexp_replace(c, rf"[{SPACE}&&[^\n]]+(?=\n|\z)", "")
    return strip(F.regexp_replace(ends, r"\n{3,}", "\n\n"))


def strip_bom(c: Column) -> Column:
    """without one leading byte order mark."""
    return F.regexp_replace(c, "^﻿", "")


def first_line_title(raw: Column, path: Column) -> Column:
    """the first line that is not blank, else the file's stem."""
    return F.coalesce(F.nullif(strip(F.regexp_extract(raw, rf"([^\n]*[^{SPACE}][^\n]*)", 1)), F.lit("")), stem(path))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def extension(path: Column) -> Column:
    """The last suffix of the file's name with its dot; a name that begins with its only dot has none."""
    return F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]+)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+\z", "")


def make_doc_id(path: Column) -> Column:
    """lower-case stem with underscores, then the extension."""
    ext = F.lower(F.regexp_replace(extension(path), r"^\.", ""))
    return F.concat(F.translate(F.lower(stem(path)), " -", "__"), F.lit("_"), ext)


def content_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes, with a prefix."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def chunk_id(doc_id: Column, index: Column, content: Column) -> Column:
    """K10."""
    return F.format_string("%s_chunk_%04d_%s", doc_id, index, F.substring(F.sha2(content, 256), 1, 8))


def count_lines(c: Column) -> Column:
    """lines of the stripped text; none for an empty one."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")))


def one_decimal(v: Column) -> Column:
    """A number with one decimal; a tie, which a quarter is and no other, goes to the even digit."""
    tie = F.abs(v) % 1 == 0.25
    return F.format_string("%.1f", F.when(tie, v - F.signum(v) * F.lit(0.01)).otherwise(v))


def human_size(n: Column) -> Column:
    """F61."""
    kb = F.concat(one_decimal(n / F.lit(1024.0)), F.lit(" KB"))
    mb = F.concat(one_decimal(n / F.lit(1048576.0)), F.lit(" MB"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, kb).otherwise(mb)


def strip_markdown(c: Column) -> Column:
    """without heading marks, bold, italics and inline code."""
    for pattern, to in ((r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"__(.+?)__", "$1"), (r"\*(.+?)\*", "$1"), (r"(?<![\w])_(.+?)_(?![\w])", "$1"), (r"`([^`]*)`", "$1")):
        c = F.regexp_replace(c, pattern, to)
    return c


def preview(c: Column, most: int = 200) -> Column:
    """F64."""
    return F.when(F.length(c) > most, F.concat(rstrip(F.substring(c, 1, most)), F.lit("..."))).otherwise(c)


def percent(c: Column) -> Column:
    """F66."""
    return F.concat(one_decimal(c * F.lit(100.0)), F.lit("%"))


def formatted(query: Column, content: Column, kind: str) -> Column:
    """as Markdown, JSON or plain text."""
    if kind == "json":
        return F.to_json(F.struct(query.alias("query"), content.alias("content")))
    return strip_markdown(content) if kind == "text" else content


def peripheral_heading(content: Column) -> tuple[Column, Column]:
    """name and description in the first top heading, split at a dash."""
    line = F.regexp_extract(content, r"(?m)^# (.*)$", 1)
    return strip(F.split(line, " — | - ", 2)[0]), F.coalesce(strip(F.try_element_at(F.split(line, " — | - ", 2), F.lit(2))), F.lit(""))


def front_matter(c: Column) -> tuple[Column, Column]:
    """what stands between the opening and closing dashes, and the body after them."""
    close = F.locate("\n---", c, 4)
    has = c.startswith("---") & (close > 0)
    body = F.regexp_replace(F.substring(c, close + 4, F.length(c)), r"^\n", "")
    return F.when(has, F.substring(c, F.lit(4), close - 4)).otherwise(""), F.when(has, body).otherwise(c)
