"""Formats, document types, content types and figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import lookup
from .text import extension, stem

# What files and passages are called by.
FORMATS = {
    ".pdf": "pdf", ".svd": "svd", ".md": "markdown", ".markdown": "markdown", ".txt": "text", ".text": "text", ".dts": "device_tree", ".dtsi": "device_tree",
    ".h": "c_header", ".c": "c_source", ".rs": "rust", ".html": "html", ".htm": "html", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".ioc": "cubemx",
    ".png": "image", ".jpg": "image", ".jpeg": "image",
}
PARSERS = {f: f for f in ("pdf", "svd", "markdown", "text", "device_tree", "c_header", "c_source", "rust", "html", "json", "yaml", "cubemx", "image")}
FIXED_TYPES = {"svd": "svd", "device_tree": "device_tree", "c_header": "code", "c_source": "code", "rust": "code", "markdown": "documentation"}
NAME_TYPES = (
    (r"(?i)(datasheet|\bds_|_ds\b)", "datasheet"),
    (r"(?i)(reference|ref_manual|\brm_|_rm\b)", "reference_manual"),
    (r"(?i)(errata|erratum|\bes_|_es\b)", "errata"),
    (r"(?i)(app_note|appnote|\ban_|_an\b)", "app_note"),
    (r"(?i)schematic", "schematic"),
)
FENCE = r"(?m)^(`{3,}|~{3,})"
TABLE_RULE = r"(?m)^\|[\s:]*-+[\s:]*\|"
HEADING = r"(?m)^(#{1,6})\s+(.+)$"
REGISTER_WORDS = r"(?iu)\b(?:register|offset|reset\s*value|bit\s*field|read[/\s-]write|read[/\s-]only|write[/\s-]only|base\s*address)\b|0x[0-9A-Fa-f]{8}"
TIMING_WORDS = r"(?iu)\b\d+\s*(?:ns|µs|us|ms|MHz|kHz|GHz)\b|\b(?:setup\s*time|hold\s*time|propagation\s*delay|clock\s*(?:speed|frequency|period)|baud\s*rate)\b"
PROCEDURE_WORDS = r"(?iu)\b(?:step\s*\d|initialization\s*sequence|programming\s*procedure|following\s*steps|must\s*be\s*set|should\s*be\s*configured)\b"
ERRATA_WORDS = r"(?iu)\b(?:errat(?:a|um)|workaround|limitation|silicon\s*bug|advisory|known\s*issue)\b|ES\d{4}"
PIN_WORDS = r"(?iu)\b(?:alternate\s*function|AF\d+|pin\s*(?:mapping|assignment|configuration)|remap)\b|\bGPIO[A-Z]\d*\b"
ELECTRICAL_WORDS = r"(?iu)\b\d+\.?\d*\s*(?:mA|µA|uA|kΩ)\b|\b(?:power\s*supply|current\s*consumption|voltage\s*(?:range|level))\b|\bV(?:DD|CC|SS|DDA|BAT|REF)\b"
FIGURES = (
    (r"(?i)\b(timing|waveform|t_?su|t_?hd|t_?hold|t_?setup|clock|clk)\b", "timing_diagram"),
    (r"(?i)\b(block\s+diagram|architecture|peripheral|bus|ahb|apb)\b", "block_diagram"),
    (r"(?i)\b(pin|pinout|package|qfp|lqfp|bga)\b", "pinout"),
    (r"(?i)\b(schematic|circuit|transistor|mosfet)\b", "schematic_figure"),
)
SUPPORTED = frozenset(FORMATS)


def first_of(c: Column, rules: tuple[tuple[str, str], ...], other: str | Column) -> Column:
    """Name of the first pattern that the text holds."""
    out = other if isinstance(other, Column) else F.lit(other)
    for pattern, name in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def extension_format(path: Column) -> Column:
    """S1."""
    return lookup(F.lower(extension(path)), FORMATS)


def magic_format(content: Column) -> Column:
    """From the first sixteen bytes."""
    head = F.hex(F.substring(content, 1, 16))
    return F.when(head.startswith("255044462D"), "pdf").when(head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF"), "image")


def is_register_xml(path: Column, content: Column) -> Column:
    """S3."""
    head = F.lower(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"))
    return F.lower(extension(path)).eqNullSafe(".xml") & head.contains("<device")


def detect_format(path: Column, content: Column, length: Column) -> Column:
    """struct(format, confidence)."""
    by_name = F.when(is_register_xml(path, content), F.lit("svd")).otherwise(extension_format(path))
    by_bytes = magic_format(content)
    form = F.coalesce(by_name, by_bytes, F.lit("unknown"))
    sure = (
        F.when(by_name.isNull() & by_bytes.isNull(), 0.0).when(by_name.isNull(), 0.8).when(by_bytes.isNull(), F.when(length == 0, 1.0).otherwise(0.9)).when(by_name == by_bytes, 1.0).otherwise(0.7)
    )
    return F.struct(form.alias("format"), sure.alias("confidence"))


def parser_name(form: Column) -> Column:
    """S5."""
    return F.coalesce(lookup(form, PARSERS), F.lit(""))


def document_type(path: Column, form: Column) -> Column:
    """S6."""
    return F.coalesce(lookup(form, FIXED_TYPES), first_of(stem(path), NAME_TYPES, "unknown"))


def content_type(c: Column) -> Column:
    """K11."""
    in_table = ((REGISTER_WORDS, "register_table"), (PIN_WORDS, "pin_mapping"), (ELECTRICAL_WORDS, "electrical_spec"), (TIMING_WORDS, "timing_spec"))
    in_prose = (
        (ERRATA_WORDS, "errata"), (PROCEDURE_WORDS, "config_procedure"), (REGISTER_WORDS, "register_description"), (TIMING_WORDS, "timing_spec"),
        (PIN_WORDS, "pin_mapping"), (ELECTRICAL_WORDS, "electrical_spec"), (HEADING, "section"),
    )
    return F.when(c.rlike(FENCE), "code").when(c.rlike(TABLE_RULE), first_of(c, in_table, "table")).otherwise(first_of(c, in_prose, "prose"))


def figure_type(c: Column) -> Column:
    """S22."""
    return first_of(c, FIGURES, "figure")
