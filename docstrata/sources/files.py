"""Files to documents (S1-S14, S30, S33, F4, F6-F8): one scan, a branch for each format."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ParseError
from ..functions.detect import FORMATS, SUPPORTED, detect_format, document_type, parser_name
from ..functions.scoring import lookup
from ..functions.text import content_hash, extension, first_line_title, front_matter, make_doc_id, normalize_whitespace, stem, strip, strip_bom

MB = 1 << 20
# Size limits, and the chips that "compatible" strings stand for.
LIMITS = {"text": 50 * MB, "markdown": 50 * MB, "device_tree": 10 * MB, "svd": 100 * MB, "pdf": 200 * MB}
CHIPS = {
    "fsl,imx8mp": "i.MX8MP", "fsl,imx8mm": "i.MX8MM", "fsl,imx8mn": "i.MX8MN", "fsl,imx8mq": "i.MX8MQ", "fsl,imx6q": "i.MX6Q", "fsl,imx6dl": "i.MX6DL",
    "fsl,imx6ul": "i.MX6UL", "fsl,imx93": "i.MX93", "ti,am625": "AM625", "ti,am62p": "AM62P", "ti,am6548": "AM6548", "rockchip,rk3588": "RK3588",
    "rockchip,rk3568": "RK3568", "rockchip,rk3399": "RK3399", "allwinner,sun50i-h616": "H616", "allwinner,sun50i-h6": "H6", "st,stm32mp157": "STM32MP157",
    "st,stm32mp135": "STM32MP135", "st,stm32mp251": "STM32MP251", "renesas,r8a774a1": "RZ/G2M", "renesas,r8a779g0": "R-Car V4H", "qcom,sm8550": "SM8550",
    "amlogic,g12a": "S905X2", "nvidia,tegra234": "Tegra234", "mediatek,mt8195": "MT8195", "brcm,bcm2711": "BCM2711", "brcm,bcm2712": "BCM2712", "xlnx,zynqmp": "ZynqMP",
}
COLUMNS = ("doc_id", "content", "doc_type", "title", "source_path", "chip", "metadata", "format", "hash", "error")


def scan(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """Files below the paths, as (path, modificationTime, length, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(list(paths))


def detect(files: DataFrame) -> DataFrame:
    """Each file's format, confidence, document type and parser."""
    found = files.withColumn("_d", detect_format(F.col("path"), F.col("content"), F.col("length")))
    out = found.withColumn("format", F.col("_d.format")).withColumn("confidence", F.col("_d.confidence")).drop("_d")
    return out.withColumn("doc_type", document_type(F.col("path"), F.col("format"))).withColumn("parser", parser_name(F.col("format")))


def parser_for(form: str) -> Callable[[DataFrame], DataFrame]:
    """The parser of a format; an error if there is none."""
    from . import pdf, svd

    known = {"text": parse_text, "markdown": parse_markdown, "device_tree": parse_device_tree, "svd": svd.parse_files, "pdf": pdf.parse_files, "pdf_layout": pdf.parse_layout_files}
    if form not in known:
        raise ParseError(f"No parser for {form!r}")
    return known[form]


def can_parse(form: str, path: str) -> bool:
    """Whether a parser takes files of that name."""
    dot = path.rfind(".")
    ext = path[dot:].lower() if dot > path.rfind("/") else ""
    return FORMATS.get(ext) == form or (form == "svd" and ext == ".xml")


def supported_extensions() -> frozenset[str]:
    """S7."""
    return SUPPORTED


def too_large(form: str) -> Column:
    """A message for files over the format's limit."""
    return F.when(F.col("length") > LIMITS[form], F.format_string(f"ParseError: %s: %d bytes; at most {LIMITS[form]}", F.col("path"), F.col("length")))


def decoded(form: str) -> Column:
    """Content as text; nothing for files over the limit. Wrong bytes become replacement characters."""
    return strip_bom(F.when(F.col("length") <= LIMITS[form], F.decode(F.col("content"), "UTF-8")).otherwise(""))


def decodable(files: DataFrame) -> DataFrame:
    """Files whose bytes are no valid UTF-8 have their wrong sequences replaced, not rejected."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.withColumn("content", text.cast("binary"))


def documents(rows: DataFrame, content: Column, title: Column, doc_type: str, chip: Column | None = None, metadata: Column | None = None, error: Column | None = None) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    return rows.select(
        make_doc_id(F.col("path")).alias("doc_id"), content.alias("content"), F.lit(doc_type).alias("doc_type"), title.alias("title"), F.col("path").alias("source_path"),
        (F.lit("") if chip is None else chip).alias("chip"), (none if metadata is None else metadata).alias("metadata"), F.lit(doc_type).alias("format"),
        content_hash(F.col("content")).alias("hash"), (F.lit(None).cast("string") if error is None else error).alias("error"),
    )


def parse_text(files: DataFrame) -> DataFrame:
    """S10."""
    rows = decodable(files).withColumn("_t", decoded("text"))
    return documents(rows, normalize_whitespace(F.col("_t")), first_line_title(F.col("_t"), F.col("path")), "text", error=too_large("text"))


def yaml_map(source: Column) -> Column:
    """a map of the front matter's keys, values as text; nothing if it is no mapping."""

    @F.pandas_udf("map<string,string>")
    def parse(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import yaml

        def one(t: str | None) -> dict[str, str]:
            try:
                found = yaml.safe_load(t or "")
            except yaml.YAMLError:
                return {}
            return {str(k): str(v) for k, v in found.items()} if isinstance(found, dict) else {}

        for s in texts:
            yield s.map(one)

    return parse(source)


def parse_markdown(files: DataFrame) -> DataFrame:
    """Title from the front matter, else the first heading, else the stem."""
    head, body = front_matter(F.col("_t"))
    rows = decodable(files).withColumn("_t", decoded("markdown")).withColumn("_b", body).withColumn("_m", yaml_map(head))
    heading = F.nullif(strip(F.regexp_extract("_b", r"(?m)^#{1,6}\s+(.+)$", 1)), F.lit(""))
    title = F.coalesce(F.nullif(F.try_element_at("_m", F.lit("title")), F.lit("")), heading, stem(F.col("path")))
    rest = F.map_filter("_m", lambda k, _: k != "title")
    return documents(rows, normalize_whitespace(F.col("_b")), title, "markdown", metadata=rest, error=too_large("markdown"))


def compatibles(c: Column) -> Column:
    """all quoted strings of "compatible" statements, in order, each once."""
    statements = F.regexp_extract_all(c, F.lit(r"(?s)compatible\s*=\s*(.*?);"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(statements, lambda s: F.regexp_extract_all(s, F.lit(r'"([^"]*)"'), F.lit(1)))))


def chip_of(names: Column) -> Column:
    """of the first name that the table has, or that continues one of its names after a dash or underscore."""

    def one(name: Column) -> Column:
        exact = lookup(name, CHIPS)
        longer = [F.when(name.startswith(f"{k}-") | name.startswith(f"{k}_"), F.lit(v)) for k, v in CHIPS.items()]
        return F.coalesce(exact, *longer)

    return F.coalesce(F.try_element_at(F.filter(F.transform(names, one), lambda x: x.isNotNull()), F.lit(1)), F.lit(""))


def parse_device_tree(files: DataFrame) -> DataFrame:
    """S12, F8."""
    rows = decodable(files).withColumn("_t", decoded("device_tree")).withColumn("_c", compatibles(F.col("_t")))
    title = F.coalesce(F.nullif(F.regexp_extract("_t", r'model\s*=\s*"([^"]+)"', 1), F.lit("")), stem(F.col("path")))
    listed = F.when(F.size("_c") > 0, F.create_map(F.lit("compatibles"), F.array_join("_c", ", "))).otherwise(F.create_map().cast("map<string,string>"))
    return documents(rows, strip(F.col("_t")), title, "device_tree", chip_of(F.col("_c")), listed, too_large("device_tree"))


def unparsed(files: DataFrame) -> DataFrame:
    """Files of a format that nothing parses, as documents with an error and no text."""
    said = F.concat(F.lit("ParseError: no parser for "), F.col("format"), F.lit(" files"))
    rows = documents(files, F.lit(""), stem(F.col("path")), "unknown", error=said)
    kinds = files.select(F.col("path").alias("_p"), F.col("format").alias("_f"), F.col("doc_type").alias("_t"))
    joined = rows.join(kinds, F.col("source_path") == F.col("_p"))
    return joined.withColumn("format", F.col("_f")).withColumn("doc_type", F.col("_t")).drop("_p", "_f", "_t")


def read_documents(spark: SparkSession, *paths: str, parsers: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All files below the paths, as documents; what cannot be parsed, or has a format without a parser, has ``error`` set.

    ``parsers`` adds parsers by format, such as one for PDF files, or replaces those that are here.
    """
    files = detect(scan(spark, *paths))
    from . import svd

    branches = {"text": parse_text, "markdown": parse_markdown, "device_tree": parse_device_tree, "svd": svd.parse_files} | dict(parsers or {})
    raw = [parse(files.where(F.col("format") == form).select("path", "length", "content")).select(*COLUMNS) for form, parse in branches.items()]
    raw.append(unparsed(files.where(~F.col("format").isin(*branches))).select(*COLUMNS))
    return reduce(DataFrame.unionByName, raw)


def file_info(spark: SparkSession, *paths: str) -> DataFrame:
    return detect(scan(spark, *paths)).select("path", extension(F.col("path")).alias("extension"), "format", "doc_type", "parser", "confidence", "length")
