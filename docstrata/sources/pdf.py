"""Pages of spans, tables and layout items to Markdown.

No PDF library comes with the engine. An extractor, a function from file bytes
to rows, is plugged in; all that follows works on its rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParseError
from ..functions.detect import figure_type
from ..functions.scoring import let
from ..functions.text import stem, strip
from ..schemas import LAYOUT_ITEM, PAGE, PAGE_TABLE, SPAN
from .files import LIMITS, documents, too_large

HEADER, FOOTER = 60.0, 50.0  # points of a page's margins


def is_pdf(files: DataFrame) -> DataFrame:
    """Files of a PDF's first bytes, within the limit."""
    return files.where((F.col("length") <= LIMITS["pdf"]) & F.hex(F.substring("content", 1, 5)).eqNullSafe("255044462D"))


def extracted(files: DataFrame, extractor: Callable[[str, bytes], list[dict]], schema=SPAN) -> DataFrame:
    """Rows that the extractor finds in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for b in batches:
            for path, content in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_pylist(extractor(path, content), schema=kinds)

    return is_pdf(files).select("path", "content").mapInArrow(run, schema)


def parser(spans: Callable[[str, bytes], list[dict]], tables: Callable[[str, bytes], list[dict]], pages: Callable[[str, bytes], list[dict]]) -> Callable[[DataFrame], DataFrame]:
    """A parser of PDF files for :func:`files.read_documents`, made of what finds the rows of a file.

    The functions give dictionaries with the columns of ``SPAN``, ``PAGE_TABLE`` and ``PAGE``; ``doc_id`` is the path.
    """

    def parse(files: DataFrame) -> DataFrame:
        text = render_pages(extracted(files, spans), extracted(files, tables, PAGE_TABLE), extracted(files, pages, PAGE))
        facts = F.create_map(F.lit("page_count"), F.col("page_count").cast("string"), F.lit("table_count"), F.col("table_count").cast("string"))
        return _documents(files, text.select("doc_id", "content", facts.alias("metadata")), "pdf")

    return parse


def layout_parser(items: Callable[[str, bytes], list[dict]], describe: Callable[[Column], Column] | None = None, otherwise: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A parser made of what finds layout items; without one, the other parser, or an error."""
    if items is None:
        if otherwise is None:
            raise ParseError("no layout extractor")
        return otherwise

    def parse(files: DataFrame) -> DataFrame:
        text = assemble_layout(extracted(files, items, LAYOUT_ITEM), describe)
        facts = F.create_map(F.lit("figure_count"), F.col("figure_count").cast("string"))
        return _documents(files, text.select("doc_id", "content", facts.alias("metadata")), "pdf")

    return parse


def _documents(files: DataFrame, text: DataFrame, form: str) -> DataFrame:
    rows = files.join(text.select(F.col("doc_id").alias("_d"), F.col("content").alias("_c"), F.col("metadata").alias("_m")), F.col("path") == F.col("_d"), "left")
    wrong = F.when(~F.hex(F.substring("content", 1, 5)).eqNullSafe("255044462D"), F.lit("ParseError: not a PDF file"))
    none = F.create_map().cast("map<string,string>")
    return documents(rows, F.coalesce("_c", F.lit("")), stem(F.col("path")), form, metadata=F.coalesce("_m", none), error=F.coalesce(too_large("pdf"), wrong))


def parse_files(files: DataFrame) -> DataFrame:
    """Without an extractor every PDF file is an error that says so."""
    return documents(files, F.lit(""), stem(F.col("path")), "pdf", error=F.lit("ParseError: PDF files need an extractor: see pdf.parser()"))


def parse_layout_files(files: DataFrame) -> DataFrame:
    return documents(files, F.lit(""), stem(F.col("path")), "pdf", error=F.lit("ParseError: PDF files need a layout extractor: see pdf.layout_parser()"))


def encode_png(width: int, height: int, pixels: bytes) -> bytes:
    """RGB pixels as a PNG file; nothing if the sizes make no sense."""
    if width <= 0 or height <= 0 or len(pixels) != 3 * width * height:
        return b""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def font_histogram(spans: DataFrame) -> DataFrame:
    """Characters by size and weight; sizes are rounded half to even."""
    chars = F.length(strip(F.col("text")))
    return spans.where(chars > 0).groupBy("doc_id", F.bround("size", 1).alias("size"), "bold").agg(F.sum(chars).alias("chars"))


def heading_levels(histogram: DataFrame) -> DataFrame:
    """sizes above that of most characters, the largest being level 1. Of equally common sizes the smallest is the body's."""
    sizes = histogram.groupBy("doc_id", "size").agg(F.sum("chars").alias("chars"))
    body = sizes.groupBy("doc_id").agg(F.max(F.struct(F.col("chars"), -F.col("size"))).alias("b")).select(F.col("doc_id").alias("_d"), (-F.col("b.col2")).alias("body"))
    larger = sizes.join(body, (F.col("doc_id") == F.col("_d")) & (F.col("size") > F.col("body")))
    return larger.select("doc_id", "size", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))).alias("level"))


def overlapping() -> Column:
    return (F.col("x0") < F.col("t_x1")) & (F.col("x1") > F.col("t_x0")) & (F.col("y0") < F.col("t_y1")) & (F.col("y1") > F.col("t_y0"))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Text blocks that no table of their page overlaps; an anti-join by page."""
    boxes = tables.select(F.col("doc_id").alias("t_doc"), F.col("page").alias("t_page"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    return blocks.join(boxes, (F.col("doc_id") == F.col("t_doc")) & (F.col("page") == F.col("t_page")) & overlapping(), "left_anti")


def render_blocks(spans: DataFrame, levels: DataFrame) -> DataFrame:
    """A block's spans joined; a heading if its longest span has a heading's size."""
    text = strip(F.col("text"))
    kept = spans.where(text != "").withColumn("_t", text).withColumn("_s", F.bround("size", 1))
    longest = F.max(F.struct(F.length("_t"), -F.col("line"), -F.col("span"), F.col("_s").alias("s")))["s"]
    whole = F.array_join(F.sort_array(F.collect_list(F.struct("line", "span", "_t")))["_t"], " ")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    blocks = kept.groupBy("doc_id", "page", "block").agg(whole.alias("text"), longest.alias("size"), *box)
    level = levels.select(F.col("doc_id").alias("_d"), F.col("size").alias("_z"), "level")
    marked = F.when(F.col("level").isNull(), F.col("text")).otherwise(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text")))
    return blocks.join(level, (F.col("doc_id") == F.col("_d")) & (F.col("size") == F.col("_z")), "left").withColumn("text", marked).drop("_d", "_z", "level")


def render_table(cells: Column) -> Column:
    """Rows padded or cut to the header's width; nothing for no rows. Cells are cleaned once, not for each row again."""
    clean = F.transform(cells, lambda row: F.transform(row, lambda c: F.replace(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))))
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))

    def lines(rows: Column, width: Column) -> Column:
        fit = lambda row: F.slice(F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))), 1, width)
        return F.array_insert(F.transform(rows, lambda r: line(fit(r))), 2, line(F.array_repeat(F.lit("---"), width)))

    shown = let(clean, lambda rows: let(F.size(F.try_element_at(rows, F.lit(1))), lambda width: F.array_join(lines(rows, width), "\n")))
    return F.when(F.size(cells) > 0, shown).otherwise("")


def render_pages(spans: DataFrame, tables: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, content, page_count, table_count); ``pages`` has doc_id, page and height."""
    levels = heading_levels(font_histogram(spans))
    inside = spans.join(pages, ["doc_id", "page"]).where((F.col("y0") >= HEADER) & (F.col("y1") <= F.col("height") - FOOTER))
    text = outside_tables(render_blocks(inside, levels), tables).select("doc_id", "page", F.col("y0").alias("y"), F.lit(0).alias("kind"), F.col("block").alias("pos"), "text")
    boxes = tables.select("doc_id", "page", F.col("y0").alias("y"), F.lit(1).alias("kind"), F.col("table").alias("pos"), render_table(F.col("cells")).alias("text"))
    entries = text.unionByName(boxes)
    # empty texts go here, not by a filter: that would be pushed down to the scan, with the rendering of the tables in it
    joined = lambda order, t: F.array_join(F.sort_array(F.collect_list(F.when(F.col(t) != "", F.struct(*order, t))))[t], "\n\n")
    by_page = entries.groupBy("doc_id", "page").agg(joined(["y", "kind", "pos"], "text").alias("text")).where("text != ''")
    marked = by_page.withColumn("text", F.concat(F.lit("<!-- PAGE:"), F.col("page").cast("string"), F.lit(" -->\n"), F.col("text")))
    whole = marked.groupBy("doc_id").agg(joined(["page"], "text").alias("content"))
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("page_count")).join(tables.groupBy("doc_id").agg(F.count("*").alias("table_count")), "doc_id", "left")
    return counts.join(whole, "doc_id", "left").select("doc_id", F.coalesce("content", F.lit("")).alias("content"), "page_count", F.coalesce("table_count", F.lit(0)).alias("table_count"))


def render_figure(caption: Column, page: Column, boxes: tuple[Column, ...], described: Column) -> Column:
    """S22, S23."""
    at = F.array_join(F.array(*[F.bround(F.coalesce(b, F.lit(0.0)), 0).cast("long").cast("string") for b in boxes]), ",")
    kind = figure_type(caption)
    head = F.concat(F.lit("<!-- FIGURE: page="), page.cast("string"), F.lit(" bbox="), at, F.lit(" type="), kind, F.lit(" -->\n> **Figure** ("), kind, F.lit(")"))
    line = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c))
    return F.concat_ws("\n", head, line("> Caption: ", caption), line("> Description: ", described))


def assemble_layout(items: DataFrame, describe: Callable[[Column], Column] | None = None, labels: tuple[str, ...] = ("section_header", "title", "text", "list_item", "paragraph", "table", "picture")) -> DataFrame:
    """(doc_id, content, figure_count) of layout items in reading order; without a place they are on page 1 at the top."""
    placed = items.where(F.col("label").isin(*labels)).withColumn("page", F.coalesce("page", F.lit(1))).withColumn("y", F.coalesce("y", F.lit(0.0)))
    described = describe(F.col("image")) if describe else F.lit("")
    figure = render_figure(F.coalesce("text", F.lit("")), F.col("page"), tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), described)
    text = F.when(F.col("label") == "picture", figure).when(F.col("label").isin("section_header", "title"), F.concat(F.lit("## "), strip(F.col("text")))).otherwise(strip(F.col("text")))
    made = placed.withColumn("_t", text).where("_t != ''").withColumn("_i", F.monotonically_increasing_id())
    by_page = made.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "_i", "_t"))), lambda x: x["_t"]), "\n\n").alias("t"), F.count_if(F.col("label") == "picture").alias("n")
    )
    marked = by_page.withColumn("t", F.concat(F.lit("<!-- PAGE:"), F.col("page").cast("string"), F.lit(" -->\n"), F.col("t")))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n\n").alias("content"), F.sum("n").alias("figure_count"))


SCHEMAS = {"spans": SPAN, "tables": PAGE_TABLE, "pages": PAGE, "items": LAYOUT_ITEM}
