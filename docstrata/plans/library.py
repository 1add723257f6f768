"""Further queries: text and scoring functions, chunks, files, store, context and question sets, over whole tables."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, metadata, relevance, scoring, sql, text
from ..operators import compile as context
from ..operators import evaluate, postings, search
from ..operators.chunker import ChunkOptions, chunk_documents
from ..operators.embed import HashingEmbedder, embed_chunks
from ..operators.store import ChunkStore
from ..session import scratch
from ..sources import catalog, files, manifest, pdf, svd
from ..streaming import versions
from . import queries
from .registry import query, read

_L = "l_orderkey, l_linenumber"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _pick(values: tuple, at):
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _sql_pick(values: tuple, at: str) -> str:
    return "['" + "','".join(v.replace("'", "''") for v in values) + f"'][({at} % {len(values)} + 1)::INT]"


# Text functions


@query("SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%.1f MB', n / 1048576.0::DOUBLE) END AS size FROM (SELECT event_id, event_id * 37 AS n FROM events)")
def human_sizes(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id").select("event_id", text.human_size(F.col("event_id") * 37).alias("size"))


@query("SELECT p_partkey, p_name || ' and ' || p_type || ' of ' || p_brand AS plain FROM part")
def strip_marks(spark, sf_dir):
    marked = F.concat(F.lit("## **"), "p_name", F.lit("** and *"), "p_type", F.lit("* of `"), "p_brand", F.lit("`"))
    return read(spark, sf_dir, "part").select("p_partkey", text.strip_markdown(marked).alias("plain"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN regexp_replace(substr(text, 1, 200), '[ \\t\\n\\r]+$', '') || '...' ELSE text END AS preview FROM documents")
def previews(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("SELECT p_partkey, printf('%.1f%%', p_size * 100.0::DOUBLE / 64) AS share FROM part")
def percents(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.percent(F.col("p_size") / F.lit(64.0)).alias("share"))


@query("SELECT doc_id, len(string_split(trim(text, ' ' || chr(9) || chr(10)), chr(10)))::INT AS lines FROM documents")
def line_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.count_lines(F.col("text")).alias("lines"))


@query("SELECT p_partkey, p_brand AS name, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS description, '{\"query\":\"' || p_brand || '\",\"content\":\"' || p_name || '\"}' AS shown FROM part")
def headings_and_forms(spark, sf_dir):
    said = F.concat(F.lit("intro\n# "), "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" — "), F.col("p_name"))).otherwise(""), F.lit("\nrest"))
    name, about = text.peripheral_heading(said)
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), about.alias("description"), text.formatted(F.col("p_brand"), F.col("p_name"), "json").alias("shown"))


@query("SELECT p_partkey, 'title: ' || p_name AS head, p_type AS body, p_type AS unmarked FROM part")
def front_matters(spark, sf_dir):
    head, body = text.front_matter(F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\n---\n"), "p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", text.strip(head).alias("head"), body.alias("body"), text.strip_bom(F.concat(F.lit("﻿"), "p_type")).alias("unmarked"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'General' END AS task, p_brand AS peripheral, p_partkey % 3 = 0 AS usage, p_partkey % 2 = 0 AS named, replace(p_name, '_', ' ') AS title FROM part"
)
def section_functions(spark, sf_dir):
    path = F.concat(F.lit("Guide > "), "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" > "), F.col("p_name"))).otherwise(""))
    said = F.concat(path, F.when(F.col("p_partkey") % 3 == 0, " Setup").otherwise(""))
    return read(spark, sf_dir, "part").select(
        "p_partkey", relevance.task_name(path).alias("task"), relevance.peripheral_of(path).alias("peripheral"), relevance.is_usage(said).alias("usage"),
        relevance.mentions(path, F.upper("p_name")).alias("named"), relevance.build_title(F.concat(F.lit("a/"), "p_name", F.lit(".pdf")), F.lit("x")).alias("title"),
    )


@query(
    "SELECT p_partkey, p_type AS description, array_to_string(list_sort(list_distinct(['tim' || p_size, 'tim', 'cr' || p_partkey] || list_filter(string_split(lower(p_type), ' '), lambda w: len(w) > 1))), ' ') AS keywords FROM part"
)
def keyword_sets(spark, sf_dir):
    register_map = F.concat(F.lit("## TIM\n**Description:** "), "p_type", F.lit("\n\n| Register | Offset |\n|---|---|\n| CR"), "p_partkey", F.lit(" | 0x0 |\n| reset | 1 |\n"))
    rows = read(spark, sf_dir, "part").withColumn("m", register_map)
    about = relevance.described(F.col("m"))
    keys = relevance.keywords(F.concat(F.lit("TIM"), F.col("p_size").cast("string")), F.col("m"), F.col("p_type"))
    return rows.select("p_partkey", about.alias("description"), F.array_join(F.sort_array(keys), " ").alias("keywords"))


# Answers

_SAID = (
    ("hex", "The address is 0x%X, not 0x1.", None), ("bit_range", "It is [%d].", None), ("access_code", "The type of %d is read-only here.", None), ("text", "The answer is R%d, I think.", None),
    ("numeric", "about %d kHz", None), ("numeric_range", "From 1 V - %d V", None), ("list", "- a%d\n- b\n", None), ("other", " as said %d ", None),
)


@query(
    f"SELECT {_L}, CASE l_suppkey % 8 WHEN 0 THEN '0x' || CASE WHEN length(h) <= 4 THEN lpad(h, 4, '0') ELSE lpad(h, 8, '0') END WHEN 1 THEN '[' || l_partkey || ']' WHEN 2 THEN 'RO' WHEN 3 THEN 'R' || l_partkey"
    f" WHEN 4 THEN l_partkey || ' kHz' WHEN 5 THEN '1V to ' || l_partkey || 'V' WHEN 6 THEN 'a' || l_partkey || ', b' ELSE 'as said ' || l_partkey END AS answer FROM (SELECT *, printf('%X', l_partkey) AS h FROM lineitem)"
)
def extract_by_form(spark, sf_dir):
    form = _pick(tuple(f for f, _, _ in _SAID), F.col("l_suppkey"))
    said = F.format_string(_SAID[-1][1], F.col("l_partkey"))
    for n, (_, pattern, _) in enumerate(_SAID[:-1]):
        said = F.when(F.col("l_suppkey") % 8 == n, F.format_string(pattern, F.col("l_partkey"))).otherwise(said)
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", scoring.extract_answer(said, form).alias("answer"))


@query(f"SELECT {_L}, CASE WHEN l_partkey % 3 = 0 OR l_suppkey % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM lineitem")
def score_texts(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    truth = F.format_string("Unit %d", p)
    said = F.when(p % 3 == 0, F.format_string("It is the UNIT  %d here", p)).when(s % 5 == 0, F.format_string("a unit the %d", p)).otherwise(F.format_string("unit x %d", p))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", scoring.score_text(said, truth).alias("score"))


@query(
    f"SELECT {_L}, CASE WHEN l_suppkey % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS exact, CASE l_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS part FROM lineitem"
)
def score_ranges(spark, sf_dir):
    a, b, k = F.col("l_partkey"), F.col("l_partkey") + F.col("l_suppkey") + 1, F.col("l_suppkey") % 4
    truth = F.format_string("%d mV to %d mV", a, b)
    said = F.when(k == 0, F.format_string("%d - %d mV", a, b)).when(k == 1, F.format_string("%d mV to %d mV", a, b + 5)).when(k == 2, F.format_string("%d mV to %d mV", a + 5, b)).otherwise(F.format_string("%d kHz to %d kHz", a, b))
    form = F.lit("numeric_range")
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", scoring.score_answer(said, truth, form).alias("exact"), scoring.score_partial(said, truth, form).alias("part"))


@query(f"SELECT {_L}, CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM (SELECT {_L}, l_suppkey % 4 + 1 AS n FROM lineitem)")
def score_lists(spark, sf_dir):
    items = lambda n: F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.concat(F.lit("Item"), i.cast("string"))), ", ")
    said, truth = F.upper(items(F.col("l_suppkey") % 4 + 1)), items(F.lit(4).cast("long"))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", scoring.score_answer(said, truth, F.lit("list")).alias("score"))


# Chunks


def _chunked(rows: DataFrame, options: ChunkOptions) -> DataFrame:
    docs = rows.select("doc_id", "content", F.lit("text").alias("doc_type"), F.lit("C").alias("chip"))
    return chunk_documents(docs, options).select("doc_id", "chunk_index", "content", "token_count")


@query(
    "WITH t AS (SELECT p_partkey::VARCHAR AS doc_id, repeat('abcdefg', p_size::INT) AS c FROM part) SELECT doc_id, i::INT AS chunk_index, substr(c, 1 + 32 * i, 32) AS content, ((length(substr(c, 1 + 32 * i, 32)) + 3) // 4)::INT AS token_count"
    " FROM t, LATERAL (SELECT unnest(range(0, (length(c) + 31) // 32)) AS i)"
)
def chunk_hard_split(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.repeat(F.lit("abcdefg"), F.col("p_size").cast("int")).alias("content"))
    return _chunked(rows, ChunkOptions(8, 0, 0))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a part, of as many paragraphs of four pieces as the part's size.

    Parts are a few bytes each, a file of them is read by one task or few, and the work on each is long: they are dealt out before it.
    """
    one = lambda i: F.concat(F.lit("para graf numb "), F.lpad(i.cast("string"), 4, "0"))
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int")), one), "\n\n")
    return queries.dealt(read(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").cast("string").alias("doc_id"), content.alias("content"))


_PARA = "SELECT p_partkey::VARCHAR AS doc_id, p_size AS n, unnest(range(0, p_size)) AS i FROM part"


@query(f"SELECT doc_id, (i // 2)::INT AS chunk_index, string_agg('para graf numb ' || lpad((i + 1)::VARCHAR, 4, '0'), chr(10) || chr(10) ORDER BY i) AS content, (4 * count(*))::INT AS token_count FROM ({_PARA}) GROUP BY doc_id, i // 2")
def chunk_recursive_split(spark, sf_dir):
    return _chunked(_paragraphs(spark, sf_dir), ChunkOptions(10, 0, 0))


@query(
    f"SELECT doc_id, g::INT AS chunk_index, string_agg('para graf numb ' || lpad((i + 1)::VARCHAR, 4, '0'), chr(10) || chr(10) ORDER BY i) AS content, (4 * count(*))::INT AS token_count"
    f" FROM (SELECT doc_id, i, CASE WHEN n % 2 = 1 AND n > 1 AND i = n - 1 THEN i // 2 - 1 ELSE i // 2 END AS g FROM ({_PARA})) GROUP BY doc_id, g"
)
def chunk_merge_small(spark, sf_dir):
    return _chunked(_paragraphs(spark, sf_dir), ChunkOptions(12, 8, 6))


_CODE, _TABLE = "```c\nint x;\n\n\nint y;\n```", "| a | b |\n|---|---|\n| 1 | 2 |"


@query(
    "SELECT p_partkey::VARCHAR AS doc_id, i::INT AS chunk_index, [p_name, '" + _CODE.replace("\n", "' || chr(10) || '") + "', p_type, '" + _TABLE.replace("\n", "' || chr(10) || '") + "', p_brand][i + 1] AS content,"
    " ['prose', 'code', 'prose', 'table', 'prose'][i + 1] AS content_type FROM part, range(0, 5) t(i)"
)
def chunk_blocks(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.concat("p_name", F.lit(f"\n\n{_CODE}\n"), "p_type", F.lit(f"\n{_TABLE}\n"), "p_brand").alias("content"), F.lit("text").alias("doc_type"), F.lit("").alias("chip"))
    return chunk_documents(rows, ChunkOptions(512, 0, 0)).select("doc_id", "chunk_index", "content", "content_type")


@query("SELECT p_partkey::VARCHAR AS doc_id, p_size::INT AS page, p_name || chr(10) || p_type AS content, p_brand AS chip, 'datasheet' AS doc_type, 'detail' AS chunk_level, '' AS peripheral FROM part")
def chunk_pages(spark, sf_dir):
    marked = F.concat(F.lit("<!-- PAGE:"), F.col("p_size").cast("string"), F.lit(" -->\n"), "p_name", F.lit("\n<!-- PAGE:9 -->\n"), "p_type")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), marked.alias("content"), F.lit("datasheet").alias("doc_type"), F.col("p_brand").alias("chip"))
    return chunk_documents(rows, ChunkOptions(512, 0, 0)).select("doc_id", "page", "content", "chip", "doc_type", "chunk_level", "peripheral")


# Files


def _files(rows: DataFrame, path, content) -> DataFrame:
    return rows.select(path.alias("path"), content.cast("binary").alias("content")).withColumn("length", F.length("content").cast("long"))


@query("SELECT 'd' || doc_id || '_txt' AS doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) AS digest, 'sha256:' || sha256(text) AS hash, doc_id::VARCHAR AS n FROM documents")
def parse_text_files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = files.parse_text(_files(docs, F.concat(F.lit("x/d"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text")))
    return found.select("doc_id", F.md5("content").alias("digest"), "hash", F.regexp_extract("doc_id", "([0-9]+)", 1).alias("n"))


@query("SELECT p_partkey || '_md' AS doc_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_partkey::VARCHAR END AS title, CASE WHEN p_partkey % 3 = 1 THEN '# ' || p_type || chr(10) || 'text' ELSE 'text' END AS content, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS vendor FROM part")
def parse_markdown_files(spark, sf_dir):
    k = F.col("p_partkey") % 3
    body = F.when(k == 0, F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\nvendor: '"), "p_brand", F.lit("'\n---\ntext\n"))).when(k == 1, F.concat(F.lit("# "), "p_type", F.lit("\ntext"))).otherwise("text")
    found = files.parse_markdown(_files(read(spark, sf_dir, "part"), F.concat(F.lit("x/"), F.col("p_partkey").cast("string"), F.lit(".md")), body))
    return found.select("doc_id", "title", "content", F.try_element_at("metadata", F.lit("vendor")).alias("vendor"))


@query("SELECT p_partkey || '_dts' AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_partkey::VARCHAR END AS title, ['i.MX93', 'AM625', ''][(p_partkey % 3 + 1)::INT] AS chip FROM part")
def parse_device_trees(spark, sf_dir):
    model = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('model = "'), F.col("p_name"), F.lit('";'))).otherwise("")
    body = F.concat(F.lit("/ { "), model, F.lit(' compatible = "acme,board", "'), _pick(("fsl,imx93-evk", "ti,am625", "none,none"), F.col("p_partkey")), F.lit('"; };'))
    found = files.parse_device_tree(_files(read(spark, sf_dir, "part"), F.concat(F.lit("x/"), F.col("p_partkey").cast("string"), F.lit(".dts")), body))
    return found.select("doc_id", "title", "chip")


def _svd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device a brand; its parts are registers of one peripheral, which another one derives from."""
    register = F.concat(
        F.lit("<register><name>R"), F.col("p_partkey").cast("string"), F.lit("</name><addressOffset>"), (F.col("p_partkey") * 4).cast("string"), F.lit("</addressOffset><access>read-only</access><resetValue>0x"),
        F.hex("p_size"), F.lit("</resetValue><fields><field><name>F</name><bitOffset>"), (F.col("p_partkey") % 16).cast("string"), F.lit("</bitOffset><bitWidth>4</bitWidth></field></fields></register>"),
    )
    whole = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(register)), "").alias("r"))
    xml = F.concat(
        F.lit("<device><name>"), F.col("p_brand"), F.lit("</name><size>32</size><peripherals><peripheral derivedFrom='TIM1'><name>TIM2</name><baseAddress>0x40000400</baseAddress></peripheral><peripheral><name>TIM1</name>"),
        F.lit("<description>Timer</description><baseAddress>0x40000000</baseAddress><registers>"), F.col("r"), F.lit("</registers></peripheral></peripherals></device>"),
    )
    return _files(whole, F.concat(F.lit("x/"), "p_brand", F.lit(".svd")), xml)


@query("SELECT p_brand AS chip, t.p AS peripheral, 'R' || p_partkey AS name, p_partkey * 4 AS address_offset, 32::INT AS size, 'read-only' AS access, p_size::BIGINT AS reset_value FROM part, (VALUES ('TIM1'), ('TIM2')) t(p)")
def svd_registers(spark, sf_dir):
    found = svd.register_table(svd.peripheral_table(svd.read_devices(_svd_files(spark, sf_dir))))
    return found.select("chip", "peripheral", "name", "address_offset", "size", "access", "reset_value")


@query("SELECT p_brand AS chip, t.p AS peripheral, 'R' || p_partkey AS register, 'F' AS name, (p_partkey % 16)::INT AS bit_offset, 4::INT AS bit_width FROM part, (VALUES ('TIM1'), ('TIM2')) t(p)")
def svd_fields(spark, sf_dir):
    found = svd.field_table(svd.register_table(svd.peripheral_table(svd.read_devices(_svd_files(spark, sf_dir)))))
    return found.select("chip", "peripheral", "register", "name", "bit_offset", "bit_width")


_HEAD = "| Register | Offset | Size | Access | Reset | Description |"


@query(
    "WITH r AS (SELECT p_brand, string_agg('| R' || p_partkey || ' | 0x' || lpad(printf('%X', p_partkey * 4), greatest(4, length(printf('%X', p_partkey * 4)))::INT, '0') || ' | 32 | RO | 0x' || lpad(printf('%X', p_size), 8, '0') || ' |  |', chr(10) ORDER BY p_partkey) AS rows FROM part GROUP BY p_brand)"
    f" SELECT p_brand AS chip, t.p AS peripheral, md5(rows) AS digest FROM r, (VALUES ('TIM1'), ('TIM2')) t(p)"
)
def svd_markdown(spark, sf_dir):
    """The register tables of the rendered pages."""
    pages = svd.render_devices(svd.read_devices(_svd_files(spark, sf_dir)))
    part = F.explode(F.slice(F.split("content", "---\n\n## "), 2, 1000)).alias("p")
    one = pages.select(text.stem(F.col("path")).alias("chip"), part)
    rows = F.regexp_extract("p", r"(?s)\| Register \|[^\n]*\n[^\n]*\n(.*?)\n(?:\n|\z)", 1)
    return one.select("chip", F.regexp_extract("p", r"^([^\n]*)", 1).alias("peripheral"), F.md5(rows).alias("digest"))


@query(
    "SELECT p_brand AS chip, t.p AS peripheral, 'R' || p_partkey AS register,"
    " '| F | [' || p_partkey % 16 + 3 || ':' || p_partkey % 16 || '] | RO | 0x' || printf('%X', (p_size::BIGINT >> (p_partkey % 16)::BIGINT) & 15) || ' |  |' AS row FROM part, (VALUES ('TIM1'), ('TIM2')) t(p)"
)
def svd_field_rows(spark, sf_dir):
    """the field tables of the rendered pages."""
    pages = svd.render_devices(svd.read_devices(_svd_files(spark, sf_dir)))
    block = pages.select(text.stem(F.col("path")).alias("chip"), F.explode(F.split("content", "---\n\n## ")).alias("b")).where("b not like '# %'")
    # named before its tables are taken apart: beside explode() the name would be looked for in the whole block for each table
    named = block.select("chip", F.regexp_extract("b", r"^([^\n]*)", 1).alias("peripheral"), "b")
    one = named.select("chip", "peripheral", F.explode(F.split("b", "\n### ")).alias("t"))
    title = F.regexp_extract("t", r"^(\S+) Fields\n", 1)
    return one.where(title != "").select("chip", "peripheral", title.alias("register"), F.regexp_extract("t", r"\n\|-[^\n]*\n([^\n]*)", 1).alias("row"))


@query(
    "SELECT p_brand AS chip, t.p AS peripheral, 'C' || p_partkey || '_' || i || '_R' || ['A', 'B', 'C'][j + 1] AS name, p_partkey * 16 + i * 4096 + j * 4 AS address_offset, 16::INT AS size, 'read-write' AS access"
    " FROM part, (VALUES ('P'), ('P2'), ('P3'), ('P4')) t(p), range(2) a(i), range(3) b(j)"
    " UNION ALL SELECT p_brand, t.p, 'D_E' || p_partkey || '_X', p_partkey * 16 + 4098, 8::INT, 'write-only' FROM part, (VALUES ('P'), ('P2'), ('P3'), ('P4')) t(p)"
)
def svd_clusters(spark, sf_dir):
    """Clusters within clusters, arrays of both, and a chain of derived peripherals that begins at its end.

    The parts of a brand are dealt to several files, as one of all could be over the size limit.
    """
    key = F.col("p_partkey")
    arrays = F.concat(
        F.lit("<cluster><dim>2</dim><dimIncrement>0x1000</dimIncrement><name>C"), key.cast("string"), F.lit("_%s</name><addressOffset>"), (key * 16).cast("string"),
        F.lit("</addressOffset><register><dim>3</dim><dimIncrement>4</dimIncrement><dimIndex>A,B,C</dimIndex><name>R%s</name><addressOffset>0x0</addressOffset><size>16</size></register></cluster>"),
    )
    inner = F.concat(F.lit("<cluster><name>E"), key.cast("string"), F.lit("</name><addressOffset>"), (key * 16).cast("string"), F.lit("</addressOffset><register><name>X</name><addressOffset>2</addressOffset></register></cluster>"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "")
    whole = read(spark, sf_dir, "part").groupBy("p_brand", F.floor(key / 100_000).alias("n")).agg(joined(arrays).alias("a"), joined(inner).alias("i"))
    derived = F.lit("".join(f"<peripheral derivedFrom='{base}'><name>{name}</name></peripheral>" for name, base in (("P4", "P3"), ("P3", "P2"), ("P2", "P"))))
    xml = F.concat(
        F.lit("<device><name>"), "p_brand", F.lit("</name><size>32</size><access>read-write</access><peripherals>"), derived, F.lit("<peripheral><name>P</name><registers>"), "a",
        F.lit("<cluster><name>D</name><addressOffset>0x1000</addressOffset><size>8</size><access>write-only</access>"), "i", F.lit("</cluster></registers></peripheral></peripherals></device>"),
    )
    found = svd.register_table(svd.peripheral_table(svd.read_devices(_files(whole, F.concat(F.lit("x/"), "p_brand", F.lit("-"), F.col("n").cast("string"), F.lit(".svd")), xml))))
    return found.select("chip", "peripheral", "name", "address_offset", "size", "access")


@query(
    "SELECT p_partkey, '| ' || p_brand || ' | a\\|b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_type || ' |  |' || chr(10) || '| 1 | 2 |' AS shown, ['timing_diagram', 'block_diagram', 'pinout', 'schematic_figure', 'figure'][(p_partkey % 5 + 1)::INT] AS kind FROM part"
)
def table_and_figure_forms(spark, sf_dir):
    cells = F.array(F.array(F.col("p_brand"), F.lit("a|b")), F.array(F.concat(F.lit(" "), F.col("p_type"))), F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    caption = _pick(("A waveform.", "Block diagram", "The LQFP package", "Some circuit", "Photograph"), F.col("p_partkey"))
    return queries.dealt(read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", pdf.render_table(cells).alias("shown"), detect.figure_type(caption).alias("kind"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dealt out: a file of them is read by one task or few, and the work on each is long."""
    return queries.dealt(read(spark, sf_dir, "part"), "p_partkey")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a brand, a page a part; a heading above two lines of text, and a footer that is cut off."""
    span = lambda block, line, said, size, y: F.struct(
        F.lit(block).alias("block"), F.lit(line).alias("line"), F.lit(0).alias("span"), said.alias("text"), F.lit(size).alias("size"), F.lit(False).alias("bold"),
        F.lit(50.0).alias("x0"), F.lit(y).alias("y0"), F.lit(400.0).alias("x1"), F.lit(y + 12).alias("y1"),
    )
    rows = F.array(
        span(0, 0, F.concat(F.lit("Part "), F.col("p_partkey").cast("string")), 18.0, 100.0), span(1, 0, F.lit("first line of the text"), 10.0, 200.0),
        span(1, 1, F.concat(F.lit("by "), F.col("p_name")), 10.0, 215.0), span(2, 0, F.lit("footer"), 10.0, 780.0),
    )
    return _parts(spark, sf_dir).select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").cast("int").alias("page"), F.explode(rows).alias("s")).select("doc_id", "page", "s.*")


@query(
    "SELECT p_brand AS doc_id, count(*) AS page_count, 0::BIGINT AS table_count, md5(string_agg('<!-- PAGE:' || p_partkey || ' -->' || chr(10) || '# Part ' || p_partkey || chr(10) || chr(10) || 'first line of the text by ' || p_name, chr(10) || chr(10) ORDER BY p_partkey)) AS digest FROM part GROUP BY p_brand"
)
def page_markdown(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    pages = spans.select("doc_id", "page").distinct().withColumn("height", F.lit(800.0))
    box = "struct<doc_id:string,page:int,table:int,x0:double,y0:double,x1:double,y1:double,cells:array<array<string>>>"
    none = spark.range(0).select(F.lit(None).cast(box).alias("t")).select("t.*")
    return pdf.render_pages(spans, none, pages).select("doc_id", "page_count", "table_count", F.md5("content").alias("digest"))


@query(
    "WITH e AS (SELECT p_brand, p_partkey, p_partkey % 3 AS k, '| Part | Size \\| mm |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_type || ' | ' || p_size || ' |' || chr(10) || '| two lines |  |' AS t,"
    " '# Part ' || p_partkey AS h, 'first line of the text by ' || p_name AS b FROM part), j AS (SELECT *, chr(10) || chr(10) AS n FROM e)"
    " SELECT p_brand AS doc_id, count(*) AS page_count, count(*) FILTER (k < 2) AS table_count, md5(string_agg('<!-- PAGE:' || p_partkey || ' -->' || chr(10) || CASE k WHEN 0 THEN h || n || t WHEN 1 THEN h || n || b || n || t ELSE h || n || b END, chr(10) || chr(10) ORDER BY p_partkey)) AS digest FROM j GROUP BY p_brand"
)
def page_tables(spark, sf_dir):
    """Pages with a table over the text, which it replaces, with one below it, and with none."""
    spans, part = _spans(spark, sf_dir), _parts(spark, sf_dir)
    pages = spans.select("doc_id", "page").distinct().withColumn("height", F.lit(800.0))
    kind = F.col("p_partkey") % 3
    cells = F.array(F.array(F.lit("Part"), F.lit("Size | mm")), F.array(F.col("p_type"), F.col("p_size").cast("string"), F.lit("cut off")), F.array(F.lit(" two\nlines ")))
    top = F.when(kind == 0, 210.0).otherwise(300.0)
    box = [F.lit(40.0).alias("x0"), top.alias("y0"), F.lit(200.0).alias("x1"), (top + 90).alias("y1")]
    tables = part.where(kind < 2).select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").cast("int").alias("page"), F.lit(0).alias("table"), *box, cells.alias("cells"))
    return pdf.render_pages(spans, tables, pages).select("doc_id", "page_count", "table_count", F.md5("content").alias("digest"))


# Store


def _as_chunks(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("lang").alias("doc_type"), F.col("text").alias("content"), F.col("n_chars").cast("int").alias("token_count"))


@query("SELECT doc_id::VARCHAR AS chunk_id, source AS doc_id, lang AS doc_type, n_chars::INT AS token_count, 'detail' AS chunk_level, '' AS chip, 0::INT AS page FROM documents WHERE source <> 'src1'")
def store_add_delete(spark, sf_dir):
    store = ChunkStore(spark, scratch(spark, "store"))
    chunks = _as_chunks(read(spark, sf_dir, "documents"))
    store.add(chunks.where("doc_type = 'en'"))
    store.add(chunks)  # the others; those that are there already stay as they are
    store.delete("src1")
    return store.metadata().select("chunk_id", "doc_id", "doc_type", "token_count", "chunk_level", "chip", "page")


@query("SELECT (SELECT count(*) FROM documents) AS added, 0::BIGINT AS again, (SELECT count(*) FROM documents WHERE source = 'src2') AS deleted, (SELECT count(*) FROM documents WHERE source <> 'src2') AS left_")
def store_counts(spark, sf_dir):
    store = ChunkStore(spark, scratch(spark, "store"))
    chunks = _as_chunks(read(spark, sf_dir, "documents"))
    return spark.createDataFrame([(store.add(chunks), store.add(chunks), store.delete("src2"), store.count())], "added long, again long, deleted long, left_ long")


@query("SELECT doc_id::VARCHAR AS chunk_id, source AS doc_id, md5(CASE WHEN source = 'src3' THEN 'new ' || text ELSE text END) AS digest FROM documents WHERE lang = 'en'")
def store_replace_filter(spark, sf_dir):
    store = ChunkStore(spark, scratch(spark, "store"))
    chunks = _as_chunks(read(spark, sf_dir, "documents"))
    store.add(chunks)
    store.replace(chunks.where("doc_id = 'src3'").withColumn("content", F.concat(F.lit("new "), F.col("content"))))
    return store.chunks(search.build_where(doc_type="en")).select("chunk_id", "doc_id", F.md5("content").alias("digest"))


def _vector_store(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """All embeddings as chunks, a document type a label, in two writes."""
    v = read(spark, sf_dir, "embeddings")
    chunks = v.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), F.concat(F.lit("d"), F.col("vec_id") % 7).alias("doc_id"), F.concat(F.lit("l"), F.col("label")).alias("doc_type"), F.lit("").alias("content"), "embedding")
    store = ChunkStore(spark, scratch(spark, "store"))
    store.add(chunks.where("doc_id <= 'd3'"))
    store.add(chunks)
    return store


_FAR = queries._D


@query(
    f"SELECT rank, vec_id, round(d, 6) AS distance FROM (SELECT vec_id, d, row_number() OVER (ORDER BY d, vec_id)::INT AS rank FROM (SELECT vec_id, {_FAR} AS d FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE vec_id % 7 <> 3)) WHERE rank <= 10"
)
def store_search_pruned(spark, sf_dir):
    """Ten nearest under a filter, from the cells of the store that can hold one of them."""
    found = _vector_store(spark, sf_dir).search(queries._first_vector(spark, sf_dir), 10, search.not_equal("doc_id", "d3"))
    return found.select("rank", F.col("chunk_id").cast("long").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(
    f"SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM (SELECT query_id, vec_id, {_FAR} AS d FROM embeddings, (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 25 = 0))) WHERE rank <= 5"
)
def store_search_each(spark, sf_dir):
    """A stated set of queries against all rows, met in cells."""
    asked = read(spark, sf_dir, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = _vector_store(spark, sf_dir).search_each(asked, 5)
    return found.select("query_id", "rank", F.col("chunk_id").cast("long").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query("SELECT doc_id::VARCHAR AS chunk_id, source AS doc_id, lang AS doc_type, md5(text) AS digest FROM documents")
def store_two_writers(spark, sf_dir):
    """Two writers at once, with a third of the rows in common; no row is lost or doubled."""
    root, chunks = scratch(spark, "store"), _as_chunks(read(spark, sf_dir, "documents"))
    third = F.pmod(F.col("chunk_id").cast("long"), F.lit(3))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda rows: ChunkStore(spark, root).add(rows), [chunks.where(third != 0), chunks.where(third != 1)]))
    return ChunkStore(spark, root).chunks().select("chunk_id", "doc_id", "doc_type", F.md5("content").alias("digest"))


@query("SELECT count(*) AS n, 64::INT AS dimension, 50::INT AS most, 1::INT AS least FROM documents")
def embed_all(spark, sf_dir):
    embedder = HashingEmbedder(64)
    rows = embed_chunks(read(spark, sf_dir, "documents", F.col("text").alias("content")), embedder)
    sizes = rows.groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))
    return sizes.select("n", "dimension", F.lit(search.clamp_k(900)).alias("most"), F.lit(search.clamp_k(-3)).alias("least"))


# Context


def _named_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Register chunks, a peripheral a brand and a chip a size; other chunks that name the brand."""
    p = read(spark, sf_dir, "part").withColumn("id", F.lpad(F.col("p_partkey").cast("string"), 9, "0")).withColumn("chip", F.concat(F.lit("C"), (F.col("p_size") % 3).cast("string")))
    own = p.select(F.col("id").alias("chunk_id"), F.col("p_partkey").cast("int").alias("chunk_index"), F.concat(F.lit("Map > "), "p_brand").alias("section_path"), "chip", F.concat(F.lit("**Description:** "), "p_type").alias("content"))
    other = p.select(F.col("id").alias("chunk_id"), F.concat(F.lit("Guide > "), F.lower("p_brand"), F.lit(" > "), "p_name").alias("section_path"), "chip", F.lit("").alias("peripheral"), F.col("p_name").alias("content"))
    return own, other


@query(
    "WITH r AS (SELECT p_brand AS peripheral, 'C' || p_size % 3 AS chip, p_partkey, p_type FROM part), c AS (SELECT peripheral, count(DISTINCT chip) AS collisions FROM r GROUP BY peripheral)"
    " SELECT peripheral, chip, collisions, md5(string_agg('**Description:** ' || p_type, chr(10) || chr(10) ORDER BY p_partkey)) AS digest, arg_min(p_type, p_partkey) AS description FROM r JOIN c USING (peripheral) GROUP BY ALL"
)
def register_maps(spark, sf_dir):
    own, _ = _named_chunks(spark, sf_dir)
    found = context.register_maps(own, context.distinct_peripherals(own))
    return found.select("peripheral", "chip", "collisions", F.md5("register_map").alias("digest"), "description")


@query("SELECT a.p_partkey AS n, b.peripheral AS peripheral, b.chip AS chip FROM (SELECT p_partkey, p_brand, 'C' || p_size % 3 AS chip FROM part) a JOIN (SELECT DISTINCT p_brand AS peripheral, 'C' || p_size % 3 AS chip FROM part) b ON a.p_brand = b.peripheral AND a.chip = b.chip")
def mentioning_join(spark, sf_dir):
    own, other = _named_chunks(spark, sf_dir)
    maps = context.register_maps(own, context.distinct_peripherals(own))
    return context.mentioning(other, maps).select(F.col("chunk_id").cast("long").alias("n"), "peripheral", F.col("p_chip").alias("chip"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'RX=PA1;TX=PA2' ELSE '' END AS pins FROM nation")
def pins_of(spark, sf_dir):
    pins = {"UART_TX": "PA2", "uart_rx": "PA1", "SPI_CLK": "PB1"}
    name = F.when(F.col("n_nationkey") % 2 == 0, "Uart").otherwise("I2C")
    found = context.matching_pins(pins, name)
    return read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(F.sort_array(found), lambda p: F.concat_ws("=", p["signal"], p["pin"])), ";").alias("pins"))


@query(
    "WITH u AS (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0) SELECT p_brand AS peripheral, lower(p_brand) || '.md' AS file, (p_brand IN (SELECT p_brand FROM u)) AS has_usage FROM (SELECT DISTINCT p_brand FROM part)"
)
def compile_pages(spark, sf_dir):
    """Whole pages of all peripherals; a part of an even number adds a procedure to its brand's page."""
    p = read(spark, sf_dir, "part").withColumn("id", F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    blank, n = F.lit("").alias("peripheral"), F.col("p_partkey").cast("int").alias("chunk_index")
    svd_rows = p.select(F.col("id").alias("chunk_id"), n, F.lit("s").alias("doc_id"), F.lit("svd").alias("doc_type"), F.lit("").alias("chip"), F.concat(F.lit("Map > "), "p_brand").alias("section_path"), F.col("p_type").alias("content"), F.lit("prose").alias("content_type"), F.lit(0).alias("page"), blank)
    use = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("u"), "id").alias("chunk_id"), n, F.lit("g").alias("doc_id"), F.lit("text").alias("doc_type"), F.lit("").alias("chip"), F.concat(F.lit("Guide > "), "p_brand", F.lit(" > Setup")).alias("section_path"), F.col("p_name").alias("content"), F.lit("config_procedure").alias("content_type"), F.lit(0).alias("page"), blank)
    listed = spark.range(1).select(F.lit("g").alias("id"), F.lit("guide.txt").alias("path"))
    pages = context.compile_peripherals(svd_rows.unionByName(use), listed)
    return pages.select("peripheral", "file", (F.col("usage") != "").alias("has_usage"))


# Postings

_WORDS = queries._TOKENS


@query(f"SELECT term, count(*) AS chunks FROM (SELECT unnest({_WORDS('text')}) AS term FROM documents) GROUP BY term")
def posting_frequencies(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return postings.PostingIndex(spark, scratch(spark, "postings")).build(docs).frequencies()


_RANKED = (
    f"WITH p AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS chunk_id, unnest({_WORDS('text')}) AS term FROM documents), k AS (SELECT item_id, unnest({_WORDS('text')}) AS term, len({_WORDS('text')}) AS size FROM benchmark),"
    " s AS (SELECT item_id, chunk_id, count(*) / any_value(size)::DOUBLE AS score FROM p JOIN k ON p.term = k.term GROUP BY item_id, chunk_id HAVING count(*) / any_value(size)::DOUBLE >= 0.1)"
    " SELECT item_id, chunk_id, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 5"
)


def _benchmark_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"), F.col("text").alias("content"))
    return docs, postings.keyword_sets(read(spark, sf_dir, "benchmark"), ["item_id"], relevance.tokenize(F.col("text")))


@query(_RANKED)
def rank_by_index(spark, sf_dir):
    """The five most relevant documents of each benchmark item, by an index that is written and read back."""
    docs, keyed = _benchmark_words(spark, sf_dir)
    half = F.pmod(F.xxhash64("chunk_id"), F.lit(2))
    index = postings.PostingIndex(spark, scratch(spark, "postings")).build(docs.where(half == 0)).extend(docs.where(half == 1))
    return index.rank(keyed, ["item_id"]).select("item_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


_PAGE_SQL = (
    "WITH p AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS id, * FROM part), m AS (SELECT p_brand, string_agg(p_type, chr(10) || chr(10) ORDER BY p_partkey) AS register_map FROM p GROUP BY p_brand),"
    f" k AS (SELECT DISTINCT p_brand, unnest([lower(p_brand), regexp_replace(lower(p_brand), '[0-9]+$', '')]) AS term FROM p), n AS (SELECT p_brand, count(*) AS size FROM k GROUP BY p_brand),"
    f" u AS (SELECT 'u' || id AS chunk_id, p_partkey, p_brand, p_name || ' ' || p_brand || '1' AS content FROM p WHERE p_partkey % 2 = 0), w AS (SELECT chunk_id, unnest({_WORDS('content')}) AS term FROM u),"
    " s AS (SELECT u.p_brand, u.p_partkey, u.chunk_id, u.content, count(k.term) / any_value(n.size)::DOUBLE AS score FROM u JOIN n ON u.p_brand = n.p_brand LEFT JOIN w ON u.chunk_id = w.chunk_id LEFT JOIN k ON k.p_brand = u.p_brand AND k.term = w.term GROUP BY ALL),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, chunk_id) AS rank FROM s),"
    " used AS (SELECT p_brand, string_agg('### Setup' || chr(10) || chr(10) || content || chr(10) || chr(10) || '*Source: guide, §' || p_brand || ' > Setup*', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS usage FROM r WHERE rank = 1 GROUP BY p_brand),"
    " rest AS (SELECT * FROM r WHERE rank > 5 AND score >= 0.1), d AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, chunk_id) AS place FROM rest),"
    " det AS (SELECT p_brand, string_agg(content || chr(10) || chr(10) || '*Source: guide, §' || p_brand || ' > Setup*', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS details FROM d WHERE place <= 5 GROUP BY p_brand)"
    " SELECT m.p_brand AS peripheral, md5(trim(register_map)) AS register_map, md5(coalesce(usage, '')) AS usage, md5(coalesce(details, '')) AS details,"
    " CASE WHEN usage IS NULL AND details IS NULL THEN '' ELSE '*Source: guide, §' || m.p_brand || ' > Setup*' END AS citations FROM m LEFT JOIN used ON m.p_brand = used.p_brand LEFT JOIN det ON m.p_brand = det.p_brand"
)


@query(_PAGE_SQL)
def compile_page_texts(spark, sf_dir):
    """What the pages of all peripherals show: map, usage, details and citations."""
    p = read(spark, sf_dir, "part").withColumn("id", F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    same = [F.lit(v).alias(k) for k, v in (("chip", ""), ("page", 0), ("peripheral", ""))]
    n = F.col("p_partkey").cast("int").alias("chunk_index")
    own = p.select("id", n, F.lit("s").alias("doc_id"), F.lit("svd").alias("doc_type"), F.concat(F.lit("Map > "), "p_brand").alias("section_path"), F.col("p_type").alias("content"), F.lit("prose").alias("content_type"), *same)
    use = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("u"), "id").alias("id"), n, F.lit("g").alias("doc_id"), F.lit("text").alias("doc_type"), F.concat(F.lit("Guide > "), "p_brand", F.lit(" > Setup")).alias("section_path"), F.concat("p_name", F.lit(" "), "p_brand", F.lit("1")).alias("content"), F.lit("config_procedure").alias("content_type"), *same)
    listed = spark.range(1).select(F.lit("g").alias("id"), F.lit("guide.txt").alias("path"))
    pages = context.compile_peripherals(own.unionByName(use).withColumnRenamed("id", "chunk_id"), listed)
    return pages.select("peripheral", F.md5("register_map").alias("register_map"), F.md5("usage").alias("usage"), F.md5("details").alias("details"), "citations")


# Question sets

_ANSWERED = "SELECT doc_id, ['hex', 'numeric', 'text'][(doc_id % 3 + 1)::INT] AS f, doc_id % 4 AS k FROM documents"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    form = _pick(("hex", "numeric", "text"), d)
    answer = F.when(form == "hex", F.format_string("0x%04X", d)).when(form == "numeric", F.format_string("%d kHz", d)).otherwise(F.format_string("unit %d", d))
    return read(spark, sf_dir, "documents", "doc_id").select(
        d.cast("string").alias("id"), _pick(evaluate.REGISTER_CATEGORIES + ("other",), d).alias("category"), F.when(d % 2 == 0, "TIM1").otherwise("").alias("peripheral"),
        F.concat(F.lit("Say "), answer).alias("question"), answer.alias("answer"), form.alias("answer_format"), F.lit("medium").alias("difficulty"), F.lit("p.1").alias("source_ref"),
    )


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 6 < 5 THEN 'svd_lookup' WHEN doc_id % 2 = 0 THEN 'rag' ELSE 'full' END AS via FROM documents")
def route_questions(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", evaluate.route(F.col("category"), F.col("peripheral")).alias("via"))


@query("SELECT 'set' AS name, 'C' AS chip, count(*) AS question_count, CASE WHEN count(*) >= 6 THEN 'access_type,base_address,bit_field,other,register_offset,reset_value' END AS categories FROM documents")
def dataset_header(spark, sf_dir):
    return evaluate.dataset_header(_asked(spark, sf_dir), "set", "C").select("name", "chip", "question_count", F.array_join("categories", ",").alias("categories"))


def echo(system: str, question: str) -> tuple[str, int, float]:
    """A provider that knows the answer if it was given some context."""
    if "hot" not in system:
        raise RuntimeError("nothing known")
    return question.removeprefix("Say "), len(question), 1.0


@query(
    "SELECT doc_id::VARCHAR AS id, c AS condition, r::VARCHAR AS run_id, c = 'hot' AS correct, CASE WHEN c = 'hot' THEN 1.0 ELSE 0.0 END::DOUBLE AS partial_score, CASE WHEN c = 'hot' THEN 4 + length(CASE doc_id % 3 WHEN 0 THEN '0x' || lpad(printf('%X', doc_id), greatest(4, length(printf('%X', doc_id)))::INT, '0') WHEN 1 THEN doc_id || ' kHz' ELSE 'unit ' || doc_id END) ELSE 0 END::INT AS tokens"
    " FROM documents, (VALUES ('hot'), ('no_context')) t(c), range(1, 3) u(r)"
)
def ask_and_score(spark, sf_dir):
    questions = _asked(spark, sf_dir)
    asked = evaluate.ask(evaluate.prompts(questions, evaluate.conditions(spark, "C", hot="hot facts"), runs=2), echo)
    rows = asked.join(questions.select("id", "answer", "answer_format"), "id")
    return evaluate.scored(rows).select("id", "condition", "run_id", "correct", "partial_score", "tokens")


@query("SELECT doc_id::VARCHAR AS id, doc_id % 5 < 4 AS correct, CASE WHEN doc_id % 5 < 4 THEN 1.0 END::DOUBLE AS confidence, 'svd_lookup' AS condition FROM documents")
def lookup_responses(spark, sf_dir):
    questions = _asked(spark, sf_dir)
    known = F.col("id").cast("long") % 5 < 4
    answers = questions.select("id", F.when(known, F.col("answer")).otherwise("").alias("answer"), known.alias("answerable"))
    return evaluate.lookup_responses(questions, answers).select("id", "correct", "confidence", "condition")


@query("SELECT doc_id AS n, 'p.1' AS source_ref, 'unit ' || doc_id AS expected FROM documents WHERE doc_id % 3 = 2")
def answers_with_source(spark, sf_dir):
    questions = _asked(spark, sf_dir).where("answer_format = 'text'")
    responses = questions.select(F.col("id").alias("question_id"))
    return evaluate.with_source_ref(responses, questions).select(F.col("question_id").cast("long").alias("n"), "source_ref", "expected")


@query("SELECT event_type AS condition, sum(event_id)::BIGINT AS total_tokens, arg_min(['openai', 'anthropic'][(user_id % 2 + 1)::INT], event_id) AS provider FROM events GROUP BY event_type")
def run_costs(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.col("event_id").alias("total_tokens"), _pick(("openai", "anthropic"), F.col("user_id")).alias("provider"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("started"), F.lit("r").alias("run_id"))
    return evaluate.run_costs(runs).select("condition", "total_tokens", "provider")


@query("SELECT p_partkey, ['easy', 'medium', 'hard', 'odd'][(p_partkey % 4 + 1)::INT] AS difficulty, (p_partkey % 4 + 1)::BIGINT AS place FROM part")
def difficulty_places(spark, sf_dir):
    d = _pick(("easy", "medium", "hard", "odd"), F.col("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", d.alias("difficulty"), evaluate.difficulty_order(d).cast("long").alias("place"))


# Tables on disk, guards and counts


@query("SELECT doc_id::VARCHAR AS id, 'x/' || doc_id || '.txt' AS path, 'text' AS doc_type, sha256(text) AS hash, n_chars::INT AS chunks, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS chip FROM documents")
def manifest_round_trip(spark, sf_dir):
    """Written as one file and read again."""
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(
        d.cast("string").alias("id"), F.concat(F.lit("x/"), d.cast("string"), F.lit(".txt")).alias("path"), F.lit("text").alias("doc_type"), F.sha2("text", 256).alias("hash"), F.lit("2026-01-01").alias("added"),
        F.col("n_chars").cast("int").alias("chunks"), F.when(d % 2 == 0, F.col("source")).otherwise("").alias("chip"),
    )
    path = scratch(spark, "manifest")
    manifest.manifest_json(rows).write.text(path)
    return manifest.read_manifest(spark, path).select("id", "path", "doc_type", "hash", "chunks", "chip")


@query("SELECT count(*) AS document_count, sum(n_chars)::BIGINT AS chunk_count FROM documents")
def manifest_totals(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("int").alias("chunks"))
    return manifest.totals(rows).select("document_count", "chunk_count")


@query("SELECT doc_id::VARCHAR AS id, ['base_address','register_offset','bit_field','reset_value','access_type','other'][(doc_id % 6 + 1)::INT] AS category, 'p.1' AS source_ref FROM documents")
def dataset_round_trip(spark, sf_dir):
    """A question set written as one object and read again."""
    path = scratch(spark, "questions")
    questions = _asked(spark, sf_dir).withColumn("register", F.lit("")).withColumn("field_name", F.lit(""))
    evaluate.write_dataset(questions, "set", "C", path)
    return evaluate.read_dataset(spark, path).withColumn("category", F.col("category")).select("id", "category", "source_ref")


@query("SELECT p_partkey, p_size % 4 = 0 AS too_large FROM part")
def size_guard(spark, sf_dir):
    length = F.when(F.col("p_size") % 4 == 0, files.LIMITS["text"] + 1).otherwise(files.LIMITS["text"])
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("x/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("path"), F.col("p_name").cast("binary").alias("content"), length.cast("long").alias("length"))
    found = files.parse_text(rows)
    return found.select(F.regexp_extract("doc_id", "([0-9]+)", 1).cast("long").alias("p_partkey"), (F.col("error").isNotNull() & (F.col("content") == "")).alias("too_large"))


@query("SELECT p_partkey, p_size % 3 = 0 AS refused FROM part")
def xml_safety(spark, sf_dir):
    head = F.when(F.col("p_size") % 6 == 0, '<!DOCTYPE x [<!ENTITY a "b">]>').when(F.col("p_size") % 6 == 3, "<!ENTITY a 'b'>").otherwise("")
    xml = F.concat(head, F.lit("<device><name>"), "p_name", F.lit("</name></device>"))
    found = svd.read_devices(_files(read(spark, sf_dir, "part"), F.concat(F.lit("x/"), F.col("p_partkey").cast("string"), F.lit(".svd")), xml))
    return found.select(text.stem(F.col("path")).cast("long").alias("p_partkey"), F.col("error").isNotNull().alias("refused"))


@query("SELECT lower(replace(replace(p_brand, ' ', '_'), '-', '_')) || '_svd' AS doc_id, p_brand AS chip, p_brand || ' Register Map' AS title, '2' AS peripherals, count(*)::VARCHAR AS registers FROM part GROUP BY p_brand")
def svd_documents(spark, sf_dir):
    """Devices as documents, with counts of what the file itself has."""
    found = svd.parse_files(_svd_files(spark, sf_dir))
    return found.select("doc_id", "chip", "title", F.try_element_at("metadata", F.lit("peripheral_count")).alias("peripherals"), F.try_element_at("metadata", F.lit("register_count")).alias("registers"))


@query("SELECT s_name AS name, n_name AS vendor, n_name || '/' || s_name || '.svd' AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0")
def catalog_index(spark, sf_dir):
    """Every third supplier is listed with another suffix and is no device."""
    both = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    tree = both.select(F.concat(F.lit("data/"), "n_name", F.lit("/"), "s_name", F.when(F.col("s_suppkey") % 3 == 0, ".txt").otherwise(".svd")).alias("path"))
    return catalog.Catalog.index(tree).devices


@query("SELECT p_partkey, p_partkey % 4 = 3 AS safe FROM part")
def safe_names(spark, sf_dir):
    name = F.concat(F.col("p_brand"), _pick(("/", "\\", "..", "-"), F.col("p_partkey")), F.col("p_partkey").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", catalog.safe_name(name).alias("safe"))


@query(
    "SELECT p_brand AS doc_id, count(*) FILTER (p_partkey % 3 = 0) AS figure_count, md5(string_agg('<!-- PAGE:' || p_partkey || ' -->' || chr(10) || CASE p_partkey % 3 WHEN 0 THEN '<!-- FIGURE: page=' || p_partkey || ' bbox=1,2,3,4 type=figure -->' || chr(10) || '> **Figure** (figure)' || chr(10) || '> Caption: ' || p_type"
    " WHEN 1 THEN '## ' || p_name ELSE p_name END, chr(10) || chr(10) ORDER BY p_partkey)) AS digest FROM part GROUP BY p_brand"
)
def layout_assembly(spark, sf_dir):
    """Headings, text and figures in reading order; a page a part, and a footer that no label keeps."""
    k = F.col("p_partkey") % 3
    label = F.when(k == 0, "picture").when(k == 1, "section_header").otherwise("text")
    items = read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), F.col("p_partkey").cast("int").alias("page"), F.explode(F.array(F.struct(label.alias("label"), F.when(k == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("text")), F.struct(F.lit("footer").alias("label"), F.lit("f").alias("text")))).alias("i"),
        F.lit(10.0).alias("y"), F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(3.0).alias("x1"), F.lit(4.0).alias("y1"), F.lit(None).cast("binary").alias("image"),
    ).select("doc_id", "page", "y", "i.label", "i.text", "x0", "y0", "x1", "y1", "image")
    return pdf.assemble_layout(items).select("doc_id", "figure_count", F.md5("content").alias("digest"))


@query(
    "SELECT 'C' AS chip, ['no_context', 'hot'][l.toxic + 1] AS condition, count(*) AS total, count_if(l.quality = 1)::BIGINT AS correct, round(count_if(l.quality = 1) / count(*)::DOUBLE, 6) AS accuracy FROM labels l GROUP BY l.toxic"
)
def report_metrics(spark, sf_dir):
    """The report's row of metrics, a row a condition again."""
    rows = read(spark, sf_dir, "labels").select(
        F.concat(F.lit("p_"), F.col("doc_id").cast("string"), F.lit("_offset")).alias("question_id"), F.when(F.col("toxic") == 0, "no_context").otherwise("hot").alias("condition"), (F.col("quality") == 1).alias("correct"),
        F.lit(1.0).alias("latency_ms"), F.lit(0.5).alias("partial_score"), F.lit(0.5).alias("confidence"),
    )
    made = evaluate.report(rows, None, "C_questions")
    return made.select("chip", F.explode("metrics").alias("m")).select("chip", "m.condition", "m.total", "m.correct", F.round("m.accuracy", 6).alias("accuracy"))


# Reports in one pass, and tests of all pairs

_SETS = (
    f"WITH r AS (SELECT condition, correct, category, coalesce(difficulty, 'medium') AS difficulty, latency_ms, confidence, CASE {queries._BINS} END AS bin FROM {queries._RESP})"
    " SELECT condition, coalesce(category, '') AS category, coalesce(difficulty, '') AS difficulty, coalesce(bin, -1)::INT AS bin, grouping(condition, category, difficulty, bin)::INT AS set, count(*) AS total, count_if(correct)::BIGINT AS correct,"
    " round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(confidence), 6) AS avg_confidence FROM r GROUP BY GROUPING SETS ((condition), (condition, category), (condition, difficulty), (condition, bin))"
)


def _asked_questions(r: DataFrame) -> DataFrame:
    kinds = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("doc_id") % 4 + 1).cast("int"))
    return r.where("doc_id % 4 < 3").select(F.col("question_id").alias("id"), kinds.alias("difficulty"))


@query(_SETS)
def report_sets(spark, sf_dir):
    """Conditions with their categories, difficulties and confidence bins, by grouping sets."""
    r = queries._responses(spark, sf_dir)
    found = evaluate.metric_sets(r, _asked_questions(r)).fillna("", ["category", "difficulty"]).fillna(-1, ["bin"])
    return queries._rounded(found.select("condition", "category", "difficulty", "bin", "set", "total", "correct", "avg_latency_ms", "avg_confidence"))


@query(
    f"WITH r AS (SELECT condition, correct, category, coalesce(difficulty, 'medium') AS difficulty, confidence, CASE {queries._BINS} END AS b FROM {queries._RESP}), g AS (SELECT condition, b, count(*) AS n, avg(confidence) AS c, count_if(correct) / count(*)::DOUBLE AS a FROM r GROUP BY condition, b),"
    " e AS (SELECT condition, sum(CASE WHEN b IS NULL THEN 0 ELSE abs(a - c) * n END) / sum(n) AS ece FROM g GROUP BY condition), k AS (SELECT condition, string_agg(category || '=' || printf('%.6f', acc), ';' ORDER BY category) AS by_category FROM (SELECT condition, category, count_if(correct) / count(*)::DOUBLE AS acc FROM r GROUP BY ALL) GROUP BY condition),"
    " d AS (SELECT condition, string_agg(difficulty || '=' || printf('%.6f', acc), ';' ORDER BY difficulty) AS by_difficulty FROM (SELECT condition, difficulty, count_if(correct) / count(*)::DOUBLE AS acc FROM r GROUP BY ALL) GROUP BY condition)"
    " SELECT condition, round(ece, 6) AS ece, by_category, by_difficulty FROM e JOIN k USING (condition) JOIN d USING (condition)"
)
def report_maps(spark, sf_dir):
    """The report's calibration errors and maps, a row a condition."""
    r = queries._responses(spark, sf_dir)
    made = evaluate.report(r, _asked_questions(r), "C_questions")
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))), ";")
    rows = made.select(F.explode("metrics").alias("m"), "maps").select("m.condition", F.round("m.ece", 6).alias("ece"), F.element_at("maps", F.col("m.condition")).alias("x"))
    return rows.select("condition", "ece", listed(F.col("x.by_category")).alias("by_category"), listed(F.col("x.by_difficulty")).alias("by_difficulty"))


_ERFC = "CASE WHEN x >= 6 THEN 0 WHEN x = 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 200), lambda n: exp((2 * n + 1) * ln(x) - lgamma(n + 1.5) - x * x))) END"


@query(
    "WITH r AS (SELECT source AS condition, n_chars % 1009 AS q, min(doc_id) % 3 = 0 AS ok FROM documents GROUP BY ALL), n AS (SELECT condition, count(*) AS n FROM r GROUP BY condition),"
    " p AS (SELECT a.condition AS first, b.condition AS second, count_if(a.ok AND NOT b.ok) AS b, count_if(NOT a.ok AND b.ok) AS c, count(*) AS met FROM r a JOIN r b ON a.q = b.q AND a.condition < b.condition GROUP BY ALL),"
    " t AS (SELECT p.*, x.n + y.n - 2 * met AS unpaired, CASE WHEN b + c = 0 THEN 0 ELSE pow(greatest(abs(b - c) - 1, 0), 2) / (b + c) END::DOUBLE AS chi2 FROM p JOIN n x ON first = x.condition JOIN n y ON second = y.condition)"
    f" SELECT first, second, b::BIGINT AS b, c::BIGINT AS c, unpaired, round(chi2, 6) AS chi2, round({_ERFC}, 9) AS p_value FROM (SELECT *, sqrt(chi2 / 2) AS x FROM t)"
)
def mcnemar_all_pairs(spark, sf_dir):
    """Each pair of conditions with chi-squared and p; sources stand for conditions, and length classes for questions."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    r = docs.groupBy(F.col("source").alias("condition"), (F.col("n_chars") % 1009).alias("question_id")).agg((F.min("doc_id") % 3 == 0).alias("correct"))
    found = evaluate.mcnemar_pairs(r)
    return found.select("first", "second", "b", "c", "unpaired", F.round("chi2", 6).alias("chi2"), F.round("p_value", 9).alias("p_value"))


# SQL functions


def _chunk_view(spark: SparkSession, rows: DataFrame) -> str:
    """A view of its own for each query, as the table functions name it."""
    name = f"chunks_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    sql.register(spark, name)
    return name


@query(f"SELECT place, vec_id, round(d, 6) AS distance FROM (SELECT vec_id, d, row_number() OVER (ORDER BY d, vec_id)::INT AS place FROM (SELECT vec_id, {_FAR} AS d FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0))) WHERE place <= 7 AND vec_id % 2 = 0")
def sql_nearest_chunks(spark, sf_dir):
    """A table function of SQL, with a filter on what it returns."""
    rows = read(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), F.lit("d").alias("doc_id"), F.lit("").alias("content"), "embedding", F.lit("").alias("section_path"), F.lit("").alias("chip"), F.lit("").alias("doc_type"))
    name = _chunk_view(spark, rows)
    return spark.sql(
        f"SELECT place, CAST(chunk_id AS BIGINT) AS vec_id, round(distance, 6) AS distance FROM (SELECT CAST(embedding AS ARRAY<DOUBLE>) AS q FROM {name} WHERE chunk_id = '000000000000'), LATERAL nearest_chunks(q, 7) WHERE CAST(chunk_id AS BIGINT) % 2 = 0"
    )


@query("SELECT p_brand AS peripheral, count(*) AS chunks FROM part WHERE p_size % 3 = 1 GROUP BY p_brand")
def sql_peripherals(spark, sf_dir):
    own, _ = _named_chunks(spark, sf_dir)
    _chunk_view(spark, own.withColumns({"doc_id": F.lit("d"), "doc_type": F.lit("svd"), "embedding": F.array().cast("array<float>")}))
    return spark.sql("SELECT * FROM peripherals_of_chip('C1')")


@query(
    "SELECT l_orderkey, l_linenumber, printf('0x%04X', l_partkey) AS address, CASE WHEN l_linenumber = 1 THEN '[' || l_suppkey % 32 || ']' ELSE '[' || (l_suppkey % 32 + l_linenumber - 1) || ':' || l_suppkey % 32 || ']' END AS bits FROM lineitem"
)
def sql_register_texts(spark, sf_dir):
    sql.register(spark)
    name = f"lines_{uuid.uuid4().hex}"
    _lines(spark, sf_dir).createOrReplaceTempView(name)
    return spark.sql(f"SELECT l_orderkey, l_linenumber, register_hex(l_partkey, 4) AS address, bit_text(CAST(l_suppkey % 32 AS INT), CAST(l_linenumber AS INT)) AS bits FROM {name}")


# Versions of documents. A deletion begins a new life.

_VERSIONS = (
    "WITH v AS (SELECT user_id::VARCHAR AS id, CASE WHEN event_type <> 'signup' THEN event_type END AS hash, ts, event_id FROM events),"
    " l AS (SELECT *, lag(hash) OVER w AS old, count(*) FILTER (hash IS NULL) OVER w AS life FROM v WINDOW w AS (PARTITION BY id ORDER BY ts, hash NULLS FIRST)),"
    " s AS (SELECT *, CASE WHEN hash IS NULL AND old IS NULL THEN 'absent' WHEN hash IS NULL THEN 'deleted' WHEN old IS NULL THEN 'new' WHEN old = hash THEN 'unchanged' ELSE 'changed' END AS state FROM l)"
    " SELECT id, event_id, state, count(*) FILTER (state IN ('new', 'changed')) OVER (PARTITION BY id, life ORDER BY ts, hash NULLS FIRST ROWS UNBOUNDED PRECEDING) AS number FROM s"
)


def _versions(events: DataFrame) -> DataFrame:
    """Events as versions of their user's document; a signup deletes it."""
    return events.select(F.col("user_id").cast("string").alias("id"), F.when(F.col("event_type") != "signup", F.col("event_type")).alias("hash"), F.col("ts").cast("timestamp").alias("at"), "event_id")


@query(_VERSIONS)
def version_history(spark, sf_dir):
    """J3, P15 over time, as windows of a table."""
    return versions.history(_versions(read(spark, sf_dir, "events"))).select("id", "event_id", "state", "number")


@query(_VERSIONS)
def tracked_versions(spark, sf_dir):
    """The same of a stream, with a state for each live document."""
    events = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    path = scratch(spark, "versions")
    return versions.write_available(versions.tracked(_versions(events)), path, f"{path}-checkpoint").select("id", "event_id", "state", "number")


# Metadata of mixed shape


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON with nested objects, a value of three kinds, and some texts that are cut off; kept as VARIANT in Parquet."""
    of_kind = F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("string")).when(F.col("event_id") % 3 == 1, '"high"').otherwise("null")
    whole = F.concat(F.lit('{"props": '), "props", F.lit(', "user": {"id": '), F.col("user_id").cast("string"), F.lit(', "tag": "'), "event_type", F.lit('"}, "value": '), of_kind, F.lit(', "flag": true}'))
    said = F.when(F.col("event_id") % 101 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    path = scratch(spark, "facts")
    read(spark, sf_dir, "events").select("event_id", metadata.from_json(said).alias("facts")).write.parquet(path)
    return spark.read.schema("event_id bigint, facts variant").parquet(path)


@query(
    "SELECT event_id, (props->>'k')::BIGINT AS k, event_type AS tag, floor(value)::DOUBLE AS value FROM events"
    " WHERE event_id % 101 <> 0 AND (props->>'k')::BIGINT >= 50 AND event_type IN ('click', 'view') AND event_id % 3 = 0 AND floor(value) > 20"
)
def metadata_filters(spark, sf_dir):
    """Typed filters on paths; a value of another kind fits none."""
    rows = _facts(spark, sf_dir).where(metadata.matches(F.col("facts"), {"props.k": (">=", 50), "user.tag": ["click", "view"], "value": (">", 20.0), "flag": True}))
    of = lambda path, kind, name: metadata.value(F.col("facts"), path, kind).alias(name)
    return rows.select("event_id", of("props.k", "bigint", "k"), of("user.tag", "string", "tag"), of("value", "double", "value"))


@query(
    "WITH e AS (SELECT * FROM events WHERE event_id % 101 <> 0) SELECT key, kind, count(*) AS n FROM (SELECT unnest(['props', 'user', 'flag', 'value']) AS key,"
    " unnest(['object', 'object', 'boolean', ['bigint', 'string', 'void'][event_id % 3 + 1]]) AS kind FROM e) GROUP BY ALL"
)
def metadata_profile(spark, sf_dir):
    return metadata.profile(_facts(spark, sf_dir), "facts")
