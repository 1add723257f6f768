"""Column functions over rows of facts."""

import re

import pytest
from pyspark.sql import functions as F

from docstrata.functions import detect, registers, relevance, scoring, text


def values(spark, rows, schema, **columns):
    out = spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in out]


SCORES = [
    ("0x40013000", "40013000", "hex", 1.0, 1.0),
    ("0x0000", "0X0", "hex", 1.0, 1.0),
    ("0x4001", "0x4002", "hex", 0.0, 0.75),
    ("0x1", "0x10001", "hex", 0.0, 7 / 8),
    ("[5:3]", "bits 5-3", "bit_range", 1.0, 1.0),
    ("[5:3]", "[5:4]", "bit_range", 0.0, 2 / 3),
    ("[3:5]", "[5:3]", "bit_range", 0.0, 0.0),
    ("7", "[7]", "bit_range", 1.0, 1.0),
    ("read-only", "RO", "access_code", 1.0, 1.0),
    ("RW", "RO", "access_code", 0.0, 0.0),
    ("the SPI1 bus", "A SPI1", "text", 1.0, 0.5),
    ("alpha", "beta", "text", 0.0, 0.0),
    ("16 MHz", "16000 kHz", "numeric", 1.0, 1.0),
    ("16000000", "16 MHz", "numeric", 1.0, 1.0),
    ("8 MHz", "16 MHz", "numeric", 0.0, 0.5),
    ("0 V", "0 mV", "numeric", 1.0, 1.0),
    ("5 wait states", "5 wait states", "numeric", 1.0, 1.0),
    ("1.8 V to 3.6 V", "1800 mV - 3600 mV", "numeric_range", 1.0, 1.0),
    ("1.8V to 3V", "1.8 to 3.6 V", "numeric_range", 0.0, 0.5),
    ("1 V to 2 V", "1 A to 2 A", "numeric_range", 0.0, 0.0),
    ("a, b, c", "A, b, c, d", "list", 1.0, 0.75),
    ("a", "b, c", "list", 0.0, 0.0),
    ("", "x", "text", 0.0, 0.0),
    (None, "x", "hex", 0.0, 0.0),
    ("x", " x ", "other", 1.0, 1.0),
]


def test_scores(spark):
    a, b, f = F.col("a"), F.col("b"), F.col("f")
    got = values(spark, [r[:3] for r in SCORES], "a string, b string, f string", x=scoring.score_answer(a, b, f), y=scoring.score_partial(a, b, f))
    assert got == [pytest.approx(r[3:]) for r in SCORES]


EXTRACTS = [
    ("The base is 0x40013000.", "hex", "0x40013000"),
    ("address 40013000 ok", "hex", "0x40013000"),
    ("DEADBEEF", "hex", ""),
    ("bits 3 to 5", "bit_range", "[5:3]"),
    ("[3:5] it is", "bit_range", "[3:5]"),
    ("bit 7", "bit_range", "[7]"),
    ("15", "bit_range", "[15]"),
    ("no", "bit_range", ""),
    ("It is read/write", "access_code", "RW"),
    ("read-write-once", "access_code", "RW"),
    ("The answer is SPI1.", "text", "SPI1"),
    (" ".join(["word"] * 25) + ". The last one!", "text", "The last one"),
    ("runs at 16 MHz", "numeric", "16 MHz"),
    ("about -3.5 or so", "numeric", "-3.5"),
    ("1.8 to 3.6 V", "numeric_range", "1.8 to 3.6V"),
    ("2 V - 3", "numeric_range", "2V to 3V"),
    ("- a\n- b", "list", "a, b"),
    ("  raw  ", "x", "raw"),
    (None, "hex", ""),
]


def test_extraction(spark):
    got = values(spark, [r[:2] for r in EXTRACTS], "t string, f string", x=scoring.extract_answer(F.col("t"), F.col("f")))
    assert got == [r[2] for r in EXTRACTS]


def test_confidence(spark):
    said = [("Confidence: 90%",), ("I am 85% confident",), ("certain = 0.95",), ("confidence 150%",), ("no",), (None,)]
    assert values(spark, said, "t string", x=scoring.extract_confidence(F.col("t"))) == [0.9, 0.85, 0.95, 1.5, None, None]


def test_registers(spark):
    rows = [(0b1011_0000, 4, 4), (0xFF, 0, 1), (5, 64, 1), (5, 0, 0), (None, 0, 1), (-1, 0, 64), (0x1234, 4, 8)]
    r, o, w = (F.col(c) for c in "row")
    assert values(spark, rows, "r long, o int, w int", x=registers.field_reset(r, o, w)) == ["0xB", "0x1", "0x0", "0x0", "—", "0xFFFFFFFFFFFFFFFF", "0x23"]
    assert values(spark, [(7, 3), (0, 1)], "o int, w int", x=registers.bit_range(o, w)) == ["[9:7]", "[0]"]
    assert values(spark, [("0x10",), ("16",), ("#101",), ("0xFFFFFFFFFFFFFFFF",), ("x",), (None,)], "t string", x=registers.parse_int(F.col("t"))) == [16, 16, 5, -1, None, None]
    assert values(spark, [("read-write",), ("odd",), (None,)], "t string", x=registers.access_code(F.col("t"))) == ["RW", "odd", "—"]
    cases = [("base_address", "SPI1", False, False, "easy"), ("bit_field", "SPI1", True, False, "medium"), ("reset_value", "XYZ", False, True, "hard"), ("other", "ADC2", False, False, "medium")]
    got = values(spark, [c[:4] for c in cases], "c string, p string, s boolean, n boolean", x=registers.difficulty(F.col("c"), F.col("p"), F.col("s"), F.col("n")))
    assert got == [c[4] for c in cases]


CONTENT = {
    "```c\nint x;\n```": "code",
    "| A |\n|---|\n| offset |": "register_table",
    "| Pin |\n|---|\n| AF7 |": "pin_mapping",
    "| P |\n|---|\n| VDD |": "electrical_spec",
    "| T |\n|---|\n| 5 ns |": "timing_spec",
    "| a |\n|---|\n| b |": "table",
    "A known issue": "errata",
    "addresses0001": "errata",
    "must be set": "config_procedure",
    "see 0x40000000": "register_description",
    "baud rate": "timing_spec",
    "GPIOA": "pin_mapping",
    "draws 5 mA": "electrical_spec",
    "# Title\nx": "section",
    "words": "prose",
}


def test_content_types(spark):
    assert values(spark, [(k,) for k in CONTENT], "t string", x=detect.content_type(F.col("t"))) == list(CONTENT.values())


def test_detection(spark):
    files = [("a/x.PDF", b"%PDF-1", "pdf", 1.0), ("a/x.md", b"%PDF-1", "markdown", 0.7), ("x.md", b"", "markdown", 1.0), ("x.c", b"int", "c_source", 0.9), ("x.bin", b"\x89PNG\r\n\x1a\n", "image", 0.8), ("noext", b"x", "unknown", 0.0), ("x.xml", b"<?xml?><Device>", "svd", 0.9), ("x.xml", b"<a>", "unknown", 0.0)]
    d = detect.detect_format(F.col("p"), F.col("c"), F.length("c"))
    assert values(spark, [(p, bytearray(c)) for p, c, _, _ in files], "p string, c binary", f=d["format"], s=d["confidence"]) == [f[2:] for f in files]
    names = [("x_datasheet.pdf", "datasheet"), ("a_rm.pdf", "reference_manual"), ("Errata1.pdf", "errata"), ("an_5.pdf", "app_note"), ("schematic.pdf", "schematic"), ("RM0090.pdf", "unknown")]
    assert values(spark, [(n,) for n, _ in names], "p string", x=detect.document_type(F.col("p"), F.lit("pdf"))) == [t for _, t in names]


def test_text(spark):
    t = F.col("t")
    one = lambda c, s: values(spark, [(s,)], "t string", x=c)[0]
    assert one(text.normalize_whitespace(t), "  a \t\n\n\n\nb\u00a0\n") == "a\n\nb"
    assert one(text.make_doc_id(t), "/d.x/My File-1.SVD") == "my_file_1_svd"
    assert one(text.first_line_title(t, F.lit("x/y.txt")), "\n  \n  Hello \nWorld") == "Hello" and one(text.first_line_title(t, F.lit("x/y.txt")), " \n") == "y"
    assert one(text.human_size(t.cast("long")), "2048") == "2.0 KB" and one(text.human_size(t.cast("long")), "5") == "5 B"
    assert one(text.strip_markdown(t), "# A **b** `c` *d*") == "A b c d"
    assert one(text.preview(t), "x" * 300) == "x" * 200 + "..." and one(text.preview(t), "x") == "x"
    assert one(text.count_lines(t), "\na\n\nb\n") == 3 and one(text.count_lines(t), " ") == 0
    assert one(text.formatted(F.lit("q"), t, "json"), "c") == '{"query":"q","content":"c"}'
    assert one(F.array(*text.front_matter(t)), "---\na: 1\n---\nbody") == ["\na: 1", "body"] and one(F.array(*text.front_matter(t)), "---\nno end") == ["", "---\nno end"]
    assert one(F.array(*text.peripheral_heading(t)), "x\n# SPI1 — Bus\n") == ["SPI1", "Bus"]
    assert re.fullmatch(r"d_chunk_0003_[0-9a-f]{8}", one(text.chunk_id(F.lit("d"), F.lit(3), t), "c"))


def test_relevance(spark):
    t = F.col("t")
    one = lambda c, s: values(spark, [(s,)], "t string", x=c)[0]
    assert sorted(one(relevance.tokenize(t), "The SPI1 bus, SPI_CR1 x 2ab über bus")) == ["bus", "spi1"]
    keys = one(relevance.keywords(F.lit("SPI1"), t, F.lit("serial bus")), "| CR1 | x |\n| REGISTER | y |\n| SR_2 | z |")
    assert sorted(keys) == ["bus", "cr1", "serial", "spi", "spi1", "sr_2"]
    assert one(relevance.relevance(F.array(F.lit("a1"), F.lit("b1")), relevance.tokenize(t)), "a1") == 0.5
    assert one(relevance.mentions(t, F.lit("SPI1")), "A > spi1 > B") and not one(relevance.mentions(t, F.lit("SPI1")), "A > SPI10")
    assert one(relevance.task_name(t), "A > B > Do it") == "Do it" and one(relevance.task_name(t), "A > B") == "General"
    assert one(relevance.peripheral_of(t), "A > B > C") == "B" and one(relevance.peripheral_of(t), "A") == ""
    assert one(relevance.described(t), "x\n**Description:** The bus \n") == "The bus"
    assert one(relevance.citation(F.lit("T"), t, F.lit("pdf"), F.lit(3)), "A > B > C") == "*Source: T, §B > C, p.3*" and one(relevance.citation(F.lit("T"), t, F.lit("md"), F.lit(3)), "") == "*Source: T*"
