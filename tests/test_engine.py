"""Files to documents to context, and what is asked of them."""

import io
import json
import zlib

import pytest
from pyspark.sql import functions as F

from docstrata import cli, config, serve
from docstrata.errors import BenchmarkError, CatalogError, ConfigError, EmbeddingError, ManifestError, ParseError, PluginError, TemplateError
from docstrata.operators import embed, evaluate, search, templates
from docstrata.operators.compile import matching_pins
from docstrata.operators.store import ChunkStore
from docstrata.project import Project, find_root
from docstrata.providers import StubProvider, default_registry
from docstrata.sources import catalog, files, manifest, pdf, svd

SVD = """<?xml version="1.0"?>
<device><name>CHIP1</name><description>A chip</description><cpu><name>CM4</name><revision>r0p1</revision></cpu><size>32</size><access>read-write</access>
<peripherals>
 <peripheral><name>SPI1</name><description>Serial bus</description><baseAddress>0x40013000</baseAddress><registers>
  <register><name>SR</name><addressOffset>0x8</addressOffset><access>read-only</access><resetValue>0x2</resetValue></register>
  <register><name>CR1</name><description>Control</description><addressOffset>0x0</addressOffset><resetValue>0x35</resetValue><fields>
   <field><name>EN</name><bitOffset>0</bitOffset><bitWidth>1</bitWidth></field>
   <field><name>BR</name><bitRange>[5:3]</bitRange><access>read-only</access></field></fields></register>
  <register><dim>2</dim><dimIncrement>4</dimIncrement><name>D%s</name><addressOffset>0x10</addressOffset></register>
  <cluster><name>CL</name><addressOffset>0x20</addressOffset><register><name>X</name><addressOffset>0x4</addressOffset></register></cluster>
 </registers></peripheral>
 <peripheral derivedFrom="SPI1"><name>SPI2</name><baseAddress>0x40003800</baseAddress></peripheral>
 <peripheral><name>NONE</name><baseAddress>0x1</baseAddress></peripheral>
</peripherals></device>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "chip.svd").write_text(SVD)
    (d / "bad.svd").write_text('<!DOCTYPE x [<!ENTITY a "b">]><device/>')
    (d / "guide.md").write_text("---\ntitle: The Guide\nauthor: me\nok: true\n---\n# Guide\n\n## SPI1\n\n### Initialization\n\nThe SPI1 bus must be set up: enable the clock of the serial bus first.\n")
    (d / "plain.md").write_text("no title\n\n## Second\n")
    (d / "notes.txt").write_bytes(b"\xef\xbb\xbf\n First line  \n\n\n\nsecond \xff\n")
    (d / "board.dts").write_text('/ { model = "My Board"; compatible = "acme,board", "st,stm32mp157-dk"; sub { compatible = "acme,board"; }; };')
    return d


def test_documents(spark, folder):
    docs = {r["doc_id"]: r for r in files.read_documents(spark, str(folder)).collect()}
    assert set(docs) == {"chip_svd", "bad_svd", "guide_md", "plain_md", "notes_txt", "board_dts"}
    assert docs["guide_md"]["title"] == "The Guide" and docs["guide_md"]["metadata"] == {"author": "me", "ok": "True"} and docs["guide_md"]["content"].startswith("# Guide")
    assert docs["plain_md"]["title"] == "Second" and docs["notes_txt"]["title"] == "First line" and docs["notes_txt"]["content"] == "First line\n\nsecond \ufffd"
    assert docs["board_dts"]["chip"] == "STM32MP157" and docs["board_dts"]["title"] == "My Board" and docs["board_dts"]["metadata"] == {"compatibles": "acme,board, st,stm32mp157-dk"}
    assert "ParseError" in docs["bad_svd"]["error"] and docs["chip_svd"]["chip"] == "CHIP1" and docs["chip_svd"]["metadata"]["register_count"] == "5"


def tables(spark, folder):
    p = svd.peripheral_table(svd.read_devices(files.scan(spark, str(folder), pattern="chip.svd")))
    r = svd.register_table(p)
    return p, r, svd.field_table(r)


def test_register_tables(spark, folder):
    p, r, f = tables(spark, folder)
    assert {x["name"]: x["base_address"] for x in p.collect()} == {"SPI1": 0x40013000, "SPI2": 0x40003800, "NONE": 1}
    own = {x["name"]: (x["address_offset"], x["size"], x["access"], x["reset_value"]) for x in r.where("peripheral = 'SPI2'").collect()}
    assert own == {"SR": (8, 32, "read-only", 2), "CR1": (0, 32, "read-write", 0x35), "D0": (16, 32, "read-write", None), "D1": (20, 32, "read-write", None), "CL_X": (36, 32, "read-write", None)}
    assert {(x["name"], x["bit_offset"], x["bit_width"], x["access"]) for x in f.where("peripheral = 'SPI1'").collect()} == {("EN", 0, 1, "read-write"), ("BR", 3, 3, "read-only")}


def test_register_text(spark, folder):
    text = svd.render_devices(svd.read_devices(files.scan(spark, str(folder), pattern="chip.svd"))).first()["content"]
    assert text.startswith("# CHIP1 Register Map\n\n**Device:** CHIP1\n**Description:** A chip\n**CPU:** CM4, revision r0p1\n")
    assert text.index("## NONE") < text.index("## SPI1") < text.index("## SPI2") and "*No registers defined.*" in text
    assert "| CR1 | 0x0000 | 32 | RW | 0x00000035 | Control |\n| SR | 0x0008 | 32 | RO | 0x00000002 |  |" in text
    assert "### CR1 Fields\n\n| Field | Bits | Access | Reset | Description |\n|-------|------|--------|-------|-------------|\n| BR | [5:3] | RO | 0x6 |  |\n| EN | [0] | RW | 0x1 |  |" in text


def test_questions_and_lookup(spark, folder):
    p, r, f = tables(spark, folder)
    p = p.withColumnRenamed("name", "peripheral")
    q = evaluate.generate_questions(p, r.drop("fields"), f)
    rows = {x["id"]: x for x in q.collect()}
    assert rows["spi1_base_address"]["answer"] == "0x40013000" and rows["spi1_cr1_offset"]["answer"] == "0x0000" and rows["spi1_cr1_br_bits"]["answer"] == "[5:3]" and rows["spi2_sr_access"]["answer"] == "RO"
    found = {x["id"]: x["answer"] for x in evaluate.lookup_answers(q, p, r, f).where("answerable").collect()}
    assert found == {i: x["answer"] for i, x in rows.items()}
    done = evaluate.lookup_responses(q, evaluate.lookup_answers(q, p, r, f))
    assert done.where("correct and confidence = 1.0").count() == len(rows)
    odd = spark.createDataFrame([("a", "base_address", "sp", "", ""), ("b", "base_address", "zz", "", ""), ("c", "clock", "SPI1", "", "")], "id string, category string, peripheral string, register string, field_name string")
    assert {x["id"]: x["answerable"] for x in evaluate.lookup_answers(odd, p, r, f).collect()} == {"a": True, "b": False, "c": False}


def test_asking_and_metrics(spark, folder):
    p, r, f = tables(spark, folder)
    q = evaluate.generate_questions(p.withColumnRenamed("name", "peripheral"), r.drop("fields"), f).where("category = 'base_address'")
    what = evaluate.conditions(spark, "CHIP1", hot="# Hot", pages={"spi1.md": "a", "tim1.md": "b"}, only=["spi"])
    assert {x["name"]: "b" in x["system_prompt"].split() for x in what.collect()} == {"no_context": False, "hot": False, "full": False}
    known = {x["question"]: f"It is {x['answer']}. Confidence: 90%" for x in q.where("peripheral <> 'NONE'").collect()}
    asked = evaluate.ask(evaluate.prompts(q, what, 2), StubProvider(known))
    done = evaluate.scored(asked.join(q.select("id", "answer", "answer_format"), "id")).withColumn("question_id", F.col("id"))
    m = {x["condition"]: x for x in evaluate.core_metrics(done, ["condition"]).collect()}
    assert m["hot"]["total"] == 6 and m["hot"]["correct"] == 4 and 0 < m["hot"]["ci_lower"] < m["hot"]["accuracy"] < m["hot"]["ci_upper"] < 1
    assert {x["ece"] for x in evaluate.calibration_error(done, ["condition"]).select(F.round("ece", 6).alias("ece")).collect()} == {0.1}
    assert evaluate.mcnemar(done.where("condition = 'hot' and run_id = '1'"), done.where("condition = 'full' and run_id = '1'")) == (0.0, 1.0)
    text = evaluate.report_markdown(evaluate.core_metrics(done, ["condition"]), evaluate.accuracy_by(done, ["condition"], evaluate.infer_category(F.col("id")), "category"), ["hot", "full"], "CHIP1")
    assert "| hot | 66.7% (4/6) |" in text and "| base_address | 66.7% | 66.7% |" in text
    failing = evaluate.scored(evaluate.ask(evaluate.prompts(q, what), lambda s, t: 1 / 0).join(q.select("id", "answer", "answer_format"), "id"))
    assert failing.where("correct or confidence is not null").count() == 0 and failing.where("raw_response like '[API_ERROR]%'").count() == failing.count()


def test_statistics(spark):
    assert evaluate.chi2_survival(3.841459) == pytest.approx(0.05, abs=1e-5)
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(6, 50), (0, 0), (50, 50)], "k int, n int").select(low, high).collect()
    assert [tuple(round(x, 3) for x in r) for r in got] == [(0.056, 0.238), (0.0, 0.0), (0.929, 1.0)]
    bins = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (0.7,), (1.0,), (1.5,)], "c double").select(evaluate.ece_bin(F.col("c"))).collect()
    assert [r[0] for r in bins] == [0, 2, None, 6, 9, None]
    m = spark.createDataFrame([("no_context", 0.2, 0.8, 0), ("hot", 0.9, 0.1, 1), ("full", 0.9, 0.1, 2)], "condition string, accuracy double, hallucination_rate double, pos int")
    assert evaluate.comparison(m).first()["best_condition"] == "hot"


def test_report(spark, tmp_path):
    rows = [("p_a_offset", "hot", True, 1.0, 2.0, 0.9), ("p_a_bits", "hot", False, 0.5, 4.0, 0.2), ("p_base_address", "no_context", False, 0.0, 1.0, None)]
    r = spark.createDataFrame(rows, "question_id string, condition string, correct boolean, partial_score double, latency_ms double, confidence double")
    q = spark.createDataFrame([("p_a_offset", "easy", "0x0", "p. 3"), ("p_a_bits", "hard", "[1]", None)], "id string, difficulty string, answer string, source_ref string")
    evaluate.write_json(evaluate.report(r, q, "CHIP1_set"), str(tmp_path / "r"))
    got = evaluate.read_report(spark, str(tmp_path / "r")).first()
    assert got["chip"] == "CHIP1" and [(m["condition"], m["total"], m["accuracy"]) for m in got["metrics"]] == [("hot", 2, 0.5), ("no_context", 1, 0.0)]
    assert got["maps"]["hot"]["by_category"] == {"register_offset": 1.0, "bit_field": 0.0} and got["maps"]["hot"]["by_difficulty"] == {"easy": 1.0, "hard": 0.0}
    assert got["maps"]["no_context"]["by_difficulty"] == {"medium": 0.0} and got["metrics"][1]["ece"] is None
    assert {x["question_id"]: x["expected"] for x in evaluate.with_source_ref(r, q).collect()} == {"p_a_offset": "0x0", "p_a_bits": "[1]", "p_base_address": None}
    runs = spark.createDataFrame([("2", "hot", "ollama", "b", 5), ("1", "hot", "openai", "a", 1_000_000)], "run_id string, condition string, provider string, started string, total_tokens int")
    assert evaluate.run_costs(runs).first()["cost"] == pytest.approx(10.00005)


def test_pages(spark):
    spans = [("d", 1, 0, 0, 0, "Title", 24.0, True), ("d", 1, 1, 0, 0, "Body text of some length", 10.0, False), ("d", 1, 1, 1, 0, "goes on", 10.0, False), ("d", 1, 2, 0, 0, "In table", 10.0, False), ("d", 1, 3, 0, 0, "Header", 8.0, False)]
    y = {0: 100, 1: 150, 2: 300, 3: 10}
    rows = [(*s, 50.0, float(y[s[2]]), 200.0, float(y[s[2]] + 20)) for s in spans]
    s = spark.createDataFrame(rows, "doc_id string, page int, block int, line int, span int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([("d", 1, 0, 40.0, 290.0, 210.0, 400.0, [["A", "B|"], ["1"], ["2", None, "x"]])], "doc_id string, page int, table int, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>")
    pages = spark.createDataFrame([("d", 1, 800.0), ("e", 1, 800.0)], "doc_id string, page int, height double")
    out = {r["doc_id"]: r for r in pdf.render_pages(s, t, pages).collect()}
    assert out["d"]["content"] == "<!-- PAGE:1 -->\n# Title\n\nBody text of some length goes on\n\n| A | B\\| |\n| --- | --- |\n| 1 |  |\n| 2 |  |" and out["e"]["content"] == ""
    items = spark.createDataFrame([("d", 1, 2.0, "text", "para", None), ("d", 1, 1.0, "section_header", "Head", None), ("d", None, None, "picture", "clock timing", None), ("d", 1, 3.0, "footer", "no", None)], "doc_id string, page int, y double, label string, text string, image binary")
    items = items.select("*", *[F.lit(1.5).alias(c) for c in ("x0", "y0", "x1", "y1")])
    got = pdf.assemble_layout(items).first()
    assert got["figure_count"] == 1 and got["content"].index("timing_diagram") < got["content"].index("## Head") < got["content"].index("para") and "bbox=2,2,2,2" in got["content"] and "no" not in got["content"].split()


def test_project(spark, folder, tmp_path):
    project = Project(spark, tmp_path)
    project.init("demo", "CHIP1")
    project.init("again")
    c = project.config()
    c.pins = {"spi1_mosi": "PA7", "spi10_x": "PB1"}
    c.output.targets = ["claude", "cursor", "unknown"]
    project.save(c)
    assert find_root(tmp_path / ".docstrata") == tmp_path.resolve() and project.config().project.name == "demo"
    (tmp_path / "CLAUDE.md").write_text("# Mine\n")
    assert project.add(str(folder)) == {"new": 5, "failed": 1}
    assert project.add(str(folder)) == {"unchanged": 5, "failed": 1}
    status = project.status()
    assert status.document_count == 5 and status.chunk_count == project.store.count() > 5
    page = (project.context / "peripherals" / "spi1.md").read_text()
    assert "| MOSI | PA7 |" in page and "SPI10" not in page and "### Initialization" in page and "*Source: guide, §SPI1 > Initialization*" in page and "CR1" in page
    mine = (tmp_path / "CLAUDE.md").read_text()
    assert mine.startswith("# Mine\n\n" + templates.BEGIN) and (tmp_path / ".cursor/rules/hardware.mdc").read_text().startswith("---\n")
    project.compile()
    assert (tmp_path / "CLAUDE.md").read_text().count(templates.BEGIN) == 1
    assert "SPI1" in serve.search(project, "serial bus clock", 3) and serve.search(project, "x", doc_type="nothing").startswith("Nothing")
    assert "0x40013000" in serve.registers(project, "spi1", content_type="") and serve.context(project, "../x") == "Not a name." and "MOSI" in serve.context(project, "SPI1", "other")
    assert "- SPI1 (CHIP1)" in serve.list_peripherals(project) and "guide_md" in serve.list_documents(project)
    sink = io.StringIO()
    asked = [("initialize", {}), ("tools/list", {}), ("tools/call", {"name": "list_documents"}), ("tools/call", {"name": "none"}), ("nothing", {}), ("tools/call", {"name": "search", "arguments": {"x": 1}})]
    lines = [json.dumps({"jsonrpc": "2.0", "id": n, "method": m, "params": x}) for n, (m, x) in enumerate(asked)] + ['{"method": "notifications/initialized"}', "no json"]
    serve.serve(project, io.StringIO("\n".join(lines)), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert len(got) == 7 and got[0]["result"]["serverInfo"]["name"] == "docstrata" and {t["name"] for t in got[1]["result"]["tools"]} == set(serve.TOOLS)
    assert "guide_md" in got[2]["result"]["content"][0]["text"] and got[3]["error"]["code"] == -32602 and got[4]["error"]["code"] == -32601
    assert got[5]["result"]["isError"] and got[6]["error"]["code"] == -32700
    n = project.store.count()
    gone = project.remove("guide_md")
    assert gone > 0 and project.store.count() == n - gone and project.manifest().count() == 4
    with pytest.raises(ConfigError):
        project.remove("guide_md")


def test_injection():
    new = f"pre{templates.BEGIN}new{templates.END}\n"
    assert templates.inject(None, new) == new
    assert templates.inject(f"a\n{templates.BEGIN}old{templates.END}\nb", new) == f"a\n{templates.BEGIN}new{templates.END}\nb"
    assert templates.inject(f"a {templates.BEGIN} b\n", new) == f"a  b\n\n{new}" and templates.inject("a\n\n", new) == f"a\n\n{new}"
    with pytest.raises(TemplateError):
        templates.render("{nobody}", {})
    with pytest.raises(TemplateError):
        templates.load("nothing")


def test_budget():
    from docstrata.operators.compile import ContextOptions, hot_values, within_lines

    options = ContextOptions({"project": "p", "mcu": "M", "naming": "snake"}, {f"pin{i}": "PA" for i in range(50)})
    values = hot_values(options, [{"title": f"t{i}", "doc_type": "x", "chip": "", "chunks": 1} for i in range(40)], [{"peripheral": f"P{i}", "svd_chunks": 2} for i in range(40)])
    full = within_lines(values, 1000)
    assert "call things: snake" in full and "| PA | pin1 |" in full
    small = within_lines(values, 40)
    assert len(small.strip().splitlines()) <= 40 and "snake" not in small and "pin1 " not in small and "| t0 |" in small


def test_config():
    c = config.Config()
    c.pins, c.project.name = {"a b": 'x"\\y\n'}, "né"
    assert config.loads(config.dumps(c)) == c
    assert config.loads("[chunk]\nmax_tokens = 9\nother = 1\n[pins]\nx = 5").pins == {"x": "5"} and config.get(config.loads(""), "chunk.max_tokens") == 512
    config.put(c, "chunk.max_tokens", "7")
    config.put(c, "output.targets", "a,b")
    assert c.chunk.max_tokens == 7 and c.output.targets == ["a", "b"]
    for bad in ("x = ", "project = 1"):
        with pytest.raises(ConfigError):
            config.loads(bad)
    with pytest.raises(ConfigError):
        config.get(c, "no.such")


def test_manifest(spark, tmp_path):
    good = {"documents": [{"id": "a", "path": "x/a.md", "hash": "h", "added": "2026"}, {"id": "b", "path": "b", "hash": "h", "added": "2026", "chip": "C", "type": "svd", "chunks": 2}]}
    (tmp_path / "m.json").write_text(json.dumps(good))
    rows = manifest.read_manifest(spark, str(tmp_path / "m.json"))
    assert [(r["id"], r["doc_type"], r["chunks"], r["chip"]) for r in rows.orderBy("id").collect()] == [("a", "unknown", 0, ""), ("b", "svd", 2, "C")]
    again = json.loads(manifest.manifest_json(rows).first()["value"])
    assert again["documents"][0] == {"id": "a", "path": "x/a.md", "type": "unknown", "hash": "h", "added": "2026", "chunks": 0} and manifest.totals(rows).first()["chunk_count"] == 2
    (tmp_path / "bad.json").write_text('{"documents": [{"id": "a"}]}')
    with pytest.raises(ManifestError):
        manifest.read_manifest(spark, str(tmp_path / "bad.json"))


def test_catalog(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"devices": [{"name": "B1", "vendor": "V", "path": "V/B1.svd"}, {"name": "A1", "vendor": "V", "path": "V/A1.svd"}, {"name": "A2", "vendor": "W", "path": "W/x/A2.svd"}]}))
    c = catalog.Catalog.read(spark, str(tmp_path / "c.json"))
    assert [r["name"] for r in c.search("1").collect()] == ["A1", "B1"] and [r["name"] for r in c.search("a", "w").collect()] == ["A2"] and c.find_exact("b1").count() == 1 and c.device_count() == 3
    tree = spark.createDataFrame([("data/V/A.svd",), ("data/x.svd",), ("src/V/B.svd",), ("data/V/W/C.svd",)], "path string")
    assert [(r["name"], r["vendor"]) for r in catalog.Catalog.index(tree).devices.collect()] == [("A", "V"), ("C", "V")]
    assert catalog.safe_path("a/b") and not catalog.safe_path("a/../b")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(CatalogError):
        catalog.Catalog.read(spark, str(tmp_path / "bad.json"))


def test_plugins(spark):
    r = default_registry()
    assert r.names("embedder") == ["function", "hashing", "http"] and r.create("embedder", "hashing", dimension=8).dimension == 8
    with pytest.raises(PluginError):
        r.create("embedder", "none")
    with pytest.raises(PluginError):
        r.register("chunker", "markdown", object)
    with pytest.raises(ParseError):
        files.parser_for("yaml")
    with pytest.raises(EmbeddingError):
        embed.HashingEmbedder(batch_size=0)
    with pytest.raises(EmbeddingError):
        embed.embed_batches(embed.FunctionEmbedder(lambda t: [[1.0]]), ["a", "b"])
    assert embed.HttpEmbedder("u", "m").vectors({"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}) == [[1.0], [2.0]]
    pins = spark.range(1).select(matching_pins({"SPI1_b": "2", "spi1_A": "1", "spi10_c": "3"}, F.lit("SPI1")).alias("p")).first()["p"]
    assert [(p["signal"], p["pin"]) for p in pins] == [("B", "2"), ("A", "1")]


def test_search_helpers():
    assert search.build_where(chip="", doc_type="") is None and search.clamp_k(0) == 1 and search.clamp_k(99) == 50


def test_nothing_is_skipped_in_silence(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "c.txt").write_text("text")
    out = {r["format"]: (r["error"] or "") for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert "pdf" in out["pdf"] and "image" in out["image"] and out["text"] == ""

    def spans(path, content):
        return [{"doc_id": path, "page": 1, "block": 0, "line": 0, "span": 0, "text": "Words", "size": 10.0, "bold": False, "x0": 0.0, "y0": 100.0, "x1": 9.0, "y1": 110.0}]

    parse = pdf.parser(spans, lambda p, c: [], lambda p, c: [{"doc_id": p, "page": 1, "height": 800.0}])
    found = {r["format"]: r for r in files.read_documents(spark, str(tmp_path), parsers={"pdf": parse}).collect()}
    assert found["pdf"]["content"] == "<!-- PAGE:1 -->\nWords" and found["pdf"]["metadata"]["page_count"] == "1" and found["pdf"]["error"] is None
    with pytest.raises(ParseError):
        pdf.layout_parser(None)
    assert pdf.layout_parser(None, otherwise=parse) is parse


def test_png():
    made = pdf.encode_png(2, 1, bytes(6))
    assert made.startswith(b"\x89PNG\r\n\x1a\n") and zlib.decompress(made[made.index(b"IDAT") + 4 : -16]) == bytes(7) and pdf.encode_png(2, 2, b"") == b""


def test_provider_of_the_configuration(spark, tmp_path):
    project = Project(spark, tmp_path)
    project.init("demo")
    assert project.embedder.batch_size == 64
    c = project.config()
    c.embedding.provider = "nothing"
    project.save(c)
    with pytest.raises(PluginError):
        Project(spark, tmp_path).embedder  # noqa: B018


def test_catalog_fetch(spark, tmp_path):
    (tmp_path / "tree/V").mkdir(parents=True)
    (tmp_path / "tree/V/X1.svd").write_text("<device/>")
    c = catalog.Catalog(spark.createDataFrame([("X1", "V", "V/X1.svd"), ("bad", "V", "../x.svd"), ("gone", "V", "V/gone.svd")], "name string, vendor string, path string"))
    base = (tmp_path / "tree").as_uri()
    assert c.fetch("x1", base, tmp_path / "out").read_text() == "<device/>"
    for name in ("bad", "gone", "none"):
        with pytest.raises(CatalogError):
            c.fetch(name, base, tmp_path / "out")


def test_benchmark_run_and_report(spark, folder, tmp_path, capsys):
    root = tmp_path / "p"
    project = Project(spark, root)
    project.init("demo", "CHIP1")
    project.add(str(folder))
    device = folder / "chip.svd"
    args = cli.parser().parse_args
    cli.bench_generate(spark, project, args(["bench", "generate", str(device), str(tmp_path / "q")]))
    run = ["bench", "run", str(tmp_path / "q"), str(tmp_path / "r"), "--chip", "CHIP1", "--runs", "2"]
    cli.bench_run(spark, project, args([*run, "--condition", "no_context", "--condition", "svd_lookup", "--condition", "hybrid", "--condition", "rag"]))
    assert capsys.readouterr().err.count("skipped") == 2
    cli.bench_run(spark, project, args([*run, "--svd", str(device)]))
    rows = spark.read.json(str(tmp_path / "r"))
    n = evaluate.read_dataset(spark, str(tmp_path / "q")).count()
    share = {r["condition"]: (r["n"], r["ok"]) for r in rows.groupBy("condition").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("ok")).collect()}
    assert set(share) == {"no_context", "hot", "full", "svd_lookup", "rag", "hybrid"} and {x for x, _ in share.values()} == {2 * n}
    assert share["svd_lookup"][1] == 1.0 and share["hybrid"][1] == 1.0 and share["no_context"][1] == 0.0
    cli.bench_report(spark, project, args(["bench", "report", str(tmp_path / "q"), str(tmp_path / "r"), "--chip", "CHIP1", "--out", str(tmp_path / "rep")]))
    assert "| svd_lookup | 100.0%" in capsys.readouterr().out and evaluate.read_report(spark, str(tmp_path / "rep")).count() == 1


def test_store_writes_only_what_changes(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(r, "chunk_id string, doc_id string, doc_type string, content string")
    assert store.count() == 0 and store.delete("a") == 0
    assert store.add(rows(("1", "a", "x y/z", "one"), ("2", "b", "", "two"), ("3", "c", "svd", "three"), ("3", "c", "svd", "three"))) == 3
    before = {p.doc_type: p.path for p in store._latest()[1]}
    reader = store.chunks()  # read after the next write
    assert store.replace(rows(("4", "a", "x y/z", "new"))) == 1
    after = {p.doc_type: p.path for p in store._latest()[1]}
    assert after["svd"] == before["svd"] and sum(before[k] != after[k] for k in before) == 1
    assert {r["content"] for r in reader.collect()} == {"one", "two", "three"}
    assert {(r["chunk_id"], r["doc_type"], r["content"]) for r in store.chunks().collect()} == {("4", "x y/z", "new"), ("2", "", "two"), ("3", "svd", "three")}
    assert store.add(rows(("4", "a", "svd", "again"), ("5", "d", "svd", "five"))) == 1 and store.delete("c") == 1
    assert {r["chunk_id"] for r in store.metadata(F.col("doc_type") == "svd").collect()} == {"5"} and store.count() == 3
    assert store.replace(rows(("9", "d", "text", "moved"))) == 1 and {r["chunk_id"]: r["doc_type"] for r in store.metadata().collect()} == {"4": "x y/z", "2": "", "9": "text"}
    assert len(list((tmp_path / "chunks/data").glob("part=*/doc_type=*"))) <= 8


def test_protocols(spark, tmp_path):
    from docstrata import protocols

    assert isinstance(ChunkStore(spark, str(tmp_path)), protocols.Store) and isinstance(StubProvider(), protocols.AnswerProvider) and isinstance(files.parse_text, protocols.Parser)


def test_benchmark_settings_are_counted(spark):
    what = spark.range(6000).select(F.col("id").cast("string").alias("name"), F.lit("").alias("system_prompt"), F.lit("").alias("description"))
    with pytest.raises(BenchmarkError):
        evaluate.prompts(spark.createDataFrame([("q",)], "id string"), what, 2)
