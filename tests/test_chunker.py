import random

import pytest

from docstrata.operators.chunker import BytePairTokenizer, Chunker, ChunkOptions, PieceTokenizer, blocks, chunk_documents, register_chunker, walk_headings

WORD = " ".join(f"w{i:03d}" for i in range(100))


def test_tokenizer_makes_the_text_up_again():
    for t in ("", " a", "abc defghi  \n", WORD, "é ü\n\n"):
        assert "".join(PieceTokenizer().pieces(t)) == t


def test_blocks():
    assert blocks("a\n```\n# x\n```\nb") == [("a", False), ("```\n# x\n```", True), ("b", False)]
    assert blocks("````\n```\n````") == [("````\n```\n````", True)]
    assert blocks("```\nopen") == [("```\nopen", True)]
    assert blocks("| a |\n|---|\n| b |\nc") == [("| a |\n|---|\n| b |", True), ("c", False)]
    assert blocks("x\n| a |\ny") == [("x", False), ("| a |\ny", False)]


def test_split_by_headings_then_smaller():
    c = Chunker(ChunkOptions(60, 0, 0))
    text = f"# A\n{WORD[:200]}\n# B\n{WORD[:150]}"
    parts = c.split(text, 60)
    assert len(parts) >= 2 and all(c.count(p) <= 60 for p in parts) and parts[-1].lstrip().startswith("# B")
    assert "".join(c.split("x" * 1000, 10)) == "x" * 1000


def test_overlap_is_of_the_chunk_as_cut():
    c = Chunker(ChunkOptions(100, 2, 0))
    out = c.overlapped([("aaaa bbbb cccc", False), ("dddd eeee ffff", False), ("| t |", True), ("gggg", False)])
    assert out == ["aaaa bbbb cccc", " bbbb ccccdddd eeee ffff", "| t |", " t |gggg"]


def test_merge_small():
    c = Chunker(ChunkOptions(10, 0, 3))
    assert c.merge_small(["a", "b", "cccc dddd eeee ffff", "g"]) == ["a\n\nb\n\ncccc dddd eeee ffff\n\ng"]
    assert Chunker(ChunkOptions(4, 0, 3)).merge_small(["a b c d", "e"]) == ["a b c d", "e"]


def test_headings():
    assert walk_headings([], "# A\n## B\n### C") == [(1, "A"), (2, "B"), (3, "C")]
    assert walk_headings([(1, "A"), (2, "B")], "## D") == [(1, "A"), (2, "D")]


def test_pages_and_indexes():
    out = Chunker(ChunkOptions(60, 0, 0)).chunk("<!-- PAGE:3 -->\n# T\n" + WORD[:100] + "\n\n<!-- PAGE:4 -->\n" + WORD[:120])
    assert [p for _, _, _, p, _ in out][0] == 3 and all("PAGE" not in c for _, c, _, _, _ in out) and {s for *_, s in out} == {"T"}


def test_limits_hold_for_plain_text():
    c = Chunker(ChunkOptions(64, 8, 0))
    out = c.chunk("# T\n\n" + "\n\n".join(WORD[:n] for n in (50, 300, 20, 400)))
    assert all(n <= 64 for _, _, n, _, _ in out)


def test_frame(spark):
    rows = [("d1", f"# Top\n## SPI1\n{WORD}", "svd", "C"), ("d2", "", "text", ""), ("d3", None, None, None)]
    out = chunk_documents(spark.createDataFrame(rows, "doc_id string, content string, doc_type string, chip string"), ChunkOptions(40, 5, 5)).collect()
    assert {r["doc_id"] for r in out} == {"d1"} and {r["peripheral"] for r in out} == {"SPI1"} and len({r["chunk_id"] for r in out}) == len(out) and all(r["error"] is None for r in out)


def test_error_row(spark):
    class Broken:
        def pieces(self, text):
            raise RuntimeError("no")

    out = chunk_documents(spark.createDataFrame([("d", "text", "t", "")], "doc_id string, content string, doc_type string, chip string"), tokenizer=Broken()).collect()
    assert out[0]["chunk_id"] is None and "no" in out[0]["error"]


def test_vocabulary_tokenizer_and_table_function(spark):
    P = pytest.importorskip("public_tokenizers")
    pytest.importorskip("tiktoken")
    t = BytePairTokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "The register CR1 is at 0x40013000.\n\nÜber 中文 \U0001f600 x" * 20
    assert "".join(t.pieces(text)) == text and t.count(text) >= len(t.pieces(text)) > 100
    chunks = Chunker(ChunkOptions(64, 8, 8), t).chunk(text)
    assert len(chunks) > 3 and all(t.count(c[1]) == c[2] <= 80 for c in chunks)
    rows = spark.createDataFrame([("d", text, "text", "")], "doc_id string, content string, doc_type string, chip string")
    assert [r["content"] for r in chunk_documents(rows, ChunkOptions(64, 8, 8), t).orderBy("chunk_index").collect()] == [c[1] for c in chunks]
    register_chunker(spark)
    spark.createDataFrame([(1, "# A\n\n" + "word " * 40)], "id int, body string").createOrReplaceTempView("bodies")
    got = spark.sql("SELECT id, c.chunk_index, c.content FROM bodies, LATERAL chunks_of(body, 16, 0, 0) c ORDER BY 2").collect()
    assert [(r["chunk_index"], r["content"]) for r in got] == [(n, c) for n, c, *_ in Chunker(ChunkOptions(16, 0, 0)).chunk("# A\n\n" + "word " * 40)]


def test_counts_of_joined_parts_are_those_of_the_text():
    class Plain:  # without what lets parts be counted once
        pieces = PieceTokenizer().pieces

    rng = random.Random(3)
    marks = ["\n", "\n\n", " ", "  ", "\t\n", "\n# "]
    for _ in range(200):
        text = "".join(rng.choice([" ".join("w" * rng.randrange(1, 12) for _ in range(rng.randrange(1, 60))), "x" * rng.randrange(1, 90), "```\na  b\n```", "| a |\n|---|"]) + rng.choice(marks) for _ in range(rng.randrange(1, 20)))
        o = ChunkOptions(rng.randrange(3, 60), rng.randrange(0, 10), rng.randrange(0, 30))
        assert Chunker(o).chunk(text) == Chunker(o, Plain()).chunk(text)
