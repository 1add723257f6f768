"""The inverted index against scores that are taken pair by pair."""

import io
import random
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from docstrata.operators import compile as context
from docstrata.operators import postings

WORDS = [f"word{n}" for n in range(40)] + ["Clock", "clock", "the", "enable", "x1", "élan", "_under"]


def texts(n, seed=1):
    rng = random.Random(seed)
    rows = [(f"c{i:04d}", " ".join(["common", *rng.choices(WORDS, k=rng.randrange(0, 30))])) for i in range(n)]
    return rows + [("null", None), ("empty", ""), ("long", "longword " * 50_000 + "clock")]


KEYS = [("a", ["clock", "word1", "word2"]), ("b", ["common"]), ("c", []), ("d", ["absent"]), ("e", [f"word{n}" for n in range(30)])]


def ranked(rows):
    return {(r["g"], r["rank"]): (r["chunk_id"], r["score"]) for r in rows.collect()}


def test_index_ranks_as_pairs_do(spark, tmp_path):
    chunks = spark.createDataFrame(texts(300), "chunk_id string, content string").repartition(4)
    keyed = spark.createDataFrame(KEYS, "g string, keys array<string>")
    rng = random.Random(2)
    pairs = spark.createDataFrame([(g, i) for g, _ in KEYS for i, _ in texts(300) if rng.random() < 0.4], "g string, chunk_id string").join(chunks, "chunk_id")
    for least in (0.1, 0.0, 0.5):
        plain = context.rank_chunks(pairs.join(keyed, "g"), F.col("keys"), ["g"], 7, least)
        for split in (None, spark.createDataFrame([("common", 5), ("clock", 2)], "term string, tasks int")):
            assert ranked(postings.rank_pairs(pairs, postings.postings(chunks), keyed, ["g"], 7, least, split)) == ranked(plain)
    every = chunks.crossJoin(keyed.where(F.size("keys") > 0))
    index = postings.PostingIndex(spark, str(tmp_path / "p")).build(chunks.where("chunk_id < 'c0100'")).extend(chunks.where("chunk_id >= 'c0100'"))
    assert ranked(index.rank(keyed, ["g"], 9, 0.1)) == ranked(context.rank_chunks(every, F.col("keys"), ["g"], 9, 0.1))
    assert {r["chunk_id"] for r in index.holding(["CLOCK"]).collect()} == {i for i, t in texts(300) if re.search(r"(?i)\bclock\b", t or "")}


def test_frequent_words_are_split(spark):
    chunks = spark.createDataFrame([(f"c{i}", "common") for i in range(400)] + [("d", "rare")], "chunk_id string, content string")
    rows = postings.postings(chunks)
    split = postings.heavy(postings.frequencies(rows), task=50, share=4)
    assert [(r["term"], r["tasks"]) for r in split.collect()] == [("common", 8)]
    assert postings.heavy(postings.frequencies(rows), task=1000).count() == 0
    keyed = spark.createDataFrame([("g", ["common", "rare"])], "g string, keys array<string>")
    found = postings.hits(rows, keyed, ["g"], split)
    assert found.count() == 401 and found.where("hits <> 1").count() == 0
    assert postings.hits(rows.limit(0), keyed, ["g"]).count() == 0


def test_chunks_are_tokenised_once_for_all_peripherals(spark):
    chunks = "chunk_id string, chunk_index int, content string, doc_id string, doc_type string, chip string, section_path string, page int, peripheral string, content_type string"
    rows = [(f"s{n}", n, f"| CR{n} |", "s", "svd", "", f"Map > P{n}", 0, "", "prose") for n in range(3)] + [(f"t{n}", n, f"P{n % 3} clock", "t", "text", "", f"Guide > P{n % 3} > Setup", 0, "", "prose") for n in range(9)]
    pages = context.compile_peripherals(spark.createDataFrame(rows, chunks), spark.createDataFrame([("t", "t.txt")], "id string, path string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = io.StringIO()
        with redirect_stdout(out):
            pages.explain()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    split = [line for line in out.getvalue().splitlines() if "Generate explode" in line and "array_except" in line or "regexp_extract_all(content" in line and "Generate" in line]
    assert len(split) == 1 and "ReusedExchange" in out.getvalue(), out.getvalue()
