"""SQL functions against the column functions that say the same."""

import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from docstrata.functions import registers, relevance, sql
from docstrata.operators import evaluate, search


def test_scalar_functions_match_columns(spark):
    sql.register(spark)
    rng = random.Random(6)
    rows = [(rng.randrange(1 << 40), rng.randrange(1, 9), rng.randrange(0, 31), rng.randrange(0, 40), [rng.gauss(0, 1) for _ in range(5)], [rng.gauss(0, 1) for _ in range(5)], rng.choice(["A > B > C", "A", "", " A  >  b "])) for _ in range(200)]
    df = spark.createDataFrame(rows, "v long, w int, at int, n long, a array<double>, b array<double>, path string").withColumn("k", F.col("n") - F.least("n", F.col("at").cast("long")))
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    pairs = {
        "register_hex(v, w)": registers.hex_format(F.col("v"), F.col("w")),
        "bit_text(at, w)": registers.bit_range(F.col("at"), F.col("w")),
        "squared_distance(a, b)": search.squared_distance(F.col("a"), F.col("b")),
        "score_of_distance(w)": search.score_of(F.col("w")),
        "section_name(path, 2)": relevance.peripheral_of(F.col("path")),
        "wilson_low(k, n)": low,
        "wilson_high(k, n)": high,
    }
    for text, column in pairs.items():
        for r in df.select(F.expr(text).alias("x"), column.alias("y")).collect():
            assert r["x"] == r["y"] if isinstance(r["y"], str) else abs(r["x"] - r["y"]) < 1e-12, text


def test_table_functions_are_inlined(spark):
    rows = [(f"c{i}", f"d{i % 3}", f"t{i}", [float(i), 1.0], f"Map > P{i % 2}", "C1", "svd") for i in range(9)] + [("n", "d0", "none", None, "x", "C2", "text")]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, content string, embedding array<float>, section_path string, chip string, doc_type string").createOrReplaceTempView("sql_chunks")
    assert set(sql.register(spark, "sql_chunks")) >= {"nearest_chunks", "chunks_of_document", "peripherals_of_chip"}
    near = spark.sql("SELECT * FROM nearest_chunks(array(3.2D, 1.0D), 3) WHERE doc_id <> 'd1'")
    assert [(r["place"], r["chunk_id"]) for r in near.orderBy("place").collect()] == [(1, "c3"), (3, "c2")]
    assert {r["chunk_id"] for r in spark.sql("SELECT * FROM chunks_of_document('d0')").collect()} == {"c0", "c3", "c6", "n"}
    assert {(r["peripheral"], r["chunks"]) for r in spark.sql("SELECT * FROM peripherals_of_chip('C1')").collect()} == {("P0", 5), ("P1", 4)}
    out = io.StringIO()
    with redirect_stdout(out):
        spark.sql("SELECT content FROM chunks_of_document('d0') WHERE chunk_id > 'c'").explain()
    assert "Python" not in out.getvalue()
