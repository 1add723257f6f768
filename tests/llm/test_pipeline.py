"""The pipeline on a small corpus with planted cases, and the SQL of the queries that have some."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from docstrata.llm import queries
from docstrata.llm.common import materialise

from .test_operators import prose

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    rng = random.Random(1)
    clean = [(i, prose(rng, rng.randrange(40, 160))) for i in range(120)]
    passage = prose(rng, 30)
    copied = [(1000 + i, clean[i][1]) for i in range(20)]
    near = [(2000 + i, clean[30 + i][1].replace(clean[30 + i][1].split()[20], "changed", 1)) for i in range(20)]
    leaked = [(3000 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(10)]
    odd = [(4000, None), (4001, ""), (4002, "12 34")]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in clean + copied + near + leaked + odd]
    spark.createDataFrame(rows, DOC).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, corpus), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    language, near, clean, mixed = seen
    assert not language & {4000, 4001, 4002} and len(language) == 170
    assert near == set(range(120)) | set(range(3000, 3010))
    assert clean == set(range(120)) and mixed <= clean and mixed
    last = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in last] == sorted(mixed) and last[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(last, last[1:]))
    whole = corpus_pipeline.run(spark, corpus).orderBy("doc_id").collect()
    assert whole == last


def test_mixture_keeps_unlabelled_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id < 120")
    for column, value in (("lang", None), ("source", None), ("lang", "pl"), ("source", "src99")):
        odd = docs.withColumn(column, F.when(F.col("doc_id") < 60, F.lit(value).cast("string")).otherwise(F.col(column)))
        kept = {r["doc_id"] for r in corpus_pipeline.mixture(spark, odd, corpus).collect()}
        assert any(i < 60 for i in kept) and any(i >= 60 for i in kept)


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{corpus}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(queries.oracle_sql()[name]).df(), entry.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(repr, got[columns].astype(object).where(got[columns].notna(), None).values.tolist())) == sorted(map(repr, want[columns].astype(object).where(want[columns].notna(), None).values.tolist()))
