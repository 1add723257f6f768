"""Queries against their SQL on keys and values that the small tables do not have."""

import random
import tracemalloc
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from docstrata.functions import registers, scoring
from docstrata.functions.text import strip
from docstrata.operators import evaluate, postings, store
from docstrata.operators.chunker import Chunker, ChunkOptions, PieceTokenizer
from docstrata.plans import library, queries  # noqa: F401
from docstrata.plans.registry import QUERIES, SQL
from docstrata.sources import files, pdf, svd


def same_as_sql(spark, name: str, folder: Path, **tables) -> None:
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(str(folder / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    made = QUERIES[name](spark, str(folder))
    want = con.sql(SQL[name])
    order = [want.columns.index(c) for c in made.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)


def lines(spark, keys):
    return spark.createDataFrame([(3 * n + 1, n % 7 + 1, p, s) for n, (p, s) in enumerate(keys)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")


def test_offsets_of_large_keys(spark, tmp_path):
    same_as_sql(spark, "register_offsets", tmp_path, lineitem=lines(spark, [(9, 1), (65_535, 1), (65_536, 1), (7_654_321, 1)]))
    assert spark.range(1).select(registers.hex_format(F.lit(7_654_321), 4)).first()[0] == "0x74CBB1"


def test_wrong_numbers_of_large_keys_are_wrong(spark, tmp_path):
    same_as_sql(spark, "score_exact", tmp_path, lineitem=lines(spark, [(3, 3), (4, 12), (2_000_000, 5), (2_000_001, 9), (90_000_001, 90_000_001)]))


def test_scores_of_any_keys(spark, tmp_path):
    keys = [None, 0, 1, 3, 8, -1, -2, -3, -9, 1_000_000, 1_199_999, 2**31, 2**32 + 1, 2**53 + 1, 10**16 + 1, 5 * 10**18 + 3, 2**63 - 1, -(2**63)]
    same_as_sql(spark, "score_exact", tmp_path, lineitem=lines(spark, [(p, s) for p in keys for s in keys]))


def test_wrong_numbers_stay_near_the_tolerance(spark, tmp_path, monkeypatch):
    keys = [19_999, 499_999, 500_000, 1_000_000, 1_199_999, 90_000_001, 10**16 + 1, 2**63 - 1, -1_000_000]
    for tolerance, rows in ((1e-4, keys), (5e-6, keys[1:]), (3.1e-6, keys[3:])):
        lines(spark, [(p, 1) for p in rows]).write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
        for used, score in ((scoring.TOLERANCE, 0.0), (tolerance, 1.0)):
            with monkeypatch.context() as m:
                m.setattr(scoring, "TOLERANCE", used)
                assert [r["numeric"] for r in QUERIES["score_exact"](spark, str(tmp_path)).collect()] == [score] * len(rows)


def test_means_do_not_depend_on_the_order_of_rows(spark):
    values = [n % 101 / 100 for n in range(7, 700, 22)]  # 32 of them: a tie in the seventh place
    rows = spark.createDataFrame([(v, n) for n, v in enumerate(values)], "v double, n int")
    found = {rows.repartition(k).orderBy(order).agg(evaluate.mean(F.col("v"))).first()[0] for k in (1, 5) for order in ("n", F.desc("n"), "v")}
    assert found == {sum(round(100 * v) for v in values) / 3200}
    odd = spark.createDataFrame([(1e300,), (3e300,), (None,)], "v double").agg(evaluate.mean(F.col("v"))).first()[0]
    assert odd == 2e300 and spark.range(0).agg(evaluate.mean(F.lit(1.0))).first()[0] is None


def test_a_writer_that_is_done_takes_no_other_writers_files(spark, tmp_path):
    """Each writer's temporary files are in its own part, and a version is made once."""
    root = tmp_path / "chunks"
    made = []

    class Watched(store.ChunkStore):
        def _create(self, n, parts):
            made.append({p.name for p in (root / "data").iterdir()})
            return super()._create(n, parts)

    s = Watched(spark, str(tmp_path))
    rows = spark.createDataFrame([(str(n), "d", f"t{n % 3}", "x", None) for n in range(30)], "chunk_id string, doc_id string, doc_type string, content string, embedding array<float>")
    (root / "data" / "_temporary" / "0").mkdir(parents=True)
    (root / "data" / "_temporary" / "0" / "of another writer").touch()
    assert s.add(rows) == 30 and (root / "data" / "_temporary" / "0" / "of another writer").exists() and len(made) == 1
    assert not s._create(1, []) and s.count() == 30 and sorted(p.name for p in (root / "versions").iterdir()) == ["000000000001.json"]


def parts(spark, keys):
    return spark.createDataFrame([(k, f"name {k}", f"Brand#{k % 2}", f"type {k % 3}", k % 50 + 1) for k in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")


def test_names_are_not_looked_for_in_whole_blocks_again(spark, tmp_path):
    part = parts(spark, range(40))
    same_as_sql(spark, "svd_field_rows", tmp_path, part=part)
    plan = QUERIES["svd_field_rows"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract(b#") > plan.index("Generate explode(split(b#")


def test_brands_over_the_size_limit_of_a_file_lose_no_cluster(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(files.LIMITS, "svd", 4_000)
    same_as_sql(spark, "svd_clusters", tmp_path, part=parts(spark, range(1, 2_000_000, 99_999)))


def test_register_files_are_not_held_as_objects():
    kinds = lambda names, **inner: pa.struct([pa.field(n, inner.get(n, pa.int32() if n == "pos" else pa.string())) for n in names.split()])
    listed = lambda kind: pa.list_(pa.field("element", kind))
    registers = listed(kinds("pos name description offset size access reset fields", fields=listed(kinds("pos name description offset width access"))))
    schema = pa.schema(list(kinds("path name description cpu revision error peripherals", peripherals=listed(kinds("pos name description base derived registers", registers=registers)))))
    one = "<register><name>R%d</name><addressOffset>4</addressOffset><fields><field><name>F</name><bitOffset>1</bitOffset><bitWidth>4</bitWidth></field></fields></register>"
    peaks = []
    for n in (10_000, 40_000):
        xml = f"<device><name>D</name><peripherals><peripheral><name>P</name><registers>{''.join(one % i for i in range(n))}</registers><access>read-only</access></peripheral></peripherals><size>32</size></device>"
        content = pa.py_buffer(xml.encode())
        tracemalloc.start()
        made = svd.read_device("p", content, schema)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        held = made.column("peripherals").to_pylist()[0][0]["registers"]
        # what comes after the registers holds for them too
        assert [r["pos"] for r in held] == list(range(n)) and {(r["size"], r["access"], r["fields"][0]["access"]) for r in held} == {("32", "read-only", "read-only")}
    assert peaks[1] < 1.3 * peaks[0]


def test_documents_of_small_rows_are_dealt_out(spark, tmp_path):
    part = parts(spark, range(60))
    for name in ("chunk_merge_small", "chunk_recursive_split"):
        same_as_sql(spark, name, tmp_path, part=part)
        assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_last_pieces_without_all_others():
    rng, tokenizer = random.Random(8), PieceTokenizer()
    for _ in range(2_000):
        text, n = "".join(rng.choice("ab cde\n\t f ghijk") for _ in range(rng.randrange(1, 60))), rng.randrange(1, 12)
        assert tokenizer.last(text, n) == "".join(tokenizer.pieces(text)[-n:])

    class Counted(PieceTokenizer):
        cut = 0

        def pieces(self, text):
            self.cut += len(text)
            return super().pieces(text)

    plain = type("Plain", (Counted,), {"last": None})()
    text = " ".join(rng.choice(["word", "longerword", "# Head\n", "x\n\n"]) for _ in range(3_000))
    fast = Counted()
    assert Chunker(ChunkOptions(64, 8, 8), fast).chunk(text) == Chunker(ChunkOptions(64, 8, 8), plain).chunk(text)
    assert fast.cut == 0 < plain.cut


def test_lists_are_taken_apart_once(spark, tmp_path):
    lineitem = lines(spark, [(p, s) for p in range(12) for s in range(12)])
    for name in ("partial_list", "score_lists"):
        same_as_sql(spark, name, tmp_path, lineitem=lineitem)
        assert QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    said = ["a, b,c", "- a\n- b\n", " 1. a\n2. b", "\n\n* a,\n,b", "", " ", ",", "•a\n\t- b, 3. c", "1.5 V, 2"]
    for r in spark.createDataFrame([(s,) for s in said], "s string").select("s", scoring._items(F.col("s")).alias("x"), F.filter(F.transform(F.split("s", scoring.ITEM), strip), lambda x: x != "").alias("y")).collect():
        assert r["x"] == r["y"], r["s"]


def test_a_write_shuffles_and_writes_rows_once(spark, tmp_path, monkeypatch):
    staged = []
    stage = store.ChunkStore._stage
    monkeypatch.setattr(store.ChunkStore, "_stage", lambda self, rows: staged.append(rows._jdf.queryExecution().optimizedPlan().toString()) or stage(self, rows))
    s = store.ChunkStore(spark, str(tmp_path))
    schema = "chunk_id string, doc_id string, doc_type string, content string, embedding array<float>"
    assert s.add(spark.createDataFrame([(str(n), "d", "t", f"x{n}", [float(n), 1.0]) for n in range(20)], schema)) == 20
    assert len(staged) == 1 and "Aggregate" not in staged[0]
    # an id that is there twice, and one that is missing twice
    twice = [(str(n % 25), "e", "t", "y", None) for n in range(15, 45)] + [(None, "e", "t", "y", None)] * 2
    assert s.add(spark.createDataFrame(twice, schema)) == 6 and s.count() == 26 == s.chunks().count()
    assert s.delete("e") == 6 and s.count() == 20 and not list((tmp_path / "chunks/staging").iterdir())


def test_tables_are_rendered_once_in_tasks_of_their_own(spark, tmp_path):
    same_as_sql(spark, "page_tables", tmp_path, part=parts(spark, range(60)))
    plan = QUERIES["page_tables"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(replace(") == 1 and "RepartitionByExpression" in plan[plan.index("replace(replace(") :]
    cells = F.col("c").cast("array<array<string>>")
    rows = spark.createDataFrame([(n, c) for n, c in enumerate([[["A"]], [["A|", "B"], ["1"], None, ["2", None, "x"]], [], None, [None, ["x"]], [[], ["x"]]])], "n int, c array<array<string>>")
    shown = [r[0] for r in rows.orderBy("n").select(pdf.render_table(cells)).collect()]
    assert shown == ["| A |\n| --- |", "| A\\| | B |\n| --- | --- |\n| 1 |  |\n| 2 |  |", "", "", "", "|  |\n|  |\n|  |"]


def test_words_are_made_once_and_counted_at_their_chunks(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(30)]
    chunks = spark.createDataFrame([(f"c{n:03d}", " ".join(rng.choices(words, k=rng.randrange(40)))) for n in range(200)] + [("none", None)], "chunk_id string, content string").repartition(3)
    assert postings.postings(chunks)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    index = postings.PostingIndex(spark, str(tmp_path)).build(chunks)
    keyed = spark.createDataFrame([(f"g{n % 3}", n, rng.sample(words, rng.randrange(0, 9))) for n in range(40)], "a string, b int, keys array<string>")
    want = sorted(map(tuple, postings.rank_all(index.rows(), keyed, ["a", "b"], 4, 0.3).collect()))
    for few, block in ((100_000, 256), (0, 7)):
        monkeypatch.setattr(postings, "FEW", few)
        monkeypatch.setattr(postings, "BLOCK", block)
        assert sorted(map(tuple, index.rank(keyed, ["a", "b"], 4, 0.3).collect())) == want
    rows = [(f"c{n // 3}", rng.sample(range(0, 90, 3), rng.randrange(1, 6))) for n in range(30, 300)]
    batches = [pa.RecordBatch.from_pydict({"chunk_id": [c for c, _ in part], "sets": [s for _, s in part]}) for part in (rows[k : k + 11] for k in range(0, 270, 11))]
    hits = Counter((s, c) for c, sets in rows for s in sets)
    for meetings in (1, 50, 10**6):
        found = [r for b in postings.top_counts(1000, meetings)(iter(batches)) for r in zip(*b.to_pydict().values())]
        assert sorted(found) == sorted((s, c, n) for (s, c), n in hits.items())
    best = [r for b in postings.top_counts(2)(iter(batches)) for r in zip(*b.to_pydict().values())]
    assert sorted(best) == sorted((s, c, n) for s in {s for s, _ in hits} for n, c in [(-m, c) for m, c in sorted((-n, c) for (t, c), n in hits.items() if t == s)[:2]])
    assert list(postings.top_counts(2)(iter([]))) == []
