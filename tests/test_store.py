"""Commits of several writers, skipping of parts, and search by cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.errors import StoreConflict
from docstrata.operators import cells, search, store
from docstrata.operators.store import ChunkStore

ROW = "chunk_id string, doc_id string, doc_type string, content string, embedding array<float>"


def rows(spark, ids, doc="d", kind="text"):
    return spark.createDataFrame([(i, doc, kind, f"text {i}", None) for i in ids], ROW)


class Interrupted(ChunkStore):
    """Another writer commits just before this one does, ``times`` times."""

    def __init__(self, *a, other, times=1):
        super().__init__(*a)
        self.other, self.times = other, times

    def _create(self, n, parts):
        if self.times:
            self.times -= 1
            self.other()
        return super()._create(n, parts)


def ids(s):
    return sorted(r["chunk_id"] for r in s.metadata().collect())


def test_interleaved_writers_keep_both(spark, tmp_path):
    b = ChunkStore(spark, str(tmp_path))
    b.add(rows(spark, ["0"]))
    a = Interrupted(spark, str(tmp_path), other=lambda: b.add(rows(spark, ["b1", "b2"])))
    assert a.add(rows(spark, ["a1"])) == 1
    assert ids(b) == ["0", "a1", "b1", "b2"] and b.count() == 4
    # the same id from both: one of them adds it
    a = Interrupted(spark, str(tmp_path), other=lambda: b.add(rows(spark, ["c", "d"])))
    assert a.add(rows(spark, ["c", "e"])) == 1 and ids(b) == ["0", "a1", "b1", "b2", "c", "d", "e"]
    # a part that one rewrites and the other takes out
    b.add(rows(spark, ["x"], "gone"))
    a = Interrupted(spark, str(tmp_path), other=lambda: b.replace(rows(spark, ["y"], "gone")))
    assert a.delete("gone") == 1 and "x" not in ids(b) and "y" not in ids(b)


def test_a_writer_that_always_loses_raises_and_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ATTEMPTS", 2)
    b = ChunkStore(spark, str(tmp_path))
    b.add(rows(spark, ["0"]))
    n = iter(range(100))
    a = Interrupted(spark, str(tmp_path), other=lambda: b.add(rows(spark, ["same", f"b{next(n)}"])), times=99)
    monkeypatch.setattr(a, "_possible", lambda parts, kind, values: parts)  # each loss is a clash
    with pytest.raises(StoreConflict):
        a.add(rows(spark, ["same", "z"]))
    assert "z" not in ids(b) and ids(b).count("same") == 1
    named = {p.path for v in b._numbers() for p in b._version(v) or []}
    assert {f"data/{p.parent.name}/{p.name}" for p in (tmp_path / "chunks/data").glob("part=*/doc_type=*")} <= named
    assert not list((tmp_path / "chunks/staging").iterdir())


def test_new_ids_open_no_part(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path))
    for n in range(3):
        assert s.add(rows(spark, [f"{i:05d}-{n}" for i in range(500)], f"doc{n}")) == 500
        assert s.opened == []
    assert s.add(rows(spark, ["00007-1", "new"])) == 1
    assert [p.split("/")[1] for p in s.opened] == [f"part={p.tag}" for p in s._latest()[1] if p.doc_least == "doc1"]
    assert s.delete("doc2") == 500 and len(s.opened) == 1 and s.count() == 1001
    assert s.delete("nothing") == 0 and s.opened == []


def test_parts_of_a_type_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MERGE", 3)
    s = ChunkStore(spark, str(tmp_path))
    for n in range(7):
        s.add(rows(spark, [f"{n}a", f"{n}b"]))
    s.add(rows(spark, ["o"], kind="other"))
    assert len([p for p in s._latest()[1] if p.doc_type == "text"]) <= 3
    assert ids(s) == sorted([*(f"{n}{x}" for n in range(7) for x in "ab"), "o"])


def vectors(spark, n=1500, clusters=12, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(clusters, dim)) * 30
    x = (at[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim))).astype(np.float32)
    x[40:60] = x[7]  # equal rows
    out = [(f"{i:05d}", f"d{i % 9}", "ab"[i % 2], "t", v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [1.0] * (dim - 1), [math.nan] * dim, [None] * dim, [math.inf] * dim]
    return spark.createDataFrame(out + [(f"odd{n}", "d", "a", "t", v) for n, v in enumerate(odd)], ROW), x


def test_search_opens_few_cells_and_finds_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 60)
    df, x = vectors(spark)
    good = df.where("chunk_id < 'odd'")
    s = ChunkStore(spark, str(tmp_path))
    s.add(df.where("chunk_id < '00900'"))
    s.add(df)
    every = len(s._cells(s._latest()[1], 6).where)
    assert every > 20 and s.count() == df.count()
    for n, where in ((7, None), (300, None), (1200, F.col("doc_id") == "d3"), (3, F.col("doc_type") == "b"), (5, F.lit(False))):
        q = [float(v) + 0.01 for v in x[n]]
        keep = lambda d: [(r["rank"], r["chunk_id"], round(r["distance"], 6)) for r in d.orderBy("rank").collect()]
        found = keep(s.search(q, 5, where))
        assert found == keep(search.nearest(good, q, 5, where))
        assert len(s.opened) < every / 2 or not found
    asked = spark.createDataFrame([(n, [float(v) for v in x[n]]) for n in range(0, 1500, 70)] + [(9000, [0.0] * 6), (9001, None), (9002, [1.0])], "query_id long, query array<double>")
    for where in (None, F.col("doc_id") == "d3"):
        near = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["distance"], 6)) for r in s.search_each(asked, 25, where).collect()}
        plain = search.nearest_for_each(good if where is None else good.where(where), asked.where("size(query) = 6"), 25, "chunk_id", "embedding")
        assert near == {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["distance"], 6)) for r in plain.collect()}
    monkeypatch.setattr(cells, "ROWS", 16)
    monkeypatch.setattr(cells, "QUERIES", 2)
    assert {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["distance"], 6)) for r in s.search_each(asked, 25, where).collect()} == near


def test_search_of_nothing(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query array<double>")
    assert s.search([1.0, 2.0], 3).count() == 0 and s.search_each(asked, 3).count() == 0
    s.add(rows(spark, ["a"]))  # no vector
    assert s.search([1.0, 2.0], 3).count() == 0 and s.search_each(asked, 3).count() == 0


def test_filters_are_sharp(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path))
    rng = random.Random(1)
    s.add(rows(spark, [f"{rng.random()}" for _ in range(5000)]))
    parts = s._latest()[1]
    held = s.read().select(F.col("chunk_id").alias("value"))
    wrong = sum(bool(s._possible(parts, "chunk", spark.createDataFrame([(f"{rng.random()}",)], "value string"))) for _ in range(8))
    assert s._possible(parts, "chunk", held) == parts and wrong <= 1


def test_budget_of_large_groups_against_a_plain_version(spark):
    import random

    from docstrata.operators.search import within_budget

    r = random.Random(7)
    rows = [(n, r.choice(["hot", "hot", "hot", "b", None]), r.randrange(10_000), None if r.random() < 0.05 else "x" * r.choice([0, 0, 1, 7, 30])) for n in range(4000)]
    table = spark.createDataFrame(rows, "id long, g string, o long, content string")
    for most, buckets in ((0, 5), (200, 3), (5000, 8), (10**9, 64)):
        want = []
        for g in ("hot", "b", None):
            used = None
            for n, _, _, said in sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0])):
                used = used if said is None else (used or 0) + len(said)
                if used is not None and used <= most:
                    want.append(n)
        for key in (None, ["id"]):
            got = within_budget(table, ["g"], ["o", "id"], most=most, buckets=buckets, key=key)
            assert sorted(x["id"] for x in got.collect()) == sorted(want) and got.columns == (table.columns if key is None else ["id", "g", "o", "content"])
