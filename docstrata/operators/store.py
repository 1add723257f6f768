"""The chunk store (ST1-ST9): Parquet parts by document type and cell, filters of ids, versions that name their parts.

A write adds parts; no part is ever changed. Beside its rows each part has the
cells of its vectors, with middle and radius, and Bloom filters of its chunk and
document ids, so that searches and writes open only what may matter to them.

A version is a file that is made only if it is not there yet. A writer who finds
it there has lost a race: if the parts that it takes out are still there, and no part that
came in between may hold an id that it is about, it makes the next version of
both, and else does its work again from the new state. So no write is lost. (Making a file only if
it is absent is atomic where the file system makes it so, as on HDFS; in local folders a version is
written whole under another name and linked.)
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from urllib.parse import unquote

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import StoreConflict, StoreError
from ..schemas import EMBEDDED_CHUNK
from . import cells, search

METADATA = ("doc_id", "doc_type", "chip", "section_path", "page", "chunk_level", "peripheral", "content_type", "token_count")
KEPT = 2  # versions whose files stay
LISTED = 20  # versions whose names stay
MERGE = 16  # parts of one document type; one more, and they become one
ATTEMPTS = 10
IDS = {"chunk": "chunk_id", "doc": "doc_id"}
NAMES = EMBEDDED_CHUNK.fieldNames()


@dataclass(frozen=True)
class Part:
    """The rows of one document type of one write; ``blocks`` is the size of its filters."""

    path: str
    doc_type: str
    rows: int
    blocks: int
    chunk_least: str
    chunk_most: str
    doc_least: str
    doc_most: str

    @property
    def tag(self) -> str:
        return self.path.split("/")[1].removeprefix("part=")


Version = tuple[int, list[Part]]


class ChunkStore:
    """A folder of parts and of versions; ``opened`` tells which parts' rows the last call looked into."""

    def __init__(self, spark: SparkSession, path: str, name: str = "chunks"):
        self.spark, self.root = spark, f"{path.rstrip('/')}/{name}"
        self.opened: list[str] = []

    # Versions

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        fs, p = self._fs(f"{self.root}/{path}")
        fs.delete(p, True)

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/versions")
        return sorted((int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")), reverse=True) if fs.exists(p) else []

    def _version(self, n: int) -> list[Part] | None:
        """None for a version that is being written or is gone."""
        fs, p = self._fs(f"{self.root}/versions/{n:012d}.json")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return [Part(**x) for x in json.loads(text)]
        except ValueError:
            return None

    def _latest(self) -> Version:
        for n in self._numbers():
            parts = self._version(n)
            if parts is not None:
                return n, parts
        return 0, []

    def _create(self, n: int, parts: list[Part]) -> bool:
        """False if another writer was there first."""
        fs, p = self._fs(f"{self.root}/versions/{n:012d}.json")
        text = json.dumps([asdict(x) for x in parts]).encode()
        fs.mkdirs(p.getParent())
        folder = fs.resolvePath(p.getParent()).toUri()
        if folder.getScheme() == "file":
            return _link(f"{folder.getPath()}/{p.getName()}", text)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                return False
            raise StoreError(f"{self.root}: {e}") from e
        out.write(bytearray(text))
        out.close()
        return True

    def _clean(self) -> None:
        """Parts that only versions before the last ``KEPT`` name go, and old versions' names."""
        numbers = self._numbers()
        kept = {p.path for n in numbers[:KEPT] for p in self._version(n) or []}
        for n in numbers[KEPT : KEPT + 2]:
            for p in self._version(n) or []:
                if p.path not in kept:
                    self._delete(p.path)
        for n in numbers[LISTED:]:
            self._delete(f"versions/{n:012d}.json")

    def _commit(self, base: Version, gone: list[Part], made: list[Part], clash: Callable[[list[Part]], bool]) -> bool:
        """Whether the change could be made on top of what others did since ``base``."""
        n, parts = base
        out, known = {p.path for p in gone}, {p.path for p in parts}
        while not self._create(n + 1, [p for p in parts if p.path not in out] + made):
            later, parts = self._latest()
            if later <= n or not out <= {p.path for p in parts} or clash([p for p in parts if p.path not in known]):
                return False
            n = later
        self._clean()
        return True

    def _change(self, plan: Callable[[list[Part]], tuple[int, list[Part], DataFrame | None, Callable[[list[Part]], bool]]]) -> int:
        """Work out and commit a change, again if another writer's clashes with it."""
        for _ in range(ATTEMPTS):
            base = self._latest()
            n, gone, rows, clash = plan(base[1])
            if not gone and rows is None:
                return n
            try:
                made = self._write(rows) if rows is not None else []
            except Exception as e:
                raise StoreError(f"{self.root}: {e}") from e
            if self._commit(base, gone, made, clash):
                return n
            for tag in {p.tag for p in made}:
                for kind in ("data", "cells", "filters"):
                    self._delete(f"{kind}/part={tag}")
        raise StoreConflict(f"{self.root}: other writers were first, {ATTEMPTS} times")

    # Parts

    def _read(self, parts: list[Part], columns: tuple[str, ...] = tuple(NAMES)) -> DataFrame:
        return self._open([p.path for p in parts], columns)

    def _open(self, paths: list[str], columns: tuple[str, ...]) -> DataFrame:
        self.opened = sorted(paths)
        if not paths:
            return self.spark.createDataFrame([], EMBEDDED_CHUNK).withColumns({"part": F.lit(""), "cell": F.lit(-1)}).select(*columns)
        wide = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in EMBEDDED_CHUNK.fields) + ", part string, cell int"
        return self.spark.read.schema(wide).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/{p}" for p in self.opened]).fillna({"doc_type": ""}).select(*columns)

    def _stage(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """Rows written once, as what is made of them reads them several times; and their path."""
        path = f"staging/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{path}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{path}"), path

    def _distinct(self, chunks: DataFrame) -> tuple[DataFrame, str]:
        """Chunks written once, one of each id: only ids are shuffled, and whole rows where an id is there twice."""
        staged, path = self._stage(decoded(chunks).select(*NAMES))
        if staged.groupBy("chunk_id").count().where("count > 1").isEmpty():
            return staged, path
        try:
            return self._stage(staged.dropDuplicates(["chunk_id"]))
        finally:
            self._delete(path)

    def _write(self, rows: DataFrame) -> list[Part]:
        """Rows of staged chunks and of parts as new parts, one a document type, with their cells and filters.

        The rows are read anew for each step, which is less than to write them once more.
        """
        tag = uuid.uuid4().hex
        staged = rows.select(*NAMES)
        vectors = staged.where(F.size("embedding") > 0)
        sized = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        middles = np.zeros((0, 0))
        if sized:
            picked = vectors.where(F.size("embedding") == sized["d"]).orderBy(F.xxhash64("chunk_id", F.lit("cells"))).limit(cells.SAMPLE).select("embedding").collect()
            x = np.array([[np.nan if v is None else v for v in r["embedding"]] for r in picked], float)
            x = x[np.isfinite(x).all(axis=1)]
            if len(x):
                middles = cells.middles(x, max(1, min(cells.MOST, sized["count"] // cells.CELL)))
        at = cells.place(F.col("embedding"), middles) if len(middles) else F.struct(F.lit(-1).alias("cell"), F.lit(None).cast("double").alias("far"))
        coded = staged.withColumn("_at", at).select(*NAMES, F.col("_at.cell").alias("cell"), F.col("_at.far").alias("far"))
        here = f"{self.root}/data/part={tag}"
        # the id is part of the order, so that a cell of many rows is written by several tasks;
        # a folder of its own, as a writer who is done takes its folder's temporary files away, another's too
        coded.repartitionByRange("doc_type", "cell", "chunk_id").write.partitionBy("doc_type", "cell").parquet(here)
        fs, p = self._fs(here)
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        folders = {unescaped(name.removeprefix("doc_type=")): name for name in names}
        if not folders:
            return []
        done = self.spark.read.schema("chunk_id string, doc_id string, far double, doc_type string, cell int").option("basePath", here).parquet(here).fillna({"doc_type": ""})
        ends = [f(c).alias(f"{k}_{n}") for k, c in IDS.items() for n, f in (("least", F.min), ("most", F.max))]
        made = [
            Part(f"data/part={tag}/{folders[r['doc_type']]}", r["doc_type"], r["n"], max(1, -(-r["n"] // 8)), r["chunk_least"], r["chunk_most"], r["doc_least"], r["doc_most"])
            for r in done.groupBy("doc_type").agg(F.count("*").alias("n"), *ends).collect()
        ]
        if len(middles):
            known = self.spark.createDataFrame([(n, m.tolist()) for n, m in enumerate(middles)], "cell int, middle array<double>")
            found = done.where("cell >= 0").groupBy("doc_type", "cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius"))
            found.join(F.broadcast(known), "cell").coalesce(1).write.parquet(f"{self.root}/cells/part={tag}")
        blocks = F.element_at(F.create_map(*[x for p in made for x in (F.lit(p.doc_type), F.lit(p.blocks))]), F.col("doc_type"))
        ids = done.select("doc_type", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in IDS.items()])))
        bits = ids.select("doc_type", "kind", block_of(blocks).alias("block"), *[w.alias(f"w{n}") for n, w in enumerate(bits_of())])
        bits.groupBy("doc_type", "kind", "block").agg(*[F.bit_or(f"w{n}").alias(f"w{n}") for n in range(4)]).write.parquet(f"{self.root}/filters/part={tag}")
        return made

    def _possible(self, parts: list[Part], kind: str, values: DataFrame) -> list[Part]:
        """Parts that may hold one of the ``values`` (a column ``value``), by their ends and filters; no row is opened."""
        least, most = values.agg(F.min("value"), F.max("value")).first()
        parts = [p for p in parts if least is not None and getattr(p, f"{kind}_least") <= most and getattr(p, f"{kind}_most") >= least]
        if not parts:
            return []
        listed = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p.tag).alias("part"), F.lit(p.doc_type).alias("doc_type"), F.lit(p.blocks).alias("blocks")) for n, p in enumerate(parts)])
        asked = values.distinct().select("value", F.inline(listed)).select("n", "part", "doc_type", block_of(F.col("blocks")).alias("block"), *[w.alias(f"m{n}") for n, w in enumerate(bits_of())])
        paths = [f"{self.root}/filters/part={t}" for t in sorted({p.tag for p in parts})]
        held = self.spark.read.option("basePath", f"{self.root}/filters").schema("doc_type string, kind string, block long, w0 long, w1 long, w2 long, w3 long, part string").parquet(*paths).where(F.col("kind") == kind)
        met = asked.join(held, ["part", "doc_type", "block"])
        for n in range(4):
            met = met.where(F.col(f"w{n}").bitwiseAND(F.col(f"m{n}")) == F.col(f"m{n}"))
        return [parts[r["n"]] for r in met.select("n").distinct().collect()]

    def _holding(self, parts: list[Part], docs: DataFrame) -> list[Part]:
        """Parts that hold a row of one of the documents (a column ``doc_id``); of those that may, ids are read."""
        maybe = self._possible(parts, "doc", docs.select(F.col("doc_id").alias("value")))
        if not maybe:
            return []
        found = self._read(maybe, ("part", "doc_type", "doc_id")).join(docs, "doc_id", "left_semi").select("part", "doc_type").distinct().collect()
        return [p for p in maybe if (p.tag, p.doc_type) in {(r["part"], r["doc_type"]) for r in found}]

    # Chunks

    def read(self) -> DataFrame:
        return self._read(self._latest()[1])

    def add(self, chunks: DataFrame) -> int:
        """ST2: rows of new chunk ids; the number added. Parts whose filters hold none of the ids are not opened."""
        staged, path = self._distinct(chunks)
        ids = staged.select(F.col("chunk_id").alias("value"))

        def plan(parts: list[Part]):
            self.opened = []
            maybe = self._possible(parts, "chunk", ids)
            fresh = staged.join(self._read(maybe, ("chunk_id",)), "chunk_id", "left_anti") if maybe else staged
            counted = {r["doc_type"]: r["count"] for r in fresh.groupBy("doc_type").count().collect()}
            many = [p for p in parts if p.doc_type in counted and sum(q.doc_type == p.doc_type for q in parts) >= MERGE]
            opened = self.opened
            rows = fresh.unionByName(self._read(many)) if many else fresh
            self.opened = opened
            return sum(counted.values()), many, rows if counted else None, lambda new: bool(self._possible(new, "chunk", ids))

        try:
            return self._change(plan)
        finally:
            self._delete(path)

    def replace(self, chunks: DataFrame) -> int:
        """Chunks of documents in place of all that the store has of these documents."""
        staged, path = self._distinct(chunks)
        docs = staged.select("doc_id").distinct()

        def plan(parts: list[Part]):
            old = self._holding(parts, docs)
            n = staged.count()
            kept = self._read(old).join(docs, "doc_id", "left_anti").select(*NAMES)
            return n, old, kept.unionByName(staged) if n else None, lambda new: bool(self._holding(new, docs))

        try:
            return self._change(plan)
        finally:
            self._delete(path)

    def delete(self, doc_id: str) -> int:
        """ST4."""
        docs = self.spark.createDataFrame([(doc_id,)], "doc_id string")

        def plan(parts: list[Part]):
            old = self._holding(parts, docs)
            rows = self._read(old)
            n = rows.where(F.col("doc_id") == doc_id).count() if old else 0
            return n, old, rows.where(F.col("doc_id") != doc_id) if old else None, lambda new: bool(self._holding(new, docs))

        return self._change(plan)

    def chunks(self, where: Column | None = None) -> DataFrame:
        """ST6."""
        return (self.read() if where is None else self.read().where(where)).drop("embedding")

    def metadata(self, where: Column | None = None) -> DataFrame:
        """ST5: neither text nor vectors are read."""
        return self.chunks(where).select("chunk_id", *METADATA)

    def count(self) -> int:
        """ST7: known from the version."""
        return sum(p.rows for p in self._latest()[1])

    # Search

    def _cells(self, parts: list[Part], dim: int) -> cells.Cells:
        fs, _ = self._fs(self.root)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        folders = [f for f in (f"{self.root}/cells/part={t}" for t in sorted({p.tag for p in parts})) if fs.exists(path(f))]
        schema = "doc_type string, cell int, rows long, radius double, middle array<double>, part string"
        table = self.spark.read.schema(schema).option("basePath", f"{self.root}/cells").parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        named = self.spark.createDataFrame([(p.tag, p.doc_type) for p in parts], "part string, doc_type string")
        return cells.Cells.read(table.join(F.broadcast(named), ["part", "doc_type"], "left_semi"), dim)

    def _cell_paths(self, parts: list[Part], known: cells.Cells, numbers) -> list[str]:
        paths = {(p.tag, p.doc_type): p.path for p in parts}
        return [f"{paths[known.where[n][:2]]}/cell={known.where[n][2]}" for n in numbers]

    def search(self, vector: list[float], k: int, where: Column | None = None) -> DataFrame:
        """ST3: the same rows as :func:`search.nearest` of all chunks, from the cells that can hold one of them.

        The nearest cells with enough rows give a k-th distance; then those are
        opened besides that can hold a nearer row. ``opened`` names all.
        """
        parts = self._latest()[1]
        known = self._cells(parts, len(vector))
        least = known.least(np.array(vector, float))
        first = known.first(least, max(k, cells.CELL)) if len(least) else np.empty(0, int)
        near = search.nearest(self._open(self._cell_paths(parts, known, first), tuple(NAMES)), vector, k, where)
        far = [r["distance"] for r in near.select("distance").collect()]
        reach = math.sqrt(far[-1]) * (1 + cells.SLACK) if len(far) == k else math.inf
        more = np.setdiff1d(np.flatnonzero(least <= reach), first)
        if not len(more):
            return near
        return search.nearest(self._open(self._cell_paths(parts, known, [*first, *more]), tuple(NAMES)), vector, k, where)

    def search_each(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, distance, score) of the ``k`` nearest chunks of each row (query_id, query) of ``queries``.

        Queries and rows meet in cells, by a join on the cell; a query looks into
        its nearest cells, and then into those that can hold a nearer row.
        Queries of another dimension than the first one's find nothing.
        """
        parts = self._latest()[1]
        one = queries.where("size(query) > 0").select(F.size("query").alias("d")).first()
        known = self._cells(parts, one["d"] if one else 0)
        asked = queries.select("query_id", "query").where(F.size("query") == known.middle.shape[1])
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, query {queries.schema['query'].dataType.simpleString()}, at int"
        rows = self._open(self._cell_paths(parts, known, range(len(known.where))), ("part", "doc_type", "cell", *NAMES))
        rows = (rows if where is None else rows.where(where)).select("part", "doc_type", "cell", "chunk_id", "embedding")
        order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
        best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if not known.where:
            return best(asked.select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("distance")).limit(0)).select("query_id", "rank", "chunk_id", "distance", F.lit(1.0).alias("score"))
        near = best(cells.meet(rows, asked.mapInArrow(cells.first_cells(known, k), kinds), known, k))
        reach = near.where(F.col("rank") == k).select("query_id", F.sqrt("distance").alias("reach"))
        more = asked.join(reach, "query_id", "left").select("query_id", "query", "reach").mapInArrow(cells.other_cells(known, k), kinds)
        both = near.drop("rank").unionByName(cells.meet(rows, more, known, k))
        return best(both).select("query_id", "rank", "chunk_id", "distance", search.score_of(F.col("distance")).alias("score"))


def _link(path: str, text: bytes) -> bool:
    """A local file made whole, or not at all if it is there."""
    whole = f"{path}.{uuid.uuid4().hex}"
    with open(whole, "xb") as f:
        f.write(text)
    try:
        os.link(whole, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(whole)
    return True


def block_of(blocks: Column) -> Column:
    """The block of a filter that ``value`` belongs to."""
    return F.pmod(F.xxhash64("value"), blocks.cast("long"))


def bits_of() -> list[Column]:
    """Two bits in each of the four words of a block."""
    h = F.xxhash64("value", F.lit(1))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int"))
    return [bit(12 * n).bitwiseOR(bit(12 * n + 6)) for n in range(4)]


def unescaped(name: str) -> str:
    """A partition's value from its folder's name."""
    return "" if name == "__HIVE_DEFAULT_PARTITION__" else unquote(name)


def decoded(rows: DataFrame) -> DataFrame:
    """ST8: defaults for metadata that a row lacks."""
    defaults = {"page": 0, "token_count": 0, "chunk_level": "detail", "chunk_index": 0}
    for f in EMBEDDED_CHUNK.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    texts = {f.name: "" for f in EMBEDDED_CHUNK.fields if f.dataType.simpleString() == "string" and f.name not in ("chunk_id", "chunk_level")}
    return rows.fillna(defaults | texts)
