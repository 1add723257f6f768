"""Cells of vectors: rows near a common middle, which a search opens or passes over as a whole.

A row is no nearer to a query than the query's distance from the row's middle
less the cell's radius, so a cell of which that is beyond the k-th distance
found so far holds none of the k nearest, and leaving it out loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = 4096  # rows wanted of a cell
MOST = 1024  # cells of one write
SAMPLE = 16_384  # vectors that middles are fitted on
SLACK = 1e-9  # relative; what rounding may have added to or taken from a distance
ROWS, QUERIES = 8192, 1024  # of a cell that meet in one task


def middles(sample: np.ndarray, n: int, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample; an empty cell keeps its middle."""
    out = sample[np.random.default_rng(seed).choice(len(sample), min(n, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(sample, out)[0]
        size = np.bincount(at, minlength=len(out))
        total = np.zeros_like(out)
        np.add.at(total, at, sample)
        out[size > 0] = total[size > 0] / size[size > 0, None]
    return out


def _nearest(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of, and exact distance from, the nearest of some points."""
    cell = np.concatenate([(-2 * part @ at.T + (at**2).sum(axis=1)).argmin(axis=1) for part in np.array_split(x, len(x) // 4096 + 1)])
    return cell, np.sqrt(((x - at[cell]) ** 2).sum(axis=1))


PLACE = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])


def place(vectors: Column, at: np.ndarray) -> Column:
    """The cell of a vector and its distance from the middle; -1 for one of another dimension, or with a null or non-finite component."""
    dim = at.shape[1]

    @F.arrow_udf(PLACE)
    def run(column: pa.Array) -> pa.Array:
        sized = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
        x = column.filter(sized).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        cell, far = np.full(len(column), -1, np.int32), np.full(len(column), np.nan)
        good = np.isfinite(x).all(axis=1)
        rows = np.flatnonzero(sized.to_numpy(zero_copy_only=False))[good]
        if len(rows):
            cell[rows], far[rows] = _nearest(x[good], at)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(far, mask=np.isnan(far))], names=["cell", "far"])

    return run(vectors)


@dataclass
class Cells:
    """All cells of a store, in the order of their rows' numbers; ``where`` names each one's folder."""

    where: list[tuple[str, str, int]]  # part, document type, cell
    rows: np.ndarray
    radius: np.ndarray
    middle: np.ndarray

    @classmethod
    def read(cls, table: DataFrame, dim: int) -> Cells:
        """Those of one dimension. What is gathered is bounded by the cells of a write and the parts of a type."""
        found = sorted(table.where(F.size("middle") == dim).collect(), key=lambda r: (r["part"], r["doc_type"], r["cell"]))
        number = lambda c: np.array([r[c] for r in found], float)
        return cls([(r["part"], r["doc_type"], r["cell"]) for r in found], number("rows"), number("radius"), number("middle").reshape(-1, dim))

    def least(self, query: np.ndarray) -> np.ndarray:
        """What a row of each cell is at least away from the query."""
        away = np.sqrt(((self.middle - query) ** 2).sum(axis=1))
        return np.maximum(away * (1 - SLACK) - self.radius * (1 + SLACK), 0)

    def first(self, least: np.ndarray, n: int) -> np.ndarray:
        """The nearest cells that hold ``n`` rows together."""
        order = np.argsort(least, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(self.rows[order]), n)) + 1]


def first_cells(cells: Cells, k: int):
    """(query_id, query, at) of each query and the cells that it looks into first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _dealt(b, [cells.first(cells.least(np.array(q.as_py(), float)), k) for q in b.column(1)])

    return run


def other_cells(cells: Cells, k: int):
    """The same for the cells that may hold a row within ``reach``, the third column, and were no first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = []
            for q, reach in zip(b.column(1), b.column(2)):
                least = cells.least(np.array(q.as_py(), float))
                within = np.flatnonzero(least <= (math.inf if not reach.is_valid else reach.as_py() * (1 + SLACK)))
                places.append(np.setdiff1d(within, cells.first(least, k)))
            yield _dealt(b, places)

    return run


def _dealt(b: pa.RecordBatch, places: list[np.ndarray]) -> pa.RecordBatch:
    rows = pa.array(np.repeat(np.arange(b.num_rows), [len(p) for p in places]))
    at = np.concatenate([np.empty(0, np.int32), *places]).astype(np.int32)
    return pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(at)], names=["query_id", "query", "at"])


def meet(rows: DataFrame, asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, chunk_id, distance): the ``k`` nearest rows of each cell for the queries (query_id, query, at) that look into it.

    ``rows`` are (part, doc_type, cell, chunk_id, embedding). A cell with many rows or
    queries is dealt over several tasks, so that each holds a bounded number of both.
    """
    spark = rows.sparkSession
    wanted = {r["at"]: r["count"] for r in asked.groupBy("at").count().collect()}  # at most one row a cell
    plan = [(*cells.where[n], n, -(-int(cells.rows[n]) // ROWS), -(-c // QUERIES)) for n, c in sorted(wanted.items())]
    known = F.broadcast(spark.createDataFrame(plan, "part string, doc_type string, cell int, at int, subs int, blocks int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = rows.join(known, ["part", "doc_type", "cell"]).select("at", part("chunk_id", "subs").alias("sub"), each("blocks").alias("block"), "chunk_id", "embedding")
    right = asked.join(known.select("at", "subs", "blocks"), "at").select("at", each("subs").alias("sub"), part("query_id", "blocks").alias("block"), "query_id", "query")
    kinds = {f.name: f.dataType for f in (*rows.schema, *asked.schema)}
    out = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField("chunk_id", kinds["chunk_id"]), T.StructField("distance", T.DoubleType())])
    dim, key = cells.middle.shape[1], ["at", "sub", "block"]

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)

    def run(held: pa.Table, queries: pa.Table) -> pa.Table:
        ids = np.array(held.column("chunk_id").to_pylist())
        order = np.argsort(ids, kind="stable")
        x, ids = matrix(held.column("embedding"))[order], ids[order]
        picked, far = [], []
        for q in matrix(queries.column("query")) if len(ids) else ():
            d = ((x - q) ** 2).sum(axis=1)
            limit = np.partition(d, k - 1)[k - 1] if len(d) > k else math.inf
            near = np.flatnonzero(d <= limit)
            near = near[np.lexsort((near, d[near]))][:k]
            picked.append(near)
            far.append(d[near])
        size = [len(p) for p in picked] if picked else [0] * queries.num_rows
        whose = queries.column("query_id").take(pa.array(np.repeat(np.arange(queries.num_rows), size)))
        found = held.column("chunk_id").take(pa.array(order[np.concatenate(picked)] if picked else np.empty(0, np.int64)))
        return pa.table([whose, found, pa.array(np.concatenate(far) if far else np.empty(0))], names=["query_id", "chunk_id", "distance"])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, out)
