"""Exact largest inner products by a bit-sliced index.

Components become integers, floor(scale * component). A segment of the index
holds some thousand rows by columns of bits: for each component the least value
and, less that value, its binary digits, a bitmap over the rows for each digit
(O'Neil and Quass, 1997). The inner product with a query is a sum of bitmaps at powers of two:
each digit of a query's component shifts that component's slices, and a negative
one takes their complements. Carry-save adders, three bitmaps to two, add all
bitmaps of a power at once (Rinfret, O'Neil and O'Neil, 2001), so the sum is bit-sliced too.

The best rows are read from the sum's most significant slice down: rows that
have the bit are in if there are no more than wanted, and else the others are
out. Rows that are still tied after the last slice have equal scores; of these
boundary rows the ones with the smallest ids are taken. The score is put
together from the slices of the rows that were taken, and is exact.

Rows are dealt into segments, and queries into blocks, of bounded size. A cell
of the grid of row groups and query blocks meets in one task, which holds that
cell only and returns at most ``k`` rows a query. Neither queries nor rows go
through the driver.

Defined results: vectors that are null, hold a null or non-finite component, or
have a null id take no part; zero vectors do; a vector shorter than the longest
counts as filled up with zeros; scaled components beyond 2^52 are cut off there,
and scores beyond a long at its ends; rows with the query's id are its own;
repeated rows are candidates each; queries of equal id and vector count once;
ties go to the smaller id; without vectors or queries the result is empty; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, named, scaled_vectors

SEGMENT = 16_384  # rows of a segment
GROUP = 16  # segments that meet a block of queries in one task
BLOCK = 256  # queries of a block
FOUND = "query_id long, vec_id long, score long"
LONG = (-(1 << 63), (1 << 63) - 1)


@dataclass
class Segment:
    """Rows by columns of bits, in ascending order of ids.

    ``planes`` holds the slices of all components, one after another, and then
    their complements, as bitmaps of 64-bit words; ``first`` is the place of each
    component's lowest slice and ``width`` the number of its slices.
    """

    ids: np.ndarray
    base: np.ndarray
    width: np.ndarray
    planes: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray) -> Segment:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        base = x.min(axis=0)
        above = (x - base).T
        width = np.array([int(v).bit_length() for v in above.max(axis=1)], np.int64)
        slices = [np.packbits((above[d] >> j) & 1 == 1, bitorder="little") for d in range(len(base)) for j in range(width[d])]
        words = -(-len(ids) // 64)
        raw = np.zeros((len(slices), words * 8), np.uint8)
        if slices:
            raw[:, : len(slices[0])] = np.stack(slices)
        return cls(ids, base, width, raw.view("<u8"))

    def __post_init__(self):
        self.first = np.cumsum(self.width) - self.width
        self.both = np.concatenate([self.planes, ~self.planes])
        present = np.zeros(self.planes.shape[1] * 8, np.uint8)
        bits = np.packbits(np.ones(len(self.ids), bool), bitorder="little")
        present[: len(bits)] = bits
        self.present = present.view("<u8")

    def product(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the inner products, lowest first, and a number to add to each."""
        size, negative = np.abs(query), query < 0
        # a(x - base) if the component is positive; a(top - x) if it is not, top being the largest value of that width
        add = sum(int(a) * (-(int(b) + (1 << int(w)) - 1) if n else int(b)) for a, b, w, n in zip(size, self.base, self.width, negative))
        start = self.first + negative * len(self.planes)
        wanted: list[list[np.ndarray]] = []
        for i in range(int(size.max(initial=0)).bit_length()):
            own = np.flatnonzero(size >> i & 1)
            for j in range(int(self.width[own].max(initial=0))):
                while len(wanted) <= i + j:
                    wanted.append([])
                wanted[i + j].append(start[own[self.width[own] > j]] + j)
        slices: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        while len(slices) < len(wanted) or carried:
            now = [self.both[np.concatenate(wanted[len(slices)])]] if len(slices) < len(wanted) and wanted[len(slices)] else []
            stack = np.concatenate([*now, *carried]) if now or carried else np.zeros((1, len(self.present)), "<u8")
            one, carried = add_up(stack)
            slices.append(one)
        return slices, add

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[list[int], np.ndarray]:
        """Scores and ids of the ``k`` rows of largest inner product, ties to smaller ids."""
        slices, add = self.product(query)
        sure, tied = np.zeros_like(self.present), self.present.copy()
        a, b = np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, side="right")
        for n in range(a, b):
            tied[n // 64] &= ~np.uint64(1 << n % 64)
        for s in reversed(slices):
            with_bit = tied & s
            inside = sure | with_bit
            n = int(np.bitwise_count(inside).sum())
            if n > k:
                tied = with_bit
            else:
                sure = inside
                tied = tied & ~s
                if n == k:
                    break
        rows = _places(sure)
        rows = np.concatenate([rows, _places(tied)[: k - len(rows)]])
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        digits = [(s[word] >> bit & np.uint64(1)).tolist() for s in slices]
        scores = [add] * len(rows)
        for p, column in enumerate(digits):
            for n, v in enumerate(column):
                scores[n] += v << p
        return [min(max(v, LONG[0]), LONG[1]) for v in scores], self.ids[rows]


def add_up(stack: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """One slice, the sum of the bitmaps modulo two, and bitmaps to carry, each worth twice as much."""
    carried = []
    while len(stack) > 2:
        t = len(stack) // 3
        a, b, c = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t]
        odd = a ^ b
        carried.append((a & b) | (c & odd))
        stack = np.concatenate([odd ^ c, stack[3 * t :]])
    if len(stack) == 2:
        carried.append(stack[:1] & stack[1:])
        stack = stack[:1] ^ stack[1:]
    return stack[0], carried


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _rows(batches: Iterator[pa.RecordBatch], dim: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integers) of about ``most`` rows at a time."""
    ids: list[np.ndarray] = []
    xs: list[np.ndarray] = []
    for part in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        ids.append(part.column(0).to_numpy())
        xs.append(part.column(1).flatten().to_numpy().reshape(part.num_rows, dim))
        if sum(map(len, ids)) >= most:
            yield np.concatenate(ids), np.concatenate(xs)
            ids, xs = [], []
    if ids:
        yield np.concatenate(ids), np.concatenate(xs)


def _packer(dim: int, most: int, sliced: bool, groups: int):
    """Rows (cell number, parts...) of the segments, or of the blocks of queries, that a task's rows make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() % groups
        for ids, x in _rows(batches, dim, most):
            if sliced:
                s = Segment.of(ids, x)
                parts = (s.ids, s.base, s.width, s.planes)
            else:
                parts = (ids, x)
            yield pa.RecordBatch.from_arrays([pa.array([at]), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["at", *NAMES[: len(parts)]])

    return run


NAMES = ["ids", "numbers", "width", "planes"]
SEGMENTS = "at long, ids binary, numbers binary, width binary, planes binary"
BLOCKS = "at long, ids binary, numbers binary"


def build_index(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 64, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame, int]:
    """The table of segments, the rows (vec_id, x) that it holds, and their dimension."""
    rows, dim, n = scaled_vectors(vectors.where(named(id_col).isNotNull()), id_col, vector_col, scale)
    dealt = -(-n // segment)
    # rows go to segments in turn, so that no id, however often it is there, makes one long
    packed = rows.repartition(max(1, dealt)).mapInArrow(_packer(dim, 2 * segment, True, max(1, dealt)), SEGMENTS)
    return materialise(packed, "slices"), rows, dim


def _searcher(k: int, dim: int):
    def run(segments: pa.Table, blocks: pa.Table) -> pa.Table:
        known = []
        for r in segments.select(NAMES).to_pylist():
            ids, base, width = (np.frombuffer(r[c], np.int64) for c in NAMES[:3])
            known.append(Segment(ids, base, width, np.frombuffer(r["planes"], "<u8").reshape(int(width.sum()), -(-len(ids) // 64))))
        out: tuple[list, list, list] = [], [], []
        for r in blocks.select(NAMES[:2]).to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            for query_id, query in zip(ids.tolist(), np.frombuffer(r["numbers"], np.int64).reshape(len(ids), dim)):
                found = [(-score, vec_id) for s in known for score, vec_id in zip(*s.best(query_id, query, k))]
                for score, vec_id in sorted(found)[:k]:
                    for column, v in zip(out, (query_id, vec_id, -score)):
                        column.append(v)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return run


def search(segments: DataFrame, queries: DataFrame, dim: int, k: int = 20, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each row (vec_id, x) of ``queries``."""
    wanted = queries.distinct()
    dealt, asked = segments.select(F.max("at")).first()[0], wanted.count()
    groups, blocks = (dealt + 1 if dealt is not None else 0) // group + 1, -(-asked // block) or 1
    packed = wanted.repartition(blocks).mapInArrow(_packer(dim, 2 * block, False, blocks), BLOCKS)
    # a segment goes to each block of queries, and a block to each group of segments: cells of bounded size
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = segments.withColumn("g", F.col("at") % groups).withColumn("b", all_of(blocks))
    right = packed.withColumnRenamed("at", "b").withColumn("g", all_of(groups))
    cells = [d.repartition(groups * blocks, "g", "b").groupBy("g", "b") for d in (left, right)]
    found = cells[0].cogroup(cells[1]).applyInArrow(_searcher(k, dim), FOUND)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def largest_products(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 20, scale: float = 64) -> DataFrame:
    """The ``k`` largest of each row that ``is_query`` (an expression on vec_id and x) holds for, against all rows but its own."""
    segments, rows, dim = build_index(vectors, id_col, vector_col, scale)
    return search(segments, rows.where(is_query), dim, k)
