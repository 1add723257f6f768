"""Approximate nearest neighbours by score-aware anisotropic quantisation.

The nearest vectors in Euclidean distance are those with the largest inner
product less half the squared norm. Distances do not change if a vector is taken
from all; the mean of the sample is, so that a common offset does not swamp what
tells vectors apart. Norms are kept exactly; the inner product is read from
four-bit codes. Pairs of components are quantised to sixteen
codewords, with a loss that weighs the part of the residual parallel to the
vector more than the part across it, as that is the part which spoils large
inner products (Guo et al., 2020). Codewords and codes are found in turn, each
in closed form given the other. Directions are quantised, vectors of length one;
the lengths are kept exactly, so that long vectors have no coarser codes than
short ones.

The index is sorted by cells, which centroids of the sample give, and dealt in
that order into groups of stretches; queries are dealt into blocks. A cell of the grid of
groups and blocks meets in one task, which adds up table entries for its rows'
codes, two codes a byte, keeps the best ``keep`` of each stretch of ``CHUNK`` rows at most for
each query and all rows that share their codes, which the tables cannot tell
apart, and reranks them by the exact distance in double precision. At most ``k``
rows a query leave a task. Neither rows nor queries go through the driver.

Rows of a stretch lie together, as it holds rows of the same cells. A query passes over it if it is
farther from the stretch's middle than its radius and the query's k-th distance so far add up
to, which loses nothing. The first such distances are those to ``anchors``, some
vectors of the sample. Where vectors form clusters, a query so meets a part of
the rows; where they do not, it meets all.

The codebooks are fitted on at most ``sample`` vectors; every vector is
indexed. Defined results: vectors that are null, zero, hold a null or
non-finite component, have a null id, or another dimension than the most common
one (the smallest such) take no part; rows with the query's id are its own;
repeated rows are candidates each; queries of equal id and vector count once;
ties go to the smaller id; without vectors the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, named

FOUND = "query_id long, vec_id long, score double"
CHUNK = 10_000  # rows that are scanned together
GROUP = 40_000  # rows that a task holds
BLOCK = (256, 8192)  # least and most queries that a task holds
ANCHORS = 4096


@dataclass
class Codebook:
    """``words`` is subspaces x 16 x 2; an odd dimension is padded with a zero; ``centre`` is taken from all vectors.

    ``cells`` are centroids of centred vectors; ``anchors`` are ids and vectors of some rows.
    """

    words: np.ndarray
    centre: np.ndarray
    cells: np.ndarray | None = None
    anchors: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def dim(self) -> int:
        return 2 * len(self.words)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.dim - x.shape[1])))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries): inner products of a centred query with each pair of codewords."""
        q = self.padded(queries - self.centre).reshape(len(queries), -1, 2)
        one = np.einsum("qmd,mkd->mkq", q, self.words)
        if len(one) % 2:
            one = np.concatenate([one, np.zeros_like(one[:1])])
        low, high = one[0::2], one[1::2]
        return (high[:, :, None, :] + low[:, None, :, :]).reshape(len(low), 256, -1).astype(np.float32)


def _assign(x: np.ndarray, unit: np.ndarray, words: np.ndarray, codes: np.ndarray, weight: float, sweeps: int) -> np.ndarray:
    """Codes by coordinate descent on |r|^2 + weight <r, unit>^2, r being the residual; x and unit, its direction, are rows x subspaces x 2."""
    parallel = np.einsum("nmd,nmd->nm", x - words[np.arange(len(words)), codes], unit)
    total = parallel.sum(axis=1)
    for _ in range(sweeps):
        for m, book in enumerate(words):
            gap = x[:, m, None, :] - book
            along = np.einsum("nkd,nd->nk", gap, unit[:, m])
            loss = np.einsum("nkd,nkd->nk", gap, gap) + weight * (along + (total - parallel[:, m])[:, None]) ** 2
            codes[:, m] = loss.argmin(axis=1)
            new = along[np.arange(len(x)), codes[:, m]]
            total += new - parallel[:, m]
            parallel[:, m] = new
    return codes


def _directions(x: np.ndarray, m: int) -> np.ndarray:
    """Rows of length one (zero for zero), by pairs of components."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).reshape(len(x), m, 2)


def _weight(dim: int, threshold: float) -> float:
    """Extra weight of the parallel residual for inner products above ``threshold`` of the norm."""
    return max(0.0, (dim - 1) * threshold**2 / (1 - threshold**2) - 1)


def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> Codebook:
    m, centre = -(-x.shape[1] // 2), x.mean(axis=0)
    x = np.pad(x - centre, ((0, 0), (0, 2 * m - x.shape[1])))
    part = unit = _directions(x, m)
    rng, weight = np.random.default_rng(seed), _weight(x.shape[1], threshold)
    words = part[rng.choice(len(x), 16, replace=len(x) < 16)].transpose(1, 0, 2).copy()
    codes = np.stack([((part[:, k, None] - words[k]) ** 2).sum(axis=2).argmin(axis=1) for k in range(m)], axis=1)
    for _ in range(rounds):
        for k in range(m):
            chosen = words[np.arange(m), codes]
            along = np.einsum("nmd,nmd->nm", part - chosen, unit)
            rest = along.sum(axis=1) - along[:, k]
            u, p = unit[:, k], part[:, k]
            target = p + weight * u * (rest + (p * u).sum(axis=1))[:, None]
            for c in range(16):
                own = codes[:, k] == c
                if own.any():
                    words[k, c] = np.linalg.solve(own.sum() * np.eye(2) + weight * u[own].T @ u[own], target[own].sum(axis=0))
                else:
                    words[k, c] = p[rng.integers(len(p))]
        codes = _assign(part, unit, words, codes, weight, 1)
    return Codebook(words, centre)


def encode(book: Codebook, x: np.ndarray, threshold: float = 0.2) -> np.ndarray:
    """Packed codes, two a byte, of each row."""
    part = unit = _directions(book.padded(x - book.centre), len(book.words))
    codes = np.stack([((part[:, k, None] - w) ** 2).sum(axis=2).argmin(axis=1) for k, w in enumerate(book.words)], axis=1)
    codes = _assign(part, unit, book.words, codes, _weight(book.dim, threshold), 2)
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)  # the even code is the low half


def centroids(x: np.ndarray, most: int = 1024, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """Means of nearby rows, a sixteenth as many as there are rows."""
    n = max(1, min(most, len(x) // 16))
    out = x[np.random.default_rng(seed).choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        cell = nearest_cell(x, out)
        size = np.bincount(cell, minlength=n)
        total = np.zeros_like(out)
        np.add.at(total, cell, x)
        out[size > 0] = total[size > 0] / size[size > 0, None]
    return out


def nearest_cell(x: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return np.concatenate([(-2 * part @ cells.T + (cells**2).sum(axis=1)).argmin(axis=1) for part in np.array_split(x, len(x) // 4096 + 1)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


CODED = "vec_id long, embedding array<double>, codes binary, cell int"
STRETCHES = "at long, ids binary, vectors binary, codes binary"


def _coder(book: Codebook, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = _matrix(part.column(1), dim)
                codes = [c.tobytes() for c in encode(book, x)]
                cell = nearest_cell(x - book.centre, book.cells) if book.cells is not None else np.zeros(len(x), np.int64)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel()))
                cols = [part.column(0), vectors, pa.array(codes, pa.binary()), pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "embedding", "codes", "cell"])

    return run


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` largest; of equal ones at the limit the first."""
    if len(score) <= n:
        return np.arange(len(score))
    limit = np.partition(score, len(score) - n)[len(score) - n]
    above = np.flatnonzero(score > limit)
    return np.concatenate([above, np.flatnonzero(score == limit)[: n - len(above)]])


class _Alike:
    """Rows of a batch by their codes."""

    def __init__(self, codes: np.ndarray):
        rows = np.ascontiguousarray(codes).view(np.dtype((np.void, codes.shape[1]))).ravel()
        _, self.group, self.size = np.unique(rows, return_inverse=True, return_counts=True)
        self.rows = np.argsort(self.group, kind="stable")
        self.end = np.cumsum(self.size)

    def of(self, top: np.ndarray) -> np.ndarray:
        """The given rows and all with the codes of one of them."""
        many = np.unique(self.group[top])
        many = many[self.size[many] > 1]
        if not len(many):
            return top
        return np.union1d(top, np.concatenate([self.rows[self.end[g] - self.size[g] : self.end[g]] for g in many]))


def first_bounds(book: Codebook, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """For each query a distance within which it has ``k`` rows: that to the k-th nearest anchor."""
    out = np.full(len(queries), np.inf)
    if book.anchors is None:
        return out
    ids, x = book.anchors
    for at in range(0, len(queries), 1024):
        q = queries[at : at + 1024]
        far = ((x - book.centre) ** 2).sum(axis=1) - 2 * (q - book.centre) @ (x - book.centre).T + ((q - book.centre) ** 2).sum(axis=1)[:, None]
        far += 1e-9 * np.abs(far).max()  # what rounding may have taken away
        far[query_ids[at : at + 1024, None] == ids] = np.inf
        if far.shape[1] >= k:
            out[at : at + 1024] = np.sqrt(np.maximum(np.partition(far, k - 1, axis=1)[:, k - 1], 0))
    return out


def _chunks(cell: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``most`` rows; a cell of a tenth of that or more shares its stretches with no other."""
    edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
    start = 0
    for a, b in zip(edges, edges[1:]):
        large = b - a >= most / 10
        if start < a and (large or b - start > most):
            yield start, a
            start = a
        while b - start > most:
            yield start, start + most
            start += most
        if large and start < b:
            yield start, b
            start = b
    if start < len(cell):
        yield start, len(cell)


def nearest_of(book: Codebook, stretches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], query_ids: np.ndarray, queries: np.ndarray, k: int, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distances, ids) of the ``k`` nearest found for each query; a stretch is (ids, vectors, codes)."""
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(queries)
    bound = first_bounds(book, query_ids, queries, k)
    for ids, x, codes in stretches:
        order = np.argsort(ids, kind="stable")
        ids, x, codes = ids[order], x[order], codes[order]
        length = np.sqrt(((x - book.centre) ** 2).sum(axis=1))
        alike = _Alike(codes)
        middle = x.mean(axis=0)
        radius = math.sqrt(((x - middle) ** 2).sum(axis=1).max())
        away = np.sqrt(((queries - middle) ** 2).sum(axis=1))
        near = np.flatnonzero(away * (1 - 1e-9) <= radius + bound)
        for own in (near[i : i + 256] for i in range(0, len(near), 256)):
            table = book.tables(queries[own])
            score = np.zeros((len(ids), table.shape[2]), np.float32)
            for at in range(0, len(ids), 2000):
                for n in range(codes.shape[1]):
                    score[at : at + 2000] += table[n][codes[at : at + 2000, n]]
            score *= length.astype(np.float32)[:, None]
            score -= (length**2 / 2).astype(np.float32)[:, None]
            for j, s in zip(own.tolist(), np.ascontiguousarray(score.T)):
                top = alike.of(_best(s, keep))
                top = top[ids[top] != query_ids[j]]
                far = np.sqrt(((x[top] - queries[j]) ** 2).sum(axis=1))
                far, found = np.concatenate([best[j][0], far]), np.concatenate([best[j][1], ids[top]])
                order = np.lexsort((found, far))[:k]
                best[j] = far[order], found[order]
                if len(order) == k:
                    bound[j] = min(bound[j], far[order[-1]])
    return best


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, of one dimension, and their number."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda v: v != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (sizes["d"] if sizes else -1)), sizes["count"] if sizes else 0


def build_index(vectors: DataFrame, id_col: str, vector_col: str, sample: int = 20_000) -> tuple[DataFrame, DataFrame, Codebook | None]:
    """The table of stretches of every usable vector, by cells, the rows (vec_id, embedding) that it holds, and the codebook."""
    rows, n = usable(vectors, id_col, vector_col)
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit("ann")), "vec_id").limit(sample).select("vec_id", "embedding").collect()
    if not picked:
        return rows.sparkSession.createDataFrame([], STRETCHES), rows, None
    x = np.array([r["embedding"] for r in picked], float)
    book = fit(x)
    book.cells = centroids(x - book.centre)
    book.anchors = np.array([r["vec_id"] for r in picked[:ANCHORS]], np.int64), x[:ANCHORS]
    ordered = rows.mapInArrow(_coder(book, x.shape[1]), CODED).repartitionByRange(max(1, -(-n // GROUP)), "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    return materialise(ordered.mapInArrow(_packer(x.shape[1]), STRETCHES), "index"), rows, book


def _packer(dim: int):
    """Rows of the index, or of queries, in stretches of bounded size, each one row of (at, ids, vectors, codes)."""

    def packed(at: int, ids: np.ndarray, x: np.ndarray, codes: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at]), *[pa.array([v], pa.binary()) for v in (ids.tobytes(), x.tobytes(), b"".join(codes))]], names=["at", "ids", "vectors", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for b in batches:
            coded = b.num_columns > 2
            for i, j in _chunks(b.column(3).to_numpy(), CHUNK) if coded else ((i, min(i + CHUNK, b.num_rows)) for i in range(0, b.num_rows, CHUNK)):
                part = b.slice(i, j - i)
                yield packed(at, part.column(0).to_numpy(), _matrix(part.column(1), dim), part.column(2).to_pylist() if coded else [])

    return run


def _searcher(book: Codebook, k: int, keep: int):
    dim = len(book.centre)

    def unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for n in range(table.num_rows):
            ids, x, codes = (np.frombuffer(table.column(c)[n].as_buffer() or b"", kind) for c, kind in (("ids", np.int64), ("vectors", np.float64), ("codes", np.uint8)))
            yield ids, x.reshape(len(ids), dim), codes.reshape(len(ids), -1)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        for query_ids, queries, _ in unpacked(asked):
            best = nearest_of(book, unpacked(rows), query_ids, queries, k, keep)
            out[0].append(np.repeat(query_ids, [len(f) for f, _ in best]))
            out[1].extend(n for _, n in best)
            out[2].extend(f for f, _ in best)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate([np.empty(0, t), *c])) for c, t in zip(out, kinds)], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, book: Codebook | None, k: int = 10, keep: int = 256, block: tuple[int, int] = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row (vec_id, embedding) of ``queries``.

    Queries are dealt into blocks, the more of them the larger within ``block``,
    in turn. Each block meets each group of rows in a task of its own.
    """
    if book is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = queries.select("vec_id", "embedding").distinct()
    asked, groups = wanted.count(), index.select(F.max("at")).first()[0] + 1
    blocks = max(1, -(-asked // min(max(asked // 64, block[0]), block[1])))
    packed = wanted.repartition(blocks).mapInArrow(_packer(len(book.centre)), STRETCHES)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.withColumnRenamed("at", "g").withColumn("b", all_of(blocks))
    right = packed.withColumnRenamed("at", "b").withColumn("g", all_of(groups))
    cells = [d.repartition(groups * blocks, "g", "b").groupBy("g", "b") for d in (left, right)]
    found = cells[0].cogroup(cells[1]).applyInArrow(_searcher(book, k, keep), FOUND)
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
