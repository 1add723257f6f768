"""Filters and exact nearest neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview
from .embed import Embedder


def build_where(**equals: str) -> Column | None:
    """All given columns equal their values; empty values do not count; null if none does."""
    parts = [F.col(k) == v for k, v in equals.items() if v]
    return reduce(lambda a, b: a & b, parts) if parts else None


def not_equal(column: str, value: str) -> Column:
    """Rows without a value count as unequal."""
    return ~F.col(column).eqNullSafe(value)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def score_of(distance: Column) -> Column:
    """F31."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def clamp_k(k: int, most: int = 50) -> int:
    """O11."""
    return max(1, min(k, most))


def nearest(rows: DataFrame, query: list[float], k: int, where: Column | None = None, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """ST3: the rows that pass the filter, nearest first, ties by id; a sort that keeps ``k`` rows a task.

    Rows without a vector of the query's dimension, or with a null in it, are not found.
    """
    kept = rows if where is None else rows.where(where)
    far = kept.withColumn("distance", squared_distance(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])))
    top = far.where(F.col("distance").isNotNull()).orderBy("distance", id_col).limit(k).withColumn("score", score_of(F.col("distance")))
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))  # k rows


def nearest_for_each(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_id: str = "query_id", query_vector: str = "query", block: int = 10_000) -> DataFrame:
    """A stated set of queries against all rows, ``block`` queries at a time.

    A block is counted before it is broadcast. Each task keeps ``k`` rows a
    query before the shuffle.
    """
    total = queries.count()
    blocks = max(1, -(-total // block))
    order = Window.partitionBy(query_id).orderBy("distance", id_col)

    def of(part: DataFrame) -> DataFrame:
        pairs = rows.join(F.broadcast(part), F.size(vector_col) == F.size(query_vector))
        far = pairs.withColumn("distance", squared_distance(F.col(vector_col), F.col(query_vector))).drop(query_vector, vector_col)
        return far.where(F.col("distance").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    parts = [of(queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == n)) for n in range(blocks)]
    return reduce(DataFrame.unionByName, parts).withColumn("score", score_of(F.col("distance")))


class SearchEngine:
    """Q1: a question in words against embedded chunks, or a store of them, which opens only the cells that it needs."""

    def __init__(self, chunks, embedder: Embedder):
        self.chunks, self.embedder = chunks, embedder

    def search(self, query: str, k: int = 5, chip: str = "", doc_type: str = "", peripheral: str = "") -> DataFrame:
        vector = self.embedder.embed([query])[0]
        where = build_where(chip=chip, doc_type=doc_type, peripheral=peripheral)
        return nearest(self.chunks, vector, k, where) if isinstance(self.chunks, DataFrame) else self.chunks.search(vector, k, where)

    def listing(self, found: DataFrame) -> DataFrame:
        """What a terminal shows of each hit."""
        return found.select("rank", "score", "chip", "doc_type", "page", "section_path", preview(F.col("content")).alias("preview"))


def within_budget(ranked: DataFrame, group: list[str], order: list[str], text_col: str = "content", most: int = 32_000, buckets: int = 64, key: list[str] | None = None) -> DataFrame:
    """Of each group the first rows whose lengths together stay within ``most``.

    Rows of a group are dealt to buckets first. A row that begins above ``most`` in its
    bucket does so among all, so each bucket keeps what one
    budget holds and the row that goes beyond it, and the window over the group meets that much
    of ``buckets`` buckets at most, however large the group. With ``key``, columns that tell rows apart, texts stay
    out of both windows, and the few rows found are joined back. A null text has no length;
    a group's rows before its first text that is not null are left out.
    """
    size = F.length(text_col)
    rows = ranked.withColumn("_size", size)
    if key:
        rows = rows.select(*dict.fromkeys([*key, *group, *order, "_size"]))
    so_far = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit("bucket")), F.lit(buckets)))
    length = F.coalesce("_size", F.lit(0))
    few = dealt.withColumn("_used", F.sum(length).over(so_far(*group, "_bucket"))).where(F.col("_used") - length <= most)
    found = few.withColumn("_used", F.sum("_size").over(so_far(*group))).where(F.col("_used") <= most).drop("_used", "_bucket", "_size")
    return ranked.join(found.select(*key), key, "left_semi") if key else found
