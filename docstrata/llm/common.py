"""Shared pieces: shared-folder tables, connected components, text helpers."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; the path is opened by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns to add that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    Taken from ``spark.checkpoint.dir``. Only a local session, whose driver is
    its one executor, may fall back on a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/docstrata/{uuid.uuid4().hex}/{tag}"


_SCOPES: list[list[str]] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive executors. Column names must
    be unique. The files stay until ``drop_table`` or the end of the ``scope``
    that they were made in; without either, until the folder is cleaned.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docstrata_path = path
    if _SCOPES:
        _SCOPES[-1].append(path)
    return out


@contextmanager
def scope(spark: SparkSession):
    """Tables made inside are deleted at the end, but for those given to the function that this yields.

    What is kept belongs to the scope around this one, if there is one.
    """
    _SCOPES.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._docstrata_path)
        return df

    try:
        yield keep
    finally:
        for path in _SCOPES.pop():
            if path not in kept:
                delete_path(spark, path.rsplit("/", 1)[0])
            elif _SCOPES:
                _SCOPES[-1].append(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` that nothing reads any more."""
    path = getattr(df, "_docstrata_path", None)
    if path:
        delete_path(df.sparkSession, path.rsplit("/", 1)[0])


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


LARGEST = 2.0**52  # scaled components are cut off here, so that all of them are exact


def scaled_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 64, add: int = 0) -> tuple[DataFrame, int, int]:
    """(vec_id, x) with x = floor(scale * component) + add, its dimension and the number of rows.

    Vectors that are null or hold a null or non-finite component are left out.
    A vector shorter than the longest one counts as filled up with zeros.
    """
    e = F.col("e")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).alias("e")).where(e.isNotNull() & F.coalesce(finite, F.lit(False)))
    n, dim = rows.agg(F.count("*"), F.max(F.size("e"))).first()
    whole = lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + add
    filled = F.concat(F.transform("e", whole), F.array_repeat(F.lit(add).cast("long"), F.lit(dim or 0) - F.size("e")))
    return rows.select("vec_id", filled.alias("x")), dim or 0, n


_HELD: dict = {}


def held(key, make: Callable | None = None):
    """What a Python worker keeps from task to task; one object at a time, so that stages do not add up.

    Without ``make``, all is given up. What the object before took goes back to
    the system, as a worker lives on from stage to stage.
    """
    if make is None or key not in _HELD:
        if _HELD:
            _HELD.clear()
        _release()
    if make is None:
        return None
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def _release() -> None:
    """Free memory that the allocators hold back, as far as they can be asked to."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, as (node, root).

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a
    min-aggregate and a join, so that no adjacency list is ever gathered. The
    root of a component is its smallest node. Nodes without an edge to another
    node are not returned; null ends and loops are ignored.
    """
    pair = [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]
    live = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialise(live.select(*pair).distinct(), "edges")
    before = _digest(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        large = _star(now, "u", lambda m: [F.struct(m.alias("u"), F.col("v").alias("v"))])
        small = _star(large, "v", lambda m: [F.struct(m.alias("u"), F.col("u").alias("v")), F.struct(m.alias("u"), F.col("v").alias("v"))])
        nxt = materialise(small, "edges")
        drop_table(now)
        now, after = nxt, _digest(nxt)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def _star(e: DataFrame, end: str, made: Callable[[Column], list[Column]]) -> DataFrame:
    """Link through the smallest smaller neighbour of the edge's ``end``."""
    least = e.groupBy(F.col("v").alias("k")).agg(F.min("u").alias("m"))
    j = e.join(least, e[end] == least["k"], "left")
    m = F.coalesce("m", end)
    out = j.select(F.explode(F.array(*made(m))).alias("e")).select("e.u", "e.v").where(F.col("u") != F.col("v"))
    return out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
