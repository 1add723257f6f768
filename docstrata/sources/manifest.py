"""The manifest of ingested files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ManifestError
from ..functions.text import content_hash, make_doc_id
from ..schemas import MANIFEST

SHAPE = "schema_version string, version string, last_compiled string, documents array<struct<id:string,path:string,type:string,hash:string,added:string,chunks:int,chip:string>>, _bad string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MANIFEST)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest file; one that lacks an id, path, hash or date is an error."""
    try:
        raw = spark.read.schema(SHAPE).option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").json(path)
        if raw.where("_bad is not null and documents is null").limit(1).count():
            raise ManifestError(f"{path}: not a manifest")
    except ManifestError:
        raise
    except Exception as e:
        raise ManifestError(f"{path}: {e}") from e
    d = raw.select(F.explode("documents").alias("d")).select("d.*")
    out = d.select("id", "path", F.coalesce("type", F.lit("unknown")).alias("doc_type"), "hash", "added", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("chip", F.lit("")).alias("chip"))
    if out.where("id is null or path is null or hash is null or added is null").limit(1).count():
        raise ManifestError(f"{path}: a document lacks id, path, hash or added")
    return out


def manifest_json(rows: DataFrame, last_compiled: str = "") -> DataFrame:
    """One row with the whole manifest as JSON, documents by id."""
    entry = F.struct("id", "path", F.col("doc_type").alias("type"), "hash", "added", "chunks", F.nullif("chip", F.lit("")).alias("chip"))
    docs = F.coalesce(F.array_sort(F.collect_list(entry)), F.array().cast("array<struct<id:string,path:string,type:string,hash:string,added:string,chunks:int,chip:string>>"))
    return rows.agg(docs.alias("documents")).select(F.to_json(F.struct(F.lit("1").alias("schema_version"), F.lit(last_compiled).alias("last_compiled"), "documents")).alias("value"))


def make_entries(files: DataFrame, doc_type: Column, chip: Column) -> DataFrame:
    """Manifest rows of files (path, content), stamped now."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return files.select(make_doc_id(F.col("path")).alias("id"), "path", doc_type.alias("doc_type"), content_hash(F.col("content")).alias("hash"), now.alias("added"), F.lit(0).alias("chunks"), chip.alias("chip"))


def work_list(incoming: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """Rows that are new, or whose hash is another; an anti-join on both."""
    return incoming.join(manifest.select(key, "hash"), [key, "hash"], "left_anti")


def classified(incoming: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """``incoming`` with ``state``: new, changed or unchanged."""
    old = manifest.select(F.col(key).alias("_k"), F.col("hash").alias("_h"))
    state = F.when(F.col("_k").isNull(), "new").when(F.col("hash").eqNullSafe(F.col("_h")), "unchanged").otherwise("changed")
    return incoming.join(old, F.col(key) == F.col("_k"), "left").withColumn("state", state).drop("_k", "_h")


def upsert(manifest: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Fresh rows in place of old ones of their key."""
    return manifest.join(fresh.select(key), key, "left_anti").select(*manifest.columns).unionByName(fresh.select(*manifest.columns))


def remove(manifest: DataFrame, id_or_path: str) -> DataFrame:
    return manifest.where((F.col("id") != id_or_path) & (F.col("path") != id_or_path))


def totals(manifest: DataFrame) -> DataFrame:
    """A8."""
    return manifest.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunk_count"))
