"""The device catalog."""

from __future__ import annotations

import urllib.parse
import urllib.request
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CatalogError
from ..functions.text import stem

SHAPE = "devices array<struct<name:string,vendor:string,path:string>>, _bad string"


def safe_name(c: Column) -> Column:
    """P10: no path in a name."""
    return ~(c.contains("/") | c.contains("\\") | c.contains("..") | c.contains("\0"))


def safe_path(path: str) -> bool:
    """No part that leaves the folder."""
    return bool(path) and not any(p in ("", ".", "..") for p in path.split("/"))


class Catalog:
    def __init__(self, devices: DataFrame):
        self.devices = devices.select("name", "vendor", "path")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Catalog:
        try:
            raw = spark.read.schema(SHAPE).option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").json(path)
            if raw.where("_bad is not null or devices is null").count():
                raise CatalogError(f"{path}: not a catalog")
        except CatalogError:
            raise
        except Exception as e:
            raise CatalogError(f"{path}: {e}") from e
        return cls(raw.select(F.explode("devices").alias("d")).select("d.*"))

    @classmethod
    def index(cls, tree: DataFrame) -> Catalog:
        """From a listing (path) of register files below ``data``."""
        parts = F.split(F.regexp_replace("path", "^data/", ""), "/")
        kept = tree.where(F.col("path").startswith("data/") & F.col("path").endswith(".svd") & (F.size(parts) >= 2))
        return cls(kept.select(stem(F.col("path")).alias("name"), parts[0].alias("vendor"), F.regexp_replace("path", "^data/", "").alias("path")).orderBy("vendor", "name"))

    def search(self, query: str, vendor: str = "", limit: int | None = None) -> DataFrame:
        hit = F.lower("name").contains(query.lower())
        if vendor:
            hit &= F.lower("vendor") == vendor.lower()
        out = self.devices.where(hit).orderBy("vendor", "name")
        return out if limit is None else out.limit(limit)

    def find_exact(self, name: str) -> DataFrame:
        return self.devices.where(F.lower("name") == name.lower())

    def vendors(self) -> DataFrame:
        return self.devices.groupBy("vendor").agg(F.count("*").alias("devices")).orderBy("vendor")

    def device_count(self) -> int:
        return self.devices.count()

    def fetch(self, name: str, base: str, folder: str | Path, timeout: float = 30.0, most: int = 100 << 20) -> Path:
        """The register file of the device of that name, from below ``base``, a URL, into ``folder``."""
        found = self.find_exact(name).orderBy("vendor", "path").limit(2).collect()
        if not found:
            raise CatalogError(f"no device {name!r}")
        path = found[0]["path"]
        if not safe_path(path):
            raise CatalogError(f"{path!r} leaves the catalog's folder")
        try:
            with urllib.request.urlopen(f"{base.rstrip('/')}/{urllib.parse.quote(path)}", timeout=timeout) as r:
                data = r.read(most + 1)
        except (OSError, ValueError) as e:
            raise CatalogError(f"{path}: {e}") from e
        if len(data) > most:
            raise CatalogError(f"{path}: over {most} bytes")
        out = Path(folder) / path.replace("/", "_")
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_bytes(data)
        return out
