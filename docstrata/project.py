"""Projects and their pipeline (M1-M4, M12-M14, D27, W10, A21): files to chunks to compiled context."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as configuration
from .errors import ConfigError, PipelineError
from .operators.chunker import ChunkOptions, Tokenizer, chunk_documents
from .operators.compile import ContextOptions, compile_hot, compile_peripherals, compile_targets, write_peripherals
from .operators.embed import Embedder, embed_chunks
from .operators.search import SearchEngine
from .operators.store import ChunkStore
from .providers import Registry, default_registry, made
from .schemas import MANIFEST
from .sources import manifest
from .sources.files import read_documents

log = logging.getLogger(__name__)
FOLDER = ".docstrata"


def find_root(start: str | Path) -> Path | None:
    """The nearest folder upwards that is a project."""
    at = Path(start).resolve()
    return next((p for p in (at, *at.parents) if (p / FOLDER).is_dir()), None)


@dataclass
class Status:
    initialized: bool
    root: str
    document_count: int = 0
    chunk_count: int = 0
    bytes: int = 0


class Pipeline:
    """Documents to embedded chunks in the store."""

    def __init__(self, store: ChunkStore, embedder: Embedder, options: ChunkOptions | None = None, tokenizer: Tokenizer | None = None):
        self.store, self.embedder, self.options, self.tokenizer = store, embedder, options, tokenizer

    def process(self, documents: DataFrame) -> DataFrame:
        """Chunks of the documents, in place of those that the store had; (doc_id, chunks) of each."""
        try:
            chunks = chunk_documents(documents.where("error is null"), self.options, self.tokenizer)
            failed = chunks.where("error is not null").select("doc_id", "error")
            embedded = embed_chunks(chunks.where("error is null").drop("error"), self.embedder)
            self.store.replace(embedded)
            for r in failed.toLocalIterator():
                log.warning("%s: %s", r["doc_id"], r["error"])
            return self.store.metadata().groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))
        except Exception as e:
            raise PipelineError(str(e)) from e

    def remove(self, doc_id: str) -> int:
        return self.store.delete(doc_id)


class Project:
    """A folder of files and what was made of them.

    The embedder and the parsers of further formats are those given, else those
    that the configuration names; ``registry`` has what it may name. A parser is
    registered under its name and taken for the format it begins with (``pdf``).
    """

    def __init__(self, spark: SparkSession, root: str | Path, embedder: Embedder | None = None, registry: Registry | None = None, parsers: Mapping[str, Callable] | None = None):
        self.spark, self.root = spark, Path(root)
        self.folder = self.root / FOLDER
        self.registry, self._embedder, self._parsers = registry or default_registry(), embedder, parsers

    @property
    def embedder(self) -> Embedder:
        if self._embedder is None:
            self._embedder = made(self.registry, "embedder", self.config().embedding)
        return self._embedder

    def parsers(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        """Parsers of further formats by format."""
        name = self.config().ingest.pdf_parser
        out = {"pdf": self.registry.create("parser", name)} if name in self.registry.names("parser") else {}
        return out | dict(self._parsers or {})

    @property
    def context(self) -> Path:
        return self.folder / "context"

    @property
    def store(self) -> ChunkStore:
        return ChunkStore(self.spark, str(self.folder / "index"), self.config().store.collection)

    def init(self, name: str = "", mcu: str = "") -> None:
        """M1: what is there already stays."""
        for d in (self.folder, self.context / "peripherals", self.folder / "index"):
            d.mkdir(parents=True, exist_ok=True)
        if not (self.folder / "config.toml").exists():
            c = configuration.Config()
            c.project.name, c.hardware.mcu = name or self.root.resolve().name, mcu
            self.save(c)
        if not (self.folder / "manifest.json").exists():
            self._save_manifest(manifest.empty(self.spark))

    def config(self) -> configuration.Config:
        return configuration.load(self.folder / "config.toml")

    def save(self, c: configuration.Config) -> None:
        (self.folder / "config.toml").write_text(configuration.dumps(c), encoding="utf-8")

    def manifest(self) -> DataFrame:
        return manifest.read_manifest(self.spark, str(self.folder / "manifest.json"))

    def _save_manifest(self, rows: DataFrame, compiled: str = "") -> None:
        text = manifest.manifest_json(rows, compiled).first()["value"]
        new = self.folder / "manifest.json.new"
        new.write_text(text, encoding="utf-8")
        new.replace(self.folder / "manifest.json")

    def add(self, *paths: str, doc_type: str = "", chip: str = "", compile_after: bool = True) -> dict[str, int]:
        """Files that are new or changed; the number of files in each state."""
        c = self.config()
        found = read_documents(self.spark, *paths, parsers=self.parsers()).where(~F.col("source_path").contains(f"/{FOLDER}/"))
        if doc_type:
            found = found.withColumn("doc_type", F.lit(doc_type))
        own = F.lit(chip or c.hardware.mcu)
        found = found.withColumn("chip", F.when(F.lit(bool(chip)) | (F.col("chip") == ""), own).otherwise(F.col("chip"))).dropDuplicates(["doc_id"])
        known = self.manifest()
        state = manifest.classified(found.withColumnRenamed("doc_id", "id"), known).withColumn("state", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("state"))).cache()
        counts = {r["state"]: r["n"] for r in state.groupBy("state").agg(F.count("*").alias("n")).collect()}
        for r in state.where("error is not null").select("source_path", "error").toLocalIterator():
            log.warning("%s: %s", r["source_path"], r["error"])
        work = state.where(F.col("state").isin("new", "changed")).withColumnRenamed("id", "doc_id")
        if counts.get("new", 0) + counts.get("changed", 0):
            options = ChunkOptions(c.chunk.max_tokens, c.chunk.overlap_tokens, c.chunk.min_tokens)
            done = Pipeline(self.store, self.embedder, options).process(work)
            now = f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%S+00:00}"
            rows = work.join(done, "doc_id", "left").select(
                F.col("doc_id").alias("id"), F.col("source_path").alias("path"), "doc_type", "hash", F.lit(now).alias("added"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "chip"
            )
            self._save_manifest(manifest.upsert(known, rows).select(*MANIFEST.fieldNames()))
            if compile_after:
                self.compile()
        state.unpersist()
        return counts

    def remove(self, id_or_path: str) -> int:
        """M3: the number of chunks that went."""
        known = self.manifest()
        gone = [r["id"] for r in known.where((F.col("id") == id_or_path) | (F.col("path") == id_or_path)).collect()]
        if not gone:
            raise ConfigError(f"{id_or_path!r} is not in the project")
        n = sum(self.store.delete(i) for i in gone)
        self._save_manifest(manifest.remove(known, id_or_path))
        return n

    def options(self) -> ContextOptions:
        c = self.config()
        values = {k: v for part in (c.hardware, c.software, c.conventions) for k, v in vars(part).items()} | {"project": c.project.name}
        return ContextOptions(values, c.pins, tuple(c.output.targets), c.output.hot_context_lines)

    def compile(self, targets: tuple[str, ...] = ()) -> list[Path]:
        """M4: short context, then peripherals, then the tools' files, which hold the short context."""
        options, overrides = self.options(), str(self.folder / "templates")
        chunks, known = self.store.chunks().cache(), self.manifest()
        hot = compile_hot(chunks, known, options, overrides=overrides)
        self.context.mkdir(parents=True, exist_ok=True)
        (self.context / "hot.md").write_text(hot, encoding="utf-8")
        write_peripherals(compile_peripherals(chunks, known, options.pins), self.context / "peripherals", overrides)
        chunks.unpersist()
        self._save_manifest(known, f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%S+00:00}")
        if targets:
            options.targets = targets
        return compile_targets(hot, options, self.root, f"{FOLDER}/context", overrides)

    def search(self, query: str, k: int = 5, **where: str) -> DataFrame:
        return SearchEngine(self.store, self.embedder).search(query, k, **where)

    def status(self) -> Status:
        """A8, A21."""
        if not self.folder.is_dir():
            return Status(False, str(self.root))
        r = manifest.totals(self.manifest()).first()
        return Status(True, str(self.root), r["document_count"], r["chunk_count"], sum(p.stat().st_size for p in self.folder.rglob("*") if p.is_file()))
