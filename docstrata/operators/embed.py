"""Embedders (E1-E6): texts in, vectors out, a batch at a time on the executors."""

from __future__ import annotations

import hashlib
import json
import math
import os
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..errors import EmbeddingError


class Embedder(Protocol):
    batch_size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def _positive(n: int) -> int:
    if n < 1:
        raise EmbeddingError(f"the batch size must be 1 at least, not {n}")
    return n


class HashingEmbedder:
    """Signed hashes of words, of unit length; needs no model. The default."""

    def __init__(self, dimension: int = 64, batch_size: int = 256):
        self.dimension, self.batch_size = dimension, _positive(batch_size)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.dimension
        for w in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % self.dimension] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]


class FunctionEmbedder:
    """Any function from texts to vectors, such as one that runs a local model."""

    def __init__(self, function: Callable[[list[str]], list[list[float]]], batch_size: int = 256):
        self.function, self.batch_size = function, _positive(batch_size)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.function(texts)


class HttpEmbedder:
    """A server that answers JSON; ``kind`` is ``input`` (``{"embeddings": [...]}``) or ``data`` (rows with an index)."""

    def __init__(self, url: str, model: str, kind: str = "data", key_variable: str = "", batch_size: int = 64, timeout: float = 120.0):
        self.url, self.model, self.kind, self.key_variable = url, model, kind, key_variable
        self.batch_size, self.timeout = _positive(batch_size), timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"}
        if self.key_variable and os.environ.get(self.key_variable):
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        body = json.dumps({"model": self.model, "input": texts}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as r:
                answer = json.load(r)
            return self.vectors(answer)
        except (OSError, ValueError, KeyError) as e:
            raise EmbeddingError(f"{self.url}: {e}") from e

    def vectors(self, answer: dict) -> list[list[float]]:
        if self.kind == "input":
            return answer["embeddings"]
        return [x["embedding"] for x in sorted(answer["data"], key=lambda x: x["index"])]


def embed_batches(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """In batches; as many vectors as texts, or an error."""
    out: list[list[float]] = []
    for i in range(0, len(texts), embedder.batch_size):
        part = texts[i : i + embedder.batch_size]
        got = embedder.embed(part)
        if len(got) != len(part):
            raise EmbeddingError(f"{len(got)} vectors for {len(part)} texts")
        out += got
    return out


def dimension(embedder: Embedder) -> int:
    """Stated, or found by a probe."""
    return getattr(embedder, "dimension", 0) or len(embedder.embed(["dimension"])[0])


def embed_chunks(chunks: DataFrame, embedder: Embedder, text_col: str = "content", into: str = "embedding") -> DataFrame:
    """``chunks`` with a vector for each text; the embedder is made once a task."""
    at = chunks.columns.index(text_col)
    schema = StructType([*chunks.schema.fields, StructField(into, ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = embed_batches(embedder, [t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, into])

    return chunks.mapInArrow(run, schema)
