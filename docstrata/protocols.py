"""What plug-ins of each category look like (X1); the classes here need not be inherited from."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

from .operators.chunker import Tokenizer
from .operators.embed import Embedder

__all__ = ["AnswerProvider", "Chunking", "Compiler", "Describer", "Embedder", "Parser", "Store", "Tokenizer"]


@runtime_checkable
class Parser(Protocol):
    """Files (path, length, content) to documents in the columns of ``files.COLUMNS``; what fails has ``error`` set."""

    def __call__(self, files: DataFrame) -> DataFrame: ...


@runtime_checkable
class Chunking(Protocol):
    """A text to (index, content, tokens, page, section path) of each chunk."""

    def chunk(self, text: str | None) -> list[tuple[int, str, int, int, str]]: ...


@runtime_checkable
class Store(Protocol):
    """Chunks that can be added, replaced by document, deleted, filtered and counted."""

    def add(self, chunks: DataFrame) -> int: ...

    def replace(self, chunks: DataFrame) -> int: ...

    def delete(self, doc_id: str) -> int: ...

    def chunks(self, where: Column | None = None) -> DataFrame: ...

    def metadata(self, where: Column | None = None) -> DataFrame: ...

    def count(self) -> int: ...


@runtime_checkable
class Compiler(Protocol):
    """What is known of a project to files below a folder."""

    def __call__(self, values: Mapping, folder: str | Path) -> list[Path]: ...


@runtime_checkable
class Describer(Protocol):
    """PNG bytes in a column to words; what fails is described by nothing."""

    def __call__(self, image: Column) -> Column: ...


@runtime_checkable
class AnswerProvider(Protocol):
    """A system prompt and a question to (text, tokens, milliseconds)."""

    def __call__(self, system: str, question: str) -> tuple[str, int, float]: ...
