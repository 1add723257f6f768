"""Plug-ins (B9, X1-X3): a registry, answer providers, describers of figures."""

from __future__ import annotations

import base64
import json
import os
import subprocess
import time
import urllib.request
from collections.abc import Callable, Iterator
from inspect import signature

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import BenchmarkError, PluginError

CATEGORIES = ("parser", "chunker", "embedder", "store", "compiler", "vision", "answer")


class Registry:
    """Factories by category and name."""

    def __init__(self):
        self._known: dict[tuple[str, str], Callable] = {}

    def register(self, category: str, name: str, factory: Callable) -> None:
        if category not in CATEGORIES:
            raise PluginError(f"unknown category {category!r}")
        if (category, name) in self._known:
            raise PluginError(f"{category} {name!r} is registered already")
        self._known[category, name] = factory

    def create(self, category: str, name: str, **options):
        return self.factory(category, name)(**options)

    def factory(self, category: str, name: str) -> Callable:
        if (category, name) not in self._known:
            raise PluginError(f"no {category} {name!r}; known: {', '.join(self.names(category)) or 'none'}")
        return self._known[category, name]

    def names(self, category: str) -> list[str]:
        return sorted(n for c, n in self._known if c == category)


def default_registry() -> Registry:
    from .operators.chunker import Chunker
    from .operators.embed import FunctionEmbedder, HashingEmbedder, HttpEmbedder
    from .operators.store import ChunkStore

    r = Registry()
    r.register("chunker", "markdown", Chunker)
    r.register("embedder", "hashing", HashingEmbedder)
    r.register("embedder", "function", FunctionEmbedder)
    r.register("embedder", "http", HttpEmbedder)
    r.register("store", "parquet", ChunkStore)
    r.register("answer", "stub", StubProvider)
    r.register("answer", "command", CommandProvider)
    r.register("answer", "http", HttpProvider)
    r.register("vision", "none", lambda: no_description)
    r.register("vision", "function", described_by)
    r.register("vision", "command", lambda command: described_by(CommandDescriber(command.split() if isinstance(command, str) else command)))
    r.register("vision", "http", lambda url, model, key_variable="": described_by(HttpDescriber(url, model, key_variable)))
    return r


def made(registry: Registry, category: str, section) -> object:
    """The provider that a section of the configuration names, with those of its settings that it takes."""
    name = section.provider
    factory = registry.factory(category, name)
    taken = signature(factory).parameters
    given = {k: v for k, v in vars(section).items() if k != "provider" and k in taken and v not in ("", None)}
    return registry.create(category, name, **given)


class StubProvider:
    """Answers from a table; the same to the same question."""

    def __init__(self, answers: dict[str, str] | None = None, default: str = "I do not know."):
        self.answers, self.default = answers or {}, default

    def __call__(self, system: str, question: str) -> tuple[str, int, float]:
        text = self.answers.get(question, self.default)
        return text, len(system.split()) + len(question.split()) + len(text.split()), 0.0


class CommandProvider:
    """A command that reads the prompt from its input and writes the answer."""

    def __init__(self, command: list[str], timeout: float = 120.0):
        self.command, self.timeout = command, timeout

    def __call__(self, system: str, question: str) -> tuple[str, int, float]:
        start = time.perf_counter()
        done = subprocess.run(self.command, input=f"{system}\n\n{question}", capture_output=True, text=True, timeout=self.timeout, check=False)
        if done.returncode:
            raise BenchmarkError(done.stderr.strip()[:500] or f"exit code {done.returncode}")
        return done.stdout.strip(), 0, (time.perf_counter() - start) * 1000


class HttpProvider:
    """A chat server; ``kind`` says how it words requests and answers: chat, messages or generate."""

    def __init__(self, url: str, model: str, kind: str = "chat", key_variable: str = "", delay: float = 0.0, timeout: float = 120.0):
        if kind not in ("chat", "messages", "generate"):
            raise BenchmarkError(f"unknown kind {kind!r}")
        self.url, self.model, self.kind, self.key_variable, self.delay, self.timeout = url, model, kind, key_variable, delay, timeout

    def request(self, system: str, question: str) -> tuple[dict, dict]:
        key = os.environ.get(self.key_variable, "") if self.key_variable else ""
        user = {"role": "user", "content": question}
        if self.kind == "messages":
            return {"x-api-key": key}, {"model": self.model, "max_tokens": 256, "temperature": 0, "system": system, "messages": [user]}
        head = {"Authorization": f"Bearer {key}"} if key else {}
        if self.kind == "generate":
            return head, {"model": self.model, "system": system, "prompt": question, "stream": False}
        return head, {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": system}, user]}

    def answer(self, got: dict) -> tuple[str, int]:
        if self.kind == "messages":
            return got["content"][0]["text"], sum(got.get("usage", {}).get(k, 0) for k in ("input_tokens", "output_tokens"))
        if self.kind == "generate":
            return got["response"], got.get("prompt_eval_count", 0) + got.get("eval_count", 0)
        return got["choices"][0]["message"]["content"], got.get("usage", {}).get("total_tokens", 0)

    def __call__(self, system: str, question: str) -> tuple[str, int, float]:
        head, body = self.request(system, question)
        start = time.perf_counter()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"} | head), timeout=self.timeout) as r:
                text, tokens = self.answer(json.load(r))
        except (OSError, ValueError, KeyError, IndexError) as e:
            raise BenchmarkError(f"{self.url}: {e}") from e
        took = (time.perf_counter() - start) * 1000
        time.sleep(self.delay)
        return text, tokens, took


def no_description(image: Column) -> Column:
    """Nothing."""
    return F.lit("")


def described_by(function: Callable[[bytes], str]) -> Callable[[Column], Column]:
    """A function from PNG bytes to words; what fails is described by nothing."""

    def column(image: Column) -> Column:
        @F.pandas_udf("string")
        def describe(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def one(b: bytes | None) -> str:
                try:
                    return function(bytes(b)) if b else ""
                except Exception:
                    return ""

            for s in images:
                yield s.map(one)

        return describe(image)

    return column


def as_data_url(png: bytes) -> str:
    return "data:image/png;base64," + base64.b64encode(png).decode()


FIGURE = "Describe this figure of a data sheet in two sentences."


class CommandDescriber:
    """A command that reads PNG bytes from its input and writes words."""

    def __init__(self, command: list[str], timeout: float = 60.0):
        self.command, self.timeout = command, timeout

    def __call__(self, png: bytes) -> str:
        done = subprocess.run(self.command, input=png, capture_output=True, timeout=self.timeout, check=True)
        return done.stdout.decode("utf-8", "replace").strip()


class HttpDescriber:
    """A chat server that takes images as data URLs."""

    def __init__(self, url: str, model: str, key_variable: str = "", timeout: float = 60.0):
        self.url, self.model, self.key_variable, self.timeout = url, model, key_variable, timeout

    def __call__(self, png: bytes) -> str:
        key = os.environ.get(self.key_variable, "") if self.key_variable else ""
        parts = [{"type": "text", "text": FIGURE}, {"type": "image_url", "image_url": {"url": as_data_url(png)}}]
        body = {"model": self.model, "messages": [{"role": "user", "content": parts}]}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as r:
            return json.load(r)["choices"][0]["message"]["content"].strip()
