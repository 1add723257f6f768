"""Benchmark decontamination by winnowing.

Texts become words, words become hashes, and every run of ``GRAM`` words has a
rolling hash. Of each ``window - GRAM + 1`` consecutive ones the smallest is
kept (the rightmost of equal ones). A span of ``window`` words that two texts
share holds one such winnowing window whole, so both keep the same hash for it:
no shared span of that length can be missed. Kept hashes of the documents are
joined with those of the benchmark, and each hit is extended: the windows of
the document around it are looked up among the benchmark's windows and compared
word by word.

A benchmark of at most ``most_words`` words, as counted, goes to every task, and
both lookups are made there, without a shuffle. A larger one stays distributed:
kept hashes are joined by shuffle, then the windows around the hits are, and
only documents with a hit have their texts read again. Either way the documents
are passed over a fixed number of times, whatever the benchmark's size.

Items shorter than a window are one window of their own length; all grams of
that length are compared with them, as winnowing cannot vouch for them.

Defined results: a null text has no words; a document without words is not
contaminated; an item without words has no window; repeated items count once by
id, a null id as the empty string; repeated documents give repeated rows; an
empty benchmark leaves all documents clean; other columns are ignored, or kept
where whole documents are returned.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import fresh, held, materialise, named, scope

WINDOW, GRAM = 10, 5
#: A-Z to a-z, every other ASCII character but digits and letters to a space.
FOLD = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def hashes(words: list[bytes]) -> np.ndarray:
    """Word hashes that hold within one process: a block's windows and the documents are hashed in the same one."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each run of ``n`` word hashes, modulo 2**64."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + h[k : len(h) - n + 1 + k]
    return out ^ (out >> np.uint64(31))


def winnow(g: np.ndarray, width: int) -> np.ndarray:
    """Positions of the kept hashes: of each ``width`` consecutive ones the rightmost smallest."""
    if len(g) < width:
        return np.empty(0, np.int64)
    m = len(g) - width + 1
    best, at = g[:m].copy(), np.arange(m)
    for k in range(1, width):
        later = g[k : k + m]
        less = later <= best
        best[less] = later[less]
        at[less] = np.flatnonzero(less) + k
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


class Block:
    """One block of the benchmark: kept hashes, windows with their items, short items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        kept, self.at, self.short = [np.empty(0, np.uint64)], defaultdict(dict), defaultdict(lambda: defaultdict(dict))
        for item, text in items:
            w = words_of(text)
            h = hashes(w)
            if len(w) >= window:
                g = gram_hashes(h, GRAM)
                kept.append(g[winnow(g, window - GRAM + 1)])
                for i, x in enumerate(gram_hashes(h, window).tolist()):
                    self.at[x].setdefault(tuple(w[i : i + window]), set()).add(item)
            elif w:
                self.short[len(w)][gram_hashes(h, len(w)).tolist()[0]].setdefault(tuple(w), set()).add(item)
        self.kept = np.unique(np.concatenate(kept))
        self.short_keys = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in self.short.items()}

    def search(self, texts: list[str | None]) -> list[tuple[int, list[int], list[str]]]:
        """Of each text: its number of words, the positions of its hit words, its items; both sorted."""
        cut = [words_of(t) for t in texts]
        size = np.array([len(w) for w in cut], np.int64)
        first = np.concatenate(([0], np.cumsum(size)))
        words = [w for c in cut for w in c]
        h, n = hashes(words), self.window
        doc = np.repeat(np.arange(len(texts)), size)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        if len(self.kept) and len(words) >= n:
            g, width = gram_hashes(h, GRAM), n - GRAM + 1
            at = winnow(g, width)
            at = at[_among(g[at], self.kept)]
            if len(at):
                starts = np.unique(at[:, None] - np.arange(width))
                self._verify(words, h, self._inside(starts, n, doc), n, self.at, doc, found, items)
        for k, keys in self.short_keys.items():
            starts = np.flatnonzero(_among(gram_hashes(h, k), keys))
            self._verify(words, h, self._inside(starts, k, doc), k, self.short[k], doc, found, items)
        out = []
        for d, m in enumerate(size.tolist()):
            if d in found:
                hit = np.zeros(m + 1, np.int64)
                for i, j in found[d]:
                    hit[i - first[d]] += 1
                    hit[j - first[d]] -= 1
                out.append((m, np.flatnonzero(np.cumsum(hit)[:-1]).tolist(), sorted(items[d])))
            else:
                out.append((m, [], []))
        return out

    @staticmethod
    def _inside(starts: np.ndarray, n: int, doc: np.ndarray) -> np.ndarray:
        """Starts of spans of n words that lie in one text."""
        starts = starts[(starts >= 0) & (starts + n <= len(doc))]
        return starts[doc[starts] == doc[starts + n - 1]]

    @staticmethod
    def _verify(words, h, starts, n, known, doc, found, items) -> None:
        if len(starts):
            near = np.zeros((len(starts), n), np.uint64)
            for k in range(n):
                near[:, k] = h[starts + k]
            keys = gram_hashes(near.ravel(), n)[:: n]
            for i, x in zip(starts.tolist(), keys.tolist()):
                if (same := known.get(x)) and (own := same.get(tuple(words[i : i + n]))):
                    items[doc[i]] |= own
                    found[doc[i]].append((i, i + n))


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are in the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values


FOUND = "n_words", "hits", "items"  # number of words, positions of hit words, items found


def _searcher(items: list[tuple[str, str | None]], window: int, key: str, text_at: int, added: list[str]):
    """Add the three columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held(("benchmark", key), lambda: Block(items, window))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, hits, found = zip(*block.search(part.column(text_at).to_pylist()))
                cols = [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *added])

    return run


def stable_hashes(words: list[bytes]) -> np.ndarray:
    """Word hashes that hold across processes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _batch(cols: list, kinds: list, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names.split())


def _item_grams(window: int):
    """(n, gram) of each kept hash of an item; of a shorter item its own hash and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gram = [], []
            for text in batch.column(1).to_pylist():
                h = stable_hashes(words_of(text))
                if len(h) >= window:
                    g = gram_hashes(h, GRAM)
                    g = g[winnow(g, window - GRAM + 1)]
                else:
                    g = gram_hashes(h, len(h)) if len(h) else h
                gram += g.view(np.int64).tolist()
                n += [min(window, len(h))] * len(g)
            yield _batch([n, gram], [pa.int32(), pa.int64()], "n gram")

    return run


def _item_windows(window: int):
    """(n, words, item) of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(text)
                n = min(window, len(w))
                rows = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if w else []
                yield _batch([[n] * len(rows), rows, [item] * len(rows)], [pa.int32(), pa.binary(), pa.string()], "n words item")

    return run


def _document_grams(window: int, shorter: list[int]):
    """(a, b, n, gram, at) of each kept hash of a text, and of all runs as long as some shorter item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = stable_hashes(words_of(text))
                found = []
                if len(h) >= window:
                    g = gram_hashes(h, GRAM)
                    at = winnow(g, window - GRAM + 1)
                    found.append((window, g[at], at))
                found += [(k, g, np.arange(len(g))) for k in shorter for g in [gram_hashes(h, k)] if len(g)]
                for n, g, at in found:
                    size = len(g)
                    cols = [np.full(size, a), np.full(size, b), np.full(size, n, np.int32), g.view(np.int64), at.astype(np.int32)]
                    yield _batch(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()], "a b n gram at")

    return run


def _document_windows(window: int):
    """(a, b, n, start, words) of the windows around the hits of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text, hits in zip(*(c.to_pylist() for c in batch.columns)):
                w = words_of(text)
                spans = {(h["n"], h["at"] - k) for h in hits for k in range(window - GRAM + 1 if h["n"] == window else 1)}
                spans = sorted((n, i) for n, i in spans if 0 <= i <= len(w) - n)
                cols = [[a] * len(spans), [b] * len(spans), [n for n, _ in spans], [i for _, i in spans], [b" ".join(w[i : i + n]) for n, i in spans]]
                yield _batch(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], "a b n start words")

    return run


def _joined(docs: DataFrame, text_col: str, items: DataFrame, window: int, added: list[str]) -> DataFrame:
    """Add the three columns by joins of fingerprints, then of windows; texts go by two hashes."""
    text = F.coalesce(named(text_col), F.lit(""))
    hashed = [F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit("text")).alias("b")]
    texts = docs.select(*hashed, text.alias("t"))
    with scope(docs.sparkSession) as keep:
        grams = materialise(items.mapInArrow(_item_grams(window), "n int, gram long").distinct(), "grams")
        windows = materialise(items.mapInArrow(_item_windows(window), "n int, words binary, item string").distinct(), "windows")
        shorter = sorted(r["n"] for r in grams.where(F.col("n") < window).select("n").distinct().collect())
        own = texts.mapInArrow(_document_grams(window, shorter), "a long, b long, n int, gram long, at int")
        near = own.join(grams, ["n", "gram"], "left_semi").groupBy("a", "b").agg(F.collect_set(F.struct("n", "at")).alias("hits"))
        near = materialise(near, "near")
        again = texts.join(near, ["a", "b"]).dropDuplicates(["a", "b"]).select("a", "b", "t", "hits")
        around = again.mapInArrow(_document_windows(window), "a long, b long, n int, start int, words binary")
        hits = materialise(around.join(windows, ["n", "words"], "left_semi"), "hits")
        spans = F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
        places = hits.groupBy("a", "b").agg(F.array_sort(F.array_distinct(spans)).alias("hits"))
        met = hits.select("a", "b", "n", "words").distinct().join(windows, ["n", "words"]).select("a", "b", "item").distinct()
        found = places.join(met.groupBy("a", "b").agg(F.sort_array(F.collect_set("item")).alias("items")), ["a", "b"])
        found = keep(materialise(found, "found"))
    i, j = fresh(docs, "a", "b")
    out = docs.join(found.select(F.col("a").alias(i), F.col("b").alias(j), F.col("hits").alias(added[1]), F.col("items").alias(added[2])), (hashed[0] == F.col(i)) & (hashed[1] == F.col(j)), "left")
    n = F.coalesce(F.regexp_count(named(text_col), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    none = F.array().cast
    return out.select(*map(named, docs.columns), n.alias(added[0]), F.coalesce(added[1], none("array<int>")).alias(added[1]), F.coalesce(added[2], none("array<string>")).alias(added[2]))


def _annotate(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, window: int, most_words: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with the columns of ``FOUND``, and what they are called."""
    if window < GRAM:
        raise ValueError(f"the window must have {GRAM} words at least")
    added = fresh(docs, *FOUND)
    items = benchmark.select(F.coalesce(named(item_col).cast("string"), F.lit("")).alias("i"), named(item_text).alias("t")).where(F.length("t") > 0)
    size = items.agg(F.sum(F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).alias("words"), F.sum(F.length("t")).alias("chars")).first()
    if (size["words"] or 0) > most_words or (size["chars"] or 0) > 16 * most_words:
        return _joined(docs, text_col, items, window, added), added
    known = [(r["i"], r["t"]) for r in items.collect()]
    key = hashlib.sha256(repr((window, known)).encode()).hexdigest()
    schema = StructType([*docs.schema.fields, *map(StructField, added, (LongType(), ArrayType(IntegerType()), ArrayType(StringType())))])
    return docs.mapInArrow(_searcher(known, window, key, docs.columns.index(text_col), added), schema), added


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, most_words: int = 2_000_000,
) -> DataFrame:
    """(doc_id, n_words, n_hit, hits, items) of every document.

    ``hits`` are the positions of the hit words, ``items`` the ids, as strings
    and sorted, of the items with a window in the document.
    """
    source = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    found, (n, hits, items) = _annotate(source, "text", benchmark, item_col, item_text, window, most_words)
    return found.select("doc_id", F.col(n).alias("n_words"), F.size(hits).cast("long").alias("n_hit"), F.col(hits).alias("hits"), F.col(items).alias("items"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, most_words: int = 2_000_000
) -> DataFrame:
    """The documents, with all their columns, that no window of the benchmark occurs in."""
    found, (n, hits, items) = _annotate(docs, text_col, benchmark, item_col, item_text, window, most_words)
    return found.where(F.size(hits) == 0).drop(n, hits, items)
