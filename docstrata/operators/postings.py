"""An inverted index for relevance (F22-F24, O2, P13): which chunks hold which words.

A chunk is tokenised once, whatever number of peripherals it may belong to, and
a keyword set meets only chunks that hold one of its words: keywords and
postings join on the word, and a score is a count of such meetings over the size
of the set.

Words are of very uneven frequency. Postings of a word that has more than its
share of all of them are split by a hash of the chunk over as many tasks as they
would fill, and the keywords, which are few, go to each of these.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.relevance import tokenize

MIN_SCORE = 0.1
TOP = 5
TASK = 100_000  # postings of one word that go to one task
SHARE = 10_000  # words with more than this fraction of all postings can be split: at most so many
SALTS = 16  # tasks for each word where frequencies are not known
FEW = 100_000  # keywords of all sets that go to each task whole
BLOCK = 256  # sets of a word in one row
MEETINGS = 1_000_000  # meetings of sets and chunks, word by word, that a task counts at once


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(term, chunk_id), each pair once; a null text has no words.

    A plain explode would make the words of a text again in a filter of empty arrays, which the optimizer puts before it.
    """
    return chunks.select(F.explode_outer(tokenize(F.col(text_col))).alias("term"), F.col(id_col).alias("chunk_id")).where("term is not null")


def frequencies(rows: DataFrame) -> DataFrame:
    """(term, chunks): in how many chunks each word is."""
    return rows.groupBy("term").agg(F.count("*").alias("chunks"))


def heavy(counted: DataFrame, task: int = TASK, share: int = SHARE, total: int | None = None) -> DataFrame:
    """(term, tasks) of the words whose postings are split, at most ``share`` of them; ``total`` is the sum of all, if known."""
    if total is None:
        total = counted.agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]
    return counted.where(F.col("chunks") > max(task, total // share)).select("term", F.ceil(F.col("chunks") / task).cast("int").alias("tasks"))


def hits(rows: DataFrame, keyed: DataFrame, group: list[str], split: DataFrame | None = None) -> DataFrame:
    """(group, chunk_id, hits): how many of a set's keywords each chunk holds; no row without one.

    ``keyed`` has the columns of ``group`` and the array ``keys`` of different words.
    """
    held, asked = salted(rows, keyed.select(*group, F.explode("keys").alias("term")), split)
    return held.join(asked, ["term", "_salt"]).groupBy(*group, "chunk_id").agg(F.count("*").alias("hits"))


def salted(rows: DataFrame, words: DataFrame, split: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings and keywords with the number of the task, of their word's, to which they go."""
    number = lambda n: F.pmod(F.xxhash64("chunk_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    if split is None:
        return rows.withColumn("_salt", number(F.lit(SALTS))), words.withColumn("_salt", each(F.lit(SALTS)))
    few = F.broadcast(split)
    held = rows.join(few, "term", "left").withColumn("_salt", F.when(F.col("tasks").isNull(), 0).otherwise(number(F.coalesce("tasks", F.lit(1))))).drop("tasks")
    return held, words.join(few, "term", "left").withColumn("_salt", each(F.coalesce("tasks", F.lit(1)))).drop("tasks")


def top_counts(most: int, meetings: int = MEETINGS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(set, chunk_id, hits) of rows (chunk_id, sets) in the order of chunks, one for each word of a chunk that is in some set.

    Rows are counted when they hold so many ``meetings`` of sets and chunks. Of those a set's chunks of most hits are given, ties to the smaller id.
    """

    def counted(rows: pa.Table, chunk: np.ndarray) -> pa.RecordBatch:
        sets = rows.column(1).combine_chunks()
        values, n = sets.flatten().to_numpy(), int(chunk[-1]) + 1
        known = np.unique(values)
        pairs = np.searchsorted(known, values) * n + np.repeat(chunk, sets.value_lengths().to_numpy())
        if n * len(known) <= 8 * len(values):
            counts = np.bincount(pairs)
            pairs = np.flatnonzero(counts)
            hits = counts[pairs]
        else:
            pairs, hits = np.unique(pairs, return_counts=True)
        of, where = np.divmod(pairs, n)
        order = np.argsort(of * (hits.max() + 1) - hits, kind="stable")  # pairs are in the order of chunks
        kept = order[np.arange(len(of)) - np.searchsorted(of, of) < most]
        first = np.searchsorted(chunk, where[kept])
        return pa.RecordBatch.from_arrays([pa.array(known[of[kept]]), rows.column(0).take(pa.array(first)).combine_chunks(), pa.array(hits[kept])], ["set", "chunk_id", "hits"])

    def numbered(rows: pa.Table) -> np.ndarray:
        # ids are in order, so that a number for each new one keeps it
        return rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(1).flatten())
            if size >= meetings:
                rows = pa.Table.from_batches(held)
                chunk = numbered(rows)
                cut = int(np.searchsorted(chunk, chunk[-1]))  # the last chunk may go on
                if cut:
                    yield counted(rows.slice(0, cut), chunk[:cut])
                held, size = rows.slice(cut).to_batches(), 0
        if sum(b.num_rows for b in held):
            rows = pa.Table.from_batches(held)
            yield counted(rows, numbered(rows))

    return run


def best(scored: DataFrame, group: list[str], most: int = TOP, id_col: str = "chunk_id") -> DataFrame:
    """The best ``most`` of each group, ties to the smaller id; tasks keep so many before they send any."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def rank_all(rows: DataFrame, keyed: DataFrame, group: list[str], most: int = TOP, least: float = MIN_SCORE, split: DataFrame | None = None) -> DataFrame:
    """(group, rank, chunk_id, score) over all chunks of the index with a score of ``least``, which is above zero."""
    sizes = keyed.select(*group, F.size("keys").alias("_size"))
    scored = hits(rows, keyed, group, split).join(sizes, group).select(*group, "chunk_id", (F.col("hits") / F.col("_size")).alias("score"))
    return best(scored.where(F.col("score") >= least), group, most)


def rank_pairs(pairs: DataFrame, rows: DataFrame, keyed: DataFrame, group: list[str], most: int = TOP, least: float = MIN_SCORE, split: DataFrame | None = None) -> DataFrame:
    """The best of given (group, chunk) pairs, with all their columns.

    Without keywords the order of ids counts and there is no threshold; pairs
    without a hit have a score of zero.
    """
    sized = pairs.join(keyed.select(*group, F.size("keys").alias("_size")), group, "left")
    scored = sized.join(hits(rows, keyed, group, split), [*group, "chunk_id"], "left")
    none = F.coalesce("_size", F.lit(0)) == 0
    score = F.when(none, 0.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("_size"))
    kept = scored.withColumn("score", score).where(none | (F.col("score") >= least)).drop("hits", "_size")
    return best(kept, group, most)


@dataclass
class PostingIndex:
    """Postings on disk, in segments: each task writes those of its own chunks, in the order of words.

    A look-up of few words opens the row groups and pages that may hold them; no
    posting is shuffled to be written. Frequencies say which words are split.
    """

    spark: SparkSession
    path: str

    def build(self, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> PostingIndex:
        self._put(postings(chunks, id_col, text_col))
        return self

    def extend(self, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> PostingIndex:
        """Chunks whose ids the index does not have yet."""
        self._put(postings(chunks, id_col, text_col))
        return self

    def _put(self, rows: DataFrame) -> None:
        rows.sortWithinPartitions("term").write.mode("append").parquet(f"{self.path}/postings")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("term string, chunk_id string").parquet(f"{self.path}/postings")

    def frequencies(self) -> DataFrame:
        return frequencies(self.rows())

    def holding(self, words: list[str]) -> DataFrame:
        """(term, chunk_id) of some words; the filter reaches the scan."""
        return self.rows().where(F.col("term").isin([w.lower() for w in words]))

    def rank(self, keyed: DataFrame, group: list[str], most: int = TOP, least: float = MIN_SCORE) -> DataFrame:
        """As :func:`rank_all`, over the index.

        Sets get numbers, which are written. Postings of their words go to the task of their chunk, with the sets of the
        word; what is counted there stays there, but for each set's best: no pair of set and chunk is shuffled.
        """
        path = f"{self.path}/asked/{uuid.uuid4().hex}"
        keyed.select(*group, "keys", F.monotonically_increasing_id().alias("set")).write.parquet(path)
        asked = self.spark.read.parquet(path)
        words = asked.select("set", F.explode("keys").alias("term"))
        blocks = -(-asked.count() // BLOCK) or 1
        in_block = F.pmod(F.xxhash64("set"), F.lit(blocks)).cast("int").alias("block")
        by_word = lambda rows, *key: rows.groupBy(*key, in_block).agg(F.collect_list("set").alias("sets"))
        if words.count() <= FEW:
            met = self.rows().join(F.broadcast(by_word(words, "term")), "term")
        else:
            held = self.rows().join(words.select("term").distinct(), "term", "left_semi")
            rows, salty = salted(self.rows(), words, heavy(frequencies(held), total=self.rows().count()))
            met = rows.join(by_word(salty, "term", "_salt"), ["term", "_salt"])
        chunks = met.select("chunk_id", "sets").repartition("chunk_id").sortWithinPartitions("chunk_id")
        counted = chunks.mapInArrow(top_counts(most), "set long, chunk_id string, hits long")
        scored = counted.join(asked.select("set", *group, F.size("keys").alias("_size")), "set").select(*group, "chunk_id", (F.col("hits") / F.col("_size")).alias("score"))
        return best(scored.where(F.col("score") >= least), group, most)


def keyword_sets(rows: DataFrame, group: list[str], keys: Column) -> DataFrame:
    """One row a group with its ``keys``."""
    return rows.select(*group, keys.alias("keys")).dropDuplicates(group)
