"""Line dedup: repeated runs of lines from a suffix array by prefix doubling.

The lines of all documents, in the order of ids and then of lines, are one
sequence of line ids with a break after each document. Suffixes of it are
ranked by their first line, then by their first two lines, four and so on: the
rank for twice the length is the order of the pair of ranks at a line and that
many lines further on (Karp, Miller and Rosenberg; Manber and Myers). Ranks come
from a sort by ranges, so that no task sees them all. Lines whose suffix is
already unlike all others leave the rounds, which so shrink to what repeats and
end when every suffix is unique.

Suffixes of equal rank are an interval of the suffix array whose longest common
prefix has that length at least. Going back from the longest ranks to the
shortest, each interval is split by the ranks at its end, half as far each time,
which is a binary search for the longest common prefix: it gives each suffix the
deepest interval that holds an earlier one, and so the longest run of lines that
begins here and occurred before (``longest_earlier``). Of a class that moves on,
the earliest suffix stays behind for those that do not, as it has all in common
with them that the others have.

Of these runs those count that are in no longer one and hold ``min_words`` words
and ``min_lines`` lines at least. Their lines are deleted; the earliest copy of
each stays.

Defined results: lines end at newlines; a null text has no lines and stays
null; an empty text is one empty line; rows of equal id are ordered by a hash
of the text; equal rows get equal results, as none is later than the other;
null ids come first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialise, named, scope

PLACE = ("doc_id", "text_hash", "line")
MIN_WORDS = 5


def _place() -> Column:
    return F.struct(*PLACE)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, line, a, b, words): two hashes name a line's content."""
    t = named(text_col)
    rows = docs.select(named(id_col).alias("doc_id"), F.xxhash64(t).alias("text_hash"), F.posexplode(F.split(t, "\n", -1)).alias("line", "content"))
    words = F.regexp_count("content", F.lit(r"[^\x20\x09-\x0D]+"))
    return rows.select(*PLACE, F.xxhash64("content").alias("a"), F.xxhash64(F.lit("line"), "content").alias("b"), words.alias("words"))


def _ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys that rows at two places share, with ``rank`` in the keys' order and the first place of each."""
    met = rows.groupBy(*key).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first != last").drop("last")
    order = met.repartitionByRange(*key).sortWithinPartitions(*key)
    return materialise(order.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _with_ranks(rows: DataFrame, key: list[str], tag: str) -> DataFrame:
    ranks = _ranked(rows, key)
    known = ranks.select(*[F.col(k).alias(f"_{k}") for k in key], "rank", "first")
    # equal rows put equal lines in equal places; each place counts once
    out = materialise(rows.join(known, [F.col(k) == F.col(f"_{k}") for k in key]).drop(*key, *[f"_{k}" for k in key]).distinct(), tag)
    drop_table(ranks)
    return out


def _further(rows: DataFrame, by: Column | int, ranks: DataFrame, into: str, how: str) -> DataFrame:
    """Add the rank at the line that is ``by`` lines further on."""
    ahead = ranks.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("line").alias("_l"), F.col("rank").alias(into))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")) & (F.col("line") + by == F.col("_l"))
    return rows.join(ahead, same, how).drop("_d", "_h", "_l")


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """Ranks of the suffixes by their first 1, 2, 4 and so on lines: (doc_id, text_hash, line, rank, first).

    Each table holds the places whose lines stand at another place too, with the
    first such place; the first table also has ``words``.
    """
    out = [_with_ranks(lines, ["a", "b"], "ranks1")]
    while out[-1].limit(1).count():
        now = out[-1].select(*PLACE, F.col("rank").alias("before"), "rank")
        pairs = materialise(_further(now.drop("rank"), F.lit(1 << len(out) - 1), now, "after", "inner"), "pairs")
        out.append(_with_ranks(pairs, ["before", "after"], f"ranks{1 << len(out)}"))
        drop_table(pairs)
    return out[:-1]


def longest_earlier(levels: list[DataFrame]) -> DataFrame:
    """(doc_id, text_hash, line, size): the most lines that begin at a place and at an earlier one too, where there are any.

    ``state`` deals places into classes; ``first`` and ``size`` name a class: the
    earliest place and the lines that all share. A row whose ``own`` is false
    only stands for its place among the others of the class.
    """
    state: DataFrame | None = None
    for k in reversed(range(len(levels))):
        own = F.struct(*PLACE) != F.col("first")
        rows = levels[k].select(*PLACE, F.lit(1 << k).alias("size"), "first", own.alias("own"))
        if k + 1 < len(levels):
            # later copies of twice the length are dealt there; the first one stands for them
            gone = levels[k + 1].where(own).select(*[F.col(c).alias(f"_{c}") for c in PLACE])
            rows = rows.join(gone, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE], "left_anti")
        if k == 0:
            rows = rows.where("own")
        now = rows if state is None else _split(state.where("own or size > 1"), levels[k], 1 << k).unionByName(rows)
        now = materialise(now, "classes")
        if state is not None:
            drop_table(state)
        state = now
    return state.where("own").select(*PLACE, "size")


def _split(state: DataFrame, ranks: DataFrame, by: int) -> DataFrame:
    """Move the places on that agree with another of their class for ``by`` more lines."""
    ahead = _further(state, F.col("size"), ranks, "after", "left")
    met = ahead.where("after is not null").groupBy("first", "size", "after").agg(F.min(_place()).alias("least"), F.max(_place()).alias("most")).where("least != most")
    met = met.select(F.col("first").alias("_f"), F.col("size").alias("_s"), F.col("after").alias("_a"), "least")
    both = ahead.join(met, (F.col("first") == F.col("_f")) & (F.col("size") == F.col("_s")) & (F.col("after") == F.col("_a")), "left")
    row = lambda size, first, own: F.struct(*PLACE, size.alias("size"), first.alias("first"), own.alias("own"))
    stay, size, least = row(F.col("size"), F.col("first"), F.col("own")), F.col("size") + by, F.col("least")
    made = F.when(least.isNull(), F.array(stay)).when(_place() == least, F.array(stay, row(size, least, F.lit(False)))).otherwise(F.array(row(size, least, F.col("own"))))
    return both.select(F.explode(made).alias("r")).select("r.*")


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, min_lines: int = 1) -> DataFrame:
    """(doc_id, text_hash, first, size): the maximal runs of lines that are later copies, joined where they overlap or touch."""
    lines = materialise(lines_of(docs, id_col, text_col), "lines")
    levels = suffix_ranks(lines)
    drop_table(lines)
    if not levels:
        return lines_of(docs, id_col, text_col).where("false").select("doc_id", "text_hash", F.col("line").alias("first"), F.col("line").alias("size"))
    of_text = Window.partitionBy("doc_id", "text_hash")
    found = longest_earlier(levels).select("doc_id", "text_hash", F.col("line").alias("first"), (F.col("line") + F.col("size")).alias("end"))
    # ends never fall from one line to the next: a run that ends where the one before does is a part of it
    before = F.lag("end").over(of_text.orderBy("first"))
    whole = found.withColumn("before", before).where("before is null or end > before").where(F.col("end") - F.col("first") >= min_lines)
    counted = levels[0].select(*PLACE, "words", F.sum("words").over(of_text.orderBy("line")).alias("upto"))
    counted = materialise(counted, "counted")
    at = lambda n, c: counted.select(F.col("doc_id").alias(f"_d{n}"), F.col("text_hash").alias(f"_h{n}"), F.col("line").alias(f"_l{n}"), c.alias(f"_w{n}"))
    same = lambda n, line: F.col("doc_id").eqNullSafe(F.col(f"_d{n}")) & (F.col("text_hash") == F.col(f"_h{n}")) & (line == F.col(f"_l{n}"))
    rated = whole.join(at(0, F.col("upto") - F.col("words")), same(0, F.col("first"))).join(at(1, F.col("upto")), same(1, F.col("end") - 1))
    long = rated.where(F.col("_w1") - F.col("_w0") >= min_words).select("doc_id", "text_hash", "first", "end")
    fresh_run = F.coalesce((F.col("first") > F.lag("end").over(of_text.orderBy("first"))).cast("int"), F.lit(1))
    group = long.withColumn("new", fresh_run).withColumn("g", F.sum("new").over(of_text.orderBy("first")))
    joined = group.groupBy("doc_id", "text_hash", "g").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return joined.select("doc_id", "text_hash", "first", (F.col("end") - F.col("first")).alias("size"))


def _let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _without(x: Column) -> Column:
    """The lines of ``x`` outside its runs, which are in order and apart; each line is looked at once."""
    begin = F.concat(F.array(F.lit(0)), F.transform(x["runs"], lambda r: r["first"] + r["size"]))
    end = F.concat(F.transform(x["runs"], lambda r: r["first"]), F.array(F.size(x["lines"])))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda s: F.slice(x["lines"], s["b"] + 1, s["e"] - s["b"]))), "\n")


def dedup_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, min_lines: int = 1) -> DataFrame:
    """(doc_id, text, n_lines, n_deleted, runs) of every document: its text without later copies, and what went."""
    with scope(docs.sparkSession) as keep:
        gone = repeated_runs(docs, id_col, text_col, min_words, min_lines)
        by_text = gone.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
        runs = keep(materialise(by_text.agg(F.sort_array(F.collect_list(F.struct("first", "size"))).alias("runs")), "runs"))
    t = F.col("t")
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("t"))
    rows = rows.join(runs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64(t) == F.col("_h")), "left")
    lines = F.split(t, "\n", -1)
    none = F.array().cast("array<struct<first:int,size:int>>")
    return rows.select(
        "doc_id",
        F.when(F.col("runs").isNull(), t).otherwise(_let(F.struct(lines.alias("lines"), F.col("runs").alias("runs")), _without)).alias("text"),
        F.when(t.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("runs", F.lit(0), lambda s, r: s + r["size"]), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce("runs", none).alias("runs"),
    )
