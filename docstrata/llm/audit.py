"""Interaction audit of document filters: every order of the filters, replayed row by row.

Each document gets the mask of the filters that it fails. All documents are
crossed with the 120 orders of the five filters, a broadcast table of fixed
size, and each such pair is exploded into the five steps of its order. The
first step whose filter the document fails removes it. One conditional
aggregate counts what each step keeps and removes; it combines in the tasks, so
that no more than a row for each part, order and step leaves a task.

Failure conditions (null text: empty; words: runs of other than white space):

    A   under 100 words
    B   100 * distinct words < 80 * words
    C   100 * letters A-Z > 10 * code points
    D   holds one of # $ % & * |
    E   identical to the text of a smaller doc_id, wherever that is

Equal texts are told by their SHA-256 and the smallest id of each comes from a
partial aggregate. Texts with a thousandth of all rows or more, at most a
thousand of them, are looked up by broadcast and take part in no join by key.

Defined results: a null text is empty and equals other empty texts; texts of any
length are taken whole; a null ``doc_id`` is smaller than none, has none smaller
and no label; rows that repeat a ``doc_id`` count each, and none is smaller than
the other; labels of one id that contradict each other count as 1 if one is 1, null labels
as 0; a null language is the part of the empty string; columns of other names
are ignored; an empty table has no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, materialise, named

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = r"[#$%&*|]"
HOT_SHARE = 1000  # texts with this fraction of all rows are looked up by broadcast


def text_failures(text: Column) -> list[Column]:
    """A to D of a text that is not null."""
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n = F.when(trimmed == "", 0).otherwise(F.size(words)).cast("long")
    distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words))).cast("long")
    length = F.length(text).cast("long")
    capitals = length - F.length(F.translate(text, UPPER, ""))
    return [n < 100, distinct * 100 < n * 80, capitals * 100 > length * 10, text.rlike(SYMBOLS)]


def _earlier_copy(rows: DataFrame) -> DataFrame:
    """Add E to rows of (doc_id, digest, ...): some smaller id has this digest."""
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    total = rows.count()
    hot = F.col("n") * HOT_SHARE >= max(total, 1)
    many = F.broadcast(first.where(hot).select(F.col("digest").alias("m_digest"), F.col("first").alias("m_first")))
    few = first.where(~hot).select(F.col("digest").alias("f_digest"), F.col("first").alias("f_first"))
    known = rows.join(many, F.col("digest") == F.col("m_digest"), "left")
    smaller = lambda c: F.coalesce(F.col("doc_id") > F.col(c), F.lit(False))
    told = known.where(F.col("m_first").isNotNull()).select(*rows.columns, smaller("m_first").alias("copy"))
    rest = known.where(F.col("m_first").isNull()).select(*rows.columns).join(few, F.col("digest") == F.col("f_digest"), "left")
    return told.unionByName(rest.select(*rows.columns, smaller("f_first").alias("copy")))


def failures(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, label_id: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(doc_id, part, mask, good, toxic) of each row; bit n of the mask is filter n of ``FILTERS``."""
    text = F.coalesce(named(text_col), F.lit(""))
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(c, F.lit(1 << n)).otherwise(0) for n, c in enumerate(text_failures(F.col("text")))), F.lit(0))
    # texts are read once; what follows needs a few bytes a row, and needs them more than once
    rows = materialise(rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "flags")
    mark = lambda c: F.max(F.when(named(c) == 1, 1).otherwise(0))
    marks = labels.where(named(label_id).isNotNull()).groupBy(named(label_id).cast("long").alias("l_id")).agg(mark(good_col).alias("good"), mark(toxic_col).alias("toxic"))
    # null ids go to many tasks in place of one; the other half of the key keeps them from any label
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    out = _earlier_copy(rows).withColumn("spread", spread).join(marks.withColumn("l_spread", F.lit(0).cast("long")), (F.col("doc_id") == F.col("l_id")) & (F.col("spread") == F.col("l_spread")), "left")
    whole = F.col("mask") + F.when(F.col("copy"), 1 << 4).otherwise(0)
    return out.select("doc_id", "part", whole.cast("int").alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def replay(flags: DataFrame) -> DataFrame:
    """Counts for each (part, filter_order, step) of rows of (part, mask, good, toxic)."""
    orders = flags.sparkSession.createDataFrame(
        [(n, *[1 << FILTERS.index(x) for x in o], [(step, 1 << FILTERS.index(x)) for step, x in enumerate(o, 1)]) for n, o in enumerate(ORDERS)],
        "n int, b1 int, b2 int, b3 int, b4 int, b5 int, steps array<struct<step:int,bit:int>>",
    )
    hit = lambda n: F.col("mask").bitwiseAND(F.col(f"b{n}")) != 0
    first = F.when(hit(1), 1).when(hit(2), 2).when(hit(3), 3).when(hit(4), 4).when(hit(5), 5).otherwise(6)
    pairs = flags.crossJoin(F.broadcast(orders)).select("part", "n", "mask", "good", "toxic", "steps", first.alias("first"))
    each = pairs.select("part", "n", "mask", "good", "toxic", "first", F.inline("steps"))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    now = F.col("first") == F.col("step")
    counts = {
        "kept": F.col("first") > F.col("step"),
        "removed": now,
        "redundant": fails & (F.col("first") < F.col("step")),
        "unique_fails": F.col("mask") == F.col("bit"),
        "good_lost": now & (F.col("good") == 1),
        "toxic_lost": now & (F.col("toxic") == 1),
    }
    added = each.groupBy("part", "n", "step").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    named_order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("n") + 1)
    added = added.select("part", named_order.alias("filter_order"), "step", *counts)
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    # at most 120 rows for each part and letter, whatever the number of documents
    return added.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return replay(failures(docs, labels, id_col, text_col, part_col))
