"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell, a combination of source, language and topic. The
cells' tokens are raked: for one dimension after another they are scaled so that
its sums meet the target shares, until the largest step is within a tolerance; a
warning tells of targets that cannot be met together. Shares of values that hold
no tokens are dealt to the others in proportion. A cell's factor is the product
of those of its values. A document is kept with a probability proportional to
its factor, scaled so that the expected tokens are ``keep_share`` of all;
probabilities above one are set to one and the rest scaled up, until all hold.
Whether a document is kept follows from a hash of its id, so a run can be
repeated.

Only sums leave the documents' partitions. The rounds run over the table of
cells; the driver holds the factors of the values that have a target, which are
as many as the caller gave, and documents look them up where they are, without a
join on cells, the largest of which may hold a third of all rows.

Defined results: a null in a dimension is a value of its own, ``(none)``; a value
without a target has target zero and its documents go, or, with ``rest``, all
values of the dimension without a target keep their observed share of the tokens
together and those with one divide what is left; targets that are empty
for a dimension leave that dimension as it is; documents without tokens are kept
with the probability of their cell; a null id has a hash of its own; repeated
rows share their fate; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, named

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"


def tokens_in(text: Column) -> Column:
    """Words between white space, as a cheap stand-in for tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rules_topic(text: Column, rules: Mapping[str, str], other: str) -> Column:
    """The first topic whose pattern the whole text holds."""
    out = F.lit(other)
    for topic, pattern in reversed(rules.items()):
        out = F.when(text.rlike(pattern), F.lit(topic)).otherwise(out)
    return out


def unit_hash(id_col: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the id as text."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def cells_of(rows: DataFrame) -> DataFrame:
    """Documents and tokens by cell; ``rows`` has the dimensions and tokens."""
    return rows.groupBy(*DIMENSIONS).agg(F.count("*").alias("docs"), F.sum("tokens").cast("double").alias("tokens"))


def _looked_up(rows: DataFrame, values: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Add ``_f_`` and the dimension's name: the value of a mapping that the driver holds; null where it has none."""
    pairs = {d: F.from_json(F.lit(json.dumps(dict(v))), "map<string,double>") for d, v in values.items()}
    small = [d for d, v in values.items() if len(v) <= 200]
    out = rows.select("*", *[F.element_at(pairs[d], F.col(d)).alias(f"_f_{d}") for d in small])
    for d in values.keys() - small:
        found = rows.sparkSession.range(1).select(F.explode(pairs[d]).alias(f"_k_{d}", f"_f_{d}"))
        out = out.join(F.broadcast(found) if len(values[d]) <= 20_000 else found, F.col(d) == F.col(f"_k_{d}"), "left").drop(f"_k_{d}")
    return out


@dataclass
class Factors:
    """By dimension: a factor for each value with a target, one for all others; and the largest step of the last round."""

    values: dict[str, dict[str, float]]
    others: dict[str, float]
    error: float = 0.0

    def of(self, rows: DataFrame, into: str) -> DataFrame:
        """Add the product of the factors of a row's values."""
        found = _looked_up(rows, self.values)
        product = reduce(lambda w, d: w * F.coalesce(F.col(f"_f_{d}"), F.lit(self.others[d])), self.values, F.lit(1.0))
        return found.withColumn(into, product).drop(*[f"_f_{d}" for d in self.values])


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], rounds: int = 100, tolerance: float = 1e-9, rest: bool = False) -> Factors:
    """The factors that make the cells' tokens meet the target shares.

    All that a step has to learn is the sums for the values that have a target,
    and for all others together.
    """
    live = {d: dict(t) for d, t in targets.items() if t}
    out = Factors({d: dict.fromkeys(t, 1.0) for d, t in live.items()}, dict.fromkeys(live, 1.0))
    kept = dict.fromkeys(live, 0.0)  # the shares that the values without a target are to have
    if rest and live:
        unlisted = [F.sum(F.when(F.col(f"_f_{d}").isNull(), F.col("tokens")).otherwise(0.0)).alias(f"_s_{d}") for d in live]
        met = _looked_up(cells, out.values).agg(F.sum("tokens").alias("whole"), *unlisted).first()
        kept = {d: met[f"_s_{d}"] / met["whole"] if met["whole"] else 0.0 for d in live}
    for _ in range(rounds):
        out.error = 0.0
        for d, shares in live.items():
            value = F.when(F.col(f"_f_{d}").isNotNull(), F.col(d))  # all others count as one
            now = _looked_up(out.of(cells, "factor"), {d: shares})
            met = now.groupBy(value.alias("v")).agg(F.sum(F.col("tokens") * F.col("factor")).alias("w")).collect()
            whole = sum(r["w"] or 0.0 for r in met)
            sums = {r["v"]: r["w"] for r in met if r["v"] is not None and r["w"] > 0}
            total = sum(max(0.0, shares[v]) for v in sums)
            left = sum(r["w"] for r in met if r["v"] is None and r["w"])
            share = (kept[d] if total > 0 else 1.0) if rest and left > 0 else 0.0
            steps = {None: share * whole / left if left > 0 else 0.0}
            steps |= {v: shares[v] / total * (1 - share) * whole / sums[v] if v in sums and total > 0 else 0.0 for v in shares}
            out.error = max([out.error, *(abs(x - 1) for x in steps.values() if x > 0)])
            out.others[d] *= steps.pop(None)
            for v, x in steps.items():
                out.values[d][v] *= x
        if out.error <= tolerance:
            break
    if out.error > tolerance:
        warnings.warn(f"the targets were not met after {rounds} rounds: the last one still changed a sum by {out.error:.2g} of itself", stacklevel=2)
    return out


def scale_of(cells: DataFrame, keep_share: float, rounds: int = 50) -> float:
    """What factors are multiplied by to get probabilities: the expected tokens are ``keep_share`` of all, as far as the cells allow."""
    goal = (cells.agg(F.sum("tokens")).first()[0] or 0.0) * keep_share
    scale = 0.0
    for _ in range(rounds):
        full = F.col("factor") * scale >= 1
        r = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("t"), F.sum(F.when(full, 0.0).otherwise(F.col("factor") * F.col("tokens"))).alias("w")).first()
        if not r["w"] or goal <= r["t"]:
            break
        nxt = (goal - r["t"]) / r["w"]
        if nxt <= scale * (1 + 1e-12):
            break
        scale = nxt
    return scale


def mix(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column, targets: Mapping[str, Mapping[str, float]], keep_share: float = 0.5,
    rest: bool = False, carry: bool = True,
) -> DataFrame:
    """Every document with its cell, ``tokens``, ``factor``, ``probability`` and ``kept``.

    With ``carry`` there is a struct ``row`` of the document's own columns, and
    the texts are read twice, for the sums and for the result; without it
    they are read once.
    """
    value = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    row = [F.struct(*map(named, docs.columns)).alias("row")] if carry else []
    rows = docs.select(
        *row, named(id_col).alias("doc_id"), value(named(source_col)).alias("source"), value(named(lang_col)).alias("lang"), value(topic).alias("topic"),
        tokens_in(named(text_col)).alias("tokens"),
    )
    if not carry:
        rows = materialise(rows, "rows")
    cells = materialise(cells_of(rows), "cells")
    factors = rake(cells, targets, rest=rest)
    scale = scale_of(factors.of(cells, "factor"), keep_share)
    drop_table(cells)
    out = factors.of(rows, "factor").withColumn("probability", F.least(F.lit(1.0), F.col("factor") * scale))
    return out.withColumn("kept", unit_hash(F.col("doc_id")) < F.col("probability"))
