"""URL filter: a blocked Bloom filter before an exact hash join.

A rule is a host and the beginning of a path, to block or to allow. It fits its
host and all subdomains of it where the path begins with the rule's; of several
that fit, the one longest in characters wins (then the longer host, then
allow). A URL that no rule fits is allowed.

Each rule's canonical form, host and path together, sets ``PROBES`` bits in one
block of the filter, a word. For a URL, the canonical forms of all rules that
could fit it are made from the ends of its host and the beginnings of its path,
in the lengths that rules have; those that the filter lacks are listed nowhere.
Only URLs with a possible hit take part in the join with the rules, which
removes the false positives, once for each distinct host and path.

The filter has ``BITS`` bits for each rule, as counted, up to ``MOST`` blocks (8
MB), so its size is bounded; with still more rules it lets more through, and the
join stays exact. URLs that the filter rules out take no part in any shuffle.

Defined results: a null URL or one without ``://`` has an empty host and path
and is allowed; repeated rows are repeated; the columns added replace those of
the same names; without rules all is allowed; null rules are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, named

PROBES = 4
BITS = 16  # a rule
USED = 62  # bits of a block's 64; a word then is never negative
LEAST, MOST = 64, 1 << 20  # blocks
ADDED = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return ascii_lower(host), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """The bits of a key in its block."""
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for n in range(PROBES):
        bit = (F.shiftrightunsigned(h, 15 * n).bitwiseAND(F.lit(0x7FFF)) % USED).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row with the array ``filter`` of a word for each of ``blocks`` blocks."""
    words = keys.groupBy(_block(F.col(key), blocks).alias("b")).agg(F.bit_or(_mask(F.col(key))).alias("w"))
    known = words.agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0).cast("long")))
    return known.select(dense.alias("filter"))


def judge_urls(pages: DataFrame, url_col: str, rules: DataFrame, broadcast_rules: int = 20_000) -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has host, path and verdict.

    At most ``broadcast_rules`` rules, as counted, are broadcast; beyond that
    they are joined by shuffle. The pages are read twice: those with a possible
    hit for the join, the others as they are.
    """
    canon = rules.where("host is not null and path is not null and verdict is not null").select(
        ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    canon = canon.groupBy("rule_host", "rule_path").agg(F.min("rule_verdict").alias("rule_verdict"))
    canon = canon.withColumn("key", F.concat("rule_host", F.lit("\n"), "rule_path"))
    shape = canon.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"), F.count("*").alias("n")
    ).first()
    kept = [c for c in pages.columns if c not in ADDED]
    # the url under a name that no column of the pages clashes with
    host, path = host_and_path(F.col("url"))
    at = pages.select(*[named(c).alias(f"_{n}") for n, c in enumerate(kept)], named(url_col).alias("url"))
    at = at.select(*[F.col(f"_{n}") for n in range(len(kept))], host.alias("host"), path.alias("path"))
    back = [F.col(f"_{n}").alias(c) for n, c in enumerate(kept)]
    if not shape["n"]:
        return at.select(*back, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))

    blocks = min(MOST, max(LEAST, -(-shape["n"] * BITS // 64)))
    words = F.lit(b"".join(w.to_bytes(8, "big") for w in bloom_filter(canon, "key", blocks).first()["filter"]))
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(shape["labels"]))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    begins = F.transform(F.filter(F.array(*map(F.lit, shape["lengths"])), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(ends, lambda e: F.transform(begins, lambda b: F.concat(e, F.lit("\n"), b))))
    block = lambda k: F.conv(F.hex(F.substring(words, _block(k, blocks) * 8 + 1, F.lit(8))), 16, 10).cast("long")
    listed = lambda k: block(k).bitwiseAND(_mask(k)) == _mask(k)
    tested = at.withColumn("hits", F.filter(keys, listed))

    hits = tested.where(F.size("hits") > 0).select("host", "path", "hits").distinct().select("host", "path", F.explode("hits").alias("k"))
    small = F.broadcast(canon) if shape["n"] <= broadcast_rules else canon
    fits = hits.join(small, F.col("k") == F.col("key"))
    best = F.max(F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("rule_verdict") == "allow", F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")))
    judged = fits.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(best.alias("best"))
    met = tested.where(F.size("hits") > 0).join(judged, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    with_rule = met.select(*back, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    without = tested.where(F.size("hits") == 0).select(*back, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return with_rule.unionByName(without)
