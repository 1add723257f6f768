"""Extraction, normalisation and scoring of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, strip, words

# Patterns and tables that decide what counts as an answer.
HEX = r"0[xX][0-9A-Fa-f]+"
BITS = r"\[(\d+)(?::(\d+))?\]"
BITS_TO = "(?i)(?:bits?\\s+)?(\\d+)\\s*(?:[-–—]|to\\s*(?:bit\\s*)?)\\s*(\\d+)"
BIT = r"(?i)\bbit\s+(\d{1,2})\b"
ACCESS = r"(?i)\b(RO|RW|WO|W1|RW1|read[- ]?only|write[- ]?only|read[- ]?write|read/write|write[- ]?once|read[- ]?write[- ]?once)\b"
CONFIDENCE = (
    (r"(?i)(?:confidence|confident|certain)\s*[:=]?\s*(\d{1,3})%", 100),
    (r"(?i)(\d{1,3})%\s*(?:confidence|confident|certain)", 100),
    (r"(?i)(?:confidence|confident|certain)\s*[:=]\s*(0\.\d+|1\.0|0|1)\b", 1),
)
UNITS = "MHz|kHz|GHz|Hz|mV|volts|volt|V|uA|µA|mA|amps|amp|A|ns|us|µs|ms|sec|s|KB|MB|MSPS|ksps|SPS|wait\\s+states?"
NUMBER = r"(-?\d+\.?\d*)"
NUMERIC = rf"(?iu){NUMBER}\s*({UNITS})(?:\b|$)"
RANGE = "(-?\\d+\\.?\\d*)\\s*([a-zA-Z°µ]*)\\s*(?:to|-|–|—)\\s*(-?\\d+\\.?\\d*)\\s*([a-zA-Z°µ]*)"
ANSWER = r"(?i)(?:is|=|:)\s+(.+?)(?:\.|,|\n|$)"
ITEM = "[,\\n]|(?:^|\\n)\\s*[-•*]\\s*|(?:^|\\n)\\s*\\d+\\.\\s*"
STOPWORDS = ("a", "an", "the", "is", "are", "of", "on", "in", "to", "for", "it", "and", "or", "that", "this", "was", "be", "at", "by")
UNIT_TABLE = {
    "hz": ("Hz", 1.0), "khz": ("Hz", 1e3), "mhz": ("Hz", 1e6), "ghz": ("Hz", 1e9), "v": ("V", 1.0), "volt": ("V", 1.0), "volts": ("V", 1.0),
    "mv": ("V", 1e-3), "a": ("A", 1.0), "amp": ("A", 1.0), "amps": ("A", 1.0), "ma": ("A", 1e-3), "ua": ("A", 1e-6), "µa": ("A", 1e-6),
    "s": ("s", 1.0), "sec": ("s", 1.0), "ms": ("s", 1e-3), "us": ("s", 1e-6), "µs": ("s", 1e-6), "ns": ("s", 1e-9), "kb": ("B", 1024.0),
    "mb": ("B", 1048576.0), "msps": ("SPS", 1e6), "ksps": ("SPS", 1e3), "sps": ("SPS", 1.0), "°c": ("°C", 1.0), "°f": ("°F", 1.0),
}
ACCESS_CODES = {
    "ro": "RO", "readonly": "RO", "rw": "RW", "readwrite": "RW", "wo": "WO", "writeonly": "WO", "w1": "W1", "writeonce": "W1", "rw1": "RW1", "readwriteonce": "RW1",
}
TOLERANCE = 1e-6


def lookup(key: Column, table: dict) -> Column:
    """Value of a constant table; null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def first(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group; null without a match, and for a group that took no part the empty string."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def hit(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, which cannot be empty; null without a match. One search."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(c), use), 1)


def yes(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


# Normal forms


def normalize_hex(c: Column) -> Column:
    """F41."""
    up = F.upper(strip(c))
    d = F.ltrim(F.when(up.startswith("0X"), F.substring(up, F.lit(3), F.length(up))).otherwise(up), F.lit("0"))
    n = F.length(d)
    return F.concat(F.lit("0x"), F.when(n <= 4, F.lpad(d, 4, "0")).when(n <= 8, F.lpad(d, 8, "0")).otherwise(d))


def _bracket(c: Column) -> Column:
    return hit(c, BITS)


def _between(c: Column) -> Column:
    def of(n: Column) -> Column:
        low, high = F.least(n[0], n[1]).cast("string"), F.greatest(n[0], n[1]).cast("string")
        return F.when(F.size(n) == 2, F.when(n[0] == n[1], F.concat(F.lit("["), high, F.lit("]"))).otherwise(F.concat(F.lit("["), high, F.lit(":"), low, F.lit("]"))))

    # a match has two numbers and no other digit
    return let(F.transform(F.regexp_extract_all(F.regexp_extract(c, BITS_TO, 0), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("decimal(38,0)")), of)


def normalize_bits(c: Column) -> Column:
    """F42."""
    return let(strip(c), lambda t: F.coalesce(_bracket(t), _between(t), F.concat(F.lit("["), hit(t, r"\d+"), F.lit("]")), t))


def normalize_access(c: Column) -> Column:
    """F43."""
    return F.coalesce(lookup(F.regexp_replace(F.lower(strip(c)), "[- /]", ""), ACCESS_CODES), F.upper(strip(c)))


def _factor(unit: Column) -> Column:
    """Struct(unit, factor) of a unit as written; null for an unknown one."""
    pairs = [x for k, (u, f) in UNIT_TABLE.items() for x in (F.lit(k), F.struct(F.lit(u).alias("unit"), F.lit(f).alias("factor")))]
    known = F.try_element_at(F.create_map(*pairs), unit)
    return F.when(unit.contains("wait"), F.struct(F.lit("wait_states").alias("unit"), F.lit(1.0).alias("factor"))).otherwise(known)


def _number(c: Column) -> Column:
    """The first number; null without one."""
    return hit(c, NUMBER).try_cast("double")


def normalize_numeric(c: Column) -> Column:
    """struct(value, unit)."""

    def of(t: Column) -> Column:
        def split(m: Column) -> Column:
            number = F.regexp_extract(m, rf"^{NUMBER}", 1)
            return F.struct(number.try_cast("double").alias("n"), F.lower(strip(F.substring(m, F.length(number) + 1, F.length(m)))).alias("u"))

        def measured(s: Column) -> Column:
            known = let(
                _factor(s["u"]), lambda f: F.struct((s["n"] * F.coalesce(f["factor"], F.lit(1.0))).alias("value"), F.coalesce(f["unit"], F.lit("")).alias("unit"))
            )
            bare = F.struct(F.coalesce(_number(t), F.lit(0.0)).alias("value"), F.lit("").alias("unit"))
            return F.when(s["u"] != "", known).otherwise(bare)

        # one search finds number and unit; what it found is taken apart
        return let(let(F.regexp_extract(t, NUMERIC, 0), split), measured)

    return let(strip(c), of)


# Extraction


def extract_hex(c: Column) -> Column:
    """F32."""
    bare = let(hit(c, r"\b([0-9A-Fa-f]{8})\b", 1), lambda m: F.when(m.rlike("[0-9]"), normalize_hex(m)))
    return F.coalesce(normalize_hex(hit(c, HEX)), bare, F.lit(""))


def extract_bits(c: Column) -> Column:
    """F33."""
    single = F.concat(F.lit("["), hit(c, BIT, 1), F.lit("]"))
    bare = F.when(strip(c).rlike(r"^\d{1,2}\z"), F.concat(F.lit("["), strip(c), F.lit("]")))
    return F.coalesce(_bracket(c), _between(c), single, bare, F.lit(""))


def extract_access(c: Column) -> Column:
    """the first spelling in the pattern's order wins."""
    return F.coalesce(normalize_access(hit(c, ACCESS, 1)), F.lit(""))


def extract_text(c: Column) -> Column:
    """F35."""
    sentences = F.filter(F.transform(F.split(c, r"[.!?\n]"), strip), lambda s: s != "")
    last = F.coalesce(F.try_element_at(sentences, F.lit(-1)), c)
    return F.coalesce(strip(first(c, ANSWER, 1)), F.when(F.size(words(c)) <= 20, c).otherwise(last), F.lit(""))


def extract_numeric(c: Column) -> Column:
    """F36."""

    def split(m: Column) -> Column:
        number = F.regexp_extract(m, rf"^{NUMBER}", 1)
        return F.when(m != "", F.concat(number, F.lit(" "), strip(F.substring(m, F.length(number) + 1, F.length(m)))))

    return F.coalesce(let(F.regexp_extract(c, NUMERIC, 0), split), hit(c, NUMBER), F.lit(""))


def extract_range(c: Column) -> Column:
    """the upper bound takes the lower one's unit if it has none."""
    g = [first(c, RANGE, n) for n in range(5)]
    high = F.when(g[4] == "", g[2]).otherwise(g[4])
    return F.coalesce(F.concat(g[1], g[2], F.lit(" to "), g[3], high), F.lit(""))


def _items(c: Column) -> Column:
    # the pattern cuts at each line's end, so no part has one; a cut at a plain character compiles no pattern for each row
    return F.filter(F.transform(F.split(F.regexp_replace(c, ITEM, "\n"), "\n"), strip), lambda x: x != "")


def extract_list(c: Column) -> Column:
    """F38."""
    bare = F.transform(_items(c), lambda x: strip(F.regexp_replace(x, r"^[-•*]\s*", "")))
    return F.coalesce(F.array_join(F.filter(bare, lambda x: x != ""), ", "), F.lit(""))


def extract_confidence(c: Column) -> Column:
    """null where none is stated."""
    return F.coalesce(*[first(c, p, 1).cast("double") / F.lit(float(by)) for p, by in CONFIDENCE])


def extract_answer(c: Column, form: Column) -> Column:
    """F39."""
    t = strip(F.coalesce(c, F.lit("")))
    by_form = {
        "hex": extract_hex, "bit_range": extract_bits, "access_code": extract_access, "text": extract_text, "numeric": extract_numeric,
        "numeric_range": extract_range, "list": extract_list,
    }
    out = t
    for name, f in by_form.items():
        out = F.when(form == name, f(t)).otherwise(out)
    return out


# Scores


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.abs(b) < TOLERANCE


def _sets(a: Column, b: Column) -> tuple[Column, Column]:
    return F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")


def _jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """U4."""
    meet, join = _sets(a, b)
    return let(F.struct(meet.alias("m"), join.alias("j")), lambda n: F.when(n["j"] == 0, both_empty).otherwise(F.coalesce(F.try_divide(n["m"], n["j"]), F.lit(0.0))))


def plain_text(c: Column) -> Column:
    """Lower-case words without articles."""
    return F.array_join(F.filter(words(F.lower(strip(c))), lambda w: ~w.isin("a", "an", "the")), " ")


def text_tokens(c: Column) -> Column:
    marks = r"^[.,;:()\[\]]+|[.,;:()\[\]]+\z"
    parts = F.filter(F.split(F.lower(c), rf"[{SPACE},;:()]+"), lambda w: ~w.isin(*STOPWORDS))
    return F.array_distinct(F.filter(F.transform(parts, lambda w: F.regexp_replace(w, marks, "")), lambda w: w != ""))


def _ratio(p: Column, q: Column) -> Column:
    return F.when(q == 0, yes(p == 0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.lit(1.0), F.abs(p - q) / F.abs(F.nullif(q, F.lit(0.0))))))


def _equal(p: Column, q: Column) -> Column:
    return F.when(q == 0, p == 0).otherwise(_near(p, F.nullif(q, F.lit(0.0))))


def _compared(a: Column, b: Column, score: Callable[[Column, Column, Column], Column]) -> Column:
    """``score`` of both normal forms, and of both numbers as written where one form has no unit."""

    def of(s: Column) -> Column:
        x, y = s["x"], s["y"]
        loose = (x["unit"] != y["unit"]) & ((x["unit"] == "") | (y["unit"] == ""))
        written = F.when(loose, F.struct(_number(s["a"]).alias("u"), _number(s["b"]).alias("v")))
        return let(written, lambda w: score(x, y, w))

    return let(F.struct(normalize_numeric(a).alias("x"), normalize_numeric(b).alias("y"), a.alias("a"), b.alias("b")), of)


def score_numeric(a: Column, b: Column) -> Column:
    """in the same unit; else by normal values, or by the numbers as written if one has no unit."""

    def score(x: Column, y: Column, w: Column) -> Column:
        normal = (x["value"] != 0) & (y["value"] != 0) & _equal(x["value"], y["value"])
        written = F.coalesce(_equal(w["u"], w["v"]), F.lit(False))
        return F.when(x["unit"] == y["unit"], yes(_equal(x["value"], y["value"]))).otherwise(yes(normal | written))

    return _compared(a, b, score)


def partial_numeric(a: Column, b: Column) -> Column:
    """one less the relative error, of the first comparison of F47 that gives any."""

    def score(x: Column, y: Column, w: Column) -> Column:
        normal = F.when((x["value"] != 0) & (y["value"] != 0), F.nullif(_ratio(x["value"], y["value"]), F.lit(0.0)))
        return F.when(x["unit"] == y["unit"], _ratio(x["value"], y["value"])).otherwise(F.coalesce(normal, _ratio(w["u"], w["v"]), F.lit(0.0)))

    return _compared(a, b, score)


def parse_range(c: Column) -> Column:
    """Struct(low, high, unit) of a range; zeros without one."""
    g = [F.regexp_extract(c, RANGE, n) for n in range(5)]
    low, high = (F.when(g[2] == "", g[4]).otherwise(g[2]), F.when(g[4] == "", g[2]).otherwise(g[4]))
    factor = lambda u: F.coalesce(lookup(F.lower(u), {k: v[1] for k, v in UNIT_TABLE.items()}), F.lit(1.0))
    unit = F.coalesce(lookup(F.lower(low), {k: v[0] for k, v in UNIT_TABLE.items()}), low)
    has = c.rlike(RANGE)
    value = lambda n, u: F.when(has, g[n].try_cast("double") * factor(u)).otherwise(0.0)
    return F.struct(value(1, low).alias("low"), value(3, high).alias("high"), F.when(has, unit).otherwise("").alias("unit"))


def _range_score(a: Column, b: Column, score: Callable[..., Column]) -> Column:
    def of(s: Column) -> Column:
        x, y = s["x"], s["y"]
        clash = (x["unit"] != y["unit"]) & (x["unit"] != "") & (y["unit"] != "")
        near = [F.abs(x[k] - y[k]) < F.greatest(F.lit(1.0), F.abs(y[k])) * TOLERANCE for k in ("low", "high")]
        exact = [F.when(y[k] != 0, n).otherwise(x[k] == 0) for k, n in zip(("low", "high"), near)]
        return score(clash, *near, *exact)

    return let(F.struct(parse_range(a).alias("x"), parse_range(b).alias("y")), of)


def score_range(a: Column, b: Column) -> Column:
    """F48."""
    return _range_score(a, b, lambda clash, _, __, low, high: yes(~clash & low & high))


def partial_range(a: Column, b: Column) -> Column:
    """half for each bound."""
    return _range_score(a, b, lambda clash, low, high, _, __: F.when(clash, 0.0).otherwise(yes(low) / F.lit(2.0) + yes(high) / F.lit(2.0)))


def _listed(c: Column) -> Column:
    return F.array_distinct(F.transform(_items(c), F.lower))


def partial_hex(a: Column, b: Column) -> Column:
    """share of equal digits."""

    def score(s: Column) -> Column:
        n = F.greatest(F.length(s["x"]), F.length(s["y"])) - 2
        pad = lambda c: F.concat(F.repeat(F.lit("0"), n + 2 - F.length(c)), F.substring(c, F.lit(3), F.length(c)))
        return let(
            F.struct(pad(s["x"]).alias("p"), pad(s["y"]).alias("q"), n.alias("n")),
            lambda t: F.size(F.filter(F.sequence(F.lit(1), t["n"]), lambda i: F.substring(t["p"], i, F.lit(1)) == F.substring(t["q"], i, F.lit(1)))).cast("double") / t["n"],
        )

    return let(F.struct(normalize_hex(a).alias("x"), normalize_hex(b).alias("y")), score)


def bit_set(c: Column) -> Column:
    """Bit positions of a normal range; none for a reversed one."""
    high = F.regexp_extract(c, BITS, 1).try_cast("int")
    low = F.coalesce(F.nullif(F.regexp_extract(c, BITS, 2), F.lit("")).try_cast("int"), high)
    return F.when(high.isNull() | (low > high), F.array().cast("array<int>")).otherwise(F.sequence(F.least(low, high), high))


def partial_bits(a: Column, b: Column) -> Column:
    """F51."""

    def score(s: Column) -> Column:
        sets = F.struct(bit_set(s["x"]).alias("p"), bit_set(s["y"]).alias("q"))
        share = let(sets, lambda t: F.when((F.size(t["p"]) == 0) | (F.size(t["q"]) == 0), 0.0).otherwise(_jaccard(t["p"], t["q"], 1.0)))
        return F.when(s["x"] == s["y"], 1.0).otherwise(share)

    return let(F.struct(normalize_bits(a).alias("x"), normalize_bits(b).alias("y")), score)


def partial_text(a: Column, b: Column) -> Column:
    """F52."""
    return _jaccard(text_tokens(a), text_tokens(b), 1.0)


def partial_list(a: Column, b: Column) -> Column:
    """F55."""
    return let(F.struct(_listed(a).alias("p"), _listed(b).alias("q")), lambda t: _jaccard(t["p"], t["q"], 1.0))


def score_list(a: Column, b: Column) -> Column:
    """F49."""

    def score(t: Column) -> Column:
        return F.when(F.size(t["q"]) == 0, yes(F.size(t["p"]) == 0)).otherwise(yes(_jaccard(t["p"], t["q"], 1.0) >= 0.75))

    return let(F.struct(_listed(a).alias("p"), _listed(b).alias("q")), score)


def score_text(a: Column, b: Column) -> Column:
    """the truth is part of the answer."""
    return yes(F.contains(plain_text(a), plain_text(b)))


def _by_form(form: Column, of: dict[str, Column], other: Column) -> Column:
    for name, c in of.items():
        other = F.when(form == name, c).otherwise(other)
    return other


def score_answer(a: Column, b: Column, form: Column) -> Column:
    """1.0 or 0.0; an empty answer is wrong."""
    of = {
        "hex": yes(normalize_hex(a) == normalize_hex(b)), "bit_range": yes(normalize_bits(a) == normalize_bits(b)), "access_code": yes(normalize_access(a) == normalize_access(b)),
        "text": score_text(a, b), "numeric": score_numeric(a, b), "numeric_range": score_range(a, b), "list": score_list(a, b),
    }
    return F.when(F.coalesce(a, F.lit("")) == "", 0.0).otherwise(_by_form(form, of, yes(strip(a) == strip(b))))


def score_partial(a: Column, b: Column, form: Column) -> Column:
    """F56."""
    of = {
        "hex": partial_hex(a, b), "bit_range": partial_bits(a, b), "access_code": yes(normalize_access(a) == normalize_access(b)), "text": partial_text(a, b),
        "numeric": partial_numeric(a, b), "numeric_range": partial_range(a, b), "list": partial_list(a, b),
    }
    return F.when(F.coalesce(a, F.lit("")) == "", 0.0).otherwise(_by_form(form, of, yes(strip(a) == strip(b))))
