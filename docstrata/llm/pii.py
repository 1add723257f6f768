"""Personal data: patterns propose spans, checksums confirm them, context scores them.

The kinds e-mail, IP address, payment card and phone number are found by one
pattern each, leftmost and without overlap within a kind. An address part over
255, a card that fails Luhn's check and a phone number of a wrong length are
dropped. Bank account numbers (IBAN) are found by a pattern of their own and
confirmed modulo 97; secrets are runs of hexadecimal digits that hold both
figures and letters. A span's score starts at a value of its kind and rises if a
word that speaks of the kind stands within ``CONTEXT`` characters before it or
after it, and falls if one stands there that speaks against it; context ends
where the next match of the same pattern begins. Scores never drop a span.

All of it is column expressions. Positions are code points, ends exclusive:
splitting a text by a pattern gives what lies between the matches, and running
sums of lengths give their places. The sums are made in blocks of ``BLOCK``
matches and then over the blocks, since an array cannot grow in place, so a text
with very many matches costs little more than its length. A cheap test per kind
spares texts that cannot hold a match.

Defined results: a null text counts as empty and has no spans; repeated rows
are repeated; the id is passed through, null or not; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named

CONTEXT = 40
BLOCK = 128
LOCAL = "A-Za-z0-9._%+-"
#: kind: (a cheaper pattern that a text with a match matches, pattern). A run of characters that can begin a match is
#: entered at its start only, or where the last match ended, so that long runs cost
#: linear time; possessive runs never give characters back where that cannot help.
PATTERNS = {
    "email": ("@", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "secret": (r"[0-9A-Fa-f]{32}", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}+(?![0-9A-Za-z])"),
}
BASE = ("email", "ip", "card", "phone")
#: kind: (score without context, words for it, words against it)
CONTEXTS = {
    "email": (0.9, "mail|contact|write|reply", "example|noreply"),
    "ip": (0.6, "ip|address|host|server|client|login", "version|release|section"),
    "card": (0.7, "card|visa|mastercard|amex|payment|credit|debit", "order|serial|isbn|tracking"),
    "phone": (0.6, "phone|tel|call|mobile|fax|whatsapp", "version|score"),
    "iban": (0.9, "iban|bank|account|bic|swift", "serial|part"),
    "secret": (0.4, "token|key|secret|password|passwd|auth|credential|bearer", "sha|md5|hash|checksum|commit|digest|uuid"),
}
STEP = 0.2
LIKELY = 0.5  # a score that speaks for the span


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        value = lambda p: F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255"
        return F.forall(F.split(m, r"\."), lambda p: small(p) & value(p))
    if kind == "card":
        d = digits_of(m)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(m)).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Fa-f]")
    return F.lit(True)


def _let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _placed(found: Column) -> Column:
    """Add ``start`` and ``end`` to an array of structs with ``gap``, the length before, and ``length``."""

    def block(part: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["gap"]
            return F.struct((start + x["length"]).alias("at"), F.concat(a["all"], F.array(start)).alias("all"))

        run = F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step)
        return F.struct(part.alias("part"), run.alias("run"))

    count = F.size(found)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((count - 1) / BLOCK).cast("int"), F.lit(0))), lambda k: block(F.slice(found, k * BLOCK + 1, F.lit(BLOCK))))

    def joined(rows: Column) -> Column:
        step = lambda a, x: F.struct((a["at"] + x["run"]["at"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))
        before = F.aggregate(rows, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step)["all"]
        place = lambda x, s, at: F.struct(x.alias("x"), (at + s).alias("start"), (at + s + x["length"]).alias("end"))
        return F.flatten(F.zip_with(rows, before, lambda r, at: F.zip_with(r["part"], r["run"]["all"], lambda x, s: place(x, s, at))))

    return _let(blocks, joined)


def _spans(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, text, score) of the confirmed matches, in order."""
    must, pattern = PATTERNS[kind]

    def shaped(c: Column) -> Column:
        n = F.size(c["found"])
        pieces = F.arrays_zip(c["found"].alias("m"), F.slice(c["between"], F.lit(1), n).alias("b"), F.slice(c["between"], F.lit(2), n).alias("a"))
        return F.transform(
            pieces,
            lambda x: F.struct(
                x["m"].alias("m"), F.length(x["m"]).alias("length"), F.length(x["b"]).alias("gap"),
                F.lower(F.concat_ws(" ", F.substring(x["b"], -CONTEXT, CONTEXT), F.substring(x["a"], 1, CONTEXT))).alias("near"),
            ),
        )

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    placed = _let(_let(parts, shaped), _placed)
    good = F.filter(placed, lambda p: valid(kind, p["x"]["m"]))
    spans = F.transform(
        good, lambda p: F.struct(F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["x"]["m"].alias("text"), _score(kind, p["x"]["near"]).alias("score"))
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string,score:double>>")
    return F.when(text.rlike(must), spans).otherwise(none)


def _score(kind: str, near: Column) -> Column:
    base, good, bad = CONTEXTS[kind]
    has = lambda words: near.rlike(rf"(?<![a-z])(?:{words})(?![a-z])")
    return F.round(F.least(F.lit(1.0), F.lit(base) + F.when(has(good), STEP).otherwise(0.0) - F.when(has(bad), STEP).otherwise(0.0)), 2)


def find_personal_data(docs: DataFrame, id_col: str, text_col: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """(doc_id, spans): an array of (kind, start, end, text, score), by kind in the order given, then by start."""
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("t"))
    return rows.select("doc_id", F.concat(*[_spans(F.col("t"), k) for k in kinds]).alias("spans"))
