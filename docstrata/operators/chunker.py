"""Structure-aware chunking.

Cutting a document is sequential, so it runs in one Arrow-batched pass over
documents; ids, content types and hashes are column expressions on its output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from ..functions.detect import FENCE, HEADING, TABLE_RULE, content_type
from ..functions.relevance import peripheral_of
from ..functions.text import chunk_id

PAGE = re.compile(r"<!-- PAGE:(\d+) -->")
PAGE_LINE = re.compile(r"<!-- PAGE:\d+ -->\n?")
ROW = re.compile(r"\|.+\|\Z")
RULE, OPEN_FENCE, TITLE = re.compile(TABLE_RULE), re.compile(FENCE), re.compile(HEADING)
#: Where to cut, coarsest first: (pattern or text to cut at, text to join with).
CUTS = (
    (re.compile(r"(?=(?:^|\n)# )"), "\n"),
    (re.compile(r"(?=(?:^|\n)## )"), "\n"),
    (re.compile(r"(?=(?:^|\n)###+ )"), "\n"),
    ("\n\n", "\n\n"),
    ("\n", "\n"),
    (" ", " "),
)
OUT = "chunk_index int, content string, token_count int, page int, section_path string, error string"


class Tokenizer(Protocol):
    """Cuts a text into pieces that make it up again when joined.

    With a true ``additive``, white space is always the beginning of a piece (or
    the text's last one), so the pieces of texts that white space joins add up,
    and each part is counted once; otherwise each joined text is counted.
    ``count`` may say how many pieces there are without making them, and ``last`` what the last ``n`` make up.
    """

    def pieces(self, text: str) -> list[str]: ...


class PieceTokenizer:
    """Words in pieces of at most four characters, white space before the first; needs no vocabulary."""

    PIECE = re.compile(r"\s*\S{1,4}|\s+\Z")
    additive = True

    def pieces(self, text: str) -> list[str]:
        return self.PIECE.findall(text)

    def count(self, text: str) -> int:
        return sum([len(w) + 3 >> 2 for w in text.split()]) + text[-1:].isspace()

    def last(self, text: str, n: int) -> str:
        """They are in the last ``n`` words."""
        return "".join(self.PIECE.findall(text[len(text.rsplit(None, n)[0]) :] if len(text.split(None, n)) > n else text)[-n:])


class BytePairTokenizer:
    """Tokens of a byte-pair vocabulary in the tiktoken format (K1); ``pattern`` cuts a text before pairs are merged.

    A token that ends within a character goes into one piece with the next ones.
    """

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks_path, self.pattern, self._encoding = ranks_path, pattern, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoding": None}  # each worker reads the vocabulary itself

    @property
    def encoding(self):
        if self._encoding is None:
            import base64

            import tiktoken

            with open(self.ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._encoding

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def pieces(self, text: str) -> list[str]:
        out, held = [], b""
        for token in self.encoding.encode_ordinary(text):
            held += self.encoding.decode_single_token_bytes(token)
            try:
                out.append(held.decode())
                held = b""
            except UnicodeDecodeError:
                continue
        return [*out, held.decode("utf-8", "replace")] if held else out


@dataclass(frozen=True)
class ChunkOptions:
    max_tokens: int = 512
    overlap_tokens: int = 50
    min_tokens: int = 50


class Chunker:
    def __init__(self, options: ChunkOptions | None = None, tokenizer: Tokenizer | None = None):
        self.options, self.tokenizer = options or ChunkOptions(), tokenizer or PieceTokenizer()
        self.additive = getattr(self.tokenizer, "additive", False)
        self._count = getattr(self.tokenizer, "count", None) or self._pieces

    def _pieces(self, text: str) -> int:
        return len(self.tokenizer.pieces(text))

    def count(self, text: str) -> int:
        """K1."""
        return self._count(text) if text else 0

    def count_joined(self, a: str, n: int, glue: str, b: str, m: int) -> int:
        """Pieces of ``a`` and ``b`` joined by white space, given those of each."""
        return n - a[-1:].isspace() + m if self.additive else self.count(a + glue + b)

    def chunk(self, text: str | None) -> list[tuple[int, str, int, int, str]]:
        """(index, content, tokens, page, section path) of each chunk; an index without content is skipped."""
        o, whole = self.options, (text or "").strip()
        budget = max(o.max_tokens - o.overlap_tokens, 1) if o.overlap_tokens > 0 else o.max_tokens
        cut: list[tuple[str, bool]] = []
        for part, atomic in blocks(whole):
            if part.strip():
                cut += [(part.strip(), True)] if atomic else [(p, False) for p in self.split(part.strip(), budget)]
        out, trail = [], []
        for n, content in enumerate(self.merge_small(self.overlapped(cut))):
            content = content.strip()
            page = None
            if "<!-- PAGE:" in content:
                page = PAGE.search(content)
                content = PAGE_LINE.sub("", content).strip()
            if content:
                trail = walk_headings(trail, content) if "#" in content else trail
                out.append((n, content, self.count(content), int(page[1]) if page else 0, " > ".join(t for _, t in trail)))
        return out

    def split(self, text: str, most: int, level: int = 0) -> list[str]:
        """K4: by the coarsest cut that helps; neighbours that fit are joined again."""
        return [text] if self.count(text) <= most else self._cut(text, most, level)

    def _cut(self, text: str, most: int, level: int) -> list[str]:
        """A text that is too long."""
        parts: list[str] = []
        while len(parts) <= 1:
            if level == len(CUTS):
                return self.hard_split(text, most)
            at, glue = CUTS[level]
            level += 1
            # headings have a mark and a blank; few texts have any
            parts = [p for p in text.split(at) if p.strip()] if isinstance(at, str) else [p for p in at.split(text) if p.strip()] if "# " in text else []
        count, additive = self._count, self.additive
        out: list[str] = []
        held: list[str] = []
        size = 0
        for p in parts:
            n = count(p)
            joined = (size - held[-1][-1].isspace() + n if additive else count(glue.join([*held, p]))) if held else n
            if joined <= most:
                held.append(p)
                size = joined
                continue
            if held:
                out.append(glue.join(held))
            held, size = [], 0
            if n > most:
                out += self._cut(p, most, level)
            else:
                held, size = [p], n
        return [*out, glue.join(held)] if held else out

    def hard_split(self, text: str, most: int) -> list[str]:
        """K5."""
        pieces = self.tokenizer.pieces(text)
        return ["".join(pieces[i : i + most]) for i in range(0, len(pieces), most)]

    def overlapped(self, cut: list[tuple[str, bool]]) -> list[str]:
        """K6: the end of the chunk before, as it was cut, in front of each chunk that is not atomic."""
        n, out = self.options.overlap_tokens, []
        last = getattr(self.tokenizer, "last", None)
        if last and n > 0:
            return [last(cut[i - 1][0], n) + text if i and not atomic and self.count(cut[i - 1][0]) > n else text for i, (text, atomic) in enumerate(cut)]
        for i, (text, atomic) in enumerate(cut):
            before = self.tokenizer.pieces(cut[i - 1][0]) if i and n > 0 and not atomic else []
            out.append("".join(before[-n:]) + text if len(before) > n else text)
        return out

    def merge_small(self, chunks: list[str]) -> list[str]:
        """K7: a small chunk takes the next one in, the last goes into the one before, where they fit."""
        o, out, held = self.options, [], ""
        if o.min_tokens <= 0:
            return chunks
        size = 0
        for c in chunks:
            n = self.count(c)
            joined = self.count_joined(held, size, "\n\n", c, n) if held and size < o.min_tokens else o.max_tokens + 1
            if joined <= o.max_tokens:
                held, size = held + "\n\n" + c, joined
            else:
                out += [(held, size)] if held else []
                held, size = c, n
        if held and out and size < o.min_tokens and self.count_joined(*out[-1], "\n\n", held, size) <= o.max_tokens:
            out[-1] = out[-1][0] + "\n\n" + held, 0
        elif held:
            out.append((held, size))
        return [t for t, _ in out]


def blocks(text: str) -> list[tuple[str, bool]]:
    """K2: runs of lines, and whether they must stay whole: fenced code and tables with a rule."""
    if "|" not in text and "```" not in text and "~~~" not in text:
        return [(text, False)]
    out: list[tuple[str, bool]] = []
    plain: list[str] = []
    lines = text.split("\n")

    def flush() -> None:
        if plain:
            out.append(("\n".join(plain), False))
            plain.clear()

    at = 0
    while at < len(lines):
        fence, end = OPEN_FENCE.match(lines[at]), at + 1
        if fence:
            closing = re.compile(rf"{re.escape(fence[1][0])}{{{len(fence[1])},}}\Z")
            while end < len(lines) and not closing.match(lines[end]):
                end += 1
            end = min(end + 1, len(lines))
            flush()
            out.append(("\n".join(lines[at:end]), True))
        elif ROW.match(lines[at]):
            while end < len(lines) and ROW.match(lines[end]):
                end += 1
            flush()  # a table without a rule still ends the text before it
            if RULE.search(table := "\n".join(lines[at:end])):
                out.append((table, True))
            else:
                plain.extend(lines[at:end])
        else:
            plain.append(lines[at])
        at = end
    flush()
    return out


def walk_headings(trail: list[tuple[int, str]], text: str) -> list[tuple[int, str]]:
    """K9: headings that hold after the text."""
    for m in TITLE.finditer(text):
        level = len(m[1])
        trail = [t for t in trail if t[0] < level] + [(level, m[2].strip())]
    return trail


def chunk_documents(docs: DataFrame, options: ChunkOptions | None = None, tokenizer: Tokenizer | None = None, fill_peripheral: bool = True) -> DataFrame:
    """Chunks of documents (doc_id, content, doc_type, chip), in the schema of a store.

    A document that cannot be cut gives one row with ``error`` set and no chunk
    (K13). ``fill_peripheral`` names the second heading of register documents.
    """
    chunker = Chunker(options, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, content, doc_type, chip in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    rows += [(doc_id, doc_type, chip, *c, None) for c in chunker.chunk(content)]
                except Exception as e:
                    rows.append((doc_id, doc_type, chip, None, None, None, None, None, f"ChunkError: {e}"))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            names = ("doc_id", "doc_type", "chip", *(x.split()[0] for x in OUT.split(", ")))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], names=list(names))

    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("doc_id", "content", "doc_type", "chip")])
    made = text.mapInArrow(run, f"doc_id string, doc_type string, chip string, {OUT}")
    own = F.when((F.col("doc_type") == "svd") & F.lit(fill_peripheral), peripheral_of(F.col("section_path"))).otherwise("")
    return made.select(
        F.when(F.col("content").isNotNull(), chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("content"))).alias("chunk_id"),
        "chunk_index", "content", "token_count", "doc_id", "doc_type", "chip", "section_path", "page", F.lit("detail").alias("chunk_level"),
        own.alias("peripheral"), content_type(F.col("content")).alias("content_type"), "error",
    )


def overlap_before(text: Column, pieces: Column, n: int, order: WindowSpec) -> Column:
    """K6, W1 for rows that hold a chunk each: the last ``n`` pieces of the row before, if it has more, in front of the text."""
    before = F.lag(pieces).over(order)
    return F.concat(F.when(F.size(before) > n, F.array_join(F.slice(before, -n, n), "")).otherwise(""), text)


def register_chunker(spark: SparkSession, name: str = "chunks_of", tokenizer: Tokenizer | None = None) -> None:
    """The chunker as a table function of SQL: ``chunks_of(content, max_tokens, overlap_tokens, min_tokens)``."""

    @F.udtf(returnType="chunk_index int, content string, token_count int, page int, section_path string")
    class Chunks:
        def eval(self, content: str, max_tokens: int, overlap_tokens: int, min_tokens: int):
            yield from Chunker(ChunkOptions(max_tokens, overlap_tokens, min_tokens), tokenizer).chunk(content)

    spark.udtf.register(name, Chunks)
