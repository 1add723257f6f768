"""Token ids in length-delimited binary records, with a separate offset index.

Documents are dealt into shards by ranges of their id and a hash of their text,
so that the files, in the order of the numbers in their names, hold them in
ascending order of ids and no id, however many rows it has, makes a shard long.
A file takes a bounded number of records. A shard is a sequence of frames, each
of which is

    length      unsigned 64 bits, of the payload
    check       unsigned 32 bits, masked CRC-32 of the length's eight bytes
    payload     document id (signed 64 bits), flags (8 bits: 1 the id is null,
                2 ids take four bytes each instead of two), the ids
    check       unsigned 32 bits, masked CRC-32 of the payload
    newline     one byte, which lets Spark's text writer lay the frames down

all little-endian. A mask rotates the checksum and adds a constant, as a
checksum of data that holds checksums is weak. Spark writes and commits the
files, so that a task that is lost and run again leaves no half a file, in any
store that Spark writes to.

The index, a Parquet table beside the shards, has a row for each record: shard,
file, offset, length, doc_id, tokens, the ids before it in the shard and the
CRC-32 of its ids. It is made from the files as they were read back, with all
checks made, and lets a reader that shuffles fetch any record by a seek.

Texts are encoded as the tokenizer does by default without special tokens of its
own: a special token's string in a text becomes that token.

Defined results: a null text is empty and has the end id only; rows of equal id
are ordered by a hash of the text, then by text; null ids come first; repeated rows are repeated; an empty
table has no records; other columns are ignored. A damaged file raises.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, named

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
INDEX = "file string, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = struct.pack("<qB", doc_id or 0, (doc_id is None) | wide << 1) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload)), b"\n"))


def frames(data: bytes | memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each frame; the length is the whole frame's. A view is not copied."""
    at = 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError(f"cut off at byte {at}")
        size, check = HEAD.unpack_from(data, at)
        if check != masked_crc(data[at : at + 8]):
            raise ValueError(f"bad length at byte {at}")
        body = data[at + HEAD.size : at + HEAD.size + size]
        end = at + HEAD.size + size + 5
        if end > len(data) or data[end - 1] != 10 or struct.unpack_from("<I", data, end - 5)[0] != masked_crc(body):
            raise ValueError(f"bad record at byte {at}")
        doc_id, flags = struct.unpack_from("<qB", body)
        yield at, end - at, None if flags & 1 else doc_id, np.frombuffer(body, "<u4" if flags & 2 else "<u2", offset=9)
        at = end


#: How byte-level tokenizers split a text (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


LONGEST = 40  # characters of a word that is remembered


class Irregular(Exception):
    """A text cannot be encoded word by word."""


class Words(dict):
    """Ids, as bytes, of words: after a space, after a newline (key begins with it) or at the start (with NUL).

    A key that is no single word, or that holds an added token, is never kept
    and raises.
    """

    def __init__(self, tokenizer, kind: str, most: int):
        self.tokenize, self.kind, self.most = tokenizer.model.tokenize, kind, most
        self.added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        # the printable stand-ins of bytes in a byte-level vocabulary: printable ones as they are, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.space = self.byte[32]
        self.pieces = regex.compile(SPLIT).findall
        self.newline = self._piece("\n")

    def _ids(self, shown: str) -> bytes:
        return array(self.kind, [x.id for x in self.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._ids(piece.encode().decode("latin-1").translate(self.byte))

    def __missing__(self, key: str) -> bytes:
        if key.isalpha():
            code = self._ids(self.space + key) if key.isascii() else self._piece(" " + key)
        else:
            word = key[1:] if key[:1] in ("\0", "\n") else key
            if word.split() != [word] or any(x in word for x in self.added):
                raise Irregular
            if key[0] == "\n":
                code = self.newline + self["\0" + word]
            else:
                found = self.pieces(word if key[0] == "\0" else " " + word)
                if len(found) == 1:
                    code = self._piece(found[0])
                else:
                    code = b"".join([self[p[1:] if p[0] == " " else "\0" + p] for p in found])
        if len(self) < self.most and len(key) <= LONGEST:
            self[key] = code
        return code


class WordEncoder:
    """Ids of whole texts, by way of a bounded memory for words.

    A byte-level tokenizer that splits before each single space and around each
    newline encodes the parts independently of each other. Where a text has
    only single spaces and newlines between non-spaces, its words are encoded
    once each by the tokenizer's model; any other text, one that holds the
    string of an added token, and any text if the tokenizer is of another kind,
    goes to the tokenizer as a whole.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.wide = t.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        probe = "ab, cd.\nEf's 1g-h é"
        cut = [x[0] for x in t.pre_tokenizer.pre_tokenize_str(probe)] if t.pre_tokenizer is not None else []
        self.words = None
        if t.normalizer is None and sys.byteorder == "little" and cut == ["ab", ",", "Ġcd", ".", "Ċ", "Ef", "'s", "Ġ1", "g", "-", "h", "ĠÃ©"]:
            self.words = Words(t, "I" if self.wide else "H", most)
            if any(x.split() != [x] for x in self.words.added) or self([probe]) != self._ids([probe]):
                self.words = None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        if self.words is not None:
            code = self.words.__getitem__
            for i, t in enumerate(texts):
                if "\0" in t:  # marks the start of a text in keys
                    continue
                try:
                    out[i] = b"".join(map(code, ("\0" + t).replace("\n", " \n").split(" ")))
                except Irregular:
                    pass
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._ids([texts[i] for i in rest])):
            out[i] = x
        return out


def encoder(path: str) -> WordEncoder:
    return held(("encoder", path), lambda: WordEncoder(path))


def _parts(texts: list, most: int = 4_000_000) -> Iterator[slice]:
    """Slices of a batch of about ``most`` characters."""
    first = size = 0
    for n, t in enumerate(texts):
        size += len(t or "")
        if size > most:
            yield slice(first, n + 1)
            first, size = n + 1, 0
    yield slice(first, len(texts))


def _framer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], encode.kind).tobytes()
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _parts(texts):
                coded = encode([t or "" for t in texts[part]])
                made = [frame(i, c + end, encode.wide)[:-1] for i, c in zip(ids[part], coded)]  # the writer adds the newline
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["frame"])

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held(None)  # what the worker remembers from encoding is not needed any more
    for batch in batches:
        for file, data in zip(batch.column(0), batch.column(1)):
            before, rows = 0, []
            for at, size, doc_id, ids in frames(memoryview(data.as_buffer())):
                rows.append((file.as_py(), at, size, doc_id, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                before += len(ids)
            kinds = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])


def write_records(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, out: str, shard_chars: int = 16_000_000) -> None:
    """Write the shards to ``out``/shards, about ``shard_chars`` characters each.

    Rows that are equal in id and text cannot be told apart by a range, so a
    file also ends after as many records as have four times that length on
    average.
    """
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    key = F.asc_nulls_first("doc_id"), F.xxhash64("text")
    ranged = rows.repartitionByRange(max(1, -(-chars // shard_chars)), *key).sortWithinPartitions(*key, "text")
    framed = ranged.mapInArrow(_framer(tokenizer_path, end_id), "frame binary")
    most = max(1, 4 * shard_chars * n // max(1, chars))
    lines = framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none")
    lines.option("maxRecordsPerFile", min(most, 2**31 - 1)).text(f"{out}/shards")


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """Read the shards back, with all checks made, and keep what was found as ``out``/index.

    A row is a whole file, so batches of rows are bounded by bytes.
    """
    files = spark.read.format("binaryFile").load(f"{out}/shards").select("path", "content")
    found = files.mapInArrow(_index, INDEX)
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, "1m")
    try:
        found.write.parquet(f"{out}/index")
    finally:
        spark.conf.set(BATCH_BYTES, before) if before is not None else spark.conf.unset(BATCH_BYTES)
    return spark.read.schema(found.schema).parquet(f"{out}/index")


def file_number(file: Column) -> Column:
    """(task, file of the task) from a shard's name, as numbers: names stop sorting as text at 100,000."""
    part = lambda p: F.coalesce(F.nullif(F.regexp_extract(file, p, 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return F.struct(part(r"part-([0-9]+)[^/]*$").alias("task"), part(r"-c([0-9]+)[^/]*$").alias("file"))


def with_starts(index: DataFrame, group: int = 1000) -> DataFrame:
    """Add ``start``: the ids of all documents before each record in the order of the files.

    Totals are added up in two steps, within groups of ``group`` tasks and over
    the groups, so no task sees all files.
    """
    n = file_number(F.col("file"))
    shards = index.groupBy("file").agg(F.sum("n_tokens").alias("total")).select("file", "total", n.alias("n"), F.floor(n["task"] / group).alias("g"))
    before = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = shards.groupBy(F.col("g").alias("h")).agg(F.sum("total").alias("total")).select("h", before(Window.orderBy("h")).alias("far"))
    near = shards.select("file", "g", before(Window.partitionBy("g").orderBy("n")).alias("near"))
    at = near.join(groups, F.col("g") == F.col("h")).select(F.col("file").alias("f"), (F.col("far") + F.col("near")).alias("base"))
    return index.join(at, F.col("file") == F.col("f")).select(*index.columns, (F.col("base") + F.col("before")).alias("start"))
