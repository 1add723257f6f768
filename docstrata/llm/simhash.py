"""SimHash near-duplicate detection with BK-trees.

``fingerprint_components`` links 64-bit fingerprints at a small Hamming radius.
By the pigeonhole principle two fingerprints within three bits agree on two of
five blocks, so every pair of blocks deals the distinct fingerprints into
shards. Each shard gets a BK-tree (children keyed by their integer Hamming
distance to the parent) in the task that holds the shard, and a search follows
only the edges within the radius. Shard trees travel by shuffle, never by way
of the driver, because the fingerprints of a whole corpus may not be gathered
there. Trees emit a spanning forest of each shard, never all its pairs.

``near_duplicates`` is meant for texts that share only most of their shingles.
It takes longer signatures of the distinct shingles, whose bands deal the texts
into shards. In a shard's BK-tree, texts whose signatures are near enough are
candidates, and those whose sets of shingles, compared as 64-bit hashes, are as
similar as wanted are linked. Only texts of equal sets are taken as one. A second
way finds what the signatures miss: two sets that are similar enough share some
shingles among the first of each in any order that all sets keep (prefix
filtering), so texts of different components that do are compared too. The order
puts shingles that are common in a sample last.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; repeated rows are repeated in
the result; a null id never is the smallest of a component unless all its ids
are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_table, fresh, held, materialise, named, scope

BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (first bit, bits)
SEED = 42
#: Odd multipliers of the 64-bit finaliser that stretches one hash to many words (fixed values).
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words (or of the whole shorter sequence), repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    first = np.concatenate(([0], gaps + 1))[: len(found) - words + 1].tolist()
    last = np.append(gaps, len(joined))[words - 1 :].tolist()
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(first, last)), np.uint64, len(first))


def mixed_shingles(text: str | None, words: int) -> np.ndarray:
    """A 64-bit hash of each run of words, made of the words' hashes; cheaper than XXH64 of the run."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(found))
    out = np.zeros(len(found) - n + 1 if n else 0, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * np.uint64(MIX_A)
        out ^= out >> np.uint64(31)
    return out


def majority_bits(words: np.ndarray) -> np.ndarray:
    """Of an (n, m) array of 64-bit words: which of the 64*m bits are set in over half the rows."""
    n = len(words)
    counts = np.zeros(64 * words.shape[1], np.int64)
    for at in range(0, n, 8192):  # bounds the unpacked block
        block = np.ascontiguousarray(words[at : at + 8192]).view(np.uint8).reshape(min(8192, n - at), -1)
        counts += np.add.reduce(np.unpackbits(block, axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return counts * 2 > n


def simhash64(text: str | None, words: int) -> int:
    """Signed 64-bit SimHash; zero without words."""
    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    return int(np.packbits(majority_bits(h.reshape(-1, 1)), bitorder="little").view("<i8")[0])


def set_signature(h: np.ndarray, bits: int) -> bytes:
    """SimHash of a set of shingles in ``bits`` bits, each further word a mix of the shingle's hash."""
    m = bits // 64
    if not len(h):
        return b"\0" * (bits // 8)
    wide = np.empty((len(h), m), np.uint64)
    for k in range(m):
        x = (h ^ np.uint64(GOLDEN * (k + 1) & MASK)) * np.uint64(MIX_A)
        x ^= x >> np.uint64(29)
        wide[:, k] = (x ^ (x >> np.uint64(32))) * np.uint64(MIX_B)
    wide ^= wide >> np.uint64(32)
    return np.packbits(majority_bits(wide), bitorder="little").tobytes()


def fingerprint_udf(words: int):
    @F.pandas_udf("long")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([simhash64(t, words) for t in s], dtype="int64")

    return fingerprint


def shared_least(n, similarity: float):
    """Shingles that the prefixes of a set of ``n`` and any larger one as similar as wanted, but unequal, share at least."""
    return np.maximum(max(1, math.floor(similarity / (1 - similarity) + 1e-6) if similarity < 1 else 1), n // 20)


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set; any set as similar as wanted has ``shared_least`` of them among its first ones too.

    ``common`` are sorted shingles that come last, in the order of ``rank``.
    """
    if not len(h):
        return h
    size = len(h) - max(1, math.ceil(similarity * len(h) - 1e-6)) + int(shared_least(len(h), similarity))
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        late = common[at] == h
        h = np.concatenate((h[~late], h[late][np.argsort(rank[at[late]])]))
    return h[:size]


def described_udf(words: int, bits: int, similarity: float, common: np.ndarray, rank: np.ndarray):
    @F.pandas_udf("sid long, sig binary, n int, prefix binary")
    def described(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held(None)
        for s in texts:
            rows = []
            for t in s:
                h = np.unique(mixed_shingles(t, words))
                sid = np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64)
                rows.append((sid, set_signature(h, bits), len(h), (prefix(h, similarity, common, rank) >> np.uint64(32)).astype(np.uint32).tobytes()))
            yield pd.DataFrame(rows, columns=["sid", "sig", "n", "prefix"])

    return described


def shingles_udf(words: int):
    @F.pandas_udf("array<long>")
    def shingles(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([np.unique(mixed_shingles(t, words)).view(np.int64) for t in s], dtype="object")

    return shingles


def common_shingles(docs: DataFrame, text_col: str, words: int, chars: int = 10_000_000, least: int = 4, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles of ``least`` texts or more of a sample, and their ranks from rare to common.

    They only make the search for candidates cheaper: any order finds the same pairs.
    """
    t = F.coalesce(named(text_col), F.lit(""))
    whole = docs.agg(F.sum(F.length(t))).first()[0] or 0
    rate = min(1.0, chars / max(1, whole))
    texts = docs.select(t.alias("t")).where(F.pmod(F.xxhash64("t", F.lit("common")), F.lit(1 << 40)) < rate * float(1 << 40)).dropDuplicates(["t"])
    met = texts.select(F.explode(shingles_udf(words)("t")).alias("s")).groupBy("s").count().where(F.col("count") >= least)
    rows = met.orderBy(F.desc("count"), "s").limit(most).collect()
    h = np.array([r["s"] for r in reversed(rows)], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], order


def set_udf(words: int):
    @F.pandas_udf("binary")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([shingle_set(t, words) for t in s], dtype="object")

    return made


def bk_links(values: list[int], radius: int, same: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the graph that links values within ``radius`` bits, if ``same`` says so too.

    The values go into one BK-tree. A subtree whose members all belong to the
    component that the searching value is in already needs no visit; that keeps
    dense groups near-linear and loses no connection.
    """
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    children: list[dict[int, int]] = [{} for _ in values]
    uniform = [True] * len(values)
    links = []
    for i in range(1, len(values)):
        v, todo = values[i], [0]
        while todo:
            j = todo.pop()
            d = (v ^ values[j]).bit_count()
            if d <= radius and (a := root(i)) != (b := root(j)) and (same is None or same(i, j)):
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
            if uniform[j] and root(i) == root(j):
                continue
            todo += [c for e, c in children[j].items() if d - radius <= e <= d + radius]
        j = 0
        while True:
            if uniform[j] and root(i) != root(j):
                uniform[j] = False
            d = (v ^ values[j]).bit_count()
            if d not in children[j]:
                children[j][d] = i
                break
            j = children[j][d]
    return links


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of a partition sorted by its first column, cut between keys only."""
    open_: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        key = cols[0]
        cut = int(np.searchsorted(key, key[-1]))  # where the last key of the batch begins
        if cut and open_:
            yield [np.concatenate(x) for x in zip(*open_, [c[:cut] for c in cols])]
            open_ = []
        elif cut:
            yield [c[:cut] for c in cols]
        elif open_ and open_[-1][0][-1] != key[0]:
            yield [np.concatenate(x) for x in zip(*open_)]
            open_ = []
        open_.append([c[cut:] for c in cols])
    if open_:
        yield [np.concatenate(x) for x in zip(*open_)]


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of each run of two or more equal keys."""
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    first, end = np.concatenate(([0], edge)), np.append(edge, len(key))
    many = end - first > 1
    yield from zip(first[many].tolist(), end[many].tolist())


def _links(pairs: list[tuple[int, int]] | np.ndarray) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _tree_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, values in _whole_groups(batches):
            pairs = []
            for i, j in _runs(key):
                own = ids[i:j].tolist()
                pairs += [(own[x], own[y]) for x, y in bk_links([x & MASK for x in values[i:j].tolist()], radius)]
            if pairs:
                yield _links(pairs)

    return run


def shingle_set(text: str | None, words: int) -> bytes:
    """Sorted 64-bit hashes of the distinct runs of words."""
    return np.unique(mixed_shingles(text, words)).tobytes()


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = small + large - len(np.union1d(a, b))
    return both >= least * (small + large - both)


def _verified_links(radius: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, sigs, sets in _whole_groups(batches):
            pairs = []
            for i, j in _runs(key):
                own, part = ids[i:j].tolist(), [np.frombuffer(x, np.uint64) for x in sets[i:j]]
                found = bk_links([int.from_bytes(x, "little") for x in sigs[i:j]], radius, lambda x, y, p=part: similar(p[x], p[y], least))
                pairs += [(own[x], own[y]) for x, y in found]
            if pairs:
                yield _links(pairs)

    return run


def _shards(keyed: DataFrame, key: str) -> DataFrame:
    return keyed.repartition(key).sortWithinPartitions(key)


def fingerprint_components(docs: DataFrame, id_col: str, text_col: str, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; see the module's text.

    ``radius`` up to 3 is exact with the five blocks used here.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the blocks used here find pairs of at most 3 differing bits")
    known = materialise(docs.select(named(id_col).alias("doc_id"), fingerprint_udf(words)(named(text_col)).alias("fp")), "fingerprints")
    classes = materialise(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    masks = [((1 << BLOCKS[a][1]) - 1 << BLOCKS[a][0]) | ((1 << BLOCKS[b][1]) - 1 << BLOCKS[b][0]) for a, b in combinations(range(len(BLOCKS)), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(m))) for n, m in enumerate(signed)])
    dealt = _shards(classes.select(F.explode(keys).alias("key"), F.col("fp").alias("id"), F.col("fp").alias("value")), "key")
    found = connected_components(dealt.mapInArrow(_tree_links(radius), "a long, b long"), "a", "b")
    return _with_component(known, "fp", classes, found).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _with_component(known: DataFrame, node: str, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Add to each row of ``known`` the smallest id of its component."""
    rooted = classes.join(found, classes[node] == found["node"], "left").select(classes[node].alias("n"), F.coalesce("root", classes[node]).alias("r"), "least")
    least = rooted.groupBy(F.col("r").alias("r2")).agg(F.min("least").alias("component_id"))
    named = rooted.join(least, F.col("r") == F.col("r2")).select("n", F.col("r").alias("component"), "component_id")
    return known.join(named, known[node] == named["n"]).drop("n")


def angle_bits(similarity: float, bits: int) -> float:
    """Expected differing bits of two shingle sets of that Jaccard similarity and equal size."""
    return bits * math.acos(2 * similarity / (1 + similarity)) / math.pi


def _bands(bits: int, band_bits: int):
    """A row for each band of each signature: its key, the id, and a check word half the signature away."""
    kind = {8: "<u1", 16: "<u2", 32: "<u4"}[band_bits]
    n, per_word = bits // band_bits, 64 // band_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), b"".join(batch.column(1).to_pylist())
            value = np.frombuffer(raw, kind).reshape(len(ids), n).astype(np.int64) + (np.arange(n, dtype=np.int64) << band_bits)
            words = np.frombuffer(raw, "<i8").reshape(len(ids), -1)
            check = words[:, (np.arange(n) // per_word + words.shape[1] // 2) % words.shape[1]]
            cols = [value.ravel(), np.repeat(ids, n), check.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "id", "check"])

    return run


def _likely(limit: int):
    """Keep the (key, id) of which another row of the key differs in no more bits of the third column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, check in _whole_groups(batches):
            n, hit = len(key), np.zeros(len(key), bool)
            bits = (np.frombuffer(b"".join(check), np.uint64) if check.dtype == object else check.view(np.uint64)).reshape(n, -1)
            end = np.searchsorted(key, key, side="right")
            at, step = np.arange(n - 1), 1
            while len(at):
                at = at[at < n - step]
                at = at[key[at] == key[at + step]]
                open_ = at[~(hit[at] & hit[at + step])]
                for part in np.array_split(open_, len(open_) // 100_000 + 1):  # bounds the memory
                    near = part[np.bitwise_count(bits[part] ^ bits[part + step]).sum(axis=1, dtype=np.int64) <= limit]
                    hit[near] = hit[near + step] = True
                if step & (step - 1) == 0:  # rows of which no pair is open any more
                    missed = np.concatenate(([0], np.cumsum(~hit)))
                    at = at[~hit[at] | (missed[end[at]] > missed[at])]
                step += 1
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(ids[hit])], names=["key", "id"])

    return run


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each prefix: 32 bits of the shingle, the id, and the set's size and the shingle's place in one number."""
    for batch in batches:
        first = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
        for i in range(0, len(first), 500):
            part = first[i : i + 500]
            size = np.array([len(x) for x in part], np.int64)
            ids, n = (np.repeat(batch.column(c).to_numpy()[i : i + 500].astype(np.int64), size) for c in (0, 1))
            at = np.concatenate([np.arange(x) for x in size])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)), pa.array(ids), pa.array(n << 32 | at)], names=["key", "id", "place"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key another row has."""
    for key, ids, place in _whole_groups(batches):
        same = key[1:] == key[:-1]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (key, ids, place)], names=["key", "id", "place"])


def _prefix_pairs(least: float):
    """Pairs of different roots, once for each key that they share, as far as sizes and places let them be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, place, root in _whole_groups(batches):
            order = np.lexsort((place, key))
            key, ids, place, root = (c[order] for c in (key, ids, place, root))
            size, left = place >> 32, (place >> 32) - (place & 0xFFFFFFFF)
            # groups of one root have no pair
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            mixed = np.repeat(np.minimum.reduceat(root, edge) != np.maximum.reduceat(root, edge), np.diff(np.append(edge, len(key))))
            at, step = np.flatnonzero(mixed), 1
            while len(at):
                at = at[at < len(key) - step]
                to = at + step
                at = at[(key[at] == key[to]) & (size[at] >= least * size[to] - 1e-6)]
                for part in np.array_split(at, len(at) // 1_000_000 + 1):
                    to = part + step
                    # at most so many of the shared shingles that count come before this one
                    need = least / (1 + least) * (size[part] + size[to]) - 1e-6 - shared_least(size[part], least) + 1
                    ok = part[(root[part] != root[to]) & (np.minimum(left[part], left[to]) >= need)]
                    if len(ok):
                        a, b = ids[ok], ids[ok + step]
                        cols = np.minimum(a, b), np.maximum(a, b), shared_least(size[ok], least)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "least"])
                step += 1

    return run


def _similar_pairs(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            ok = np.array([similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), least) for p, q in zip(x, y)], bool)
            yield _links(np.stack((a[ok], b[ok]), axis=1))

    return run


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """(sid, set) of the picked texts of ``wanted``, read again."""
    rows = docs.select(named(id_col).alias("_i"), F.xxhash64(F.coalesce(named(text_col), F.lit(""))).alias("_h"), named(text_col).alias("_t"))
    texts = rows.join(wanted.select("sid", "picked.*"), F.col("_i").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("text_hash")))
    return materialise(texts.select("sid", set_udf(words)(F.col("_t")).alias("set")).dropDuplicates(["sid"]), "sets")


def _missed_links(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): similar classes of different components of ``found``."""
    # sets of fewer shingles are similar enough to others only if they are equal
    some = classes.where(F.col("n") >= math.floor(similarity / (1 - similarity) + 1e-6) if similarity < 1 else F.lit(False))
    dealt = _shards(some.select("sid", "n", "prefix").mapInArrow(_prefix_rows, "key int, id long, place long"), "key")
    shared = materialise(dealt.mapInArrow(_shared, "key int, id long, place long"), "shared")
    rooted = shared.join(found, F.col("id") == F.col("node"), "left").select("key", "id", "place", F.coalesce("root", "id").alias("root"))
    met = _shards(rooted, "key").mapInArrow(_prefix_pairs(similarity), "a long, b long, least long")
    pairs = materialise(met.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n >= least").select("a", "b"), "pairs")
    drop_table(shared)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sets = _sets(docs, id_col, text_col, words, classes.join(ends, "sid", "left_semi"))
    one, other = sets.select(F.col("sid").alias("a"), F.col("set").alias("x")), sets.select(F.col("sid").alias("b"), F.col("set").alias("y"))
    links = materialise(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(_similar_pairs(similarity), "a long, b long"), "links")
    drop_table(pairs)
    drop_table(sets)
    return links


def near_duplicates(
    docs: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8, bits: int = 512, band_bits: int = 32, slack: float = 3.0
) -> DataFrame:
    """(doc_id, text_hash, component, component_id, copies) of every distinct (id, text).

    Two texts are candidates if their signatures differ in no more bits than
    those of two texts of the wanted similarity do, plus ``slack`` standard
    deviations of that number, and share one of ``bits / band_bits`` bands, which
    are so long that few texts share one by chance in a corpus of any size. Texts
    that this leaves in different components are candidates too if their prefixes
    share as many shingles as those of all similar ones do.
    Candidates are linked if their sets of shingles are as similar as wanted.
    ``text_hash`` is xxhash64 of the text (null as empty) and ``copies`` counts
    equal rows.
    """
    expect = angle_bits(similarity, bits)
    radius = round(expect + slack * math.sqrt(expect * (1 - expect / bits)))
    share = expect / bits
    limit = math.ceil(64 * share + slack * math.sqrt(64 * share * (1 - share)))
    text_hash = F.xxhash64(F.coalesce(named(text_col), F.lit("")))
    described = described_udf(words, bits, similarity, *common_shingles(docs, text_col, words))(named(text_col))
    rows = docs.select(named(id_col).alias("doc_id"), text_hash.alias("text_hash"), described.alias("d"))
    known = materialise(rows.select("doc_id", "text_hash", "d.*"), "signatures")
    picked = F.min(F.struct("doc_id", "text_hash")).alias("picked")
    # a class is a set of shingles; all that its texts have in common follows from it
    same = [F.first(c).alias(c) for c in ("sig", "n", "prefix")]
    classes = materialise(known.groupBy("sid").agg(F.min("doc_id").alias("least"), picked, *same), "classes")
    dealt = _shards(classes.select("sid", "sig").mapInArrow(_bands(bits, band_bits), "key long, id long, check long"), "key")
    # first by one word of the signatures, then by all of them
    maybe = materialise(dealt.mapInArrow(_likely(limit), "key long, id long"), "maybe")
    signed = maybe.join(classes.select("sid", "sig"), F.col("id") == F.col("sid")).select("key", "id", "sig")
    likely = materialise(_shards(signed, "key").mapInArrow(_likely(radius), "key long, id long"), "likely")
    drop_table(maybe)
    # only texts with a likely partner are read again, one of each class
    wanted = classes.join(likely.select(F.col("id").alias("sid")).distinct(), "sid", "left_semi")
    sets = _sets(docs, id_col, text_col, words, wanted)
    whole = likely.join(sets.join(classes.select("sid", "sig"), "sid"), F.col("id") == F.col("sid")).select("key", "id", "sig", "set")
    found = connected_components(_shards(whole, "key").mapInArrow(_verified_links(radius, similarity), "a long, b long"), "a", "b")
    drop_table(likely)
    drop_table(sets)
    missed = _missed_links(docs, id_col, text_col, words, similarity, classes, found)
    if missed.limit(1).count():
        found = connected_components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(missed), "a", "b")
    counted = known.groupBy("doc_id", "text_hash", "sid").agg(F.count("*").alias("copies"))
    return _with_component(counted, "sid", classes.select("sid", "least"), found).select("doc_id", "text_hash", "component", "component_id", "copies")


def drop_near_duplicates(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """The rows of ``docs`` with one document kept of each group of near duplicates.

    The kept one has the group's smallest id; among rows that share it, the
    smallest text hash; among equal rows, one. A group whose ids are all null
    keeps one row.
    """
    with scope(docs.sparkSession) as keep:
        found = near_duplicates(docs, id_col, text_col, **options)
        best = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        kept = keep(materialise(best.groupBy("component").agg(F.min(F.struct("text_hash", "copies", "doc_id")).alias("k")).select("k.*"), "kept"))
    i, h = fresh(docs, "i", "h")
    hashed = F.xxhash64(F.coalesce(named(text_col), F.lit("")))
    keys = kept.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h))
    out = docs.join(keys, named(id_col).eqNullSafe(F.col(i)) & (hashed == F.col(h)), "left_semi")
    if kept.where("copies > 1").limit(1).count():
        out = out.withColumn(h, hashed).dropDuplicates([id_col, h]).drop(h)
    return out
