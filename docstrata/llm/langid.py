"""Language identification by cross-parsing entropy.

Of each labelled language a bounded sample of text becomes a suffix automaton.
A text is parsed against it from left to right into phrases, each the longest
match that the sample holds (Ziv and Merhav, 1993); a text in the sample's
language needs few phrases. The phrases, times the bits that point into the
sample, over the characters give the cross-parsing entropy, and the language
with the smallest one wins.

An automaton is flattened into one table that holds, for each state and class
of characters, the next state and whether a new phrase begins there, so that
many segments of text are parsed in step with numpy. The parse of a segment
starts ``WARM`` characters before it, and mostly is in the state in which the one
before it ended when it comes to its own characters. Those for which it is not
are parsed again from that state, until all agree. The result is the parse of the
whole text.

The sample is bounded by ``sample_chars`` characters over all languages, or
``least`` a language where these are more; which texts are in it follows from a
hash. Of a text longer than an eighth of a language's share, a window at a
place that follows from the hash is learnt from. Every label is learnt.

Beside the languages there is a null model, in which each character costs
``SLACK`` bits more than a letter drawn evenly from those known; the slack
spares short texts with names, numbers or keys in them. ``unknown`` is its share of the odds; it tells
texts in no learnt language, whose prediction means little.

Letters beyond the ``MOST`` commonest of the samples share ``HASHED`` classes by
a hash, so that scripts of many letters keep the table small and still have
matches; letters that no sample holds match nothing.

Defined results: a text that is null or has no letters is ``und`` with score
zero; ties go to the label that sorts first; repeated rows are repeated; if
there is nothing to learn from, all texts are ``und``; the label, source and id
of a document never enter its prediction; other columns stay, but those of the
names that are added are replaced.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, held, named

UNKNOWN = "und"
SEGMENT, WARM = 512, 96
PART = 2_000_000  # characters that are parsed together
GAP = 0  # class of all that is no letter; runs of it count as one
MOST, HASHED = 192, 63  # letters with a class of their own; classes of the other letters of the samples
SLACK = 2.0
ADDED = "lang_pred", "score", "entropy", "unknown"
SCHEMA = "lang_pred string, score double, entropy double, unknown double"


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start (Blumer et al., 1985)."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Alphabet:
    """Classes of characters: the gap, the letters of the samples, any other letter, padding."""

    def __init__(self, texts: list[str], most: int = MOST, hashed: int = HASHED):
        met = Counter(c for t in texts for c in t.lower() if c.isalpha())
        ranked = sorted(met, key=lambda c: (-met[c], c))
        letters, rare = sorted(ranked[:most]), ranked[most:]
        self.known = len(met)
        self.size = len(letters) + 3 + (hashed if rare else 0)
        self.other, self.pad = self.size - 2, self.size - 1
        self.table = np.fromiter((self.other if chr(c).isalpha() else GAP for c in range(0x110000)), np.uint16, 0x110000)
        for n, c in enumerate(letters, 1):
            self.table[ord(c)] = n
        for c in rare:
            self.table[ord(c)] = len(letters) + 1 + ord(c) * 2_654_435_761 % (1 << 32) * hashed // (1 << 32)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.table[points]
        return c[np.concatenate(([True], (c[1:] != GAP) | (c[:-1] != GAP)))] if len(c) else c


class Language:
    """A sample's automaton as one table: next state times classes, times two, plus one where a phrase begins after another.

    The last state is the one after a character that the sample lacks, which is
    a phrase of its own; the first is that before the text.
    """

    def __init__(self, text: str, alphabet: Alphabet):
        codes = alphabet.codes(text)
        step, width = suffix_automaton(codes.tolist()), alphabet.size
        self.bits = math.log2(max(2, len(codes)))
        lost = len(step) * width * 2
        begin = np.full(width, lost + 1, np.int32)
        for c, to in step[0].items():
            begin[c] = to * width * 2 + 1
        begin[alphabet.pad] = 0
        table = np.tile(begin, (len(step) + 1, 1))
        for s, out in enumerate(step):
            for c, to in out.items():
                table[s, c] = to * width * 2
        table[0] &= ~1
        self.table = table.ravel()

    def phrases(self, lanes: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases begun after the first in each lane; ``lanes`` has a row for each step, ``follows`` says which lane goes on with the one before."""
        state = np.zeros(lanes.shape[1], np.int32)
        for row in lanes[:WARM]:
            state = self.table[state + row] >> 1
        begin = state
        total, end = self._run(lanes, slice(None), begin)
        while True:
            wrong = np.flatnonzero(follows[1:] & (begin[1:] != end[:-1])) + 1
            if not len(wrong):
                return total
            begin[wrong] = end[wrong - 1]
            total[wrong], end[wrong] = self._run(lanes, wrong, begin[wrong])

    def _run(self, lanes: np.ndarray, own, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ended = np.zeros(len(state), np.int32)
        for row in lanes[WARM:, own]:
            got = self.table[state + row]
            ended += got & 1
            state = got >> 1
        return ended, state


class Model:
    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.alphabet = Alphabet(list(samples.values()))
        self.languages = [Language(samples[n], self.alphabet) for n in self.names]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, entropy and odds of the null model of each text."""
        a, n = self.alphabet, len(texts)
        codes = [a.codes(t or "") for t in texts]
        size = np.array([len(c) for c in codes], np.int64)
        lettered = np.array([bool((c != GAP).any()) for c in codes], bool)
        if not self.names or not lettered.any():
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n)
        pieces = -(-size // SEGMENT)
        first = np.concatenate(([0], np.cumsum(pieces)))
        grid = np.full((int(first[-1]), WARM + SEGMENT), a.pad, np.uint16)
        for c, at, m in zip(codes, first.tolist(), pieces.tolist()):
            whole = np.pad(c, (0, m * SEGMENT - len(c)), constant_values=a.pad).reshape(m, SEGMENT)
            grid[at : at + m, WARM:] = whole
            grid[at + 1 : at + m, :WARM] = whole[:-1, -WARM:]
        lanes = np.ascontiguousarray(grid.T)
        del grid
        follows = np.ones(lanes.shape[1], bool)
        follows[first[:-1][pieces > 0]] = False
        entropy = np.zeros((len(self.names), n))
        for k, lang in enumerate(self.languages):
            counted = np.concatenate(([0], np.cumsum(lang.phrases(lanes, follows))))
            entropy[k] = (counted[first[1:]] - counted[first[:-1]] + 1) * lang.bits / np.maximum(size, 1)
        best = entropy.argmin(axis=0)
        low = entropy.min(axis=0)
        # the posterior odds that the entropies give a document of a nominal length, or of its own where that is less
        odds = lambda bits: np.exp2(-np.clip((bits - low) * np.minimum(size, 32), -1000, 1000))
        known = odds(entropy).sum(axis=0)
        null = odds(math.log2(max(2, a.known + 1)) + SLACK)
        score = np.where(lettered, 1 / (known + null), 0.0)
        unknown = np.where(lettered, null / (known + null), 1.0)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score, low, unknown


def _model(samples: dict[str, str]) -> Model:
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    return held(("languages", key), lambda: Model(samples))


def predictor(samples: dict[str, str]):
    """Column function from a text to (lang_pred, score, entropy, unknown)."""

    @F.pandas_udf(SCHEMA)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(samples)
        for s in texts:
            done: list[tuple] = []
            held, chars = [], 0
            for t in chain(s, (...,)):  # parts bound the memory
                if t is ... or chars > PART:
                    done.append(model.predict(held))
                    held, chars = [], 0
                if t is not ...:
                    held.append(t)
                    chars += len(t or "")
            cols = [[x for d in done for x in d[0]], *(np.concatenate([d[k] for d in done]) for k in (1, 2, 3))]
            yield pd.DataFrame(dict(zip(ADDED, cols)))

    return predict


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_chars: int = 160_000, least: int = 2_000) -> dict[str, str]:
    """A sample of text for each label, ``sample_chars`` characters at most in all, but ``least`` for each label."""
    rows = labelled.select(named(id_col).alias("i"), named(text_col).alias("t"), named(lang_col).cast("string").alias("l"), F.length(named(text_col)).alias("n")).where("l is not null and n > 0")
    # lengths by powers of two say how much windows of any size hold
    sizes = rows.groupBy("l", F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("docs"), F.sum("n").alias("chars")).collect()
    names = {r["l"] for r in sizes}
    if not names:
        return {}
    share = max(least, sample_chars // len(names))
    window = max(1, share // 8)
    held = dict.fromkeys(names, 0)
    for r in sizes:
        held[r["l"]] += min(r["chars"], r["docs"] * window)
    # Windows that fill the share six times are expected, in the order of a hash; equal texts count once.
    rates = json.dumps({lang: min(1.0, 6 * share / n) for lang, n in held.items()})
    rate = F.element_at(F.from_json(F.lit(rates), "map<string,double>"), F.col("l"))
    order = F.pmod(F.xxhash64("i", "t", F.lit("langid")), F.lit(1 << 40))
    near = rows.withColumn("o", order).where(F.col("o") < rate * float(1 << 40))
    begin = F.pmod(F.xxhash64("i", "t", F.lit("place")), F.greatest(F.col("n") - F.lit(window), F.lit(0)) + 1).cast("int") + 1
    part = near.select("l", "o", F.substring(F.col("t"), begin, F.lit(window)).alias("t")).groupBy("l", "o").agg(F.min("t").alias("t"))
    picked: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for r in part.orderBy("o", "t").collect():
        lang, text = r["l"], r["t"]
        if size.get(lang, 0) + len(text) <= share:
            size[lang] = size.get(lang, 0) + len(text)
            picked.setdefault(lang, []).append(text)
    return {lang: "".join(t + "\n" for t in texts) for lang, texts in picked.items()}


def identify(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, lang_col: str, **bounds) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), entropy (bits a character) of the best language and unknown (0 to 1).

    Columns of these names that ``docs`` has are replaced.
    """
    (p,) = fresh(docs, "p")
    found = predictor(learn(labelled, id_col, text_col, lang_col, **bounds))(named(text_col))
    kept = [named(c) for c in docs.columns if c not in ADDED]
    return docs.select(*kept, found.alias(p)).select(*kept, f"{p}.*")


def with_language(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, lang_col: str, most_unknown: float = 0.99, **bounds) -> DataFrame:
    """The documents in a learnt language, with their own columns and the prediction as their ``lang_col``.

    Documents without a letter go, and those for which the odds of the null
    model are above ``most_unknown``. Without labels to learn from, all
    documents with a letter stay as they are.
    """
    samples = learn(labelled, id_col, text_col, lang_col, **bounds)
    if not samples:
        return docs.where(F.coalesce(named(text_col).rlike(r"\p{L}"), F.lit(False)))
    (p,) = fresh(docs, "p")
    kind = docs.schema[lang_col].dataType
    # told to be nondeterministic, it is not worked out again for the filter
    found = docs.select(*map(named, docs.columns), predictor(samples).asNondeterministic()(named(text_col)).alias(p))
    kept = found.where((F.col(f"{p}.lang_pred") != UNKNOWN) & (F.col(f"{p}.unknown") <= most_unknown))
    return kept.select(*[F.col(f"{p}.lang_pred").cast(kind).alias(c) if c == lang_col else named(c) for c in docs.columns])


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))
