"""The operators against plain versions of themselves, on small tables with all that is odd in them."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docstrata.llm import ann, common, decontam, langid, linededup, mixing, pii, queries, quality, simhash, tokens, urlfilter

DOC = "doc_id long, text string, lang string, source string, score double, path string, hits int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def documents(spark, rows):
    """Rows of (id, text), with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, "en", "s", 0.5, "p", 1) for i, t in rows], DOC).repartition(3)


# Components


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(None, 3), (5, 5)] + [(1000 + i, 1001 + i) for i in range(40)]
    found = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert {n: root(n) for n in parent if root(n) != n} == found


def test_components_of_nothing(spark):
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# 1 Language


def language_rows():
    rng = random.Random(2)
    kinds = {"aa": "ba be bi bo bu".split(), "bb": "kra kre kri kro kru".split(), "cc": "éso ésa ésu ésé".split()}
    rows = []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(30)), lang))
    return rows


def test_language_held_out(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(900, None, "aa"), (901, "", "aa"), (902, "123 ...", None), (None, rows[0][1] * 300, None)], "doc_id long, text string, lang string")
    fold = langid.in_fold(F.col("doc_id"), 3, 1)
    out = langid.identify(docs.unionByName(odd), docs.where(~fold), "doc_id", "text", "lang").withColumn("held", fold).collect()
    known = {i: lang for i, _, lang in rows}
    held = [r for r in out if r["held"] and r["doc_id"] in known]
    assert len(held) > 40 and all(r["lang_pred"] == known[r["doc_id"]] for r in held)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (900, 901, 902)} == {"und"}
    assert [r["lang_pred"] for r in out if r["doc_id"] is None] == ["aa"] and all(0 <= r["score"] <= 1 for r in out)
    assert langid.with_language(docs.unionByName(odd), docs, "doc_id", "text", "lang").count() == len(rows) + 1


def plain_phrases(sample, codes):
    """Longest matches from left to right; a character that the sample lacks is a phrase."""
    n = at = 0
    known = "".join(map(chr, sample))
    while at < len(codes):
        m = 1
        while at + m < len(codes) and "".join(map(chr, codes[at : at + m + 1])) in known:
            m += 1
        at += m
        n += 1
    return n


def test_language_prediction_matches_a_plain_one():
    rng = random.Random(3)
    kinds = {"aa": "ba be bi bo bu".split(), "bb": "bra be kri bo kru".split(), "cc": "\u4e00 \u4e8c\u4e09 \u56db be".split()}
    made = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    samples = {k: made(k, 300) for k in kinds} | {"dd": "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(900))}
    model = langid.Model(samples)
    texts = [made(k, n) for k in kinds for n in (1, 3, 60, 400)] + ["be" * 900, "zzz", "be \u9fa0 be", "1", "", None, "\u4e00" * 600, made("aa", 100) + made("bb", 100)]
    got = model.predict(texts)
    for t, lang, low in zip(texts, got[0], got[2]):
        c = model.alphabet.codes(t or "").tolist()
        if not any(c):
            assert lang == "und"
            continue
        codes = {k: model.alphabet.codes(samples[k]).tolist() for k in samples}
        bits = {k: plain_phrases(codes[k], c) * math.log2(len(codes[k])) / len(c) for k in samples}
        assert bits[lang] == min(bits.values()) and math.isclose(low, bits[lang]), t[:20]


def test_languages_are_learnt_whatever_their_number_and_length(spark):
    rng = random.Random(5)
    syllables = {f"l{n:02d}": [rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(6)] for n in range(70)}
    made = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(3)) for _ in range(n))
    rows = [(i * 100 + j, made(k, 60), k) for i, k in enumerate(syllables) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, docs, "doc_id", "text", "lang").select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95 and {r["lang_pred"] for r in out} == set(syllables)
    long = spark.createDataFrame([(1, made("l00", 40_000), "l00"), (2, made("l01", 40_000), "l01"), (3, made("l00", 20), None)], docs.schema)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(long, long, "doc_id", "text", "lang").collect()}
    assert found == {1: "l00", 2: "l01", 3: "l00"}
    foreign = spark.createDataFrame([(1, "\u4e2d\u6587" * 30, "x"), (2, made("l00", 20), "x"), (3, "12", "x")], docs.schema)
    kept = langid.with_language(foreign, long, "doc_id", "text", "lang").collect()
    assert [(r["doc_id"], r["lang"]) for r in kept] == [(2, "l00")]


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(docs, docs, "doc_id", "text", "lang").collect()] == ["und"]
    assert langid.identify(docs.limit(0), docs, "doc_id", "text", "lang").count() == 0
    mixed = spark.createDataFrame([(1, "words", None), (2, None, None), (3, "12", None)], docs.schema)
    assert [r["doc_id"] for r in langid.with_language(mixed, mixed, "doc_id", "text", "lang").collect()] == [1]


# 2 Mixing


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 30)), rng.choice(["a", "a", "a", "b", None]), rng.choice("xy")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.5, "b": 0.3, "(none)": 0.2}, "lang": {"x": 0.7, "y": 0.3}, "topic": {}}
    out = mixing.mix(docs, "doc_id", "text", "source", "lang", F.lit("t"), targets, 0.4, carry=False).toPandas()
    assert len(out) == len(rows)
    out["w"] = out["tokens"] * out["probability"]
    share = lambda c: (out.groupby(c)["w"].sum() / out["w"].sum()).to_dict()
    assert share("source") == pytest.approx(targets["source"], abs=1e-3) and share("lang") == pytest.approx(targets["lang"], abs=1e-3)
    assert out["w"].sum() == pytest.approx(0.4 * out["tokens"].sum(), rel=1e-6)
    assert out.loc[out["kept"], "tokens"].sum() == pytest.approx(out["w"].sum(), rel=0.1)


def test_mixing_full_cells_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "rare", "x"), (2, None, "rare", "x"), (None, "", "z", "x"), *[(i, "w " * 20, "big", "x") for i in range(10, 60)]], "doc_id long, text string, source string, lang string")
    out = mixing.mix(docs, "doc_id", "text", "source", "lang", F.lit("t"), {"source": {"rare": 0.5, "big": 0.5}, "lang": {}, "topic": {}}, 0.5).toPandas()
    assert (out.loc[out.source == "rare", "probability"] == 1).all() and not out.loc[out.source == "z", "kept"].any()
    assert mixing.mix(docs.limit(0), "doc_id", "text", "source", "lang", F.lit("t"), queries.TARGETS, 0.5).count() == 0


def test_mixing_tells_of_targets_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(1, "w " * 9, "a", "x"), (2, "w " * 9, "b", "y")], "doc_id long, `text.t` string, source string, lang string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.9, "y": 0.1}, "topic": {}}
    with pytest.warns(UserWarning, match="not met"):
        assert mixing.mix(docs, "doc_id", "text.t", "source", "lang", F.lit("t"), targets, 0.5, carry=False).count() == 2


def test_mixing_keeps_the_rest(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, 20), rng.choice(["a", "a", "a", "b", "new", None]), rng.choice(["x", "x", "y", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.4, "b": 0.6, "absent": 0.1}, "lang": {"x": 0.7, "y": 0.3}, "topic": {}}
    out = mixing.mix(docs, "doc_id", "text", "source", "lang", F.lit("t"), targets, 0.3, rest=True).toPandas()
    out["w"] = out["tokens"] * out["probability"]
    for c, listed, shares in (("source", ("a", "b"), {"a": 0.4, "b": 0.6}), ("lang", ("x", "y"), {"x": 0.7, "y": 0.3})):
        got, before = out.groupby(c)["w"].sum() / out["w"].sum(), out.groupby(c)["tokens"].sum() / out["tokens"].sum()
        kept = before[~before.index.isin(listed)].sum()
        assert got[~got.index.isin(listed)].sum() == pytest.approx(kept, abs=1e-3) and kept > 0.2
        assert [got[v] for v in listed] == pytest.approx([shares[v] * (1 - kept) for v in listed], abs=1e-3)
    assert out.loc[out.source == "(none)", "kept"].any() and out.loc[out.source == "new", "kept"].any() and out.loc[out.lang == "(none)", "kept"].any()
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert mixing.mix(none, "doc_id", "text", "source", "lang", F.lit("t"), targets, 0.3, rest=True).where("kept").count() > 0


# 3 URLs


def judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url[url.index("://") + 3 :], re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fit = [(len(h) + len(p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("small", [0, 20_000])
def test_urls(spark, small):
    rng = random.Random(4)
    hosts = ["example.com", "www.EXAMPLE.com", "com", "a.b.example.net", "example.net:80", "xexample.com", "example.org", ".com", "é.org"]
    paths = ["", "/", "/en/", "/en/7", "/en/77?x", "/de/8#a", "/de/", "/es/ü", "/EN/", "/en", "?/en/", "/e\nn"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(200)] + [None, "", "no scheme", "://", "a://b://example.com/en/", "http:/x"] + ["http://example.com/en/7"] * 50
    pages = spark.createDataFrame([(i if i % 9 else None, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block")], "host string, path string, verdict string")
    out = urlfilter.judge_urls(pages, "url", rules, broadcast_rules=small).collect()
    want = sorted(repr((u, *judge(u, queries.URL_RULES))) for u in urls)
    assert sorted(repr((r["url"], r["host"], r["path"], r["rule"], r["verdict"])) for r in out) == want
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, "url", rules.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives_and_few_positives(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    words = urlfilter.bloom_filter(keys, "key", 256).first()["filter"]
    probe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(words).alias("w"))
    hit = probe.where(F.element_at("w", urlfilter._block(F.col("k"), 256) + 1).bitwiseAND(urlfilter._mask(F.col("k"))) == urlfilter._mask(F.col("k")))
    got = {r["k"] for r in hit.select("k").collect()}
    assert {f"k{i}" for i in range(500)} <= got and len(got) < 1000


# 4 SimHash


def plain_simhash(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def copies(rng, n=40):
    rows = []
    for i in range(n):
        rows.append((i * 10, prose(rng, rng.randrange(3, 120))))
    for i in range(n):
        w = rows[rng.randrange(n)][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    return rows + [(2000, rows[0][1]), (2001, None), (2002, ""), (2003, " \t\n"), (2004, "x y"), (2005, "X\u00a0Y z " * 4000), (7, rows[3][1]), (None, rows[5][1]), rows[2]]


def test_fingerprint_components(spark):
    rows = copies(random.Random(5))
    out = simhash.fingerprint_components(documents(spark, rows), "doc_id", "text").collect()
    prints = [plain_simhash(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    want = [(d, f"{p:016x}", min((x for x in least[root(i)] if x is not None), default=None)) for i, ((d, _), p) in enumerate(zip(rows, prints))]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in out)
    assert simhash.fingerprint_components(documents(spark, []), "doc_id", "text").count() == 0


def test_bk_links_keep_all_connections():
    rng = random.Random(6)
    for radius in (0, 1, 3, 8):
        values = list({rng.getrandbits(12) for _ in range(150)})
        links = simhash.bk_links(values, radius)
        assert all((values[i] ^ values[j]).bit_count() <= radius for i, j in links)

        def parts(pairs):
            p = list(range(len(values)))

            def root(x):
                while p[x] != x:
                    x = p[x]
                return x

            for a, b in pairs:
                x, y = root(a), root(b)
                p[max(x, y)] = min(x, y)
            return [root(i) for i in range(len(values))]

        every = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= radius]
        assert parts(links) == parts(every)


def jaccard(a, b, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicates_are_found_and_others_left(spark):
    rng = random.Random(7)
    rows, group = [], {}
    for i in range(60):
        text = prose(rng, rng.randrange(80, 250))
        rows.append((i, text))
        for j in range(3):
            w = text.split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "other"
            rows.append((100 + 10 * i + j, " ".join(w)))
            if jaccard(text, rows[-1][1]) >= 0.8:
                group[rows[-1][0]] = i
    rows += [(5000 + i, prose(rng, 4)) for i in range(30)] + [rows[0], (0, rows[4][1]), (9000, None)]
    docs = documents(spark, rows)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, "doc_id", "text").collect() if r["doc_id"] != 0}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    want = {d: least[root(i)] for i, (d, _) in enumerate(rows) if d != 0}
    assert len(group) > 100 and all(found[d] == w for d, w in want.items())
    kept = simhash.drop_near_duplicates(docs, "doc_id", "text").collect()
    texts = [r["text"] for r in kept]
    assert len(texts) == len(set(texts)) and docs.columns == simhash.drop_near_duplicates(docs, "doc_id", "text").columns
    assert {5000 + i for i in range(30)} <= {r["doc_id"] for r in kept} and not {r["doc_id"] for r in kept} & {d for d in group if found[d] != d}


def test_near_duplicates_beyond_the_signatures(spark):
    rng = random.Random(71)
    pairs, rows = [], []
    for _ in range(6):  # a footer that repeats, a shingle that repeats, a short text with one more word
        text, short, run = prose(rng, 200), prose(rng, 8), prose(rng, 5)
        pairs += [(text, text + (" " + prose(rng, 12)) * 5), (short, short + " more"), (text + " x" + " end" * 6, text + " x" + " end" * 400), (run + " z", " ".join([run, "z"] * 60))]
    for i, (a, b) in enumerate(pairs):
        rows += [(10 * i, a), (10 * i + 1, b)]
    want = {10 * i + 1: 10 * i for i, (a, b) in enumerate(pairs) if jaccard(a, b) >= 0.8}
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(spark, rows), "doc_id", "text").collect()}
    assert len(want) >= 12
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert found == {d: rows[root(i)][0] for i, (d, _) in enumerate(rows)}


def test_texts_of_equal_signature_are_compared(spark, monkeypatch):
    rng = random.Random(73)
    line, base = prose(rng, 11), prose(rng, 100)
    rows = [(i, (line + " ") * 40 + prose(rng, 60)) for i in range(4)] + [(10 + i, "go " * 80 + prose(rng, 60)) for i in range(4)] + [(20, base), (21, base + " more")]
    apart = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(spark, rows), "doc_id", "text").collect()}
    want = {d: 20 if d == 21 else d for d, _ in rows}
    assert apart == want
    # also where all signatures are the same
    monkeypatch.setattr(simhash, "described_udf", _one_signature(simhash.described_udf))
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(spark, rows), "doc_id", "text").collect()} == want


def _one_signature(made):
    def described(*args):
        d = made(*args)
        return lambda c: F.struct(*[F.lit(bytes(64)).alias("sig") if k == "sig" else d(c)[k].alias(k) for k in ("sid", "sig", "n", "prefix")])

    return described


def test_near_duplicates_beside_clashing_columns(spark):
    rng = random.Random(74)
    text = prose(rng, 40)
    rows = [(1, text, "a", 1), (1, text, "b", 2), (2, text + " more", "c", 3), (3, prose(rng, 40), "d", 4)]
    docs = spark.createDataFrame(rows, "_i long, `t.x` string, _h string, i int")
    out = simhash.drop_near_duplicates(docs, "_i", "t.x")
    assert out.columns == docs.columns and sorted(r["_i"] for r in out.collect()) == [1, 3]


def test_prefixes_meet_in_any_order():
    rng = np.random.default_rng(72)
    for n in (1, 4, 5, 9, 60, 300):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for _ in range(20):
            drop = rng.permutation(len(a))[: len(a) // 9]
            b = np.unique(np.concatenate((np.delete(a, drop), rng.integers(0, 1 << 63, len(drop)).astype(np.uint64))))
            common = np.sort(rng.permutation(a)[: len(a) // 2])
            p, q = (simhash.prefix(x, 0.8, common, np.arange(len(common))[::-1]) for x in (a, b))
            if simhash.similar(a, b, 0.8):
                assert set(p.tolist()) & set(q.tolist())
            if simhash.similar(a, b, 0.8) and set(a.tolist()) != set(b.tolist()):
                assert len(set(p.tolist()) & set(q.tolist())) >= simhash.shared_least(min(len(a), len(b)), 0.8)


# 5 Records


def test_records_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    rng = random.Random(8)
    odd = ["", None, "  two  spaces ", "tab\there", "a\n\nb", "it's we'll x's 12's", "\n", "é ü\u00a0ß", "a\x85b\x1fc", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|>", "<|endoftext", "nul\0 b\0", "x \0b", " \0b c \0d", "\0", "x" * 5000, prose(rng, 20_000), "ende.\nAnfang, \u4e2d\u6587 \U0001f600", "a\r\nb"]
    rows = [(rng.randrange(-50, 50), prose(rng, 30)) for _ in range(60)] + list(enumerate(odd, 100)) + [(None, "null id"), (3, "again"), (3, "again")]
    out = common.new_path(spark, "t")
    tokens.write_records(documents(spark, rows), "doc_id", "text", path, 2, out, shard_chars=20_000)
    index = tokens.read_index(spark, out)
    got = tokens.with_starts(index).orderBy("start").collect()
    texts = spark.createDataFrame([(t or "",) for _, t in rows], "t string")
    order = {r["t"]: r["h"] for r in texts.select("t", F.xxhash64("t").alias("h")).collect()}
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order[r[1] or ""])):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    assert index.select("file").distinct().count() > 3
    r = got[7]  # a seek by the index
    with open(r["file"].removeprefix("file:"), "rb") as f:
        f.seek(r["offset"])
        [(_, _, doc_id, ids)] = list(tokens.frames(f.read(r["length"])))
    assert doc_id == r["doc_id"] and len(ids) == r["n_tokens"]


def test_words_match_the_tokenizer_on_odd_texts():
    path = queries.tokenizer_path()
    encode = tokens.WordEncoder(path, most=500)
    rng = random.Random(12)
    bits = [" ", " ", "\n", "\0", "\t", "a", "Word", "1", "'s", "'", "\u00e9", "\u00a0", "\u4e2d", "<|endoftext|>", "<|", ".", "#!", "\r", "\x1c", "\u0301", "\U0001f600"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(100_000)]
    texts += [prose(rng, 300_000), "y" * 200_000, "z \0" * 50_000]
    plain = encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert encode.words is not None and encode(texts) == [np.array(e.ids, encode.kind).tobytes() for e in plain]


def test_damaged_records_raise():
    data = tokens.frame(5, np.arange(9, dtype="<u2").tobytes(), False) + tokens.frame(None, b"", False)
    assert [(d, i.tolist()) for _, _, d, i in tokens.frames(data)] == [(5, list(range(9))), (None, [])]
    for at in (0, 9, 20, len(data) - 2):
        with pytest.raises(ValueError):
            list(tokens.frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
    with pytest.raises(ValueError):
        list(tokens.frames(data[:-3]))


def test_hot_ids_are_split(spark):
    rows = [(None, f"text {n} " + "word " * 40) for n in range(300)] + [(5, "the same")] * 3000
    out = common.new_path(spark, "t")
    tokens.write_records(documents(spark, rows), "doc_id", "text", queries.tokenizer_path(), 2, out, shard_chars=4000)
    index = tokens.with_starts(tokens.read_index(spark, out))
    got = index.orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in rows] and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert max(r["count"] for r in index.groupBy("file").count().collect()) <= 4 * 4000 * 3300 // sum(len(t) for _, t in rows)


def test_starts_follow_the_numbers_of_files(spark):
    names = [(5, 0), (5, 1), (99_999, 0), (100_000, 0), (100_000, 10), (1_000_000, 2)]
    rows = [(f"s3://x/shards/part-{n:05d}-3f2a0c1e-1111-c{c:03d}.txt", 10**k) for k, (n, c) in enumerate(names)]
    index = spark.createDataFrame([(f, 0, 1, 1, t, 0, 0) for f, t in rows], tokens.INDEX).repartition(3)
    got = {r["file"]: r["start"] for r in tokens.with_starts(index).collect()}
    assert [got[f] for f, _ in rows] == [sum(t for _, t in rows[:k]) for k in range(len(rows))]


def test_no_records(spark):
    out = common.new_path(spark, "t")
    tokens.write_records(documents(spark, []), "doc_id", "text", queries.tokenizer_path(), 2, out)
    assert tokens.with_starts(tokens.read_index(spark, out)).count() == 0


# 6 Quality


def test_quality(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60) if i % 2 else " ".join(rng.choice("abc") * 6 for _ in range(60))) for i in range(600)]
    docs = documents(spark, [*rows, (9001, None), (9002, ""), (None, "x")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(600) if zlib.crc32(str(i).encode()) % 5] + [(3, None), (4, 7), (None, 1), (77777, 0)], "doc_id long, quality int")
    forest = quality.learn(docs, labels, "doc_id", "text", "doc_id", "quality")
    out = quality.score_quality(docs, forest, "text").collect()
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 60 and sum((r["score"] >= 0.3) == bool(r["doc_id"] % 2) for r in held) >= 0.98 * len(held)
    assert len(out) == 603 and all(0 <= r["score"] <= 1 for r in out)
    none = quality.learn(docs, labels.limit(0), "doc_id", "text", "doc_id", "quality")
    assert {r["score"] for r in quality.score_quality(docs, none, "text").collect()} == {0.5}


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    forest = quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=20, depth=3)

    def walk(row):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.limit, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        return total

    assert np.allclose(forest.raw(x), [walk(r) for r in x])


def plain_statistics(text):
    """Character by character and word by word."""
    b = (text or "").encode()
    words, word = [], []
    for c in b:
        if c in b" \t\n\r\x0b\x0c":
            words, word = (words + [bytes(word)] if word else words), []
        else:
            word.append(c)
    words += [bytes(word)] if word else []
    if not words:
        return [0.0] * len(quality.NAMES)
    n, lines, marks = len(words), b.split(b"\n"), b"#$%&*+/<=>@[\\]^_`{}~"
    kinds = sorted(set(words))
    share = lambda test: sum(map(test, b)) / len(b)
    per_word = lambda c: sum(x == ord(c) for x in b) / n
    return [
        math.log(1 + n), sum(len(w) for w in words) / n, len(kinds) / n, sum(a == c for a, c in zip(words, words[1:])) / (n - 1) if n > 1 else 0.0, max(words.count(w) for w in kinds) / n,
        share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in marks), per_word("!"), per_word("|"), per_word("."), per_word(","),
        share(lambda c: c > 127), math.log(1 + len(lines)), len(b) / len(lines), sum(x in lines[:k] for k, x in enumerate(lines)) / len(lines),
        sum(len(w) < 3 for w in words) / n, sum(len(w) > 11 for w in words) / n, sum(w[-1] in marks for w in kinds) / len(kinds), len(zlib.compress(b, 1)) / len(b),
    ]


def test_statistics_match_a_plain_version(spark):
    rng = random.Random(4)
    odd = [None, "", " \n\t", "a", "é", "ÄÖ ж 漢字 漢字", "a\nb\nb\n\n", "A1! |,.#$%", "same same same", "\x00 \x1c x\x0by", "longwordlongword " * 3, "x" * 20_000, "word# " * 3000]
    texts = odd + ["".join(rng.choice("aB3 é\n#|!.,x") for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    got = documents(spark, list(enumerate(texts))).select("doc_id", quality.statistics_udf()("text").alias("x")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert np.allclose(r["x"], plain_statistics(texts[r["doc_id"]]), rtol=1e-12, atol=1e-12), texts[r["doc_id"]]


@pytest.mark.parametrize("seed", range(6))
def test_each_split_is_the_best_of_all(seed, trees=6, depth=3, bins=8, rate=0.1, least=1.7, l2=1.0):
    """Every split of every node is tried on its rows themselves; of equally good ones any will do."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, 3))
    x[:, 1] = np.round(x[:, 1])  # ties and repeated edges
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=150) * 0.3) > 0).astype(float)
    forest = quality.fit(x, y, trees=trees, depth=depth, bins=bins, least=least)  # no sum of weights is just the least, where rounding decides
    limits = [sorted({float(np.quantile(c, q)) for q in np.linspace(0, 1, bins + 1)[1:-1]}) for c in x.T]
    raw, splits = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), 0
    for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + l2)
        nodes = {0: np.arange(len(y))}
        for n in range(2**depth - 1):
            rows = nodes[n]
            best = 0.0
            for k, t in ((k, t) for k in range(3) for t in limits[k]):
                low, high = rows[x[rows, k] <= t], rows[x[rows, k] > t]
                if h[low].sum() >= least and h[high].sum() >= least:
                    best = max(best, worth(low) + worth(high) - worth(rows))
            low, high = rows[x[rows, feature[n]] <= limit[n]], rows[x[rows, feature[n]] > limit[n]]
            nodes[2 * n + 1], nodes[2 * n + 2] = low, high
            assert abs(worth(low) + worth(high) - worth(rows) - best) < 1e-8
            if len(high):
                assert limit[n] in limits[feature[n]] and min(h[low].sum(), h[high].sum()) >= least - 1e-9
                splits += 1
        for n in range(2**depth):
            rows = nodes[2**depth - 1 + n]
            assert abs(leaf[n] + rate * g[rows].sum() / (h[rows].sum() + l2)) < 1e-9
            raw[rows] += leaf[n]
    assert len(forest.leaf) == trees and splits > trees and np.allclose(forest.raw(x), raw, atol=1e-9)


# 7 Lines


def plain_line_dedup(rows, min_words=5, min_lines=1):
    """Text and merged runs by comparing every place with every earlier one."""
    texts = [(d, t.split("\n")) for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) if t is not None]
    places = [(k, n) for k, (_, ls) in enumerate(texts) for n in range(len(ls))]
    gone = defaultdict(set)
    for i, (k, n) in enumerate(places):
        here, best = texts[k][1], 0
        for l, m in places[:i]:
            there, size = texts[l][1], 0
            while n + size < len(here) and m + size < len(there) and here[n + size] == there[m + size]:
                size += 1
            best = max(best, size)
        if best >= min_lines and best and len(" ".join(here[n : n + best]).split()) >= min_words:
            gone[k] |= set(range(n, n + best))
    out = {d: (None, []) for d, t in rows if t is None}
    for k, (d, ls) in enumerate(texts):
        edge = [n for n in sorted(gone[k]) if n - 1 not in gone[k]]
        runs = [(n, next(m for m in range(n, len(ls) + 1) if m not in gone[k]) - n) for n in edge]
        out[d] = ("\n".join(x for n, x in enumerate(ls) if n not in gone[k]), runs)
    return out


@pytest.mark.parametrize("min_words, min_lines", [(5, 1), (0, 1), (40, 1), (7, 3)])
def test_line_dedup(spark, min_words, min_lines):
    rng = random.Random(10 + min_words)
    pool = [prose(rng, rng.choice([1, 2, 3, 4, 6, 30])) for _ in range(14)] + ["", "tau"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(50)]
    long = [rng.choice(pool) + (str(n) if n % 5 == 0 else "") for n in range(60)]
    rows += [(60, "\n".join(long)), (61, "\n".join(long[7:41])), (62, "\n".join(["x", *long[3:50], "y", *long[20:33]])), (63, "\n".join(long[:9] + long[40:]))]
    rows += [(100, None), (101, ""), (102, ""), (103, "\n\n\n"), (104, "a b\n" * 30), (105, "a b\nc d e\n" * 20), (None, pool[0] + "\n" + pool[1])]
    out = {r["doc_id"]: (r["text"], [(x["first"], x["size"]) for x in r["runs"]]) for r in linededup.dedup_lines(documents(spark, rows), "doc_id", "text", min_words, min_lines).collect()}
    want = plain_line_dedup(rows, min_words, min_lines)
    assert out == want and sum(bool(r) for _, r in want.values()) > 8


def test_line_dedup_of_equal_rows_and_none(spark):
    docs = documents(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb")])
    out = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in linededup.dedup_lines(docs, "doc_id", "text", 2).collect())
    assert out == [(1, "a\nb\nc", 3, 0), (1, "a\nb\nc", 3, 0), (2, "x", 3, 2)]
    assert linededup.dedup_lines(documents(spark, []), "doc_id", "text").count() == 0


# 8 Contamination


def plain_contamination(rows, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        k = min(n, len(w))
        for at in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[at : at + k])].add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for k in {len(x) for x in windows}:
            for at in range(len(w) - k + 1):
                if own := windows.get(tuple(w[at : at + k])):
                    hit |= set(range(at, at + k))
                    found |= own
        out.append((d, len(w), sorted(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [60, 2_000_000])
def test_contamination(spark, block):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randrange(8, 40))) for i in range(15)] + [(20, "Two words"), (21, "one"), (22, ""), (23, None), (None, prose(rng, 12)), (3, prose(rng, 11)), (24, "tau tau " * 9)]
    rows = []
    for i in range(80):
        w = prose(rng, rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(3)):
            src = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(src) + 1)
            w[rng.randrange(len(w) + 1) : 0] = src[at : at + rng.randrange(5, 30)]
        rows.append((i, ("! ".join(w)).title() if i % 3 else " ".join(w)))
    rows += [(500, None), (501, ""), (None, "one"), (502, "tau " * 40), rows[0], (503, prose(rng, 5) + " " + items[0][1] + " " + prose(rng, 30_000))]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    out = [(r["doc_id"], r["n_words"], list(r["hits"]), list(r["items"])) for r in decontam.find_contamination(docs, bench, most_words=block).collect()]
    want = plain_contamination(rows, items)
    assert sorted(map(repr, out)) == sorted(map(repr, want)) and any(h for _, _, h, _ in want)
    clean = decontam.drop_contaminated(docs, bench, most_words=block)
    assert clean.columns == docs.columns and clean.count() == sum(not h for _, _, h, _ in want)
    assert decontam.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 5, 60).astype(np.uint64), rng.integers(0, 5, 60).astype(np.uint64)
        b[20:30] = a[35:45]
        ga, gb = decontam.gram_hashes(a, 5), decontam.gram_hashes(b, 5)
        assert set(ga[decontam.winnow(ga, 6)][:].tolist()) & set(gb[decontam.winnow(gb, 6)].tolist())


# 9 Neighbours


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 24))
    x = centres[rng.integers(0, 8, 900)] + 0.4 * rng.normal(size=(900, 24))
    x[300:340] = x[200]  # many equal vectors
    good = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    bad = [(2000, None), (2100, []), (2200, [0.0] * 24), (2300, [float("nan")] * 24), (2400, [1.0] * 23), (2500, [None] + [1.0] * 23), (2600, [float("inf")] * 24), (None, [1.0] * 24)]
    rows = spark.createDataFrame([(*r, 1, "c", 2) for r in good + bad], "vec_id long, embedding array<float>, score int, codes string, cell int").repartition(5)
    monkeypatch.setattr(ann, "GROUP", 300)
    index, known, book = ann.build_index(rows, "vec_id", "embedding")
    assert known.count() == 900 and index.select("at").distinct().count() == 3
    out = defaultdict(list)
    for r in ann.search(index, known.where(F.col("vec_id") % 100 == 0), book, keep=60, block=(4, 4)).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    v = np.array([r for _, r in good])
    hits = total = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        near = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        assert all(math.isclose(s, d[i], abs_tol=1e-9) for i, s in out[q]) and len(out[q]) == 10
        hits += len(set(near) & {i for i, _ in out[q]})
        total += 10
    assert hits / total >= 0.9 and [i for i, _ in out[200]] == list(range(300, 310))


def stretches(book, x, size=5_000):
    """An index in one piece, as (ids, vectors, codes)."""
    return [(np.arange(len(x))[i : i + size], x[i : i + size], ann.encode(book, x[i : i + size])) for i in range(0, len(x), size)]


def spread(rng, case, n=10_000, dim=64):
    x = rng.normal(size=(n, dim))
    kind, by = case
    if kind == "offset":
        return x + by
    if kind == "lengths":
        return x * np.exp(by * rng.normal(size=(n, 1)))
    if kind == "clusters":
        return (rng.normal(size=(50, dim))[rng.integers(0, 50, n)] + 0.3 * x) * np.exp(by * rng.normal(size=(n, 1)))
    if kind == "uneven":
        return x * np.exp(by * rng.normal(size=dim)) * np.exp(0.5 * rng.normal(size=(n, 1)))
    return x * np.where(rng.random((n, 1)) < 0.005, by, 1)


CASES = [*[("offset", v) for v in (0, 3, 10, 100)], *[(k, v) for k in ("lengths", "clusters") for v in (0.5, 1.0, 1.5)], ("uneven", 1.0), ("uneven", 2.0), ("long", 100)]


@pytest.mark.parametrize("case", CASES)
def test_recall(case):
    x = spread(np.random.default_rng(6), case).astype(np.float32).astype(float)
    book, ids = ann.fit(x[:2000], rounds=2), np.arange(len(x))
    asked = ids[::200]
    found = ann.nearest_of(book, stretches(book, x), asked, x[asked], 10, 256)
    hit = 0
    for q, (_, got) in zip(asked.tolist(), found):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(got.tolist()) & set(np.argsort(d)[:10].tolist()))
    assert hit / (10 * len(asked)) >= 0.9


def test_cells_spare_work_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(60, 16)) * 20 + 50
    x = middles[rng.integers(0, 60, 12_000)] + rng.normal(size=(12_000, 16))
    ids = np.arange(len(x))
    book = ann.fit(x[:2000], rounds=2)
    book.cells = ann.centroids(x[:2000] - book.centre)
    cell = ann.nearest_cell(x - book.centre, book.cells)
    order = np.lexsort((ids, cell))
    met = []
    tables = ann.Codebook.tables
    monkeypatch.setattr(ann.Codebook, "tables", lambda self, q: met.append(len(q)) or tables(self, q))
    asked = ids[::100]

    def found():
        met.clear()
        parts = [(ids[order[i:j]], x[order[i:j]], ann.encode(book, x[order[i:j]])) for i, j in ann._chunks(cell[order], 200)]
        return {(q, v, round(d, 9)) for q, (far, near) in zip(asked.tolist(), ann.nearest_of(book, parts, asked, x[asked], 10, 256)) for d, v in zip(far.tolist(), near.tolist())}

    whole, pairs = found(), sum(met)
    book.anchors = ids[:2000], x[:2000]
    assert found() == whole and sum(met) < pairs and sum(met) < 6 * len(asked)  # of more than 60 stretches
    for q in asked.tolist():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert {v for a, v, _ in whole if a == q} == {i for i in np.argsort(d, kind="stable").tolist() if i != q and d[i] <= np.sort(d)[10]}


def test_neighbours_of_few_and_none(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 4.0]), (1, [1.0, 2.0, 4.0])], "vec_id long, embedding array<float>")
    index, known, book = ann.build_index(rows, "vec_id", "embedding")
    assert [(r["vec_id"], r["score"]) for r in ann.search(index, known.where(F.col("vec_id") % 100 == 0), book).orderBy("rank").collect()] == [(1, 1.0), (1, 1.0)]
    assert ann.search(index, known.where("vec_id = 7"), book).count() == 0
    index, known, book = ann.build_index(rows.limit(0), "vec_id", "embedding")
    assert ann.search(index, known, book).count() == 0


def test_codes_favour_the_parallel_residual():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def error(threshold):
        book = ann.fit(x, threshold)
        packed = ann.encode(book, x, threshold)
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(x), -1)
        back = np.concatenate([book.words[m, codes[:, m]] for m in range(8)], axis=1)
        return np.mean(((x - back) * x).sum(axis=1) ** 2)

    assert error(0.5) < error(0.0)


# 10 Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and plain_luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark):
    rng = random.Random(12)
    bits = ["a.b@c.de", "x@y", "me@host.co_x@y.zz", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+49 (30) 1234-567", "+1 2", "+12 345 678 901 234 567", "12", "é", "\U0001f600", ".", " ", "\n", "@", "a@@b.c.d", "9" * 30, "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "card", "%+-._", "0@1.2"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(0, 14)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "7" * 30_000), (903, "a." * 30_000), (904, "x " * 30_000 + "a@b.cd"), (None, "1.2.3.4"), rows[1]]
    out = pii.find_personal_data(documents(spark, rows), "doc_id", "text").collect()
    got = sorted(repr((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in BASE])) for r in out)
    assert got == sorted(repr((i, plain_spans(t))) for i, t in rows)
    for r in out:
        assert all(0 <= s["score"] <= 1 for s in r["spans"])


def test_iban_and_context(spark):
    docs = documents(spark, [(1, "Pay to IBAN DE89370400440532013000 now."), (2, "part DE89370400440532013001"), (3, "card 4111111111111111"), (4, "order 4111111111111111")])
    out = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs, "doc_id", "text").collect()}
    assert [(s["kind"], s["text"]) for s in out[1] if s["kind"] == "iban"] == [("iban", "DE89370400440532013000")] and not [s for s in out[2] if s["kind"] == "iban"]
    assert out[3][0]["score"] > 0.7 > out[4][0]["score"]


def test_personal_data_digest(spark, tmp_path):
    documents(spark, [(1, "x 1.2.3.4 a@b.cd 1.2.3.5"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in queries.op10_personal_data(spark, str(tmp_path)).collect()}
    text = "email:10:16,ip:2:9,ip:17:24"
    assert out[1]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and out[1]["spans"] == text and (out[1]["n_email"], out[1]["n_ip"]) == (1, 2)
    assert out[1]["scores"] == "0.90,0.60,0.60" and out[1]["n_likely"] == 3
    assert out[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[2]["spans"] == "" and out[2]["n_likely"] == 0


def test_scores_match_plain_context(spark):
    rng = random.Random(13)
    bits = ["mail", "Reply", "example", "server", "version", "1.2.3.4", "a@b.cd", "token =", "sha", "4111111111111111", "order", "0123456789abcdef" * 2, "f" * 32, "x" * 30, "IP", "card"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))) for i in range(150)]
    out = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(documents(spark, rows), "doc_id", "text").collect()}
    for i, t in rows:
        for kind, (must, p) in pii.PATTERNS.items():
            found = [m.span() for m in re.finditer(p.replace(r"|\G)", ")").replace(r"(?:(?<", "(?:(?<"), t)]
            edges = [0, *[x for s in found for x in s], len(t)]
            for s in (s for s in out[i] if s["kind"] == kind):
                k = found.index((s["start"], s["end"]))
                near = (t[max(edges[2 * k], s["start"] - 40) : s["start"]] + " " + t[s["end"] : min(edges[2 * k + 3], s["end"] + 40)]).lower()
                base, good, bad = pii.CONTEXTS[kind]
                has = lambda w: bool(re.search(rf"(?<![a-z])(?:{w})(?![a-z])", near))
                assert math.isclose(s["score"], min(1, base + 0.2 * has(good) - 0.2 * has(bad))) and s["text"] == t[s["start"] : s["end"]]
    assert {s["kind"] for spans in out.values() for s in spans} >= {"email", "ip", "card", "secret"}


def test_very_many_matches(spark):
    rows = [(1, "a@b.cd " * 100_000), (2, "1.2.3.4 x " * 60_000)]
    began = time.time()
    out = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, rows), "doc_id", "text").select("doc_id", F.size("spans").alias("n"), F.element_at("spans", -1).alias("last")).collect()}
    assert (out[1]["n"], out[1]["last"]["start"], out[2]["n"], out[2]["last"]["end"]) == (100_000, 699_993, 60_000, 599_997)
    assert time.time() - began < 60
