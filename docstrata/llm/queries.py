"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bitslice, decontam, langid, linededup, mixing, pii, quality, simhash, tokens, urlfilter, whiten
from .common import new_path, table

URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: First rule that fits; the topics of the tables at hand.
TOPICS = {"contact": r"@|\+[0-9]", "table": r" \| ", "noise": r"[#$%&*]{3}|!! "}
OTHER_TOPIC = "prose"
TARGETS = {
    "source": {"src0": 0.2} | {f"src{n}": 0.04 for n in range(1, 21)},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.8, "contact": 0.1, "table": 0.05, "noise": 0.05},
}
KEEP_SHARE = 0.5
END_ID = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.in_fold(F.col("doc_id"), 3, 1)
    found = langid.identify(docs.select("doc_id", "text"), docs.where(~held_out), "doc_id", "text", "lang")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    topic = mixing.rules_topic(F.coalesce("text", F.lit("")), TOPICS, OTHER_TOPIC)
    mixed = mixing.mix(docs, "doc_id", "text", "source", "lang", topic, TARGETS, KEEP_SHARE, rest=True, carry=False)
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 4).alias("probability"), "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(pages, "url", rules).select("page_id", "host", "path", "rule", "verdict")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, radius=3)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "records")
    tokens.write_records(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), END_ID, out)
    return tokens.with_starts(tokens.read_index(spark, out)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.in_fold(F.col("doc_id"), 5, 0)
    labels = table(spark, sf_dir, "labels").where(~held_out)
    forest = quality.learn(docs, labels, "doc_id", "text", "doc_id", "quality")
    scored = quality.score_quality(docs, forest, "text")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontam.find_contamination(docs, bench)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, rows, book = ann.build_index(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.search(index, rows.where(F.col("vec_id") % 100 == 0), book)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), "doc_id", "text")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("decimal(3,2)").cast("string")), ",")
    likely = F.size(F.filter("spans", lambda s: s["score"] >= pii.LIKELY)).cast("long")
    return found.select(
        "doc_id", *map(count, pii.BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores.alias("scores"), likely.alias("n_likely")
    )


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector against all of ``embeddings``."""
    return bitslice.largest_products(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20, 64)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of the five filters on whole ``documents``, with what each step costs in labelled ones."""
    return audit.audit_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` on their first 32 principal components, with unit variance."""
    return whiten.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 1_000_000, 32)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_mix_sources, op3_url_filter, op4_simhash, op5_token_records, op6_quality, op7_line_dedup, op8_decontaminate, op9_nearest, op10_personal_data, op11_exact_topk, op12_filter_audit, op13_whitening)
    return {f.__name__: f for f in own}


def _mix_sql(rounds: int = 25, scales: int = 8) -> str:
    """Raking unrolled, a table a step."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{t}'" for t, p in TOPICS.items()) + f" ELSE '{OTHER_TOPIC}' END"
    unit = "('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, {topic} AS topic, "
        r"length(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')), '[^ ]+', 'x', 'g')) AS marks, "
        f"{unit} AS u, coalesce(text, '') AS text FROM documents)",
        "r AS MATERIALIZED (SELECT doc_id, source, lang, topic, u, ((marks + 1) // 2)::BIGINT AS tokens FROM d)",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, 1.0::DOUBLE AS f FROM r GROUP BY ALL)",
        *[f"t_{d}(v, share) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in t.items()) + ")" for d, t in TARGETS.items()],
        *[f"rest_{d} AS MATERIALIZED (SELECT sum(CASE WHEN t.v IS NULL THEN tokens ELSE 0 END) / sum(tokens) AS kept FROM c0 c LEFT JOIN t_{d} t ON c.{d} = t.v)" for d in TARGETS],
    ]
    at = 0
    for _ in range(rounds):
        for d in mixing.DIMENSIONS:
            parts.append(f"s{at} AS MATERIALIZED (SELECT t.v AS v, any_value(t.share) AS share, sum(c.tokens * c.f) AS w FROM c{at} c LEFT JOIN t_{d} t ON c.{d} = t.v GROUP BY t.v)")
            parts.append(
                f"a{at} AS MATERIALIZED (SELECT *, CASE WHEN rest > 0 THEN CASE WHEN total > 0 THEN kept ELSE 1.0 END ELSE 0.0 END AS sh FROM (SELECT sum(w) AS whole, "
                f"sum(CASE WHEN v IS NOT NULL AND w > 0 THEN share ELSE 0 END) AS total, sum(CASE WHEN v IS NULL THEN w ELSE 0 END) AS rest FROM s{at}) CROSS JOIN rest_{d})"
            )
            parts.append(
                f"c{at + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.f * CASE WHEN s.v IS NULL THEN CASE WHEN rest > 0 THEN sh * whole / rest ELSE 0 END "
                f"WHEN s.w > 0 AND total > 0 THEN s.share / total * (1 - sh) * whole / s.w ELSE 0 END AS f "
                f"FROM c{at} c LEFT JOIN t_{d} t ON c.{d} = t.v JOIN s{at} s ON s.v IS NOT DISTINCT FROM t.v CROSS JOIN a{at})"
            )
            at += 1
    parts.append("k0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS k)")
    for n in range(scales):
        parts.append(
            f"k{n + 1} AS MATERIALIZED (SELECT CASE WHEN w > 0 AND goal > t THEN greatest(k, (goal - t) / w) ELSE k END AS k FROM (SELECT any_value(k) AS k, sum(tokens) * {KEEP_SHARE} AS goal, "
            f"sum(CASE WHEN f * k >= 1 THEN tokens ELSE 0 END) AS t, sum(CASE WHEN f * k >= 1 THEN 0 ELSE f * tokens END) AS w FROM c{at} CROSS JOIN k{n}))"
        )
    parts.append(f"p AS (SELECT source, lang, topic, least(1.0, f * k) AS probability FROM c{at} CROSS JOIN k{scales})")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, tokens, round(probability, 4) AS probability, u < probability AS kept FROM r JOIN p USING (source, lang, topic)"


_URL_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*(/[^?#]*)?', 1) AS path FROM p
), r(rh, rp, rv) AS (VALUES %s),
m AS (
  SELECT host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY host, path ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS n
  FROM (SELECT DISTINCT host, path FROM h) JOIN r ON (host = rh OR host LIKE '%%.' || rh) AND starts_with(path, rp)
)
SELECT page_id, h.host AS host, h.path AS path, rule, coalesce(rv, 'allow') AS verdict
FROM h LEFT JOIN (SELECT * FROM m WHERE n = 1) m ON h.host = m.host AND h.path = m.path
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

#: A later copy of a run with enough words is covered by the shortest stretches with enough words that begin, and that end, at each line.
_LINES_SQL = r"""
WITH x AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT doc_id, ls, list_transform(ls, lambda s: len(list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda t: t <> ''))) AS ws FROM x
), l AS (
  SELECT doc_id, ls, ws, unnest(range(1, len(ls) + 1)) AS n FROM c
), stretch AS (
  SELECT doc_id, ls, n AS p, list_filter(range(n, len(ls) + 1), lambda m: list_sum(ws[n:m]) >= %(w)d)[1] AS e FROM l
  UNION ALL
  SELECT doc_id, ls, list_filter(range(1, n + 1), lambda m: list_sum(ws[m:n]) >= %(w)d)[-1] AS p, n AS e FROM l
), run AS (
  SELECT DISTINCT doc_id, p, e, array_to_string(ls[p:e], chr(10)) AS content FROM stretch WHERE p IS NOT NULL AND e IS NOT NULL
), later AS (
  SELECT doc_id, p, e, row_number() OVER (PARTITION BY content ORDER BY doc_id, p) AS k FROM run
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, e + 1)) AS n FROM later WHERE k > 1
)
SELECT d.doc_id AS doc_id, count(l.n)::BIGINT AS n_lines, count(g.n)::BIGINT AS n_deleted,
  sha256(coalesce(string_agg(CASE WHEN g.n IS NULL THEN l.ls[l.n] END, chr(10) ORDER BY l.n), '')) AS text_sha256
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n
GROUP BY d.doc_id
""" % {"w": linededup.MIN_WORDS}

_WINDOW_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda t: t <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda t: t <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
word AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM hit, LATERAL (SELECT unnest(range(i, i + n)) AS pos) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word ON d.doc_id = word.doc_id LEFT JOIN item ON d.doc_id = item.doc_id
"""


_PRODUCTS_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_AUDIT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT doc_id, part, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws FROM t
), f AS (
  SELECT doc_id, part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) AS c,
    regexp_matches(x, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS e FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id
), k(v) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT k1.v || k2.v || k3.v || k4.v || k5.v AS filter_order FROM k k1, k k2, k k3, k k4, k k5
  WHERE len(list_distinct([k1.v, k2.v, k3.v, k4.v, k5.v])) = 5
), s AS (
  SELECT part, good, toxic, failed, filter_order, step, substr(filter_order, step, 1) AS letter,
    coalesce(list_min(list_filter(range(1, 6), lambda n: contains(failed, substr(filter_order, n, 1)))), 6) AS gone
  FROM m, o, (SELECT unnest(range(1, 6)) AS step)
), c AS (
  SELECT part, filter_order, step, letter, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
    count(*) FILTER (contains(failed, letter) AND gone < step) AS redundant, count(*) FILTER (failed = letter) AS unique_fails,
    count(*) FILTER (gone = step AND good = 1) AS good_lost, count(*) FILTER (gone = step AND toxic = 1) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": _mix_sql(), "op3_url_filter": _URL_SQL, "op7_line_dedup": _LINES_SQL, "op8_decontaminate": _WINDOW_SQL, "op11_exact_topk": _PRODUCTS_SQL, "op12_filter_audit": _AUDIT_SQL}
