"""Operator 12 against a plain replay."""

import random
import re
from itertools import permutations

from docstrata.llm import audit

DOC = "doc_id long, text string, lang string, part string, mask int, step int, n int"
LABEL = "doc_id long, quality int, toxic int, good string"


def plain(docs, labels):
    """A dictionary (part, order, step) -> counts, a document and an order at a time."""
    good, toxic = {}, {}
    for i, q, t in labels:
        if i is not None:
            good[i], toxic[i] = good.get(i) or q == 1, toxic.get(i) or t == 1
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = {}
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        for order in permutations("ABCDE"):
            gone = next((n for n, f in enumerate(order, 1) if fails[f]), 6)
            for step, f in enumerate(order, 1):
                c = out.setdefault((lang or "", "".join(order), step), [0] * 6)
                now = gone == step
                for k, v in enumerate((gone > step, now, fails[f] and gone < step, [x for x in fails if fails[x]] == [f], now and good.get(i), now and toxic.get(i))):
                    c[k] += bool(v)
    share = {}
    for (part, order, step), c in out.items():
        share[part, order[step - 1]] = share.get((part, order[step - 1]), 0) + c[1]
    return {k: (*c, share[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def run(spark, docs, labels):
    d = spark.createDataFrame([(i, t, lang, "x", 1, 1, 1) for i, t, lang in docs], DOC).repartition(3)
    rows = audit.audit_filters(d, spark.createDataFrame([(*x, "g") for x in labels], LABEL)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_orders_match_a_plain_replay(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "A", "a # b", "\x00 z", "É" * 20, "x y", "w " * 120, "BIG " * 200]
    texts += [" ".join(f"{rng.choice('abX')}{rng.randrange(300)}" for _ in range(rng.randrange(200))) + rng.choice(["", "|", " Q" * 30]) for _ in range(30)]
    docs = [(rng.randrange(80) if rng.random() > 0.05 else None, rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(rng.choice([*range(80), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    assert run(spark, docs, labels) == plain(docs, labels)


def test_copies_beyond_and_below_the_share_are_the_same(spark, monkeypatch):
    docs = [(i, f"text {i % 7 if i % 3 else 0}", "en") for i in range(200)] + [(None, "text 0", "en")] * 50
    monkeypatch.setattr(audit, "HOT_SHARE", 0)
    few = run(spark, docs, [])
    monkeypatch.setattr(audit, "HOT_SHARE", 10**9)
    assert few == run(spark, docs, []) == plain(docs, [])


def test_a_very_long_text_and_no_rows(spark):
    docs = [(1, " ".join(f"w{n}" for n in range(400_000)), "en"), (2, "w " * 1_000_000, "en")]
    assert run(spark, docs, [(1, 1, 0), (2, 0, 1)]) == plain(docs, [(1, 1, 0), (2, 0, 1)])
    assert run(spark, [], []) == {}
