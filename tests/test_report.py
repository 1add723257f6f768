"""The one-pass report against the metrics one by one, and p-values against the function."""

import io
import math
import random
from contextlib import redirect_stdout
from itertools import combinations

from pyspark.sql import functions as F

from docstrata.operators import evaluate

RESPONSE = "condition string, question_id string, correct boolean, latency_ms double, partial_score double, confidence double"


def responses(spark):
    rng = random.Random(4)
    kinds = ["base_address", "offset", "bits", "other"]
    rows = [(c, f"p_{n}_{rng.choice(kinds)}", rng.random() < 0.5, rng.random() * 100, rng.random(), rng.choice([None, rng.random(), 1.0, 1.7, -0.2])) for c in ("a", "b", "c") for n in range(60)]
    rows += [("silent", "p_1_bits", True, 1.0, 1.0, None)]
    questions = spark.createDataFrame([(r[1], rng.choice(["easy", "hard"])) for r in rows[:90:2]], "id string, difficulty string").dropDuplicates(["id"])
    return spark.createDataFrame(rows, RESPONSE).repartition(3), questions


def test_report_matches_the_metrics_one_by_one(spark):
    r, q = responses(spark)
    made = evaluate.report(r, q, "X_q").first()
    metrics = {m["condition"]: m for m in made["metrics"]}
    ece = {x["condition"]: x["ece"] for x in evaluate.calibration_error(r, ["condition"]).collect()}
    for m in evaluate.core_metrics(r, ["condition"]).collect():
        found = metrics[m["condition"]]
        assert all(math.isclose(found[k], m[k], rel_tol=1e-12) for k in ("total", "correct", "accuracy", "hallucination_rate", "avg_latency_ms", "avg_partial_score", "ci_lower", "ci_upper"))
        want = ece.get(m["condition"])
        assert found["ece"] is None if want is None else math.isclose(found["ece"], want, rel_tol=1e-9)
    for name, rows in (("by_category", evaluate.accuracy_by(r, ["condition"], evaluate.infer_category(F.col("question_id")), "k")), ("by_difficulty", evaluate.accuracy_by(evaluate.with_difficulty(r, q), ["condition"], F.col("difficulty"), "k"))):
        want = {}
        for x in rows.collect():
            want.setdefault(x["condition"], {})[x["k"]] = x["accuracy"]
        assert {c: made["maps"][c][name] for c in metrics} == want
    assert all(not m["by_difficulty"] for m in evaluate.report(r, None, "X_q").first()["maps"].values())
    assert evaluate.report(r.limit(0), None, "X_q").first()["metrics"] == []


def test_report_reads_the_responses_once(spark, tmp_path):
    r, _ = responses(spark)
    r.write.parquet(str(tmp_path / "r"))
    out = io.StringIO()
    with redirect_stdout(out):
        evaluate.report(spark.read.parquet(str(tmp_path / "r")), None, "X_q").explain()
    assert out.getvalue().count("FileScan") == 1 and out.getvalue().count("Expand") == 1


def test_p_values(spark):
    values = [0.0, 1e-12, 1e-3, 0.5, 1.0, 3.84, 7.99, 8.0, 8.01, 50.0, 400.0, 1300.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", evaluate.p_value(F.col("x")).alias("p")).collect()
    assert all(math.isclose(r["p"], evaluate.chi2_survival(r["x"]), rel_tol=1e-12) for r in rows)


def test_all_pairs_of_conditions(spark):
    r, _ = responses(spark)
    r = r.withColumn("question_id", F.regexp_extract("question_id", "p_([0-9]+)", 1)).union(spark.createDataFrame([("a", "extra", True, 0.0, 0.0, None)], RESPONSE))
    given = {}
    for x in r.collect():
        given.setdefault(x["condition"], {})[x["question_id"]] = x["correct"]
    found = {(x["first"], x["second"]): x for x in evaluate.mcnemar_pairs(r).collect()}
    assert set(found) == set(combinations(sorted(given), 2))
    for (a, b), x in found.items():
        both = given[a].keys() & given[b].keys()
        n, m = (sum(given[p][k] and not given[q][k] for k in both) for p, q in ((a, b), (b, a)))
        chi = 0.0 if n + m == 0 else max(abs(n - m) - 1, 0) ** 2 / (n + m)
        assert (x["b"], x["c"], x["unpaired"]) == (n, m, len(given[a].keys() ^ given[b].keys()))
        assert math.isclose(x["chi2"], chi) and math.isclose(x["p_value"], evaluate.chi2_survival(chi), rel_tol=1e-12)
