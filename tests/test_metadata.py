import json

import pytest
from pyspark.sql import functions as F

from docstrata.functions.metadata import from_json, matches, profile, typed, value

GIVEN = ['{"a": 1, "b": {"c": "x", "d": [1, "two", null]}}', '{"a": "1", "b": {"c": "y"}}', '{"a": 2.5}', '{"a": true, "b": null}', "{}", "[1, 2]", "3", "not json", '{"a": ', None, ""]


def table(spark):
    return spark.createDataFrame(list(enumerate(GIVEN)), "id long, said string").select("id", from_json(F.col("said")).alias("facts"))


def test_round_trip_through_files(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    got = {r["id"]: r["j"] for r in spark.read.parquet(str(tmp_path / "t")).select("id", F.to_json("facts").alias("j")).collect()}
    for n, said in enumerate(GIVEN):
        try:
            want = json.loads(said)
        except (TypeError, ValueError):
            want = None
        assert (None if got[n] is None else json.loads(got[n])) == want


def test_filters(spark, tmp_path):
    rows = table(spark)
    ids = lambda filters: sorted(r["id"] for r in rows.where(matches(F.col("facts"), filters)).collect())
    assert ids({}) == list(range(len(GIVEN))) and ids({"b.c": "x"}) == [0] and ids({"b.c": ["x", "y", "z"]}) == [0, 1] and ids({"b.d[1]": "two"}) == [0]
    assert ids({"a": (">", 1.5)}) == [2] and ids({"a": (">=", 1), "b.c": ("!=", "x")}) == [1] and ids({"none": 1}) == [] and ids({"b.d[9]": "x"}) == []
    for wrong in ({"a": None}, {"a": ("~", 1)}, {"a": []}):
        with pytest.raises(ValueError):
            matches(F.col("facts"), wrong)


def test_the_scan_reads_the_paths_only(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    found = spark.read.schema("id long, facts variant").parquet(str(tmp_path / "t")).where(matches(F.col("facts"), {"a": (">", 1)})).select(value(F.col("facts"), "b.c", "string").alias("c"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :]
    assert "variant" not in read.split("\n")[0] and "Python" not in plan


def test_maps_of_strings_become_typed(spark):
    given = {"n": "12", "neg": "-3", "zero": "007", "long": "9" * 19, "d": "1.50", "t": "True", "f": "false", "no": "None", "s": "a b", "empty": "", "null": None}
    rows = spark.createDataFrame([(1, given), (2, {}), (3, None)], "id long, m map<string,string>").select("id", F.to_json(typed(F.col("m"))).alias("j"))
    got = {r["id"]: r["j"] for r in rows.collect()}
    assert json.loads(got[1]) == {"n": 12, "neg": -3, "zero": "007", "long": "9" * 19, "d": 1.5, "t": True, "f": False, "no": None, "s": "a b", "empty": "", "null": None}
    assert got[2] == "{}" and got[3] is None


def test_profile(spark):
    got = {(r["key"], r["kind"]): r["n"] for r in profile(table(spark), "facts").collect()}
    assert got == {("a", "bigint"): 1, ("a", "string"): 1, ("a", "decimal"): 1, ("a", "boolean"): 1, ("b", "object"): 2, ("b", "void"): 1}
    assert profile(table(spark).where("id is null"), "facts").count() == 0
