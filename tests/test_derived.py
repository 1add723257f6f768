import pytest

from docstrata.errors import ParseError
from docstrata.sources import svd


def device(path, *peripherals):
    """(name, base it derives from, description, registers) as a device."""
    kind = svd.peripheral_type()["registers"].dataType.elementType
    register = {f.name: None for f in kind.fields}
    return path, "X", [{"pos": n, "name": name, "description": said, "base": "0x10", "derived": base, "registers": [register | {"name": r} for r in regs]} for n, (name, base, said, regs) in enumerate(peripherals)]


def table(spark, *devices):
    kind = svd.peripheral_type()
    found = spark.createDataFrame(list(devices), f"path string, name string, peripherals array<{kind.simpleString()}>")
    return {(r["path"], r["name"]): (r["description"], [x["name"] for x in r["registers"]], r["derived_from"]) for r in svd.peripheral_table(found).collect()}


def test_chains_of_any_length_in_any_order(spark):
    chain = [(f"P{n}", f"P{n - 1}" if n else None, "first" if n == 0 else "fourth" if n == 4 else None, ["R"] if n in (0, 7) else []) for n in range(20)]
    got = table(spark, device("a", *reversed(chain)), device("b", ("P1", "P0", None, []), ("P0", None, "other", ["S", "T"])))
    for n in range(20):
        assert got["a", f"P{n}"] == ("fourth" if n >= 4 else "first", ["R"], f"P{n - 1}" if n else None)
    assert got["b", "P1"] == ("other", ["S", "T"], "P0") and len(got) == 22


def test_bases_that_are_missing_or_named_twice(spark):
    got = table(spark, device("a", ("A", "none", None, []), ("B", "C", "own", []), ("C", None, None, ["one"]), ("C", None, "late", ["two"])), device("b", ("D", None, None, [])))
    assert got["a", "A"] == (None, [], "none") and got["a", "B"] == ("own", ["one"], "C") and got["b", "D"] == (None, [], None)
    assert table(spark, device("empty")) == {}


@pytest.mark.parametrize("links", ["AA", "ABBA", "ABBCCA", "ABBCCB"])
def test_circles_are_errors(spark, links):
    pairs = [(links[i], links[i + 1]) for i in range(0, len(links), 2)]
    with pytest.raises(ParseError, match="circle"):
        table(spark, device("c", *((name, base, None, []) for name, base in pairs), ("Z", None, "fine", ["R"])))
