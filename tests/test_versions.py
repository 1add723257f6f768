from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docstrata.sources.files import scan
from docstrata.streaming.versions import history, record_listing, tracked, write_available

SCHEMA = "id string, hash string, at timestamp, note long"
T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def rows_of(*given):
    """(id, hash, minute) as rows, numbered."""
    return [(i, h, None if m is None else T0 + timedelta(minutes=m), n) for n, (i, h, m) in enumerate(given)]


def plain(rows):
    live, out = {}, []
    for i, h, at, note in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1] is not None, r[1] or "")):
        old = live.get(i)
        if h is None:
            out.append((i, note, "deleted" if old else "absent", 0))
            live.pop(i, None)
        else:
            n = old[1] if old else 0
            state = "new" if not old else "unchanged" if old[0] == h else "changed"
            live[i] = (h, n + (state != "unchanged"))
            out.append((i, note, state, live[i][1]))
    return sorted(out)


def run(spark, folder, checkpoint, out, **options):
    stream = tracked(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), **options)
    return write_available(stream, out, checkpoint)


GIVEN = rows_of(("a", "1", 0), ("a", "1", 1), ("b", "1", 1), (None, "1", 1), ("c", "x", None), ("a", "2", 2), ("a", None, 3), ("a", None, 4), ("a", "2", 5), ("b", "1", 6), ("c", None, 6), ("b", "2", 7), ("b", "1", 8), ("", "", 9), ("", "", 10))


def test_history_of_a_table(spark):
    got = history(spark.createDataFrame(GIVEN, SCHEMA))
    assert sorted((r["id"], r["note"], r["state"], r["number"]) for r in got.collect()) == plain(GIVEN)
    assert history(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got.columns == ["id", "hash", "at", "note", "state", "number"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from([None, "", "x", "y"]), st.integers(0, 50)), max_size=30, unique_by=lambda r: (r[0], r[2])))
def test_history_against_a_plain_version(spark, given):
    rows = rows_of(*given)
    assert sorted((r["id"], r["note"], r["state"], r["number"]) for r in history(spark.createDataFrame(rows, SCHEMA)).collect()) == plain(rows)


def test_stream_tells_what_the_table_tells_after_a_restart_too(spark, tmp_path):
    folder, checkpoint, out = (str(tmp_path / n) for n in ("in", "c", "out"))
    for part in (GIVEN[:7], GIVEN[7:11], GIVEN[11:]):  # each is a run of its own, with the state of the one before
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        got = run(spark, folder, checkpoint, out)
    assert sorted((r["id"], r["note"], r["state"], r["number"]) for r in got.collect()) == plain(GIVEN)
    spark.createDataFrame([("b", "9", T0, 99)], SCHEMA).write.mode("append").parquet(folder)
    late = run(spark, folder, checkpoint, out).where("note = 99").collect()
    assert [(r["state"], r["number"]) for r in late] == [("late", 0)]


def test_what_no_listing_shows_is_gone(spark, tmp_path):
    folder, checkpoint, out = (str(tmp_path / n) for n in ("in", "c", "out"))
    for minute, ids in ((0, "ab"), (10, "ab"), (20, "a"), (30, "a"), (40, "a"), (50, "ab")):
        spark.createDataFrame([(i, "h", T0 + timedelta(minutes=minute), minute) for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        got = run(spark, folder, checkpoint, out, gone_after=15 * 60_000)
    told = {(r["id"], r["note"]): (r["state"], r["number"]) for r in got.collect()}
    assert told["b", 0] == ("new", 1) and told["b", 10] == ("unchanged", 1) and told["b", None] == ("deleted", 0) and told["b", 50] == ("new", 1)
    assert [told["a", m][0] for m in (0, 10, 20, 30, 40, 50)] == ["new"] + ["unchanged"] * 5 and ("a", None) not in told


def test_listings_tell_what_changed_and_what_has_gone(spark, tmp_path):
    folder, listings = tmp_path / "files", str(tmp_path / "listings")
    folder.mkdir()
    for minute, change in ((0, {"a.md": "one", "b.md": "two"}), (10, {"a.md": "three"}), (20, {"b.md": None}), (30, {}), (40, {}), (50, {"b.md": "two"})):
        for name, body in change.items():
            (folder / name).write_text(body) if body else (folder / name).unlink()
        record_listing(scan(spark, str(folder), pattern="*.md"), listings, F.lit(T0 + timedelta(minutes=minute)))
    stream = tracked(spark.readStream.schema(spark.read.parquet(listings).schema).option("maxFilesPerTrigger", 2).parquet(listings), gone_after=15 * 60_000, late="1 hour")
    told = [(r["id"], r["at"].minute, r["state"], r["number"]) for r in write_available(stream, str(tmp_path / "out"), str(tmp_path / "c")).orderBy("id", "at").collect()]
    a, b = (sorted(t[1:] for t in told if t[0].endswith(n)) for n in ("a_md", "b_md"))
    assert a[:2] == [(0, "new", 1), (10, "changed", 2)] and {t[1] for t in a[2:]} <= {"unchanged"}
    assert b == [(0, "new", 1), (10, "unchanged", 1), (50, "unchanged", 1)]  # rows may come an hour late, so nothing counts as gone yet
