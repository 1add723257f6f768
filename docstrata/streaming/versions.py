"""Documents over time (J3, P15, M2): which versions are new, changed, unchanged, deleted.

A version is a row of ``id``, ``hash`` and ``at``; a null hash says that the
document was deleted. :func:`history` tells the states of a table by windows,
:func:`tracked` those of a stream by a state for each live document, which holds
hash, number, time and timer. Both give the same rows.

    new        the document was not live
    changed    it was, with another hash; its number grows by one
    unchanged  it was, with this hash
    deleted    it was, and is no longer; number 0
    absent     it was not live when it was deleted; number 0
    late       (streams only) older than what the state knows; nothing changes

Numbers begin at 1 in each life of a document. Versions of one time follow one
another by hash, deletions first. Rows without an id or a time are no versions.
A stream sorts what a batch of it holds of one document in the task of that
document; the source bounds the batch. State is dropped when a document is deleted, so it
grows with live documents only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.text import content_hash, make_doc_id

ADDED = T.StructType([T.StructField("state", T.StringType()), T.StructField("number", T.LongType())])
KNOWN = T.StructType([T.StructField("hash", T.StringType()), T.StructField("number", T.LongType()), T.StructField("at", T.LongType()), T.StructField("timer", T.LongType())])

MICROS = "_micros"  # of ``at``; the state needs no time zone


def versions_of(files: DataFrame, at: Column | None = None) -> DataFrame:
    """(id, hash, at, path) of files, at the time of their last change or another."""
    when = F.col("modificationTime") if at is None else at
    return files.select(make_doc_id(F.col("path")).alias("id"), content_hash(F.col("content")).alias("hash"), when.alias("at"), "path")


def record_listing(files: DataFrame, listings: str, at: Column | None = None) -> None:
    """Append the versions of a scan to a folder of listings, all at one time.

    A stream of files never reads a path twice, so it cannot tell that a file has
    changed or gone; a stream of listings can. A listing that is recorded again changes nothing.
    """
    versions_of(files, F.current_timestamp() if at is None else at).write.mode("append").parquet(listings)


def _valid() -> Column:
    return F.col("id").isNotNull() & F.col("at").isNotNull()


def history(versions: DataFrame) -> DataFrame:
    """All versions of a table with ``state`` and ``number``; one shuffle, by id."""
    order = [F.col("at"), F.col("hash").asc_nulls_first()]
    w = Window.partitionBy("id").orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = versions.where(_valid()).withColumns({"_old": F.lag("hash").over(w), "_life": F.count_if(F.col("hash").isNull()).over(so_far)})
    gone, old = F.col("hash").isNull(), F.col("_old")
    state = F.when(gone & old.isNull(), "absent").when(gone, "deleted").when(old.isNull(), "new").when(old == F.col("hash"), "unchanged").otherwise("changed")
    life = Window.partitionBy("id", "_life").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("state", state).withColumn("number", F.count_if(F.col("state").isin("new", "changed")).over(life)).drop("_old", "_life")


class _Tracker(StatefulProcessor):
    """The state of one document at a time."""

    def __init__(self, names: list[str], gone_after: int | None):
        self.names, self.gone_after = names, gone_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", KNOWN)

    def _forget(self, timer: int | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.known.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = self.known.get() if self.known.exists() else None
        digest, number, at, timer = before or (None, 0, None, None)
        for r in sorted(rows, key=lambda r: (r[MICROS], r["hash"] is not None, r["hash"] or "")):
            if at is not None and r[MICROS] < at:
                state, told = "late", 0
            elif r["hash"] is None:
                state, told = ("absent" if digest is None else "deleted"), 0
                digest, number, at = None, 0, None
            else:
                state = "new" if digest is None else "unchanged" if digest == r["hash"] else "changed"
                digest, at = r["hash"], r[MICROS]
                number = told = number + (state != "unchanged")
            yield Row(**{n: r[n] for n in self.names}, state=state, number=told)
        if digest is None:
            if before is not None:
                self._forget(timer)
            return
        if self.gone_after is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = at // 1000 + self.gone_after
            self.handle.registerTimer(timer)
        self.known.update((digest, number, at, timer))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        at = self.known.get()[2]
        self.known.clear()
        yield Row(**{n: {"id": key[0], MICROS: at}.get(n) for n in self.names}, state="deleted", number=0)

    def close(self) -> None:
        pass


def tracked(versions: DataFrame, late: str = "0 seconds", gone_after: int | None = None) -> DataFrame:
    """A stream of versions with ``state`` and ``number``; needs the RocksDB state store.

    With ``gone_after``, milliseconds, a document that no version tells of for so
    long, by the times of the rows, counts as deleted: what a listing that is
    taken again and again leaves out. Its row has the time of its last version
    and nulls in other columns. Rows ``late`` behind the newest are then dropped.
    """
    rows = versions.where(_valid())
    if gone_after is not None:
        rows = rows.withWatermark("at", late)
    rows = rows.withColumn(MICROS, F.unix_micros("at"))
    kept = [f for f in rows.schema.fields if f.name != "at"]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), *ADDED.fields])
    mode = "none" if gone_after is None else "eventTime"
    out = rows.groupBy("id").transformWithState(_Tracker([f.name for f in kept], gone_after), schema, "append", mode)
    at = F.timestamp_micros(MICROS).alias("at")
    return out.select(*(at if n == "at" else n for n in versions.columns), *ADDED.names)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is, from where its checkpoint ends, and read all that it has written."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
