from docstrata.sources.files import read_documents
from docstrata.streaming.ingest import file_stream, ingest_stream, without_copies
from docstrata.streaming.metrics import windowed

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_windows_of_a_stream_match_those_of_the_table(spark, tmp_path):
    events = spark.sql("SELECT id AS event_id, timestamp_seconds(1700000000 + id * 97) AS ts, id AS user_id, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS event_type, id * 0.5D AS value, '{}' AS props FROM range(500)")
    events.write.parquet(str(tmp_path / "events"))
    stream = windowed(spark.readStream.schema(EVENT).parquet(str(tmp_path / "events")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, windowed(events).collect()))


def test_files_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two")):
        (tmp_path / "in" / name).write_text(body)
    got = []

    def step(batch):
        got.extend(r["hash"] for r in batch.collect())

    for _ in range(2):
        ingest_stream(without_copies(file_stream(spark, str(tmp_path / "in"), "*.txt")), step, str(tmp_path / "c")).awaitTermination(120)
    assert len(got) == len(set(got)) == 2
    assert read_documents(spark, str(tmp_path / "in")).count() == 3
