"""Functions of the engine for SQL text (X2, X5): scalar functions and table functions whose bodies Catalyst inlines.

They are SQL, not Python: a query over them has the plan of its body, so filters
and column pruning reach the scan, and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALARS = {
    "squared_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0.0D, (s, x) -> s + x)",
    "score_of_distance(d DOUBLE) RETURNS DOUBLE": "1.0D / (1.0D + d)",
    "register_hex(v BIGINT, width INT) RETURNS STRING": "'0x' || lpad(hex(v), greatest(width, length(hex(v))), '0')",
    "bit_text(first INT, width INT) RETURNS STRING": "CASE WHEN width = 1 THEN '[' || first || ']' ELSE '[' || (first + width - 1) || ':' || first || ']' END",
    "section_name(path STRING, n INT) RETURNS STRING": "coalesce(try_element_at(transform(split(path, ' > '), x -> btrim(x)), n), '')",
    "wilson_low(k BIGINT, n BIGINT) RETURNS DOUBLE": "CASE WHEN n = 0 THEN 0.0D ELSE greatest(0.0D, (k / n + 1.9208D / n - 1.96D * sqrt(k / n * (1 - k / n) / n + 0.9604D / n / n)) / (1 + 3.8416D / n)) END",
    "wilson_high(k BIGINT, n BIGINT) RETURNS DOUBLE": "CASE WHEN n = 0 THEN 0.0D ELSE least(1.0D, (k / n + 1.9208D / n + 1.96D * sqrt(k / n * (1 - k / n) / n + 0.9604D / n / n)) / (1 + 3.8416D / n)) END",
}
#: Over a table or view of chunks, whose name takes the place of {chunks}.
TABLES = {
    "nearest_chunks(query ARRAY<DOUBLE>, k INT) RETURNS TABLE (place INT, chunk_id STRING, doc_id STRING, distance DOUBLE, score DOUBLE)": (
        "SELECT place, chunk_id, doc_id, distance, score_of_distance(distance) FROM (SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS place"
        " FROM (SELECT chunk_id, doc_id, squared_distance(CAST(embedding AS ARRAY<DOUBLE>), nearest_chunks.query) AS distance FROM {chunks}) WHERE distance IS NOT NULL) WHERE place <= nearest_chunks.k"
    ),
    "chunks_of_document(doc STRING) RETURNS TABLE (chunk_id STRING, content STRING)": "SELECT chunk_id, content FROM {chunks} WHERE doc_id = chunks_of_document.doc",
    "peripherals_of_chip(c STRING) RETURNS TABLE (peripheral STRING, chunks BIGINT)": (
        "SELECT peripheral, count(*) FROM (SELECT section_name(section_path, 2) AS peripheral FROM {chunks} WHERE chip = peripherals_of_chip.c AND doc_type = 'svd') WHERE peripheral <> '' GROUP BY peripheral"
    ),
}


def register(spark: SparkSession, chunks: str | None = None) -> list[str]:
    """Create the scalar functions, and the table functions over ``chunks`` if it is named; their names.

    They are temporary: they live as long as the session, and so may name a temporary view.
    """
    made = [(head, body) for head, body in SCALARS.items()] + [(head, body.format(chunks=chunks)) for head, body in TABLES.items() if chunks]
    for head, body in made:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head, _ in made]
