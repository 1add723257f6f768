"""Schemas of all tables."""

from pyspark.sql import types as T

KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
    "array<float>": T.ArrayType(T.FloatType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()), "array<array<string>>": T.ArrayType(T.ArrayType(T.StringType())),
}


def fields(text: str) -> T.StructType:
    """A schema of the kinds above; needs no session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (part.split(" ") for part in text.split(", "))])


DOCUMENT = fields("doc_id string, content string, doc_type string, title string, source_path string, chip string, metadata map<string,string>, format string, error string")
CHUNK = fields(
    "chunk_id string, chunk_index int, content string, token_count int, doc_id string, doc_type string, chip string, section_path string, page int, "
    "chunk_level string, peripheral string, content_type string"
)
EMBEDDED_CHUNK = T.StructType([*CHUNK.fields, *fields("embedding array<float>").fields])
MANIFEST = fields("id string, path string, doc_type string, hash string, added string, chunks int, chip string")
CATALOG = fields("name string, vendor string, path string")
PERIPHERAL = fields("chip string, pos int, name string, description string, base_address long, derived_from string")
REGISTER = fields("chip string, peripheral string, pos int, name string, description string, address_offset long, size int, access string, reset_value long")
FIELD = fields("chip string, peripheral string, register string, pos int, name string, description string, bit_offset int, bit_width int, access string")
QUESTION = fields(
    "id string, category string, peripheral string, register string, field_name string, question string, answer string, answer_format string, difficulty string, source_ref string"
)
RESPONSE = fields(
    "run_id string, condition string, question_id string, raw_response string, extracted_answer string, correct boolean, score double, latency_ms double, partial_score double, confidence double"
)
RUN = fields("run_id string, dataset_name string, condition string, model string, provider string, temperature double, started string, completed string, total_tokens int")
CONDITION = fields("name string, system_prompt string, description string")
SPAN = fields("doc_id string, page int, block int, line int, span int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double")
PAGE_TABLE = fields("doc_id string, page int, table int, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>")
PAGE = fields("doc_id string, page int, height double")
LAYOUT_ITEM = fields("doc_id string, page int, y double, label string, text string, x0 double, y0 double, x1 double, y1 double, image binary")
