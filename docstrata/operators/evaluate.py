"""Question sets, lookup, scoring and statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BenchmarkError
from ..functions.registers import access_code, bit_range, difficulty, hex_format, priority
from ..functions.scoring import extract_answer, extract_confidence, lookup, score_answer, score_partial
from .embed import Embedder, embed_chunks
from .search import nearest_for_each, within_budget

# Fixed values.
REGISTER_CATEGORIES = ("base_address", "register_offset", "bit_field", "reset_value", "access_type")
COST = {"anthropic": 9.0, "openai": 10.0, "ollama": 0.0, "command": 0.0}
Z = 1.96
PROMPT = "You are an expert on the {chip} microcontroller. Answer with the value only.\n\n{context}"


# Questions


def _question(rows: DataFrame, suffix: str, category: str, text: Column, answer: Column, form: str, single: Column | None = None, nonzero: Column | None = None, register: Column | None = None, field: Column | None = None) -> DataFrame:
    none = F.lit("")
    parts = [F.lower("peripheral")] + ([F.lower(register)] if register is not None else []) + ([F.lower(field)] if field is not None else []) + [F.lit(suffix)]
    no = F.lit(False)
    return rows.select(
        F.concat_ws("_", *parts).alias("id"), F.lit(category).alias("category"), "peripheral", (none if register is None else register).alias("register"),
        (none if field is None else field).alias("field_name"), text.alias("question"), answer.alias("answer"), F.lit(form).alias("answer_format"),
        difficulty(F.lit(category), F.col("peripheral"), single if single is not None else no, nonzero if nonzero is not None else no).alias("difficulty"), none.alias("source_ref"),
    )


def select_peripherals(peripherals: DataFrame, most: int = 20) -> DataFrame:
    """By rank in the list of priorities, then by name."""
    return peripherals.orderBy(priority(F.col("peripheral")), F.upper("peripheral"), "pos").limit(most)


def generate_questions(peripherals: DataFrame, registers: DataFrame, fields: DataFrame, most_peripherals: int = 20, most_registers: int = 8, most_fields: int = 5) -> DataFrame:
    """Five kinds of questions. ``peripherals`` has chip, peripheral, pos, base_address; the others their keys.

    Fields are counted before those without a place are left out, and at most
    ``most_registers * most_fields`` are asked of a peripheral.
    """
    chosen = select_peripherals(peripherals, most_peripherals)
    key = ["chip", "peripheral"]
    by_offset = Window.partitionBy(*key).orderBy(F.coalesce("address_offset", F.lit(0)), "pos")
    own = registers.join(chosen.select(*key), key, "left_semi").withColumn("reg_rank", F.row_number().over(by_offset))
    first = own.where(F.col("reg_rank") <= most_registers)
    msb = F.coalesce("bit_offset", F.lit(0)) + F.coalesce(F.nullif("bit_width", F.lit(0)), F.lit(1)) - 1
    by_bit = Window.partitionBy(*key, "register").orderBy(F.desc(msb), "pos")
    ranked = fields.join(own.select(*key, F.col("name").alias("register"), "reg_rank"), [*key, "register"]).withColumn("f_rank", F.row_number().over(by_bit))
    known = ranked.where((F.col("f_rank") <= most_fields) & F.col("bit_offset").isNotNull() & F.col("bit_width").isNotNull())
    asked = known.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("reg_rank", "f_rank"))).where(F.col("_n") <= most_registers * most_fields)
    say = F.format_string
    p, r, f, chip = F.col("peripheral"), F.col("name"), F.col("name"), F.col("chip")
    nonzero = F.coalesce(F.col("reset_value") != 0, F.lit(False))
    code = access_code(F.col("access"))
    parts = [
        _question(chosen.where("base_address is not null"), "base_address", "base_address", say("What is the base address of the %s peripheral on the %s?", p, chip), hex_format(F.col("base_address"), 8), "hex"),
        _question(first.where("address_offset is not null"), "offset", "register_offset", say("What is the address offset of the %s register in the %s peripheral on the %s?", r, p, chip), hex_format(F.col("address_offset"), 4), "hex", register=r),
        _question(first.where("reset_value is not null"), "reset", "reset_value", say("What is the reset value of the %s_%s register on the %s?", p, r, chip), hex_format(F.col("reset_value"), 8), "hex", nonzero=nonzero, register=r),
        _question(first.where(code.isin("RO", "WO", "RW", "W1", "RW1")), "access", "access_type", say("What is the access type of the %s_%s register on the %s?", p, r, chip), code, "access_code", register=r),
        _question(
            asked, "bits", "bit_field", say("What bit position(s) does the %s field occupy in the %s_%s register on the %s?", f, p, F.col("register"), chip),
            bit_range(F.col("bit_offset"), F.col("bit_width")), "bit_range", single=F.col("bit_width") == 1, register=F.col("register"), field=f,
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def dataset_header(questions: DataFrame, name: str, chip: str) -> DataFrame:
    """D17, A20."""
    return questions.agg(F.lit(name).alias("name"), F.lit(chip).alias("chip"), F.count("*").alias("question_count"), F.sort_array(F.collect_set("category")).alias("categories"))


def read_dataset(spark, path: str) -> DataFrame:
    """The questions of a JSON file, defaults filled in."""
    q = "struct<id:string,category:string,peripheral:string,register:string,field_name:string,question:string,answer:string,answer_format:string,difficulty:string,source_ref:string>"
    raw = spark.read.schema(f"questions array<{q}>, _bad string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").json(path)
    if raw.where("_bad is not null or questions is null").count():
        raise BenchmarkError(f"{path}: not a question set")
    out = raw.select(F.explode("questions").alias("q")).select("q.*").fillna({"difficulty": "medium", "source_ref": ""})
    if out.where("id is null or answer is null or question is null or category is null").limit(1).count():
        raise BenchmarkError(f"{path}: a question lacks a field")
    return out


# Lookup


def lookup_answers(questions: DataFrame, peripherals: DataFrame, registers: DataFrame, fields: DataFrame) -> DataFrame:
    """Answers straight from the tables: (id, answer, answerable).

    A peripheral is found by its name, whatever the case, else by the first name
    in the file that begins with it; registers and fields by name, of the same
    chip. Of several chips with the name the first in order counts. Only rows of
    peripherals and names that are asked for reach a window. Questions are read several times, so give a table.
    """
    q = questions.select("id", "category", F.upper("peripheral").alias("q_p"), F.upper("register").alias("q_r"), F.upper("field_name").alias("q_f"))
    wanted = q.select("q_p").distinct()
    names = peripherals.select(F.col("peripheral").alias("p"), F.col("chip").alias("p_chip"), "pos", "base_address")
    exact = wanted.join(names, F.upper("p") == F.col("q_p"))
    missing = wanted.join(exact.select("q_p"), "q_p", "left_anti").where("q_p != ''")
    # beginnings of the same length are compared by equality
    begin = names.withColumn("_n", F.explode(F.sequence(F.lit(1), F.length("p")))).withColumn("_k", F.substring(F.upper("p"), F.lit(1), F.col("_n")))
    longer = missing.join(begin, F.col("_k") == F.col("q_p")).drop("_n", "_k")
    best = exact.unionByName(longer).withColumn("_r", F.row_number().over(Window.partitionBy("q_p").orderBy("pos", "p_chip"))).where("_r = 1").drop("_r", "pos")

    def first(rows: DataFrame, key: list[str]) -> DataFrame:
        return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).where("_r = 1").drop("_r", "pos")

    asked = q.join(best, "q_p").select("p_chip", "p", "q_r", "q_f")
    of_r = registers.select(F.col("chip").alias("r_chip"), F.col("peripheral").alias("r_p"), F.upper("name").alias("r_n"), "pos", "address_offset", "reset_value", F.col("access").alias("r_access"))
    of_f = fields.select(F.col("chip").alias("f_chip"), F.col("peripheral").alias("f_p"), F.upper("register").alias("f_r"), F.upper("name").alias("f_n"), "pos", "bit_offset", "bit_width")
    of_r = of_r.join(asked, F.col("p_chip").eqNullSafe(F.col("r_chip")) & (F.col("p") == F.col("r_p")) & (F.col("q_r") == F.col("r_n")), "left_semi")
    of_f = of_f.join(asked, F.col("p_chip").eqNullSafe(F.col("f_chip")) & (F.col("p") == F.col("f_p")) & (F.col("q_r") == F.col("f_r")) & (F.col("q_f") == F.col("f_n")), "left_semi")
    regs, flds = first(of_r, ["r_chip", "r_p", "r_n"]), first(of_f, ["f_chip", "f_p", "f_r", "f_n"])
    found = q.join(best, "q_p", "left").join(regs, F.col("p_chip").eqNullSafe(F.col("r_chip")) & (F.col("p") == F.col("r_p")) & (F.col("q_r") == F.col("r_n")), "left")
    found = found.join(flds, F.col("p_chip").eqNullSafe(F.col("f_chip")) & (F.col("p") == F.col("f_p")) & (F.col("q_r") == F.col("f_r")) & (F.col("q_f") == F.col("f_n")), "left")
    code = access_code(F.col("r_access"))
    some = lambda c, out: F.when(F.col(c).isNotNull(), out)
    answer = (
        F.when(F.col("category") == "base_address", some("base_address", hex_format(F.col("base_address"), 8)))
        .when(F.col("category") == "register_offset", some("address_offset", hex_format(F.col("address_offset"), 4)))
        .when(F.col("category") == "reset_value", some("reset_value", hex_format(F.col("reset_value"), 8)))
        .when(F.col("category") == "access_type", F.when(code.isin("RO", "WO", "RW", "W1", "RW1"), code))
        .when(F.col("category") == "bit_field", F.when(F.col("bit_offset").isNotNull() & F.col("bit_width").isNotNull(), bit_range(F.col("bit_offset"), F.col("bit_width"))))
    )
    return found.select("id", F.coalesce(answer, F.lit("")).alias("answer"), answer.isNotNull().alias("answerable"), F.coalesce("p", F.lit("")).alias("peripheral"))


def lookup_responses(questions: DataFrame, answers: DataFrame, condition: str = "svd_lookup") -> DataFrame:
    """B7."""
    a = answers.select(F.col("id").alias("_id"), F.col("answer").alias("raw_answer"), "answerable")
    raw = F.when(F.col("answerable"), F.col("raw_answer")).otherwise("[SVD_UNANSWERABLE]")
    rows = questions.join(a, F.col("id") == F.col("_id")).withColumn("raw_response", raw).withColumn("condition", F.lit(condition)).withColumn("latency_ms", F.lit(0.0))
    out = scored(rows, F.when(F.col("answerable"), F.col("raw_answer")).otherwise(""))
    return out.withColumn("confidence", F.when(F.col("answerable"), 1.0))


# Asking


def route(category: Column, peripheral: Column) -> Column:
    """B5."""
    return F.when(category.isin(*REGISTER_CATEGORIES), "svd_lookup").when(F.coalesce(peripheral, F.lit("")) != "", "rag").otherwise("full")


def fallback(available: list[str]) -> str:
    return next((n for n in ("full", "hot", "no_context") if n in available), "no_context")


def conditions(spark, chip: str, hot: str | None = None, raw_text: str | None = None, pages: dict[str, str] | None = None, only: list[str] | None = None, most_raw: int = 400_000) -> DataFrame:
    """(name, system_prompt, description) of what a question can be asked with."""
    said = lambda head, body: PROMPT.format(chip=chip, context=f"{head}\n\n{body}" if body else "").strip()
    rows = [("no_context", said("", ""), "no documentation")]
    if hot is not None:
        rows.append(("hot", said("Hardware context:", hot), "short context"))
    if raw_text is not None:
        rows.append(("raw_text", said("Data sheet text:", raw_text[:most_raw]), f"{min(len(raw_text), most_raw)} characters of text"))
    if pages is not None:
        kept = [t for n, t in sorted(pages.items()) if not only or any(n.rsplit(".", 1)[0].upper().startswith(p.upper()) for p in only)]
        whole = ([hot] if hot is not None else []) + kept
        if whole:
            rows.append(("full", said("Hardware context:", "\n\n---\n\n".join(whole)), "short context and peripherals"))
    return spark.createDataFrame(rows, "name string, system_prompt string, description string")


def prompts(questions: DataFrame, what: DataFrame, runs: int = 1) -> DataFrame:
    """Each question with each condition in each run; conditions are a handful, made by the caller and counted."""
    if (size := what.count() * runs) > 10_000:
        raise BenchmarkError(f"{size} settings are too many to ask each question in")
    n = questions.sparkSession.range(runs).select((F.col("id") + 1).cast("string").alias("run_id"))
    setting = what.select(F.col("name").alias("condition"), "system_prompt").join(n)
    return questions.join(F.broadcast(setting))


def ask(rows: DataFrame, provider: Callable[[str, str], tuple[str, int, float]]) -> DataFrame:
    """(id, condition, run_id, raw_response, tokens, latency_ms); an error becomes an answer that is wrong."""
    kept = rows.select("id", "condition", "run_id", "system_prompt", "question")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, c, r, system, question in zip(*(x.to_pylist() for x in b.columns)):
                try:
                    text, tokens, ms = provider(system, question)
                except Exception as e:
                    text, tokens, ms = f"[API_ERROR] {e}", 0, 0.0
                out.append((i, c, r, text, int(tokens), float(ms)))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64())
            names = ["id", "condition", "run_id", "raw_response", "tokens", "latency_ms"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names=names)

    return kept.mapInArrow(run, "id string, condition string, run_id string, raw_response string, tokens int, latency_ms double")


def scored(rows: DataFrame, extracted: Column | None = None) -> DataFrame:
    """Rows of (id, answer, answer_format, raw_response) with what was extracted and its scores."""
    failed = F.col("raw_response").startswith("[API_ERROR]")
    found = extracted if extracted is not None else F.when(failed, "").otherwise(extract_answer(F.col("raw_response"), F.col("answer_format")))
    out = rows.withColumn("extracted_answer", found)
    a, b, form = F.col("extracted_answer"), F.col("answer"), F.col("answer_format")
    out = out.withColumn("score", score_answer(a, b, form)).withColumn("partial_score", score_partial(a, b, form))
    return out.withColumn("correct", F.col("score") == 1.0).withColumn("confidence", F.when(failed, F.lit(None).cast("double")).otherwise(extract_confidence(F.col("raw_response"))))


#: Conditions whose prompts, if any, depend on the question.
DYNAMIC = ("svd_lookup", "rag", "hybrid")


def with_placeholders(what: DataFrame, names: tuple[str, ...] = DYNAMIC) -> DataFrame:
    """Conditions without a prompt of their own, after those with one."""
    rows = what.sparkSession.createDataFrame([(n, "", "depends on the question") for n in names], what.schema)
    return what.unionByName(rows)


def retrieved_prompts(questions: DataFrame, chunks: DataFrame, embedder: Embedder, chip: str = "", k: int = 5, most: int = 32_000) -> DataFrame:
    """(id, system_prompt): the passages nearest to a question, as many as fit."""
    asked = embed_chunks(questions.select("id", "question"), embedder, "question", "query").select(F.col("id").alias("query_id"), "query")
    rows = chunks.where(F.col("chip") == chip) if chip else chunks
    found = within_budget(nearest_for_each(rows.select("chunk_id", "content", "embedding"), asked, k, "chunk_id", "embedding"), ["query_id"], ["rank"], most=most)
    text = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n---\n\n").alias("t"))
    head, tail = PROMPT.format(chip=chip, context="\0").split("\0")
    prompt = F.concat(F.lit(head + "Hardware documentation:\n\n"), F.coalesce("t", F.lit("")), F.lit(tail))
    return questions.select(F.col("id").alias("_q")).join(text, F.col("_q") == F.col("query_id"), "left").select(F.col("_q").alias("id"), prompt.alias("system_prompt"))


RESULT = ("id", "condition", "run_id", "raw_response", "extracted_answer", "score", "partial_score", "correct", "confidence", "latency_ms", "tokens")


def run_benchmark(
    questions: DataFrame, what: DataFrame, provider: Callable[[str, str], tuple[str, int, float]], runs: int = 1, model: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    chunks: DataFrame | None = None, embedder: Embedder | None = None, chip: str = "",
) -> tuple[DataFrame, list[str]]:
    """The responses to all questions in all conditions, and the conditions that were skipped for want of what they need.

    ``model`` are the tables of :func:`lookup_answers`, ``chunks`` the embedded
    passages that are searched. The hybrid condition looks up what the tables
    hold, searches for what names a peripheral, and else takes the fullest prompt.
    """
    names = [r["name"] for r in what.select("name").collect()]
    can = {"svd_lookup": model is not None, "hybrid": model is not None, "rag": chunks is not None and embedder is not None}
    skipped = [n for n in names if not can.get(n, True)]
    names = [n for n in names if n not in skipped]
    static = what.where(~F.col("name").isin(*DYNAMIC))
    number = questions.sparkSession.range(runs).select((F.col("id") + 1).cast("string").alias("run_id"))
    columns = [*questions.columns, "condition", "system_prompt", "run_id"]
    asked = [prompts(questions, static, runs).select(*columns)]
    passages = retrieved_prompts(questions, chunks, embedder, chip) if can["rag"] and {"rag", "hybrid"} & set(names) else None
    repeated = lambda rows, name: rows.withColumn("condition", F.lit(name)).join(F.broadcast(number)).select(*columns)
    known = []
    if "rag" in names:
        asked.append(repeated(questions.join(passages, "id"), "rag"))
    if model is not None and {"svd_lookup", "hybrid"} & set(names):
        answers = lookup_answers(questions, *model)
        if "svd_lookup" in names:
            known.append(lookup_responses(questions, answers, "svd_lookup"))
        if "hybrid" in names:
            via = route(F.col("category"), F.col("peripheral"))
            via = via if can["rag"] else F.when(via == "rag", "full").otherwise(via)
            routed = questions.withColumn("via", via)
            known.append(lookup_responses(routed.where("via = 'svd_lookup'").drop("via"), answers, "hybrid"))
            if can["rag"]:
                asked.append(repeated(routed.where("via = 'rag'").drop("via").join(passages, "id"), "hybrid"))
            best = static.where(F.col("name") == fallback(names)).select("system_prompt")  # one row
            asked.append(repeated(routed.where("via = 'full'").drop("via").join(F.broadcast(best)), "hybrid"))
    raw = ask(reduce(DataFrame.unionByName, asked), provider)
    out = scored(raw.join(questions.select("id", "answer", "answer_format"), "id")).select(*RESULT)
    for rows in known:
        out = out.unionByName(rows.join(F.broadcast(number)).withColumn("tokens", F.lit(0)).select(*RESULT))
    return out, skipped


def write_dataset(questions: DataFrame, name: str, chip: str, path: str) -> None:
    """A question set as one JSON object; its size is bounded by what is asked of a peripheral."""
    head = dataset_header(questions, name, chip)
    rows = questions.agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in questions.columns if c != "id"]))).alias("questions"))
    head.join(rows).coalesce(1).write.mode("overwrite").json(path)  # one row and one row


# Statistics


def infer_category(question_id: Column) -> Column:
    """F30."""
    parts = F.split(question_id, "_")
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    names = {"offset": "register_offset", "bits": "bit_field", "reset": "reset_value", "access": "access_type"}
    return F.when((last == "address") & (before == "base"), "base_address").otherwise(F.coalesce(lookup(last, names), F.lit("unknown")))


def wilson(correct: Column, total: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % interval; zeros without trials."""
    n = F.nullif(total, F.lit(0)).cast("double")
    p, z2 = correct / n, Z * Z
    mid = (p + F.lit(z2) / (n * 2)) / (F.lit(1.0) + F.lit(z2) / n)
    half = F.lit(Z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z2) / (n * n * 4)) / (F.lit(1.0) + F.lit(z2) / n)
    bound = lambda c: F.when(n.isNull(), 0.0).otherwise(c)
    return bound(F.greatest(F.lit(0.0), mid - half)), bound(F.least(F.lit(1.0), mid + half))


def mean(c: Column) -> Column:
    """The average of numbers, whose sum does not depend on the order of rows; a plain one where decimals cannot hold them."""
    exact = c.try_cast("decimal(38,18)")
    return F.coalesce(F.when(F.count(exact) == F.count(c), F.try_divide(F.try_sum(exact), F.count(c)).cast("double")), F.avg(c))


def core_metrics(responses: DataFrame, group: list[str]) -> DataFrame:
    """One row a group; several runs are pooled."""
    hit = F.count_if("correct")
    n = F.count("*")
    low, high = wilson(F.col("correct"), F.col("total"))
    m = responses.groupBy(*group).agg(n.alias("total"), hit.alias("correct"), mean(F.col("latency_ms")).alias("avg_latency_ms"), mean(F.col("partial_score")).alias("avg_partial_score"))
    m = m.withColumn("accuracy", F.col("correct") / F.col("total")).withColumn("hallucination_rate", F.lit(1.0) - F.col("accuracy"))
    return m.withColumn("ci_lower", low).withColumn("ci_upper", high)


def accuracy_by(responses: DataFrame, group: list[str], by: Column, name: str) -> DataFrame:
    """(group, name, accuracy)."""
    return responses.groupBy(*group, by.alias(name)).agg((F.count_if("correct") / F.count("*")).alias("accuracy"))


def with_difficulty(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """J9."""
    q = questions.select(F.col("id").alias("_q"), F.col("difficulty").alias("_d"))
    return responses.join(q, F.col("question_id") == F.col("_q"), "left").withColumn("difficulty", F.coalesce("_d", F.lit("medium"))).drop("_q", "_d")


def ece_bin(confidence: Column) -> Column:
    """The bin of ten, by the bounds that doubles give; null for a value in none."""
    out = F.lit(None).cast("int")
    for i in range(9, -1, -1):
        low = i * 0.1
        high = low + 0.1
        inside = (confidence >= low) & ((confidence <= high) if i == 9 else (confidence < high))
        out = F.when(inside, i).otherwise(out)
    return out


def calibration_error(responses: DataFrame, group: list[str]) -> DataFrame:
    """Null where no response states a confidence."""
    known = responses.where(F.col("confidence").isNotNull()).withColumn("_bin", ece_bin(F.col("confidence")))
    bins = known.groupBy(*group, "_bin").agg(F.count("*").alias("n"), mean(F.col("confidence")).alias("c"), (F.count_if("correct") / F.count("*")).alias("a"))
    gap = F.sum(F.when(F.col("_bin").isNotNull(), F.abs(F.col("a") - F.col("c")) * F.col("n")).otherwise(0.0))
    return bins.groupBy(*group).agg((gap / F.sum("n")).alias("ece"))


def chi2_survival(x: float, df: int = 1) -> float:
    """F67."""
    if df != 1:
        raise ValueError("one degree of freedom only")
    return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, to 1e-12 of its value: a series below two, a continued fraction above."""
    square = x * x
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("term"), x.alias("sum")),
        lambda s, n: F.struct((s["term"] * 2 * square / (2 * n + 1)).alias("term"), (s["sum"] + s["term"] * 2 * square / (2 * n + 1)).alias("sum")),
    )["sum"]
    below = F.aggregate(F.sequence(F.lit(120), F.lit(1)), x, lambda f, k: x + k / 2 / f)
    small = F.lit(1.0) - F.lit(2 / math.sqrt(math.pi)) * F.exp(-square) * terms
    return F.when(x < 2, small).otherwise(F.exp(-square) / (F.lit(math.sqrt(math.pi)) * below))


def p_value(chi2: Column) -> Column:
    """F67 as a column, for one degree of freedom."""
    return F.when(chi2 > 0, erfc(F.sqrt(chi2.cast("double") / 2))).otherwise(1.0)


def mcnemar_pairs(responses: DataFrame, key: str = "question_id") -> DataFrame:
    """A15 for all pairs of conditions: (first, second, b, c, unpaired, chi2, p_value), the first name before the second.

    Responses of a question meet once, in one array of at most a few conditions,
    and no condition is joined with another. A condition answers a question once.
    """
    one = F.sort_array(F.collect_list(F.struct("condition", "correct")))
    answers = responses.groupBy(key).agg(one.alias("of"))
    pairs = F.flatten(F.transform("of", lambda a, n: F.transform(F.slice("of", n + 2, F.size("of")), lambda b: F.struct(a["condition"].alias("first"), b["condition"].alias("second"), a["correct"].alias("x"), b["correct"].alias("y")))))
    met = answers.select(F.inline(pairs)).groupBy("first", "second").agg(F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c"), F.count("*").alias("both"))
    totals = responses.groupBy("condition").agg(F.count("*").alias("n"))
    of = lambda name: totals.select(F.col("condition").alias(name), F.col("n").alias(f"n_{name}"))
    sized = met.join(of("first"), "first").join(of("second"), "second")
    differ = F.col("b") + F.col("c")
    chi2 = F.when(differ == 0, 0.0).otherwise(F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)).cast("double"), F.lit(2.0)) / differ)
    out = sized.select("first", "second", "b", "c", (F.col("n_first") + F.col("n_second") - 2 * F.col("both")).alias("unpaired"), chi2.alias("chi2"))
    return out.withColumn("p_value", p_value(F.col("chi2")))


def mcnemar_counts(a: DataFrame, b: DataFrame, key: str = "question_id") -> DataFrame:
    """One row (b, c, chi2); pairs are matched by question, and none may be left over."""
    x, y = a.select(key, F.col("correct").alias("x")), b.select(key, F.col("correct").alias("y"))
    pairs = x.join(y, key, "full")
    chi = F.when(F.col("b") + F.col("c") == 0, 0.0).otherwise(F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)).cast("double"), F.lit(2.0)) / (F.col("b") + F.col("c")))
    counts = pairs.agg(F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unpaired"))
    return counts.withColumn("chi2", chi)


def mcnemar(a: DataFrame, b: DataFrame, key: str = "question_id") -> tuple[float, float]:
    """Chi-squared and its p-value."""
    r = mcnemar_counts(a, b, key).first()
    if r["unpaired"]:
        raise ValueError("the responses are not of the same questions")
    return r["chi2"], chi2_survival(r["chi2"])


def comparison(metrics: DataFrame, baseline: str = "no_context", first_seen: str = "pos") -> DataFrame:
    """The best other condition against the baseline; no row if none is above zero or there is no baseline."""
    best = metrics.where((F.col("condition") != baseline) & (F.col("accuracy") > 0)).orderBy(F.desc("accuracy"), first_seen).limit(1)
    base = metrics.where(F.col("condition") == baseline).select(F.col("accuracy").alias("baseline_accuracy"), F.col("hallucination_rate").alias("_h")).limit(1)
    both = best.join(base)  # one row and one row
    return both.select(
        F.col("condition").alias("best_condition"), (F.col("accuracy") - F.col("baseline_accuracy")).alias("accuracy_delta"), (F.col("_h") - F.col("hallucination_rate")).alias("hallucination_reduction"),
        "baseline_accuracy", F.col("accuracy").alias("best_accuracy"),
    )


def knowledge_group(category: Column) -> Column:
    """F59."""
    return F.when(category.isin(*REGISTER_CATEGORIES), "Register Knowledge").otherwise("Datasheet Knowledge")


def knowledge_accuracy(by_category: DataFrame, group: list[str]) -> DataFrame:
    """The plain mean of the accuracies of a group's categories."""
    return by_category.groupBy(*group, knowledge_group(F.col("category")).alias("knowledge")).agg(F.avg("accuracy").alias("accuracy"))


def cost(provider: Column, tokens: Column) -> Column:
    """F60, A19."""
    return tokens * F.coalesce(lookup(provider, COST), F.lit(0.0)) / F.lit(1_000_000.0)


def difficulty_order(c: Column) -> Column:
    """O9."""
    return F.coalesce(F.nullif(F.array_position(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), c), F.lit(0)), F.lit(4))


def pivot_accuracy(by: DataFrame, name: str, conditions_: list[str]) -> DataFrame:
    """A row for each value, a column for each condition; 0.0 where there is none."""
    return by.groupBy(name).pivot("condition", conditions_).agg(F.first("accuracy")).fillna(0.0)


def with_source_ref(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Where a question's answer stands, and the answer itself."""
    q = questions.select(F.col("id").alias("_q"), F.coalesce("source_ref", F.lit("")).alias("source_ref"), F.col("answer").alias("expected"))
    return responses.join(q, F.col("question_id") == F.col("_q"), "left").drop("_q")


def run_costs(runs: DataFrame) -> DataFrame:
    """Tokens of each condition, and their cost at the rate of its first run's provider."""
    first = F.min_by("provider", F.struct("started", "run_id"))
    sums = runs.groupBy("condition").agg(F.sum("total_tokens").alias("total_tokens"), first.alias("provider"))
    return sums.withColumn("cost", cost(F.col("provider"), F.col("total_tokens")))


def default_chip(dataset_name: str) -> str:
    return dataset_name.split("_", 1)[0]


WHOLE, CATEGORY, DIFFICULTY, BIN = 0b0111, 0b0011, 0b0101, 0b0110  # which of four columns a grouping set leaves out


def metric_sets(responses: DataFrame, questions: DataFrame | None) -> DataFrame:
    """Counts and sums of each condition, and of its categories, difficulties and confidence bins, in one pass.

    ``set`` tells the grouping sets apart. Responses are read and shuffled once; partial sums leave the tasks.
    """
    r = responses if questions is None else with_difficulty(responses, questions)
    r = r.select("condition", "correct", "latency_ms", "partial_score", "confidence", infer_category(F.col("question_id")).alias("category"), (F.lit("") if questions is None else F.col("difficulty")).alias("difficulty"), ece_bin(F.col("confidence")).alias("bin"))
    c = {k: F.col(k) for k in ("condition", "category", "difficulty", "bin")}
    sets = [[c["condition"]], [c["condition"], c["category"]], [c["condition"], c["bin"]], *([] if questions is None else [[c["condition"], c["difficulty"]]])]
    stated = F.col("confidence").isNotNull()
    return r.groupingSets(sets, *c.values()).agg(
        F.grouping_id().cast("int").alias("set"), F.count("*").alias("total"), F.count_if("correct").alias("correct"), mean(F.col("latency_ms")).alias("avg_latency_ms"), mean(F.col("partial_score")).alias("avg_partial_score"),
        F.count("confidence").alias("stated"), F.count_if(F.col("correct") & stated).alias("stated_correct"), mean(F.col("confidence")).alias("avg_confidence"),
    )


def report(responses: DataFrame, questions: DataFrame | None, dataset_name: str, chip: str = "") -> DataFrame:
    """One row: chip, dataset_name, and the metrics of each condition with its maps and calibration error."""
    accuracy = F.col("correct") / F.col("total")
    of = lambda which, value: F.when(F.col("set") == which, value)
    entries = lambda which, key: F.map_from_entries(F.sort_array(F.collect_list(of(which, F.struct(F.col(key).alias("key"), accuracy.alias("accuracy"))))))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("stated_correct") / F.col("stated") - F.col("avg_confidence")) * F.col("stated")).otherwise(0.0)
    only = ("total", "correct", "avg_latency_ms", "avg_partial_score")
    m = metric_sets(responses, questions).groupBy("condition").agg(
        *[F.max(of(WHOLE, F.col(k))).alias(k) for k in only], entries(CATEGORY, "category").alias("by_category"), entries(DIFFICULTY, "difficulty").alias("by_difficulty"),
        F.sum(of(BIN, gap)).alias("gap"), F.sum(of(BIN, F.col("stated"))).alias("stated"),
    )
    low, high = wilson(F.col("correct"), F.col("total"))
    m = m.withColumn("accuracy", accuracy).withColumn("hallucination_rate", F.lit(1.0) - F.col("accuracy")).withColumn("ci_lower", low).withColumn("ci_upper", high).withColumn("ece", F.col("gap") / F.nullif("stated", F.lit(0)))
    rows = F.sort_array(F.collect_list(F.struct("condition", "total", "correct", "accuracy", "hallucination_rate", "avg_latency_ms", "avg_partial_score", "ci_lower", "ci_upper", "ece")))
    maps = F.map_from_entries(F.collect_list(F.struct("condition", F.struct("by_category", "by_difficulty").alias("maps"))))
    return m.agg(rows.alias("metrics"), maps.alias("maps")).select(F.lit(chip or default_chip(dataset_name)).alias("chip"), F.lit(dataset_name).alias("dataset_name"), "metrics", "maps")


def write_json(rows: DataFrame, path: str) -> None:
    """A report or question set, a JSON object a row."""
    rows.write.mode("overwrite").json(path)


def read_report(spark, path: str) -> DataFrame:
    m = "struct<condition:string,total:long,correct:long,accuracy:double,hallucination_rate:double,avg_latency_ms:double,avg_partial_score:double,ci_lower:double,ci_upper:double,ece:double>"
    by = "map<string,struct<by_category:map<string,double>,by_difficulty:map<string,double>>>"
    out = spark.read.schema(f"chip string, dataset_name string, metrics array<{m}>, maps {by}").json(path)
    if out.where("metrics is null or dataset_name is null").limit(1).count():
        raise BenchmarkError(f"{path}: not a report")
    return out


def report_markdown(metrics: DataFrame, by_category: DataFrame, conditions_: list[str], chip: str) -> str:
    """A table of conditions and one of categories; both have a row for each, a handful."""
    rows = metrics.orderBy("condition").collect()
    lines = [f"# Results for {chip}", "", "| Condition | Accuracy | 95 % interval | Partial | Latency |", "|---|---|---|---|---|"]
    lines += [f"| {r['condition']} | {r['accuracy']:.1%} ({r['correct']}/{r['total']}) | {r['ci_lower']:.1%} to {r['ci_upper']:.1%} | {r['avg_partial_score']:.1%} | {r['avg_latency_ms']:.0f} ms |" for r in rows]
    lines += ["", "| Category | " + " | ".join(conditions_) + " |", "|---" * (len(conditions_) + 1) + "|"]
    for r in pivot_accuracy(by_category, "category", conditions_).orderBy("category").collect():
        lines.append(f"| {r['category']} | " + " | ".join(f"{r[c]:.1%}" for c in conditions_) + " |")
    return "\n".join(lines) + "\n"
