"""Context compilation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CompileError
from ..functions.relevance import build_title, citation, described, is_usage, keywords, peripheral_of, relevance, sections, task_name, tokenize
from ..functions.text import strip
from . import postings, templates
from .postings import MIN_SCORE, TOP

RULE = "\n\n---\n\n"


@dataclass
class ContextOptions:
    """What the configuration says of the project."""

    values: dict[str, str] = field(default_factory=dict)
    pins: dict[str, str] = field(default_factory=dict)
    targets: tuple[str, ...] = ("claude",)
    budget: int = 120


def title_map(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.col("id").alias("_doc"), build_title(F.col("path"), F.col("id")).alias("title"))


def with_titles(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """A chunk's document title, or the document's id."""
    return chunks.join(title_map(manifest), F.col("doc_id") == F.col("_doc"), "left").withColumn("title", F.coalesce("title", "doc_id")).drop("_doc")


def distinct_peripherals(svd_chunks: DataFrame) -> DataFrame:
    """A1, A2: (peripheral, chip, collisions): the second headings, and how many chips share a name."""
    named = svd_chunks.select(peripheral_of(F.col("section_path")).alias("peripheral"), "chip").where("peripheral != ''").distinct()
    return named.withColumn("collisions", F.count("*").over(Window.partitionBy("peripheral")))


def peripheral_counts(chunks: DataFrame) -> DataFrame:
    """A3: register chunks of each named peripheral."""
    return chunks.where("peripheral != ''").groupBy("peripheral", "chip").agg(F.count_if(F.col("doc_type") == "svd").alias("svd_chunks")).orderBy("peripheral", "chip")


def chips_of(peripherals: DataFrame) -> DataFrame:
    """A5."""
    chips = F.array_join(F.sort_array(F.collect_set(F.nullif("chip", F.lit("")))), ", ")
    return peripherals.groupBy("peripheral").agg(F.coalesce(F.nullif(chips, F.lit("")), F.lit("unknown")).alias("chips"))


def ordered_text(text: Column, *order: Column, between: str = "\n\n") -> Column:
    """A4: texts of a group joined in order."""
    return strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], text.alias("t")))), lambda x: x["t"]), between))


def register_maps(svd_chunks: DataFrame, peripherals: DataFrame) -> DataFrame:
    """One join for all peripherals; their text and the description in it."""
    named = svd_chunks.withColumn("peripheral", peripheral_of(F.col("section_path")))
    both = named.join(peripherals, ["peripheral", "chip"])
    maps = both.groupBy("peripheral", "chip", "collisions").agg(ordered_text(F.col("content"), F.col("chunk_index"), F.col("chunk_id")).alias("register_map"))
    return maps.withColumn("description", described(F.col("register_map")))


def mentioning(chunks: DataFrame, peripherals: DataFrame) -> DataFrame:
    """Other chunks by the peripherals that an element of their path names; an equi-join on the elements."""
    names = chunks.drop("peripheral").withColumn("_name", F.explode(F.array_distinct(F.transform(sections(F.col("section_path")), F.lower))))
    own = peripherals.select("peripheral", F.col("chip").alias("p_chip"), F.lower("peripheral").alias("_key"), "register_map", "description")
    return names.join(own, (F.col("_name") == F.col("_key")) & ((F.col("p_chip") == "") | (F.col("chip") == F.col("p_chip")))).drop("_name", "_key")


def rank_chunks(rows: DataFrame, keys: Column, group: list[str], most: int = TOP, least: float = MIN_SCORE) -> DataFrame:
    """Best first, ties by id; without keywords in the order of ids and no threshold."""
    scored = rows.withColumn("score", relevance(keys, tokenize(F.col("content")))).where((F.size(keys) == 0) | (F.col("score") >= least))
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def usage_patterns(candidates: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The five best chunks that tell of use; ``shown`` marks the best of each task.

    ``words`` are the chunks' postings, if they are known already.
    """
    keys = F.array_distinct(F.array(F.lower("peripheral"), F.regexp_replace(F.lower("peripheral"), r"\d+\z", "")))
    using = candidates.where((F.col("content_type") == "config_procedure") | is_usage(F.col("section_path")))
    group = ["peripheral", "p_chip"]
    if words is None:
        words = postings.postings(using.dropDuplicates(["chunk_id"]))
    keyed = postings.keyword_sets(using.select(*group).distinct(), group, F.filter(keys, lambda k: k != ""))
    best = postings.rank_pairs(using, words, keyed, group, TOP, 0.0).withColumn("task", task_name(F.col("section_path")))
    first = F.row_number().over(Window.partitionBy("peripheral", "p_chip", "task").orderBy("rank"))
    return best.withColumn("shown", first == 1)


def compile_peripherals(chunks: DataFrame, manifest: DataFrame, pins: Mapping[str, str] | None = None) -> DataFrame:
    """A row for each peripheral and chip with all that its page shows."""
    svd = chunks.where(F.col("doc_type") == "svd")
    maps = register_maps(svd, distinct_peripherals(svd))
    prose = chunks.where(F.col("doc_type") != "svd")
    words = postings.postings(prose)  # each chunk is tokenised once, for all peripherals
    others = with_titles(mentioning(prose, maps), manifest)
    used = usage_patterns(others, words)
    # What the usage patterns took, shown or not, is no detail
    rest = others.join(used.select("peripheral", "p_chip", "chunk_id"), ["peripheral", "p_chip", "chunk_id"], "left_anti")
    keyed = postings.keyword_sets(maps.select("peripheral", F.col("chip").alias("p_chip"), "register_map", "description"), ["peripheral", "p_chip"], keywords(F.col("peripheral"), F.col("register_map"), F.col("description")))
    found = postings.rank_pairs(rest.drop("register_map", "description"), words, keyed, ["peripheral", "p_chip"])
    source = citation(F.col("title"), F.col("section_path"), F.col("doc_type"), F.col("page"))
    cited = F.concat(F.col("content"), F.lit("\n\n"), source)
    group = ["peripheral", "p_chip"]
    shown = used.where("shown").groupBy(*group).agg(ordered_text(F.concat(F.lit("### "), F.col("task"), F.lit("\n\n"), cited), F.col("rank"), between=RULE).alias("usage"))
    details = found.groupBy(*group).agg(ordered_text(cited, F.col("rank"), between=RULE).alias("details"))
    first = Window.partitionBy(*group, "doc_id").orderBy("chunk_index", "chunk_id")
    all_ = used.where("shown").select(*group, "doc_id", "chunk_index", "chunk_id", "title", "section_path", "doc_type", "page").unionByName(
        found.select(*group, "doc_id", "chunk_index", "chunk_id", "title", "section_path", "doc_type", "page")
    )
    # A citation for each document, of its first chunk
    per_doc = all_.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    sources = per_doc.groupBy(*group).agg(ordered_text(source, F.col("doc_id"), between="\n").alias("citations"))
    out = maps.withColumnRenamed("chip", "p_chip")
    for part in (shown, details, sources):
        out = out.join(part, group, "left")
    out = out.fillna("", ["usage", "details", "citations", "description"]).withColumnRenamed("p_chip", "chip")
    file = F.when(F.col("collisions") > 1, F.concat(F.lower("peripheral"), F.lit("_"), F.lower("chip"))).otherwise(F.lower("peripheral"))
    return out.withColumn("file", F.concat(F.regexp_replace(file, r"[/\\]|\.\.", "_"), F.lit(".md"))).withColumn("pins", matching_pins(pins or {}, F.col("peripheral")))


def matching_pins(pins: Mapping[str, str], peripheral: Column) -> Column:
    """Pins whose key begins with the peripheral's name, by key; the rest of the key is the signal."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("pin")) for k, v in sorted(pins.items())]).cast("array<struct<key:string,pin:string>>")
    prefix = F.concat(F.lower(peripheral), F.lit("_"))
    own = F.filter(rows, lambda r: F.startswith(F.lower(r["key"]), prefix))
    return F.transform(own, lambda r: F.struct(F.upper(F.substring(r["key"], F.length(prefix) + 1, F.length(r["key"]))).alias("signal"), r["pin"].alias("pin")))


def render_peripheral(row: Mapping, overrides: str | None = None) -> str:
    values = {k: row[k] for k in ("description", "register_map", "usage", "details", "citations")}
    values |= {"name": row["peripheral"], "dash_chip": f" — {row['chip']}" if row["chip"] else "", "pins": [{"signal": p["signal"], "pin": p["pin"]} for p in row["pins"]]}
    return templates.render(templates.load("peripheral", overrides), values)


NAMES = (
    "project mcu mcu_family architecture clock_mhz flash_kb ram_kb soc soc_family board kernel bootloader distro rtos hal language build_system register_access error_handling naming"
).split()


def hot_values(options: ContextOptions, documents: Iterable[Mapping], peripherals: Iterable[Mapping], errata: Iterable[Mapping] = ()) -> dict:
    v = {n: "" for n in NAMES} | {k: str(x) for k, x in options.values.items() if x not in (None, "", 0)}
    clock = f", {v['clock_mhz']} MHz" if v["clock_mhz"] else ""
    return v | {
        "dash_project": f" — {v['project']}" if v["project"] else "",
        "core": f" ({v['architecture']}{clock})" if v["architecture"] else "",
        "software": any(v[n] for n in ("kernel", "bootloader", "distro", "rtos", "hal", "build_system")),
        "conventions": any(v[n] for n in ("register_access", "error_handling", "naming")),
        "pins": [{"signal": k, "pin": p} for k, p in sorted(options.pins.items())],
        "documents": [dict(d) for d in documents],
        "peripherals": [{"name": p["peripheral"], "about": f" ({p['svd_chunks']} sections)" if p["svd_chunks"] else ""} for p in peripherals],
        "errata": [dict(e) for e in errata],
    }


def within_lines(values: dict, budget: int, overrides: str | None = None) -> str:
    """Less and less of what matters least, until the text fits the number of lines."""
    template = templates.load("hot", overrides)
    count = lambda t: len(t.strip().splitlines())
    text = templates.render(template, values)
    steps = [{"conventions": False, "register_access": "", "error_handling": "", "naming": ""}, {"pins": []}]
    steps += [{"peripherals": values["peripherals"][:n]} for n in (20, 10, 5, 0) if n < len(values["peripherals"])]
    steps += [{"documents": values["documents"][:n]} for n in (10, 5, 0)]
    for change in steps:
        if count(text) <= budget:
            break
        values = values | change
        text = templates.render(template, values)
    return text.strip() + "\n"


def compile_hot(chunks: DataFrame, manifest: DataFrame, options: ContextOptions, most_listed: int = 1000, overrides: str | None = None) -> str:
    """Documents and peripherals in short. What a page can list bounds what is gathered."""
    docs = manifest.join(title_map(manifest), F.col("id") == F.col("_doc")).select("title", "doc_type", "chip", "chunks", "id").orderBy("id").limit(most_listed).collect()
    found = peripheral_counts(chunks).limit(most_listed).collect()
    return within_lines(hot_values(options, [r.asDict() for r in docs], [r.asDict() for r in found]), options.budget, overrides)


def compile_targets(hot: str, options: ContextOptions, root: str | Path, context_dir: str = ".docstrata/context", overrides: str | None = None) -> list[Path]:
    """The file of each configured tool, its marked part replaced; an unknown tool is skipped."""
    written = []
    when = f" on {datetime.now(timezone.utc):%Y-%m-%d %H:%M} UTC"
    for name in options.targets:
        target = templates.TARGETS.get(name)
        if target is None:
            continue
        text = templates.render(templates.load(target.template, overrides), {"preamble": target.preamble, "hot_context": hot.strip(), "context_dir": context_dir, "when": when})
        path = Path(root) / target.path
        try:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(templates.inject(path.read_text(encoding="utf-8") if path.exists() else None, text), encoding="utf-8")
        except OSError as e:
            raise CompileError(f"{path}: {e}") from e
        written.append(path)
    return written


def write_peripherals(rows: DataFrame, folder: str | Path, overrides: str | None = None) -> int:
    """One page a peripheral, one at a time on the driver."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    n = 0
    for row in rows.toLocalIterator():
        (out / row["file"]).write_text(render_peripheral(row.asDict(recursive=True), overrides), encoding="utf-8")
        n += 1
    return n
