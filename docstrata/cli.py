"""The command line."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from dataclasses import asdict
from pathlib import Path

from . import VERSION
from . import __doc__ as about
from . import config as configuration
from .errors import EngineError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docstrata", description=about)
    p.add_argument("--root", default=".")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init")
    c.add_argument("--name", default="")
    c.add_argument("--chip", default="")
    for name in ("status", "version"):
        sub.add_parser(name)
    sub.add_parser("serve").add_argument("--config", action="store_true", help="print what a tool needs to start the server")
    c = sub.add_parser("add")
    c.add_argument("paths", nargs="+")
    c.add_argument("--type", default="")
    c.add_argument("--chip", default="")
    c.add_argument("--no-compile", action="store_true")
    sub.add_parser("remove").add_argument("document")
    sub.add_parser("compile").add_argument("--target", action="append", default=[])
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--top", type=int, default=5)
    for name in ("chip", "doc-type", "peripheral"):
        c.add_argument(f"--{name}", default="")
    c = sub.add_parser("context")
    c.add_argument("peripheral", nargs="?", default="")
    c.add_argument("--chip", default="")
    c.add_argument("--format", choices=("md", "json", "text"), default="md")
    catalog = sub.add_parser("catalog").add_subparsers(dest="action", required=True)
    c = catalog.add_parser("list")
    c.add_argument("file")
    c.add_argument("query", nargs="?", default="")
    c.add_argument("--vendor", default="")
    c = catalog.add_parser("add")
    c.add_argument("file")
    c.add_argument("device")
    c.add_argument("--base", required=True, help="URL of the folder that the catalog's paths are below")
    c = sub.add_parser("config")
    c.add_argument("key")
    c.add_argument("value", nargs="?")
    bench = sub.add_parser("bench").add_subparsers(dest="action", required=True)
    c = bench.add_parser("generate")
    c.add_argument("svd")
    c.add_argument("out")
    c.add_argument("--peripherals", type=int, default=20)
    c = bench.add_parser("run")
    c.add_argument("questions")
    c.add_argument("out")
    c.add_argument("--provider", default="stub", help="stub, command or http")
    c.add_argument("--option", action="append", default=[], help="name=value of the provider; a command's words are separated by spaces")
    c.add_argument("--condition", action="append", default=[], help="of no_context, hot, raw_text, full, svd_lookup, rag, hybrid; all that can be had if none is given")
    c.add_argument("--svd", default="", help="register file for lookups")
    c.add_argument("--text", default="", help="text file for the raw_text condition")
    c.add_argument("--chip", default="")
    c.add_argument("--runs", type=int, default=1)
    c = bench.add_parser("report")
    c.add_argument("questions")
    c.add_argument("responses")
    c.add_argument("--chip", default="")
    c.add_argument("--out", default="")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    try:
        return run(args)
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def run(args: argparse.Namespace) -> int:
    if args.command == "version":
        print(f"docstrata {VERSION}")
        return 0
    from . import serve
    from .project import Project, find_root
    from .session import session

    spark = session()
    root = Path(args.root) if args.command == "init" else find_root(args.root) or Path(args.root)
    project = Project(spark, root)
    if args.command == "init":
        project.init(args.name, args.chip)
    elif args.command == "status":
        print(json.dumps(asdict(project.status())))
    elif args.command == "serve":
        if args.config:
            print(json.dumps({"mcpServers": {"docstrata": serve.settings(root.resolve())}}))
        else:
            serve.serve(project)
    elif args.command == "add":
        print(json.dumps(project.add(*args.paths, doc_type=args.type, chip=args.chip, compile_after=not args.no_compile)))
    elif args.command == "remove":
        print(project.remove(args.document))
    elif args.command == "compile":
        print("\n".join(map(str, project.compile(tuple(args.target)))))
    elif args.command == "search":
        print(serve.search(project, args.query, args.top, args.chip, args.doc_type, args.peripheral))
    elif args.command == "context":
        text = serve.context(project, args.peripheral, args.chip) if args.peripheral else (project.context / "hot.md").read_text(encoding="utf-8")
        print(shown(spark, args.peripheral or "hot", text, args.format))
    elif args.command == "catalog":
        from .sources.catalog import Catalog

        c = Catalog.read(spark, args.file)
        if args.action == "add":
            path = c.fetch(args.device, args.base, project.folder / "devices")
            print(json.dumps(project.add(str(path), chip=args.device)))
        else:
            for r in (c.search(args.query, args.vendor, 10) if args.query else c.vendors()).collect():
                print(*r)
    elif args.command == "config":
        c = project.config()
        if args.value is None:
            print(configuration.get(c, args.key))
        else:
            configuration.put(c, args.key, args.value)
            project.save(c)
    elif args.command == "bench":
        {"generate": bench_generate, "run": bench_run, "report": bench_report}[args.action](spark, project, args)
    return 0


def shown(spark, query: str, text: str, kind: str) -> str:
    from pyspark.sql import functions as F

    from .functions.text import formatted

    return spark.range(1).select(formatted(F.lit(query), F.lit(text), kind)).first()[0]


def register_model(spark, svd_path: str):
    """Peripherals, registers and fields of register files."""
    from .sources.files import scan
    from .sources.svd import field_table, peripheral_table, read_devices, register_table

    p = peripheral_table(read_devices(scan(spark, svd_path)))
    r = register_table(p)
    return p.withColumnRenamed("name", "peripheral"), r.drop("fields"), field_table(r)


def bench_generate(spark, project, args) -> None:
    """M8: a question set from a register description."""
    from .operators.evaluate import generate_questions, write_dataset

    model = register_model(spark, args.svd)
    chip = (model[0].select("chip").first() or ("",))[0]
    write_dataset(generate_questions(*model, args.peripherals), f"{chip}_questions", chip, args.out)


def bench_run(spark, project, args) -> None:
    """M8: answers of a provider to a question set, in each condition that can be had; the skipped ones are named."""
    from pyspark.sql import functions as F

    from .operators import evaluate
    from .providers import default_registry

    options = dict(o.split("=", 1) for o in args.option)
    if "command" in options:
        options["command"] = options["command"].split()
    provider = default_registry().create("answer", args.provider, **options)
    inside = project.folder.is_dir()
    hot = project.context / "hot.md"
    pages = {p.name: p.read_text(encoding="utf-8") for p in sorted((project.context / "peripherals").glob("*.md"))} if inside else None
    raw = Path(args.text).read_text(encoding="utf-8", errors="replace") if args.text else None
    what = evaluate.conditions(spark, args.chip, hot.read_text(encoding="utf-8") if hot.is_file() else None, raw, pages)
    what = evaluate.with_placeholders(what)
    if args.condition:
        what = what.where(F.col("name").isin(*args.condition))
    model = register_model(spark, args.svd) if args.svd else None
    chunks = project.store.read() if inside else None
    responses, skipped = evaluate.run_benchmark(evaluate.read_dataset(spark, args.questions), what, provider, args.runs, model, chunks, project.embedder if inside else None, args.chip)
    responses.write.mode("overwrite").json(args.out)
    for name in skipped:
        print(f"skipped {name}: what it needs was not given", file=sys.stderr)


def bench_report(spark, project, args) -> None:
    """M8: tables of the metrics by condition and by category."""
    from pyspark.sql import functions as F

    from .operators import evaluate

    questions = evaluate.read_dataset(spark, args.questions)
    raw = spark.read.schema("id string, condition string, correct boolean, latency_ms double, partial_score double, confidence double").json(args.responses).withColumnRenamed("id", "question_id")
    metrics = evaluate.core_metrics(raw, ["condition"])
    names = [r["condition"] for r in metrics.select("condition").orderBy("condition").collect()]
    text = evaluate.report_markdown(metrics, evaluate.accuracy_by(raw, ["condition"], evaluate.infer_category(F.col("question_id")), "category"), names, args.chip)
    print(text)
    if args.out:
        evaluate.write_json(evaluate.report(raw, questions, f"{args.chip}_questions", args.chip), args.out)


if __name__ == "__main__":
    sys.exit(main())
