"""Handlers for tools that ask (Q2-Q6, P8, P9, O12, D28, M6): plain functions, and a Model Context Protocol server over them."""

from __future__ import annotations

import json
import sys
from pathlib import Path
from typing import TextIO

from pyspark.sql import functions as F

from . import VERSION
from .functions.relevance import peripheral_of
from .operators.compile import chips_of
from .operators.search import clamp_k
from .project import Project


def safe(name: str) -> bool:
    """P10."""
    return bool(name) and not any(x in name for x in ("/", "\\", "..", "\0"))


def search(project: Project, query: str, top_k: int = 5, chip: str = "", doc_type: str = "", peripheral: str = "") -> str:
    """Q2."""
    try:
        rows = project.search(query, clamp_k(top_k), chip=chip, doc_type=doc_type, peripheral=peripheral).orderBy("rank").collect()
    except Exception as e:
        return f"Search error: {e}"
    if not rows:
        return f"Nothing found for {query!r}."
    parts = [f"**{r['rank']}. {r['section_path'] or r['doc_id']}** (score {r['score']:.3f}, {r['doc_type']}{', ' + r['chip'] if r['chip'] else ''})\n\n{r['content']}" for r in rows]
    return "\n\n---\n\n".join(parts)


def registers(project: Project, peripheral: str, register: str = "", chip: str = "", content_type: str = "register_description", limit: int = 50) -> str:
    """Q3: register passages of a peripheral, whatever the case of its name."""
    own = (F.col("doc_type") == "svd") & (F.upper(peripheral_of(F.col("section_path"))) == peripheral.upper())
    if content_type:
        own &= F.col("content_type") == content_type
    if chip:
        own &= F.col("chip") == chip
    if register:
        own &= F.upper("content").contains(register.upper())
    rows = project.store.chunks(own).orderBy("chunk_index", "chunk_id").limit(limit + 1).collect()
    return "\n\n".join(_listed([r["content"] for r in rows], limit)) or f"No registers of {peripheral!r}."


def _listed(lines: list[str], limit: int) -> list[str]:
    """The first lines, and a word on it if there are more."""
    return lines if len(lines) <= limit else [*lines[:limit], f"(more than {limit}; give a larger limit to see them)"]


def context(project: Project, peripheral: str, chip: str = "") -> str:
    """Q4: the chip's page, the plain page, the first page that begins so, or passages from the store."""
    if not safe(peripheral) or (chip and not safe(chip)):
        return "Not a name."
    pages = project.context / "peripherals"
    name = peripheral.lower()
    tries = ([pages / f"{name}_{chip.lower()}.md"] if chip else []) + [pages / f"{name}.md"] + sorted(pages.glob(f"{name}_*.md"))
    found = next((p for p in tries if p.is_file()), None)
    return found.read_text(encoding="utf-8") if found else registers(project, peripheral, chip=chip, content_type="")


def list_peripherals(project: Project, limit: int = 1000) -> str:
    """Q5."""
    svd = project.store.metadata(F.col("doc_type") == "svd").select(peripheral_of(F.col("section_path")).alias("peripheral"), "chip").where("peripheral != ''")
    rows = chips_of(svd).orderBy("peripheral").limit(limit + 1).collect()
    return "\n".join(_listed([f"- {r['peripheral']} ({r['chips']})" for r in rows], limit)) or "No peripherals."


def list_documents(project: Project, limit: int = 1000) -> str:
    rows = project.manifest().orderBy("id").limit(limit + 1).collect()
    return "\n".join(_listed([f"| {r['id']} | {r['doc_type']} | {r['chip']} | {r['chunks']} | {r['added'][:10]} |" for r in rows], limit)) or "No documents."


TOOLS = {"search": search, "registers": registers, "context": context, "list_peripherals": list_peripherals, "list_documents": list_documents}


#: Arguments of each tool: name to type, the required ones first.
ARGUMENTS = {
    "search": ("Search the indexed documents", {"query": "string", "top_k": "integer", "chip": "string", "doc_type": "string", "peripheral": "string"}, ["query"]),
    "registers": ("Registers of a peripheral", {"peripheral": "string", "register": "string", "chip": "string", "limit": "integer"}, ["peripheral"]),
    "context": ("The compiled page of a peripheral", {"peripheral": "string", "chip": "string"}, ["peripheral"]),
    "list_peripherals": ("All peripherals", {"limit": "integer"}, []),
    "list_documents": ("All documents", {"limit": "integer"}, []),
}
PROTOCOL = "2024-11-05"


def described_tools() -> list[dict]:
    kinds = lambda given: {k: {"type": t} for k, t in given.items()}
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": kinds(a), "required": r}} for n, (d, a, r) in ARGUMENTS.items()]


def respond(project: Project, request: dict) -> dict | None:
    """The answer to a JSON-RPC request of the Model Context Protocol; nothing to a notification."""
    method, params = request.get("method", ""), request.get("params") or {}
    if "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    if method == "initialize":
        about = {"name": "docstrata", "version": VERSION}
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": about}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": described_tools()}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method {method!r}"}}
    name = params.get("name")
    if name not in TOOLS:
        return reply | {"error": {"code": -32602, "message": f"no tool {name!r}"}}
    try:
        text, wrong = TOOLS[name](project, **(params.get("arguments") or {})), False
    except Exception as e:
        text, wrong = f"{type(e).__name__}: {e}", True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": wrong}}


def serve(project: Project, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """M6: a JSON-RPC request a line, an answer a line."""
    for line in source:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            answer = respond(project, request) if isinstance(request, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
        except ValueError as e:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if answer is not None:
            print(json.dumps(answer), file=sink, flush=True)


def settings(root: str | Path) -> dict:
    """What a tool needs to start the server."""
    return {"command": sys.executable, "args": ["-m", "docstrata.cli", "--root", str(root), "serve"]}
