"""Templates (C8-C10, X4): texts with names, sections that vanish when empty, and project overrides.

A template is lines. ``{name}`` is replaced, an unknown name is an error. A line
that begins with ``?name `` is kept, without the mark, only if the value is not
empty; ``@name `` is repeated for each row of a list, with the row's names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from ..errors import TemplateError

BEGIN, END = "<!-- BEGIN HARDWARE CONTEXT (generated, do not edit) -->", "<!-- END HARDWARE CONTEXT -->"

HOT = """\
# The machine behind this code{dash_project}

Peripherals come first, each with a page of its own; then wiring, parts and rules.
?peripherals
?peripherals ## What can be driven
@peripherals - `{name}`{about}
?pins
?pins ## How it is wired
?pins | Pin | carries |
?pins |-----|---------|
@pins | {pin} | {signal} |
?errata
?errata ## Known faults of the silicon
@errata - {errata_id}{about}

## Parts
?mcu - controller: `{mcu}`{core}
?soc - system on chip: `{soc}`{core}
?mcu_family - controller family: {mcu_family}
?soc_family - chip family: {soc_family}
?board - mounted on: {board}
?flash_kb - program memory: {flash_kb} KB
?ram_kb - working memory: {ram_kb} KB
?language - written in: {language}
?build_system - built by: {build_system}
?hal - drivers through: {hal}
?rtos - scheduled by: {rtos}
?kernel - kernel: {kernel}
?bootloader - started by: {bootloader}
?distro - packaged as: {distro}
?conventions
?conventions ## House rules
?naming - call things: {naming}
?register_access - touch registers: {register_access}
?error_handling - when something fails: {error_handling}
?documents
?documents ## Where this comes from
?documents | Title | Chunks | About | Kind |
?documents |-------|--------|-------|------|
@documents | {title} | {chunks} | {chip} | {doc_type} |
"""
PERIPHERAL = """\
# {name}{dash_chip}
?description
?description {description}
?pins
?pins ## Pin assignments
?pins | Signal | Pin |
?pins |--------|-----|
@pins | {signal} | {pin} |
?register_map
?register_map ## Register map
?register_map
?register_map {register_map}
?usage
?usage ## Usage patterns
?usage
?usage {usage}
?details
?details ## Additional documentation
?details
?details {details}
?citations
?citations ## Sources
?citations
?citations {citations}
"""
#: What each tool is told below the context: a heading and how to use the folder of pages.
_ADVICE = {
    "claude": ("Hardware reference", (
        "Read the peripheral's file in `{context_dir}/peripherals/` before you write code for it.",
        "Take register addresses, offsets and bit positions from there; do not guess them.",
        "The `search`, `registers` and `context` tools of the documentation server find what the pages leave out.",
    )),
    "codex": ("Working with the hardware", (
        "Pages of all peripherals are in `{context_dir}/peripherals/`, one file each.",
        "Check every register address and bit position there before you use it.",
    )),
    "cursor": ("Rules for hardware code", (
        "Open `{context_dir}/peripherals/<name>.md` before you edit a driver of that peripheral.",
        "Use the register names of the page as they stand.",
        "Where the page does not say, ask; do not make up addresses.",
    )),
    "gemini": ("Hardware pages", (
        "`{context_dir}/peripherals/` holds a page for each peripheral: registers, fields, usage, sources.",
        "Quote the page's source when you state a register's address or reset value.",
    )),
    "copilot": ("Instructions for hardware code", (
        "Look registers up in `{context_dir}/peripherals/` and keep to the conventions above.",
        "Do not suggest addresses or bit positions that no page has.",
    )),
}


def _tool(name: str) -> str:
    heading, lines = _ADVICE[name]
    listed = "\n".join(f"- {x}" for x in lines)
    return f"{{preamble}}{BEGIN}\n{{hot_context}}\n\n## {heading}\n\n{listed}\n\n> Generated{{when}}\n{END}\n"


@dataclass(frozen=True)
class Target:
    """A tool and the file that it reads."""

    path: str
    template: str
    preamble: str = ""


# The files that tools look for.
TARGETS = {
    "claude": Target("CLAUDE.md", "claude"),
    "codex": Target("AGENTS.md", "codex"),
    "cursor": Target(".cursor/rules/hardware.mdc", "cursor", "---\ndescription: Hardware context\nalwaysApply: true\n---\n"),
    "gemini": Target(".gemini/GEMINI.md", "gemini"),
    "copilot": Target(".github/copilot-instructions.md", "copilot"),
}
BUILT_IN = {"hot": HOT, "peripheral": PERIPHERAL} | {name: _tool(name) for name in _ADVICE}


def load(name: str, overrides: str | Path | None = None) -> str:
    """The project's own template if it has one, else the built-in one."""
    own = Path(overrides) / f"{name}.tmpl" if overrides else None
    if own is not None and own.is_file():
        return own.read_text(encoding="utf-8")
    if name not in BUILT_IN:
        raise TemplateError(f"no template {name!r}")
    return BUILT_IN[name]


def _filled(line: str, values: dict) -> str:
    def value(m: re.Match) -> str:
        if m[1] not in values:
            raise TemplateError(f"unknown name {m[1]!r}")
        return str(values[m[1]])

    return re.sub(r"\{(\w+)\}", value, line)


def render(template: str, values: dict) -> str:
    out = []
    for line in template.split("\n"):
        mark = re.match(r"([?@])(\w+)(?: |$)(.*)", line)
        if mark is None:
            out.append(_filled(line, values))
            continue
        if mark[2] not in values:
            raise TemplateError(f"unknown name {mark[2]!r}")
        value = values[mark[2]]
        if mark[1] == "@":
            out += [_filled(mark[3], values | row) for row in value]
        elif value:
            out.append(_filled(mark[3], values))
    return "\n".join(out)


def inject(existing: str | None, rendered: str, begin: str = BEGIN, end: str = END) -> str:
    """The rendered text in place of the marked part; whatever else a file holds stays."""
    if existing is None:
        return rendered
    first, last = existing.find(begin), existing.find(end)
    if 0 <= first < last:
        own = rendered[max(rendered.find(begin), 0) :]
        rest = existing[last + len(end) :]
        return existing[:first] + own + rest.removeprefix("\n")
    if first >= 0:  # a beginning without an end
        existing = existing[:first] + existing[first + len(begin) :]
    return existing.rstrip() + "\n\n" + rendered
