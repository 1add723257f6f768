"""Configuration (S28, D25): sections of a TOML file; what is missing has a default, what is unknown is left aside."""

from __future__ import annotations

import tomllib
from copy import deepcopy
from pathlib import Path
from types import SimpleNamespace

from .errors import ConfigError

#: Every section with its settings and their defaults (fixed values).
DEFAULTS: dict[str, dict] = {
    "project": {"name": ""},
    "hardware": {"mcu": "", "mcu_family": "", "architecture": "", "clock_mhz": 0, "flash_kb": 0, "ram_kb": 0, "soc": "", "soc_family": "", "board": ""},
    "software": {"rtos": "", "hal": "", "language": "C", "build_system": "", "kernel": "", "bootloader": "", "distro": ""},
    "conventions": {"register_access": "", "error_handling": "", "naming": ""},
    "embedding": {"provider": "hashing", "model": "", "url": "", "key_variable": "", "batch_size": 64},
    "store": {"provider": "parquet", "collection": "chunks"},
    "chunk": {"max_tokens": 512, "overlap_tokens": 50, "min_tokens": 50},
    "output": {"targets": ["claude"], "hot_context_lines": 120},
    "ingest": {"pdf_parser": "pdf"},
    "vision": {"provider": "none", "model": "", "url": "", "key_variable": ""},
    "serving": {"top_k": 5},
}


class Config(SimpleNamespace):
    """A namespace a section, and ``pins``, a free mapping."""

    def __init__(self, given: dict | None = None):
        given = given or {}
        for section, defaults in DEFAULTS.items():
            own = given.get(section, {})
            if not isinstance(own, dict):
                raise ConfigError(f"{section} is no section")
            setattr(self, section, SimpleNamespace(**(deepcopy(defaults) | {k: v for k, v in own.items() if k in defaults})))
        self.pins = {str(k): str(v) for k, v in given.get("pins", {}).items()}


def loads(text: str) -> Config:
    try:
        return Config(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e


def load(path: str | Path) -> Config:
    try:
        return loads(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigError(f"{path}: {e}") from e


def _value(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    escaped = "".join({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c if ord(c) >= 32 else f"\\u{ord(c):04x}") for c in str(v))
    return f'"{escaped}"'


def dumps(config: Config) -> str:
    lines = []
    for name, section in ((n, getattr(config, n)) for n in (*DEFAULTS, "pins")):
        section = section if isinstance(section, dict) else vars(section)
        lines.append(f"[{name}]")
        lines += [f"{k if k.replace('_', '').replace('-', '').isalnum() and k.isascii() else _value(k)} = {_value(v)}" for k, v in section.items()]
        lines.append("")
    return "\n".join(lines)


def get(config: Config, key: str):
    """M9: a value by section and name."""
    section, _, name = key.partition(".")
    try:
        return config.pins[name] if section == "pins" else getattr(getattr(config, section), name)
    except (AttributeError, KeyError) as e:
        raise ConfigError(f"no setting {key!r}") from e


def put(config: Config, key: str, value: str) -> None:
    section, _, name = key.partition(".")
    if section == "pins":
        config.pins[name] = value
        return
    old = get(config, key)
    try:
        new = value.split(",") if isinstance(old, list) else type(old)(value)
    except ValueError as e:
        raise ConfigError(f"{key}: {value!r} is no {type(old).__name__}") from e
    setattr(getattr(config, section), name, new)
