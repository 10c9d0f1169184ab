"""Settings from a file and from the environment, with warnings instead of failures."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

#: Bytes of a settings file at most.
LARGEST_FILE = 65_536
PREFIX = "STRANDLINE_"


@dataclass(frozen=True)
class Settings:
    """``mode`` full has searches and hints, lite grep and expand alone; cadences count events until an index is prepared."""

    mode: str = "full"
    trace: bool = False
    user_cycles: int = 10
    tool_rounds: int = 10
    recall_timeout_ms: int = 5_000
    auto_gate: int = 280
    snippet_budget: int = 240
    segmenter: bool = True

    @property
    def tools(self) -> tuple[str, ...]:
        return ("history_recall", "history_grep", "history_expand") if self.mode == "full" else ("history_grep", "history_expand")


def _cadence(value: object) -> bool:
    return type(value) is int and 1 <= value <= 100


def _positive(value: object) -> bool:
    return type(value) is int and 0 < value < 2**53


#: Field -> (key in the file, check, whether a wrong value is worth a warning).
_FIELDS: dict[str, tuple[str, Callable[[object], bool], bool]] = {
    "mode": ("mode", lambda v: v in ("full", "lite"), True),
    "trace": ("trace", lambda v: type(v) is bool, True),
    "user_cycles": ("preindex.userCycles", _cadence, True),
    "tool_rounds": ("preindex.toolRounds", _cadence, True),
    "recall_timeout_ms": ("recallTimeoutMs", _positive, False),
    "auto_gate": ("autoGate", _positive, False),
    "snippet_budget": ("snippetBudget", _positive, False),
    "segmenter": ("segmenter", lambda v: type(v) is bool, True),
}


def _read_file(path: Path, warn: Callable[[str], None]) -> dict[str, object]:
    """Values by key, those of an inner object as ``outer.inner``."""
    try:
        if path.stat().st_size > LARGEST_FILE:
            raise ValueError("too large")
        parsed = json.loads(path.read_text(encoding="utf-8"))
        inner = parsed.get("preindex", {}) if isinstance(parsed, dict) else None
        if not isinstance(inner, dict):
            raise ValueError("not an object")
    except FileNotFoundError:
        return {}
    except (OSError, ValueError) as error:
        warn(f"settings file {path.name} can't be used ({error}); defaults and environment apply")
        return {}
    found = {k: v for k, v in parsed.items() if k != "preindex"} | {f"preindex.{k}": v for k, v in inner.items()}
    unknown = sorted(set(found) - {key for key, _, _ in _FIELDS.values()})
    if unknown:
        warn(f"unknown settings ignored: {', '.join(unknown)}")
    return found


def _from_environment(name: str, raw: str) -> object:
    kind = type(getattr(Settings, name))
    if kind is bool:
        return {"on": True, "off": False}.get(raw, raw)
    if kind is int:
        return int(raw) if raw.isascii() and raw.isdigit() else raw
    return raw


def load(path: str | Path | None = None, env: Mapping[str, str] | None = None, warn: Callable[[str], None] = lambda text: None) -> Settings:
    """Settings of a file, over which the environment goes (``trace`` comes from the file alone).

    A value that isn't valid leaves what there was, but a mode or number of the
    environment that isn't valid falls back to the default.
    """
    env = os.environ if env is None else env
    values = _read_file(Path(path), warn) if path is not None else {}
    out = Settings()
    for field in fields(Settings):
        key, valid, loud = _FIELDS[field.name]
        if key in values:
            if valid(values[key]):
                out = replace(out, **{field.name: values[key]})
            elif loud:
                warn(f"invalid {key}; using {getattr(out, field.name)}")
        raw = env.get(PREFIX + field.name.upper())
        if raw is None or field.name == "trace":
            continue
        value = _from_environment(field.name, raw)
        if valid(value):
            out = replace(out, **{field.name: value})
        else:
            if field.name in ("mode", "segmenter", "recall_timeout_ms", "auto_gate", "snippet_budget"):
                out = replace(out, **{field.name: field.default})
            if loud:
                warn(f"invalid {PREFIX}{field.name.upper()}; using {getattr(out, field.name)}")
    return out
