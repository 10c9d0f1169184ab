"""JSON in the forms that histories need: canonical, and safe to show."""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNSAFE = re.compile("[<>\\[\\]`\u007f-\u009f\u200b-\u200f\u2028-\u202e\u2060-\u206f]")


def _number(value: float) -> int | float | str:
    if not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    return int(value) if value == int(value) and abs(value) < 1e21 else value


def _stable(value: object, inside: tuple[int, ...] = ()) -> object:
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, (int, float)):
        return _number(value) if isinstance(value, float) else value
    if not isinstance(value, (dict, list, tuple)):
        return f"[Unsupported {type(value).__name__}]"
    if id(value) in inside:
        return "[Circular]"
    inside = (*inside, id(value))
    if isinstance(value, dict):
        # Keys sort by UTF-16 units.
        return {k: _stable(value[k], inside) for k in sorted(map(str, value), key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    return [_stable(x, inside) for x in value]


def canonical_json(value: object) -> str:
    """Compact JSON with sorted keys; whole numbers without a fraction, what isn't finite as text."""
    return json.dumps(_stable(value), ensure_ascii=False, separators=(",", ":"))


def canonical_hash(value: object) -> str:
    """SHA-256, in hexadecimal, of a value's canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode("utf-8", "surrogatepass")).hexdigest()


def canonical_arguments(text: str | None) -> str:
    """Canonical JSON of arguments that are JSON text; what can't be read stays a string."""
    if text is None:
        return "null"
    try:
        return canonical_json(json.loads(text))
    except ValueError:
        return canonical_json(text)


def safe_json(value: object) -> str:
    """JSON without characters that could end a tag, a list or a line, or turn the direction of text."""
    plain = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return _UNSAFE.sub(lambda m: f"\\u{ord(m.group()):04x}", plain)


@F.pandas_udf(T.StringType())
def canonical_udf(text: pd.Series) -> pd.Series:
    return text.map(canonical_arguments)


@F.pandas_udf(T.StringType())
def canonical_hash_udf(text: pd.Series) -> pd.Series:
    """Hashes of JSON texts by what they say, whatever the order of keys; null for what isn't JSON."""

    def one(value: str | None) -> str | None:
        try:
            return None if value is None else canonical_hash(json.loads(value))
        except ValueError:
            return None

    return text.map(one)


class DuplicateKey(ValueError):
    """An object names a key twice."""


def strict_json(text: str) -> object:
    """JSON in which no object names a key twice and no number is NaN or infinite."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out: dict = {}
        for key, value in items:
            if key in out:
                raise DuplicateKey(key)
            out[key] = value
        return out

    def constant(name: str) -> None:
        raise ValueError(f"{name} isn't JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
