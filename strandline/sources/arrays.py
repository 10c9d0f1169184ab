"""Records of large files that are one JSON array, in bounded memory."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

#: Characters that are read at once.
CHUNK = 64 << 10


def records(path: str | Path, chunk: int = CHUNK) -> Iterator[object]:
    """The elements of a file's array, one after the other.

    What is held is a chunk and the element that it breaks off; a text that isn't an
    array of JSON values, or goes on behind it, is a ValueError.
    """
    decode = json.JSONDecoder().raw_decode
    with open(path, encoding="utf-8") as file:
        held, at, ended = "", 0, False

        def more() -> bool:
            nonlocal held, at, ended
            new = "" if ended else file.read(chunk)
            ended = not new
            held, at = held[at:] + new, 0
            return not ended

        def next_sign() -> str:
            nonlocal at
            while True:
                while at < len(held) and held[at] in " \t\r\n":
                    at += 1
                if at < len(held):
                    return held[at]
                if not more():
                    return ""

        if next_sign() != "[":
            raise ValueError("not an array")
        at += 1
        if next_sign() == "]":
            at += 1
        else:
            while True:
                next_sign()
                while True:
                    try:
                        value, end = decode(held, at)
                        # A number may go on in the next chunk.
                        if end < len(held) or not more():
                            break
                    except ValueError:
                        if not more():
                            raise ValueError("the array breaks off") from None
                yield value
                at = end
                sign = next_sign()
                at += 1
                if sign == "]":
                    break
                if sign != ",":
                    raise ValueError(f"a comma or the array's end was expected, not {sign!r}")
        if next_sign():
            raise ValueError("the text goes on behind the array")


def to_lines(source: str | Path, target: str | Path, chunk: int = CHUNK) -> int:
    """Write an array's elements as JSON lines, which Spark reads in parallel; how many."""
    count = 0
    with open(target, "w", encoding="utf-8") as out:
        for count, value in enumerate(records(source, chunk), 1):
            out.write(json.dumps(value, ensure_ascii=False) + "\n")
    return count
