"""Pages of matches and of entries: accounting, budgets, continuation."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.operators import branch, expand, grep
from strandline.functions.patterns import Pattern
from strandline.sources import sessions

STAMP = "2026-09-30T00:00:00.000Z"


def page(entries, pattern, limit=30, offset=0):
    """A page over (id, text) pairs, as the operator makes it from its counts."""
    found = [{"id": i, "ts": STAMP, "role": "user", "text": t} for i, t in entries if Pattern(pattern).count(t)]
    total = sum(Pattern(pattern).count(r["text"]) for r in found)
    offset = min(offset, len(found))
    return grep.render(found[offset : offset + limit], pattern, total, len(found), offset, limit)


def test_caps_of_snippets():
    text, details = page([(str(i), ("hit" + "x" * 400) * 4) for i in range(12)], "hit")
    assert (details["total"], details["snippets"], details["omitted"]) == (48, 30, 18)
    assert len(text.split("\n")) == 31
    assert sum(x.startswith("[0]") for x in text.split("\n")) == 3


@pytest.mark.parametrize(
    ("entries", "pattern", "expected"),
    [
        ([("a", "ab")], "", (3, 1, 2, 0)),
        ([("a", "😀😀")], ".", (4, 1, 3, 0)),
        ([("a", "😀")], "", (3, 1, 2, 0)),
        ([("a", "A   B")], r"\s", (3, 3, 0, 0)),
        ([("a", "A\nB\nC")], "\n", (2, 2, 0, 0)),
        ([("a", "A   B X A   B")], r"A\s+B", (2, 2, 0, 0)),
        ([("a", "A\tB")], "", (4, 3, 1, 0)),
        ([("a", "BEGIN" + "x" * 1000 + "END\t \tZ")], r"BEGIN[\s\S]*?END|\s", (4, 3, 0, 1)),
        ([("a", "hit near hit near hit" + "x" * 400 + "DISTANT hit")], "hit", (4, 2, 2, 0)),
        ([("a", "needle"), ("b", "needle")], "needle", (2, 2, 0, 0)),
        ([("a", "x" * 200 + "A" + "x" * 149 + "B" * 20)], "A|B{20}", (2, 2, 0, 0)),
    ],
)
def test_coverage(entries, pattern, expected):
    _, details = page(entries, pattern)
    assert (details["total"], details["snippets"], details["covered"], details["omitted"]) == expected


def test_pages_go_on_without_gaps():
    entries = [(f"signal-{i}", "signal") for i in range(80)]
    offset, seen = 0, []
    while offset is not None:
        text, details = page(entries, "signal", offset=offset)
        seen.append((details["offset"], details["returned"], details["omitted"]))
        assert f"raw matches not shown anywhere in this response: {details['omitted']}" in text
        offset = details["nextOffset"]
    assert seen == [(0, 30, 50), (30, 30, 50), (60, 20, 60)]
    assert page(entries, "signal", offset=99)[1]["returned"] == 0


def test_oversized_prefixes_count_when_they_are_reached():
    entries = [("x" * 200 if i == 30 else f"entry-{i}", "signal") for i in range(45)]
    _, first = page(entries, "signal", 50)
    assert (first["returned"], first["metadataSkipped"], first["omitted"]) == (30, False, 15)
    text, second = page(entries, "signal", 50, 30)
    assert (second["returned"], second["nextOffset"], second["omitted"], second["metadataSkipped"]) == (15, None, 31, True)
    assert "[xx" not in text and "oversized metadata" in text


def test_lines_and_budget():
    entries = [(f"{i:02d}" + "m" * 118, "z" * 1000) for i in range(30)]
    text, details = page(entries, "z+")
    assert details["snippets"] == 30 and len(text) <= 16_000
    assert {len(x) for x in text.split("\n")[1:]} == {498}
    text, _ = page([("long", "start😀" + "x" * 120_000 + "end😀")], r"start[\s\S]*end😀")
    assert "[snippet clipped]" in text and "start😀" in text and "end😀" in text


def test_grep_over_a_table(spark):
    rows = [("b", i, f"m{i}", STAMP, "user", t) for i, t in enumerate(["SF and san francisco [literal", "nothing", "sf SF", None])]
    entries = spark.createDataFrame(rows, "branch_id string, pos long, id string, ts string, role string, searchable string")
    assert grep.grep(entries, "sf|San Francisco")[1]["total"] == 4
    assert grep.grep(entries, "[literal")[1]["total"] == 1
    assert grep.grep(entries, r"\bsf\b")[1]["totalEntries"] == 2
    assert grep.grep(entries, "absent")[0].startswith("No matches")
    text, details = grep.grep(entries, "sf", limit=1, offset=1)
    assert "[m2]" in text and "[m0]" not in text and details["nextOffset"] is None
    with pytest.raises(ValueError):
        grep.grep(entries, "x", limit=0)


@pytest.fixture(scope="module")
def entries(spark):
    huge = "start" + "😀x" * 9000 + "end"
    rows = [("before", "user", "z" * 32_000), ("target", "assistant", huge), ("tool", "toolResult", "stdout"), ("after", "user", "context")]
    logs = [{"type": "message", "id": i, "timestamp": STAMP, "message": {"role": r, "content": t}} for i, r, t in rows]
    return branch.projected(sessions.entries(spark, {"b": logs})).persist()


def test_expand_pages_join_to_the_text(entries):
    offset, parts = 0, []
    while True:
        text, details = expand.expand(entries, "target", 1, 0, offset)
        assert len(text) <= 16_000
        parts.append(text[text.index("\n") + 1 : text.rindex("\n[page offset=")])
        if not details["hasMore"]:
            break
        offset = details["nextOffset"]
    assert "".join(parts) == "start" + "😀x" * 9000 + "end"
    assert details["total"] == 18_008 and len(parts) == 2


def test_expand_neighbours_and_ends(entries):
    text, details = expand.expand(entries, "tool", before=0)
    assert (details["from"], details["to"]) == ("tool", "after")
    assert "toolResult (requested)\nstdout" in text and "context" in text
    # A neighbour that doesn't fit ends the row of neighbours.
    assert expand.expand(entries, "tool")[1]["from"] == "tool"
    assert expand.expand(entries, "tool", 0, 0, 99)[1]["returned"] == 0
    assert expand.expand(entries, "nowhere") == ("No compacted entry with id nowhere.", {})


def test_neighbourhoods_of_many(spark):
    rows = [("a", p, f"a{p}", STAMP, "user", "t") for p in (0, 3, 7, 9)] + [("b", 0, "b0", STAMP, "user", "t")]
    table = spark.createDataFrame(rows, "branch_id string, pos long, id string, ts string, role string, readable string")
    found = expand.neighbourhood(table, table.where(F.col("id").isin("a3", "b0")), 2, 1).collect()
    assert sorted((r["target_id"], r["at"], r["id"]) for r in found) == [("a3", -1, "a0"), ("a3", 0, "a3"), ("a3", 1, "a7"), ("b0", 0, "b0")]
