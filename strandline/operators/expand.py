"""Reading an entry by id, in pages, with its neighbours where they fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Size of a page, neighbours by default and at most, and the largest number that a status may hold.
PAGE, NEIGHBOURS, MOST, LARGEST = 16_000, 2, 20, 2**53 - 1
# What a page says.
STATUS = "\n[page offset={offset} returned={returned} total={total} nextOffset={following} hasMore={more}]"
HEAD = "--- [{id}] {ts} {role}{requested}\n"
MISSING = "No compacted entry with id {id}."


def _status(offset: int, returned: int, total: int, following: int, more: bool) -> str:
    return STATUS.format(offset=offset, returned=returned, total=total, following=following, more=str(more).lower())


RESERVE = len(_status(LARGEST, LARGEST, LARGEST, LARGEST, True))


def _header(row: dict, requested: bool) -> str:
    return HEAD.format(id=row["id"], ts=row["ts"], role=row["role"], requested=" (requested)" if requested else "")


#: Positions of a branch that are numbered together.
BLOCK = 4_096


def numbered(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Entries with ``n``, their number in their branch from 1.

    A branch is numbered block by block, of ``block`` positions each, and what the
    blocks before it hold is added, so that a long branch isn't one task's window.
    """
    cut = entries.withColumn("block", F.floor(F.col("pos") / block).cast("long"))
    before = Window.partitionBy("branch_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("branch_id", "block").agg(F.count("*").alias("rows"))
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    own = cut.withColumn("own", F.row_number().over(Window.partitionBy("branch_id", "block").orderBy("pos")))
    return own.join(ahead, ["branch_id", "block"]).withColumn("n", F.col("ahead") + F.col("own")).drop("block", "ahead", "own")


def neighbourhood(entries: DataFrame, targets: DataFrame, before: int = NEIGHBOURS, after: int = NEIGHBOURS) -> DataFrame:
    """Of each target (branch_id, id) its entry and those around it, with ``at`` from -before to after.

    Distances count entries, not positions: the entries of a branch are numbered,
    and of an id that stands more than once the first is meant.
    """
    rows = numbered(entries)
    asked = targets.select("branch_id", "id").distinct()
    own = rows.select("branch_id", "id", "n").join(asked, ["branch_id", "id"]).groupBy("branch_id", "id").agg(F.min("n").alias("n0"))
    near = own.select("branch_id", F.col("id").alias("asked_id"), "n0", F.explode(F.sequence(F.col("n0") - before, F.col("n0") + after)).alias("n"))
    joined = near.join(rows, ["branch_id", "n"])
    return joined.select("branch_id", F.col("asked_id").alias("target_id"), (F.col("n") - F.col("n0")).alias("at"), "pos", "id", "ts", "role", "readable")


def render(rows: dict[int, dict], offset: int = 0) -> tuple[str, dict]:
    """A page of the entry at 0: its text from an offset, and, if it is there whole, neighbours that fit, those before it first."""
    target = rows[0]
    text = target["readable"]
    offset = min(offset, len(text))
    head = _header(target, True)
    shown = text[offset : offset + max(0, PAGE - len(head) - RESERVE)]
    following = offset + len(shown)
    more = following < len(text)
    out, first, last = head + shown, 0, 0
    if not more and offset == 0:
        for at in sorted((k for k in rows if k), key=lambda k: (k > 0, abs(k))):
            section = f"\n{_header(rows[at], False)}{rows[at]['readable']}"
            if len(out) + len(section) + RESERVE > PAGE:
                break
            out += section
            first, last = min(first, at), max(last, at)
    out += _status(offset, len(shown), len(text), following, more)
    details = {"from": rows[first]["id"], "to": rows[last]["id"], "offset": offset, "total": len(text), "returned": len(shown), "nextOffset": following, "hasMore": more}
    return out, details


def expand(entries: DataFrame, entry_id: str, before: int = NEIGHBOURS, after: int = NEIGHBOURS, offset: int = 0) -> tuple[str, dict]:
    """A page of one branch's entry (pos, id, ts, role, readable)."""
    if not (0 <= before <= MOST and 0 <= after <= MOST and offset >= 0):
        raise ValueError(f"before and after must be from 0 to {MOST} and offset not negative")
    # One branch: a few rows around one place are all that is read of it.
    here = entries.where(F.col("id") == entry_id).agg(F.min("pos").alias("p")).first()["p"]
    if here is None:
        return MISSING.format(id=entry_id), {}
    some = entries.select("pos", "id", "ts", "role", "readable")
    earlier = some.where(F.col("pos") < here).orderBy(F.col("pos").desc()).limit(before).collect()
    later = some.where(F.col("pos") >= here).orderBy("pos").limit(after + 1).collect()
    rows = {-i - 1: r.asDict() for i, r in enumerate(earlier)} | {i: r.asDict() for i, r in enumerate(later)}
    return render(rows, offset)
