"""When a session's index is due: after so many user cycles or tool batches, whichever comes first.

Events (session_id, pos, kind, event_id, ok): ``user`` a user's message, ``end`` the
end of an answer, ``batch`` a batch of tool results, ``reset`` a new or other branch.
A cycle is complete when an answer ends well after a user's message; a batch counts
if it went well and its id isn't among the last ``REMEMBERED``.  When an index is
due both counts begin anew.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CYCLES, BATCHES, REMEMBERED = 10, 10, 128
DUE = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("reason", T.StringType())])
_STATE = T.StructType(
    [
        T.StructField("pending", T.BooleanType()),
        T.StructField("cycles", T.IntegerType()),
        T.StructField("batches", T.IntegerType()),
        T.StructField("seen", T.ArrayType(T.StringType())),
    ]
)


@dataclass
class Cadence:
    """The counts of one session."""

    pending: bool = False
    cycles: int = 0
    batches: int = 0
    seen: list[str] = field(default_factory=list)
    every_cycles: int = CYCLES
    every_batches: int = BATCHES

    def event(self, kind: str, event_id: str | None, ok: bool) -> str | None:
        """Take an event; why an index is due now, if it is."""
        if kind == "reset":
            self.pending, self.cycles, self.batches, self.seen = False, 0, 0, []
        elif kind == "user":
            self.pending = True
        elif kind == "end":
            if self.pending and ok:
                self.cycles += 1
            self.pending = False
        elif kind == "batch" and ok and event_id is not None and event_id not in self.seen:
            self.seen = [*self.seen, event_id][-REMEMBERED:]
            self.batches += 1
        reason = "cycles" if self.cycles >= self.every_cycles else "batches" if self.batches >= self.every_batches else None
        if reason:
            self.cycles = self.batches = 0
        return reason


def due(events: DataFrame, cycles: int = CYCLES, batches: int = BATCHES) -> DataFrame:
    """Of a stream of events the moments (session_id, pos, reason) at which an index is due."""
    if not (1 <= cycles <= 100 and 1 <= batches <= 100):
        raise ValueError("cadences must be from 1 to 100")

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [False, 0, 0, []]
        own = Cadence(held[0], held[1], held[2], list(held[3]), cycles, batches)
        found = []
        # A session's events of one micro-batch, in their order.
        rows = pd.concat(list(frames), ignore_index=True).sort_values("pos", kind="stable")
        for row in rows.itertuples(index=False):
            event_id = None if pd.isna(row.event_id) else str(row.event_id)
            reason = own.event(row.kind, event_id, bool(row.ok) if not pd.isna(row.ok) else False)
            if reason:
                found.append((key[0], int(row.pos), reason))
        state.update((own.pending, own.cycles, own.batches, own.seen))
        yield pd.DataFrame(found, columns=DUE.names)

    rows = events.select("session_id", F.col("pos").cast("long").alias("pos"), "kind", "event_id", "ok")
    return rows.groupBy("session_id").applyInPandasWithState(run, DUE, _STATE, "append", GroupStateTimeout.NoTimeout)


def due_counts(events: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The batch form for tool batches alone: how often an index is due in each session, and batches since.

    Batches with an id seen before in the session count once.
    """
    counted = events.where("kind = 'batch' AND ok").groupBy("session_id").agg(F.count_distinct("event_id").alias("n"))
    return counted.select("session_id", F.floor(F.col("n") / batches).cast("long").alias("due"), (F.col("n") % batches).cast("long").alias("since"))


def completed_cycles(events: DataFrame) -> DataFrame:
    """User cycles of each session that ended well, over a table of events."""
    order = Window.partitionBy("session_id").orderBy("pos")
    said = events.where("kind IN ('user', 'end')")
    before = said.withColumn("before", F.lag("kind").over(order))
    return before.groupBy("session_id").agg(F.count_if((F.col("kind") == "end") & F.col("ok") & (F.col("before") == "user")).alias("cycles"))
