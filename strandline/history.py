"""Histories: the tools of one branch, or of many, over the same operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import automatic, branch, expand, grep, recall
from strandline.operators.index import Index, build
from strandline.plans.query import Plan, plan
from strandline.sources import pages
from strandline.sources.settings import Settings


class History:
    """The compacted histories of a table of entries.

    The index is built at the first ranked search and kept.  Methods for one branch
    take its id; ``None`` is right where there is only one.  ``recall_many`` and
    ``hints_many`` run any number of queries in one plan.
    """

    def __init__(self, entries: DataFrame, settings: Settings | None = None, segment: Callable[[str], list[str]] | None = None):
        self.entries = entries
        self.settings = settings or Settings()
        self.segment = segment
        self.messages = branch.compacted(entries)
        self._index: Index | None = None

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = build(branch.documents(self.messages)).cached()
        return self._index

    def close(self) -> None:
        if self._index is not None:
            self._index.released()
            self._index = None

    @property
    def size(self) -> int:
        """Documents in the index."""
        return self.index.documents.count()

    def _messages(self, branch_id: str | None) -> DataFrame:
        return self.messages if branch_id is None else self.messages.where(F.col("branch_id") == branch_id)

    def grep(self, pattern: str, limit: int = grep.LIMIT, offset: int = 0, branch_id: str | None = None) -> tuple[str, dict]:
        """A page of entries that match a regular expression."""
        return grep.grep(self._messages(branch_id), pattern, limit, offset)

    def expand(self, entry_id: str, before: int = 2, after: int = 2, offset: int = 0, branch_id: str | None = None) -> tuple[str, dict]:
        """A page of an entry, with neighbours."""
        return expand.expand(self._messages(branch_id), entry_id, before, after, offset)

    def recall_many(self, queries: Mapping[str, dict], limit: int = 50, offset: int = 0, budget: int | None = None) -> dict[str, tuple[list[dict], int, Plan]]:
        """Rows, total and plan of each query."""
        plans = {name: plan(query) for name, query in queries.items()}
        found = recall.representatives(self.index, recall.hits(self.index, plans)).persist()
        try:
            total = {r["query_id"]: r["total"] for r in recall.totals(found).collect()}
            page = recall.with_snippets(self.index, recall.top(found, limit, offset), plans, budget or self.settings.snippet_budget, limit)
            rows: dict[str, list[dict]] = {name: [] for name in queries}
            for r in page.orderBy("query_id", "rank").collect():
                rows[r["query_id"]].append(r.asDict())
        finally:
            found.unpersist()
        return {name: (rows[name], total.get(name, 0), plans[name]) for name in queries}

    def recall(self, query: dict, limit: int = pages.MOST, offset: int = 0) -> tuple[str, dict]:
        """A page of a concept query."""
        pages.check_page(limit, offset)
        rows, total, used = self.recall_many({"q": query}, limit, offset)["q"]
        return pages.page(rows, total, limit, offset, used.warnings)

    def hints_many(self, messages: Mapping[str, automatic.Message]) -> dict[str, list[dict]]:
        """The rows for each message that asks for any."""
        found = automatic.lookup(self.index, messages, self.segment, self.settings.auto_gate)
        rows: dict[str, list[dict]] = {name: [] for name in messages}
        if found is not None:
            for r in found.orderBy("query_id", "rank").collect():
                rows[r["query_id"]].append(r.asDict())
        return rows

    def hint(self, text: str, recent: Sequence[str] = ()) -> str | None:
        """The hint for a message."""
        return pages.hints(self.hints_many({"m": automatic.Message(text, recent)})["m"])
