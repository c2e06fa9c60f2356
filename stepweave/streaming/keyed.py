"""Keyed state of the streams: what each key remembers between batches, as state variables in the RocksDB store."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Resets(StatefulProcessor):
    """Pages that wait, an entry for each PAGES of them, and of each set the last page that is done and when it is due.

    A row touches the entry of its page's block alone. One timer a set is due when the watermark has passed the last row of the page
    that ends first; when it fires, all pages that the watermark has passed go in page order and leave their entries, so the state
    holds what is still open. Calls to the store, not rows, are what a set costs: they grow with its blocks.
    """

    PAGES = 128

    def __init__(self, least: int, limit: int) -> None:
        self.least, self.limit = least, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block int", "page array<int>, low array<int>, high array<int>, last array<bigint>")
        self.done = handle.getValueState("done", "page int, previous int, due long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh: dict[int, dict[int, tuple]] = {}
        for r in rows:
            if r["page"] is not None and r["value"] is not None and r["value"] > 0:
                block, at = fresh.setdefault(r["page"] // self.PAGES, {}), r["at"] or 0
                low, high, last = block.get(r["page"], (r["value"], r["value"], at))
                block[r["page"]] = min(low, r["value"]), max(high, r["value"]), max(last, at)
        for number, pages in fresh.items():
            for page, low, high, last in zip(*(self.waiting.getValue((number,)) or ())):
                if page in pages:
                    a, b, c = pages[page]
                    pages[page] = min(a, low), max(b, high), max(c, last)
                else:
                    pages[page] = low, high, last
            self._keep(number, pages)
        if fresh:
            page, previous, due = self.done.get() or (None, None, None)
            self._wake(page, previous, due, fresh.values())
        return iter(())

    def _keep(self, number: int, pages: dict[int, tuple]) -> None:
        self.waiting.updateValue((number,), ([*pages], *([*column] for column in zip(*pages.values()))))

    def _wake(self, page: int | None, previous: int | None, due: int | None, blocks: Iterable[dict[int, tuple]]) -> None:
        """A timer for the first end among ``blocks``, if none is due before."""
        first = min(last for pages in blocks for _, _, last in pages.values()) + 1
        if due is None or first < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            self.done.update((page, previous, first))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        open_, ready = {}, []
        for (number,), entry in self.waiting.iterator():
            pages = {page: rest for page, *rest in zip(*entry)}
            gone = [page for page, rest in pages.items() if rest[2] < passed]
            ready += [(page, *pages.pop(page)) for page in gone]
            open_[number] = pages, bool(gone)
        page, previous, _ = self.done.get() or (None, None, None)
        for number, low, high, _ in sorted(ready):
            late = page is not None and number <= page
            start = not late and high <= self.limit and low == 1 and previous is not None and previous >= self.least and previous - 1 >= self.least
            yield Row(set_id=key[0], page=number, low=low, high=high, previous=previous, bag_start=start, late=late)
            if not late:
                page, previous = number, high if high <= self.limit else previous
        for number, (pages, changed) in open_.items():
            if not pages:
                self.waiting.removeKey((number,))
            elif changed:
                self._keep(number, pages)
        left = [pages for pages, _ in open_.values() if pages]
        if left:
            self._wake(page, previous, None, left)
        else:
            self.done.update((page, previous, None))

    def close(self) -> None:
        pass


class Scan(StatefulProcessor):
    """The number that is due and the cursor of each scan, forgotten after a time without chunks if one is given."""

    def __init__(self, first: int, forget_after: int | None) -> None:
        self.first, self.forget_after = first, forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "expected int, cursor int", self.forget_after)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        expected, cursor = self.at.get() if self.at.exists() else (self.first, 0)
        out, last = [], cursor - 1
        for r in pd.concat(list(rows)).sort_values(["page", "bag"]).itertuples():
            last = max(last, r.page)
            if r.page < cursor:
                out.append((key[0], r.page, r.bag, expected, False, "behind the cursor"))
                continue
            good = r.bag == expected
            out.append((key[0], r.page, r.bag, expected, good, "" if good else "already passed" if r.bag < expected else "not the next number"))
            expected += good
        self.at.update((int(expected), int(last + 1)))
        yield pd.DataFrame(out, columns=["set_id", "page", "bag", "expected", "accepted", "reason"])

    def close(self) -> None:
        pass


class Truth(StatefulProcessor):
    """The first page of each bag of a block of them, as a list to which new bags are added: a call to read and one to add."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "bag int, page int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held, fresh = dict(self.held.get()), []
        for r in sorted(rows, key=lambda r: (r["ordinal"] is None, r["ordinal"])):
            bag, page, first = r["bag"], r["page"], None
            if bag not in held:
                held[bag], status = page, "inserted"
                fresh.append((bag, page))
            else:
                status = "exists" if held[bag] == page else "conflict"
                first = held[bag] if status == "conflict" else None
            yield Row(set_id=r["set_id"], bag=bag, page=page, ordinal=r["ordinal"], status=status, existing_page=first)
        if fresh:
            self.held.appendList(fresh)

    def close(self) -> None:
        pass
