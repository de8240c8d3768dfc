"""Change events to re-indexing: events gather, the books they touch are looked up once a batch."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, item long, kind string, parent long"
DELAY = "5 seconds"


def affected(events: DataFrame, known: DataFrame | None = None, auto_index: bool = True) -> DataFrame:
    """(item, deleted): each item once. An attachment's event counts for its parent; an item that was deleted is
    handled as such whatever else happened to it; items not known before count only with auto_index."""
    item = F.coalesce("parent", "item").alias("item")
    deleted = F.max(((F.col("kind") == "delete") & F.col("parent").isNull()).cast("int")) == 1
    found = events.select(item, "kind", "parent").groupBy("item").agg(deleted.alias("deleted"))
    return found if auto_index or known is None else found.join(known.select("item"), "item", "left_semi")


def follow(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, delay: str = DELAY, once: bool = False, known: Callable[[], DataFrame] | None = None, auto_index: bool = True, listeners: Listeners | None = None) -> StreamingQuery:
    """Runs handle(affected items, batch number) for each micro-batch: events of one delay meet in one batch, those that
    come meanwhile wait for the next. known: gives the items (item) that are in the catalogue at the time; others count
    with auto_index only. The checkpoint makes a restart go on where it stopped."""

    def batch(events: DataFrame, number: int) -> None:
        handle(affected(events, known() if known else None, auto_index), number)
        if listeners:
            listeners.emit(number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=delay)).start()


class Listeners:
    """Who wants to know of progress. One that fails does not keep the others from hearing of it."""

    def __init__(self):
        self._all: dict[int, Callable[[int], None]] = {}
        self._next = 0

    def on_change(self, listen: Callable[[int], None]) -> Callable[[], None]:
        """Returns what takes the listener off again."""
        key, self._next = self._next, self._next + 1
        self._all[key] = listen
        return lambda: self._all.pop(key, None) and None

    def emit(self, number: int) -> None:
        for listen in list(self._all.values()):
            try:
                listen(number)
            except Exception:
                logging.getLogger(__name__).exception("a listener failed")


def passes(step: Callable[[], int]) -> int:
    """Calls step() (which returns how many documents it settled) until one pass settles none; how many passes ran."""
    n = 1
    while step():
        n += 1
    return n
