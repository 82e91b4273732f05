"""Keyed event rules as stateful streaming operators.

Each takes a streaming DataFrame and returns one; results over all batches equal those of ``symtab.operators.events``. Needs the
RocksDB state store (``configure``). Events of a key that come in one batch are put in order; time-driven rules use
event-time timers, so the stream needs a watermark on ``ts``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from symtab.operators.events import ORDER, _joined, _units, fold_document


def configure(spark: SparkSession) -> None:
    """Sets the state store that these operators need, and that sessions are merged before they are shuffled."""
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)


class FoldEdits(StatefulProcessor):
    """State: the document's content, while it is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.content = handle.getValueState("content", "content string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = _units(self.content.get()[0]) if self.content.exists() else None
        after = fold_document(before, _rows(rows, ORDER))
        if after is None:
            self.content.clear()
            yield pd.DataFrame({"uri": [key[0]], "content": [None], "open": [False]})
        else:
            self.content.update((_joined(after),))
            yield pd.DataFrame({"uri": [key[0]], "content": [_joined(after)], "open": [True]})

    def close(self) -> None:
        pass


def stream_documents(events: DataFrame) -> DataFrame:
    """(uri, content, open) after each batch that touches a document; ``events`` as for ``document_lifecycle``, with ``ordinal``."""
    return events.groupBy("uri").transformWithStateInPandas(FoldEdits(), "uri string, content string, open boolean", "Update", "None")


class Accumulate(StatefulProcessor):
    """State: the set of items."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getValueState("items", "items array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items = set(self.items.get()[0]) if self.items.exists() else set()
        out = []
        for e in _rows(rows, ["ts", "event_id"]).itertuples(index=False):
            found = {e.item} if isinstance(e.item, str) else {i for i in (e.item if e.item is not None else ()) if isinstance(i, str)}
            items = found if e.reset else items | found
            out.append((key[0], e.event_id, sorted(items)))
        self.items.update((sorted(items),))
        yield pd.DataFrame(out, columns=["uri", "event_id", "items"])

    def close(self) -> None:
        pass


def stream_accumulate(events: DataFrame) -> DataFrame:
    """(uri, event_id, items): the set after each event (uri, ts, event_id, item, reset), ``item`` being one item or an array; nulls add nothing."""
    return events.groupBy("uri").transformWithStateInPandas(Accumulate(), "uri string, event_id long, items array<string>", "Append", "None")


_MS = pd.Timedelta(milliseconds=1)
_EPOCH = pd.Timestamp(0)


def _ms(t: pd.Timestamp) -> int:
    return -(-(t - _EPOCH) // _MS)


def stream_debounce(events: DataFrame, delay_seconds: float, keyed: bool = True) -> DataFrame:
    """(uri, event_id) of the events that no later one follows within the delay: of the same uri or, if not ``keyed``, of any.

    Such an event is the last of a session: a session window whose gap is the delay and a microsecond, since an event exactly the
    delay later still supersedes. Partitions merge their own sessions first (``configure``), so that a scope, be it all events, is dealt out
    as a row a session and partition, and no event is kept in Python.
    """
    scope = F.col("uri") if keyed else F.coalesce(F.substring("uri", 1, 0), F.lit(""))  # the same for all, but no constant, which Spark refuses
    gap = f"{round(delay_seconds * 1_000_000) + 1} microseconds"
    sessions = events.groupBy(F.session_window("ts", gap), scope.alias("scope")).agg(F.max(F.struct("ts", "event_id", "uri")).alias("last"))
    return sessions.select("last.uri", "last.event_id")


class Conflate(StatefulProcessor):
    """State: when the running task ends, and the newest arrival that waits for it."""

    def __init__(self, service: pd.Timedelta):
        self.service = service

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "until long, pending long")

    def _load(self):
        us, pending = self.state.get() if self.state.exists() else (None, None)
        return (None if us is None else _EPOCH + pd.Timedelta(microseconds=us)), pending

    def _store(self, until, pending) -> None:
        self.state.update(((until - _EPOCH) // pd.Timedelta(microseconds=1), pending))
        if pending is not None:
            self.handle.registerTimer(_ms(until))

    def _out(self, key, runs) -> Iterator[pd.DataFrame]:
        if runs:
            yield pd.DataFrame({"uri": [key[0]] * len(runs), "event_id": [e for e, _ in runs], "start": pd.to_datetime([t for _, t in runs])})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, pending = self._load()
        if pending is not None:
            self.handle.deleteTimer(_ms(until))
        runs = []
        for e in _rows(rows, ["ts", "event_id"]).itertuples(index=False):
            t = pd.Timestamp(e.ts)
            if until is not None and t > until and pending is not None:
                runs.append((pending, until))
                until, pending = until + self.service, None
            if until is None or t > until:
                runs.append((int(e.event_id), t))
                until = t + self.service
            else:
                pending = int(e.event_id)
        self._store(until, pending)
        yield from self._out(key, runs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, pending = self._load()
        runs = []
        if pending is not None:
            runs.append((pending, until))
            self._store(until + self.service, None)
        yield from self._out(key, runs)

    def close(self) -> None:
        pass


def stream_conflate(events: DataFrame, service_seconds: float) -> DataFrame:
    """(uri, event_id, start) of the tasks that run."""
    return events.groupBy("uri").transformWithStateInPandas(Conflate(pd.Timedelta(seconds=service_seconds)), "uri string, event_id long, start timestamp", "Append", "EventTime")
