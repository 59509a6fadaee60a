"""Sessions as keyed state of a stream: summaries at the end of turns, and writes checked against issued numbers.

Events of a session are worked through in the order of their time, whatever micro-batch
they come in: an event waits in the session's state until the watermark has passed it, and
a timer wakes the session. So the rows do not depend on how a stream is cut into batches,
and equal those of the batch functions named with each job. An event older than the
watermark is late and is left out by the engine; the batch function over the ledger
is the source of truth for it. State is checkpointed by the engine, and a session's
state goes when it ends or has been quiet for long enough.

The state of one session is read and written by keys (a row a waiting event, a type or a
block of numbers), never as one value that grows with the session. The jobs need the
RocksDB state store: ``use_state_store`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textwarden.operators.records import RECORD, SESSION_END, TURN_END

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "1 hour"
#: Numbers of a block of issued numbers.
NUMBERS = 1024


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Hands the events of a key on in the order of ``(ts, seq)``, once the watermark has passed them.

    Moments are microseconds. A repeated event (same ``ts``, ``seq`` and columns ``SAME``) counts once;
    different ones of one ``ts`` and ``seq`` come in the order of those columns, nulls first.
    """

    #: Columns of a waiting event besides its moment and sequence number, and of those the first few that tell events apart.
    WAITING, SAME = "", 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ["at bigint", "seq bigint", *self.WAITING.split(", ")[: self.SAME]]
        self.waiting = handle.getMapState("waiting", ", ".join(columns), self.WAITING)
        self.timer = handle.getValueState("timer", "wake bigint")

    def start(self) -> None:
        """Nothing is known of the session."""

    def packed(self, row: Row) -> tuple:
        """The waiting form of an event."""
        raise NotImplementedError

    def event(self, key: tuple, at: int, seq: int, value: tuple) -> Iterator[Row]:
        raise NotImplementedError

    def quiet_from(self) -> int | None:
        """When the session counts as over unless something comes; None if it is not open."""
        raise NotImplementedError

    def quiet(self, key: tuple) -> Iterator[Row]:
        """The session is over."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        earliest = None
        for row in rows:
            at = row.micros
            if at is None:
                continue
            value = self.packed(row)
            self.waiting.updateValue((at, row.seq or 0, *value[: self.SAME]), value)
            earliest = at if earliest is None else min(earliest, at)
        if earliest is not None:
            self._wake(earliest)
        return iter(())

    def _wake(self, at: int) -> None:
        """A timer at the first millisecond that is not before ``at``, unless an earlier one is set."""
        wanted = -(-at // 1000)
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is None or wanted < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        ready, later = [], None
        for moment, value in self.waiting.iterator():
            if moment[0] <= watermark:
                ready.append((tuple(moment), tuple(value)))
            else:
                later = moment[0] if later is None else min(later, moment[0])
        for moment, value in sorted(ready, key=lambda e: [(x is not None, x) for x in e[0]]):
            at, seq = moment[:2]
            over = self.quiet_from()
            if over is not None and at > over:
                yield from self.quiet(key)
            yield from self.event(key, at, seq, value)
            self.waiting.removeKey(moment)
        over = self.quiet_from()
        if over is not None and over <= watermark and (later is None or later > over):
            yield from self.quiet(key)
            over = None
        wake = min((x for x in (later, over) if x is not None), default=None)
        if wake is not None:
            self._wake(wake)


def _per_session(events: DataFrame, processor: InOrder, schema: str, late: str) -> DataFrame:
    watched = events.where("session_id is not null").withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    rows = watched.groupBy("session_id").transformWithState(processor, schema, "Append", "EventTime")
    return rows.withColumn("at", F.timestamp_micros("at"))


class Summaries(InOrder):
    """State of ``stream_summaries``: counts of the session so far, and how many records its last summary had."""

    WAITING = "kind string, done string, types array<string>, counts array<bigint>"

    def __init__(self, idle_micros: int):
        self.idle = idle_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.life = handle.getValueState("life", "records bigint, shown bigint, last bigint")
        self.totals = handle.getMapState("totals", "done string, entity string", "n bigint")

    def packed(self, row: Row) -> tuple:
        kind = row.kind if row.kind in (TURN_END, SESSION_END) else RECORD
        return kind, row.done, list(row.types), list(row.counts)

    def quiet_from(self) -> int | None:
        return self.life.get()[2] + self.idle if self.life.exists() else None

    def _forget(self) -> None:
        self.life.clear()
        self.totals.clear()

    def _summary(self, key: tuple, at: int, reason: str) -> Iterator[Row]:
        records, shown, last = self.life.get()
        if records > shown:
            totals = sorted(((k[0], k[1], v[0]) for k, v in self.totals.iterator()), key=lambda t: (t[0] is not None, t[0] or "", t[1]))
            self.life.update((records, records, last))
            yield Row(session_id=key[0], at=at, reason=reason, n_records=records, n_new=records - shown, totals=totals)

    def event(self, key: tuple, at: int, seq: int, value: tuple) -> Iterator[Row]:
        kind, done, types, counts = value
        if kind == SESSION_END:
            self._forget()
            return
        records, shown, _ = self.life.get() if self.life.exists() else (0, 0, 0)
        self.life.update((records + (kind == RECORD), shown, at))
        if kind == TURN_END:
            yield from self._summary(key, at, "turn")
            return
        for entity, n in zip(types, counts, strict=True):
            place = (done, entity)
            held = self.totals.getValue(place)[0] if self.totals.containsKey(place) else 0
            self.totals.updateValue(place, (held + n,))

    def quiet(self, key: tuple) -> Iterator[Row]:
        yield from self._summary(key, self.quiet_from(), "idle")
        self._forget()


SUMMARY = "session_id string, at bigint, reason string, n_records bigint, n_new bigint, totals array<struct<done:string,entity:string,n:bigint>>"


def stream_summaries(events: DataFrame, idle_minutes: int = 30, late: str = LATE) -> DataFrame:
    """A summary of a session at each end of a turn, and when it has been quiet, if records came since the last one.

    ``events``: ``session_id, ts`` (timestamp), ``seq, kind`` (turn_end,
    session_end, else a record), ``done`` (what was done with the record) and
    ``entities`` (map of type to count). A session's end forgets it. Rows and columns as
    ``records.session_summaries`` gives them.
    """
    processor = Summaries(idle_minutes * 60 * 1_000_000)
    held = F.map_filter(F.coalesce("entities", F.create_map().cast("map<string,int>")), lambda _, n: n.isNotNull())
    known = events.withColumns({"types": F.map_keys(held), "counts": F.transform(F.map_values(held), lambda n: n.cast("long"))})
    return _per_session(known.drop("entities"), processor, SUMMARY, late)


class Issued(InOrder):
    """State of ``stream_refusals``: blocks of numbers, each with its runs merged, and whether a run could not be read."""

    WAITING, SAME = "kind string, entity string, first bigint, last bigint", 4

    def __init__(self, idle_micros: int):
        self.idle = idle_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.runs = handle.getMapState("runs", "entity string, block bigint", "runs array<bigint>")
        self.life = handle.getValueState("life", "last bigint, unreadable boolean")

    def packed(self, row: Row) -> tuple:
        return row.kind, row.entity, row.first, row.last

    def quiet_from(self) -> int | None:
        return self.life.get()[0] + self.idle if self.life.exists() else None

    def quiet(self, key: tuple) -> Iterator[Row]:
        self.runs.clear()
        self.life.clear()
        yield from ()

    def _runs(self, entity: str, block: int) -> list[int]:
        """Borders of the runs of a block, in order: first, last, first, last."""
        place = (entity, block)
        return list(self.runs.getValue(place)[0]) if self.runs.containsKey(place) else []

    def _issue(self, entity: str, first: int, last: int) -> None:
        for block in range(first // NUMBERS, last // NUMBERS + 1):
            low, high = max(first, block * NUMBERS), min(last, block * NUMBERS + NUMBERS - 1)
            held = self._runs(entity, block)
            merged = merge_run(held, low, high)
            if merged != held:
                self.runs.updateValue((entity, block), (merged,))

    def event(self, key: tuple, at: int, seq: int, value: tuple) -> Iterator[Row]:
        kind, entity, first, last = value
        if kind == SESSION_END:
            yield from self.quiet(key)
            return
        unreadable = self.life.get()[1] if self.life.exists() else False
        if kind == "issue":
            readable = entity is not None and first is not None and last is not None and first <= last
            if readable:
                self._issue(entity, first, last)
            unreadable = unreadable or not readable
        self.life.update((at, unreadable))
        if kind == "write":
            known = entity is not None and first is not None
            held = self._runs(entity, first // NUMBERS) if known else []
            verdict = "unchecked" if unreadable else "refused" if any(a <= first <= b for a, b in zip(held[::2], held[1::2], strict=True)) else "free"
            yield Row(session_id=key[0], seq=seq, at=at, entity=entity, number=first, verdict=verdict)


def merge_run(borders: list[int], low: int, high: int) -> list[int]:
    """Disjoint runs in order with ``low`` to ``high`` among them; runs that touch become one."""
    before, after = [], []
    for a, b in zip(borders[::2], borders[1::2], strict=True):
        if b < low - 1:
            before += [a, b]
        elif a > high + 1:
            after += [a, b]
        else:
            low, high = min(low, a), max(high, b)
    return [*before, low, high, *after]


REFUSAL = "session_id string, seq bigint, at bigint, entity string, number bigint, verdict string"


def stream_refusals(events: DataFrame, idle_minutes: int = 24 * 60, late: str = LATE) -> DataFrame:
    """The verdict on each placeholder that a session writes: refused if it was issued in the session before, else free.

    ``events``: ``session_id, ts, seq, kind`` (issue, write, session_end),
    ``entity, first, last``; a write has its number in ``first``. After a run that can't be
    read (a null, or an end before its start) the session's writes are unchecked,
    which a caller refuses too. Different events of one ``ts`` and ``seq`` all count. Rows as
    ``policy.refusals`` gives them.
    """
    processor = Issued(idle_minutes * 60 * 1_000_000)
    return _per_session(events, processor, REFUSAL, late)
