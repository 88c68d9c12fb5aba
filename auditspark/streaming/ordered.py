"""Keyed streams in true order: rows wait in the state store until the watermark has passed them, then go by in order of time
and number, however they arrived and however many batches or Arrow chunks they came in.

What each operator does with a row, or when time passes without one, is a small function of its state; ``InOrder`` holds the
waiting rows and the states of a shard of the keys, and calls it. Waiting rows are those of the watermark's delay, not the
history.
Rows that arrive later than the watermark allows are dropped by Spark, as the delay says; with a delay that covers the
disorder nothing is. The first watermark is the epoch, so times have to lie after it.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import TERMINAL

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RANK = {"pending": 0, "init": 0, "analyzing": 1, "static_analysis": 1, "auditing": 2} | dict.fromkeys(TERMINAL, 3)
NAMES = ("pending", "analyzing", "auditing")
#: Rows of a frame that goes out.
FRAME = 10_000
#: Keys are dealt over so many shards, and the keys of a shard over so many cells of state.
SHARDS, CELLS = 1024, 8

#: A key's state, its rows (microseconds, number, values ...) in order, and the time up to which it is known, to output rows.
Advance = Callable[[dict, list[tuple], int], Iterable[tuple]]


def with_ordered_state(spark: SparkSession) -> None:
    """Timers and lists in state need this store; queries that start from now on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == FRAME:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark, or processing time, has passed them; ``wake`` tells when a state wants to act
    without a row (microseconds).

    One instance serves a shard of the keys: a call of the state store or of Python costs as much as hundreds of rows, so
    keys are not served one by one. Waiting rows are Arrow chunks; the states of a shard's keys are dealt over cells, and a
    trigger reads and writes only the cells that its rows, or what is due, are in.
    """

    def __init__(self, key: str, values: list[str], schema: pa.Schema, output: list[str], advance: Advance, wake: Callable[[dict], int | None] | None = None, live: bool = False):
        self.key, self.values, self.schema, self.output, self.advance, self.wake, self.live = key, values, schema, output, advance, wake, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk binary")
        self.states = handle.getMapState("states", "cell int", "states binary")
        # The least time of a waiting row, and of each cell the least time at which a state wants to act.
        self.next = handle.getValueState("next", "least long, wakes binary")

    def _next(self) -> tuple[int | None, dict[int, int]]:
        held = self.next.get() if self.next.exists() else None
        return (held[0], pickle.loads(held[1])) if held else (None, {})

    def _go(self, due: pa.Table, until: int, least: int | None, wakes: dict[int, int]) -> Iterator[tuple]:
        """due: rows in order."""
        cells: dict[int, dict] = {}
        for cell, key, *row in zip(*(due.column(c).to_pylist() for c in ["cell", self.key, *self.values])):
            cells.setdefault(cell, {}).setdefault(key, []).append(tuple(row))
        for cell, at in wakes.items():
            if at <= until:
                cells.setdefault(cell, {})
        for cell, rows in cells.items():
            held = self.states.getValue((cell,))
            states = pickle.loads(held[0]) if held else {}
            if self.wake:
                for key, state in states.items():
                    if key not in rows and (at := self.wake(state)) is not None and at <= until:
                        rows[key] = []
            for key, some in rows.items():
                state = states.get(key, {})
                for row in self.advance(state, some, until):
                    yield (key, *row)
                if state:
                    states[key] = state
            self.states.updateValue((cell,), (pickle.dumps(states),))
            if self.wake:
                ats = [at for state in states.values() if (at := self.wake(state)) is not None]
                wakes.pop(cell, None)
                wakes |= {cell: min(ats)} if ats else {}
        self.next.update((least, pickle.dumps(wakes)))
        if wakes:
            self.handle.registerTimer(max(min(wakes.values()) // 1000 + 1, until // 1000 + 1))

    def _in_order(self, rows: pa.Table) -> pa.Table:
        return rows.sort_by([(c, "ascending") for c in self.values[:2]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least, wakes = self._next()
        arrived = [pa.Table.from_pandas(part[self.schema.names], self.schema, preserve_index=False) for part in rows]
        if self.live:
            # Rows count as of now, in order of their times and numbers.
            now = timerValues.getCurrentProcessingTimeInMs() * 1000
            due = self._in_order(pa.concat_tables(arrived))
            at = due.schema.get_field_index(self.values[0])
            due = due.set_column(at, self.schema.field(at), pa.array(np.full(due.num_rows, now), pa.int64()))
            yield from _frames(self._go(due, now, least, wakes), self.output)
            return
        self.waiting.appendList([(_packed(part),) for part in arrived])
        first = min(pc.min(part.column(self.values[0])).as_py() for part in arrived)
        # The shard wakes for its first waiting row, and then for the first of those that are left.
        if least is None or first < least:
            self.next.update((first, pickle.dumps(wakes)))
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        least, wakes = self._next()
        until = (timerValues.getCurrentProcessingTimeInMs() if self.live else timerValues.getCurrentWatermarkInMs()) * 1000
        due = self.schema.empty_table()
        if least is not None and least <= until:
            held = pa.concat_tables(_unpacked(c[0]) for c in self.waiting.get())
            now = pc.less_equal(held.column(self.values[0]), until)
            due, rest = self._in_order(held.filter(now)), held.filter(pc.invert(now))
            least = pc.min(rest.column(self.values[0])).as_py()
            if rest.num_rows:
                self.waiting.put([(_packed(pa.Table.from_batches([b])),) for b in rest.combine_chunks().to_batches(FRAME)])
                self.handle.registerTimer(least // 1000 + 1)
            else:
                self.waiting.clear()
        elif all(at > until for at in wakes.values()):
            return
        yield from _frames(self._go(due, until, least, wakes), self.output)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(chunk: bytes) -> pa.Table:
    return pa.ipc.open_stream(chunk).read_all()


def _ordered(rows: DataFrame, key: str, at: str, number: str, values: dict[str, str], output: dict[str, str], advance: Advance, wake: Callable[[dict], int | None] | None = None, delay: str = "0 seconds", live: bool = False) -> DataFrame:
    """The stream of what ``advance`` makes of each key's rows. values, output: names and types."""
    with_ordered_state(rows.sparkSession)
    names = ["micros", number, *values]
    hashed = F.xxhash64(key)
    made = rows.select(F.pmod(hashed, F.lit(SHARDS)).cast("int").alias("shard"), F.pmod(F.shiftright(hashed, 32), F.lit(CELLS)).cast("int").alias("cell"), key, F.col(at), F.unix_micros(F.col(at)).alias("micros"), F.col(number).cast("long").alias(number), *(F.col(v).cast(t).alias(v) for v, t in values.items()))
    schema = to_arrow_schema(made.select("cell", key, *names).schema)
    made = made if live else made.withWatermark(at, delay)
    out = {key: made.schema[key].dataType.simpleString(), **output}
    processor = InOrder(key, names, schema, list(out), advance, wake, live)
    return made.groupBy("shard").transformWithStateInPandas(processor, ", ".join(f"`{n}` {t}" for n, t in out.items()), "append", "processingtime" if live else "eventtime")


def _suppress(state: dict, rows: list[tuple], until: int) -> Iterator[tuple]:
    for _, seq, rejected in rows:
        suppressed = state.get("rejected", False)
        # A pattern that is not rejected needs no state.
        if rejected:
            state["rejected"] = True
        yield seq, rejected, suppressed


def stream_suppression(results: DataFrame, at: str = "at", delay: str = "0 seconds") -> DataFrame:
    """``results(pattern, at, seq, rejected)`` with suppressed, in order of time and seq: once a pattern is rejected, what
    follows is suppressed."""
    return _ordered(results, "pattern", at, "seq", {"rejected": "boolean"}, {"seq": "long", "rejected": "boolean", "suppressed": "boolean"}, _suppress, delay=delay)


def _phases(state: dict, rows: list[tuple], until: int) -> Iterator[tuple]:
    for _, seq, phase, message in rows:
        rank = RANK.get(phase, 0)
        if rank == 3 and state.get("rank", 0) < 3:
            state["end"] = phase
        state["done"] = state.get("done", False) or rank >= 2
        state["rank"] = max(state.get("rank", 0), rank)
        state["n"] = state.get("n", 0) + 1
        state["message"] = message
        status = state["end"] if state["rank"] == 3 else NAMES[state["rank"]]
        yield seq, status, state["done"], state["n"], message


def stream_states(events: DataFrame, at: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """State of a scan after each of its events, in order: forward only; late progress never reopens a scan that ended. The
    state of a scan is its row of the greatest n_events."""
    output = {"seq": "long", "status": "string", "static_done": "boolean", "n_events": "long", "last_message": "string"}
    return _ordered(events, "scan_id", at, "seq", {"phase": "string", "message": "string"}, output, _phases, delay=delay)


def reports(debounce: int, heartbeat: int) -> tuple[Advance, Callable[[dict], int | None]]:
    """Snapshots to send: the first at once; after a change, ``debounce`` microseconds later, what is then the last one, if it
    differs from the one sent before; and the last one again, ``heartbeat`` after the one sent before.

    While a change waits, a heartbeat waits too. An update that brings nothing new starts a wait and sends nothing.
    """

    def due(state: dict) -> int | None:
        if "sent_at" not in state:
            return None
        return state["wait"] if state.get("wait") is not None else state["sent_at"] + heartbeat

    def fire(state: dict, until: int) -> Iterator[tuple]:
        while (at := due(state)) is not None and at <= until:
            waited, state["wait"] = state.get("wait") is not None, None
            if not waited or state["last"] != state["sent"]:
                kind = "change" if waited else "heartbeat"
                state["sent"], state["sent_at"] = state["last"], at
                yield at, state["seq"], state["last"], kind
            elif state["sent_at"] + heartbeat <= at:
                # The heartbeat that had to wait.
                state["sent_at"] = at
                yield at, state["seq"], state["last"], "heartbeat"

    def advance(state: dict, rows: list[tuple], until: int) -> Iterator[tuple]:
        for at, seq, signature in rows:
            # What is due at the same moment sees the row.
            yield from fire(state, at - 1)
            state["last"], state["seq"] = signature, seq
            if "sent_at" not in state:
                state["sent"], state["sent_at"], state["wait"] = signature, at, None
                yield at, seq, signature, "first"
            elif state.get("wait") is None:
                state["wait"] = at + debounce
        yield from fire(state, until)

    return advance, due


def stream_reports(snapshots: DataFrame, at: str = "at", debounce_seconds: float = 2.0, heartbeat_seconds: float = 60.0, delay: str = "0 seconds", live: bool = False) -> DataFrame:
    """``snapshots(session, at, seq, signature)`` to the reports to send: session, sent_at, seq, signature, kind. By the
    times of the snapshots, or, ``live``, by the clock."""
    advance, due = reports(int(debounce_seconds * 1e6), int(heartbeat_seconds * 1e6))
    found = _ordered(snapshots, "session", at, "seq", {"signature": "string"}, {"sent": "long", "seq": "long", "signature": "string", "kind": "string"}, advance, due, delay, live)
    return found.select("session", F.timestamp_micros("sent").alias("sent_at"), "seq", "signature", "kind")


def offline(timeout: int, running: tuple[str, ...], ended: str) -> tuple[Advance, Callable[[dict], int | None]]:
    """States of an agent's scans; ``timeout`` microseconds after its last sign of life those still running end."""

    def due(state: dict) -> int | None:
        return state["seen"] + timeout if state.get("running") else None

    def fire(state: dict, until: int) -> Iterator[tuple]:
        if (at := due(state)) is not None and at <= until:
            gone, state["running"] = state["running"], []
            for scan in gone:
                yield at, scan, ended

    def advance(state: dict, rows: list[tuple], until: int) -> Iterator[tuple]:
        for at, _, scan, status in rows:
            yield from fire(state, at)
            state["seen"] = at
            if scan is not None:
                held = [s for s in state.get("running", []) if s != scan]
                state["running"] = [*held, scan] if status in running else held
                yield at, scan, status
        yield from fire(state, until)

    return advance, due


def stream_offline(signs: DataFrame, at: str = "at", timeout_seconds: float = 90.0, running: tuple[str, ...] = ("analyzing", "auditing"), ended: str = "cancelled", delay: str = "0 seconds", live: bool = False) -> DataFrame:
    """``signs(agent, at, seq, scan_id, status)`` of life, with a null scan_id for a heartbeat, to the states that scans go
    through: agent, at, scan_id, status. An agent that is silent for the timeout is offline, and what it ran has ended."""
    advance, due = offline(int(timeout_seconds * 1e6), running, ended)
    found = _ordered(signs, "agent", at, "seq", {"scan_id": "string", "status": "string"}, {"at_micros": "long", "scan_id": "string", "status": "string"}, advance, due, delay, live)
    return found.select("agent", F.timestamp_micros("at_micros").alias("at"), "scan_id", "status")


def keepalives(interval: int) -> tuple[Advance, Callable[[dict], int | None]]:
    """Events as they are, and a keepalive after each ``interval`` microseconds without anything."""

    def due(state: dict) -> int | None:
        return state["sent_at"] + interval if "sent_at" in state else None

    def fire(state: dict, until: int) -> Iterator[tuple]:
        while (at := due(state)) is not None and at <= until:
            state["sent_at"] = at
            yield at, None, None, "keepalive"

    def advance(state: dict, rows: list[tuple], until: int) -> Iterator[tuple]:
        for at, seq, payload in rows:
            # What is due at the same moment gives way to the event.
            yield from fire(state, at - 1)
            state["sent_at"] = at
            yield at, seq, payload, "event"
        yield from fire(state, until)

    return advance, due


def stream_with_keepalives(events: DataFrame, at: str = "at", seconds: float = 30.0, delay: str = "0 seconds", live: bool = False) -> DataFrame:
    """``events(consumer, at, seq, payload)`` with a keepalive to each consumer that gets nothing for so long: consumer,
    sent_at, seq, payload, kind. No event is dropped, however slow a consumer is: what it has not read waits in its files."""
    advance, due = keepalives(int(seconds * 1e6))
    found = _ordered(events, "consumer", at, "seq", {"payload": "string"}, {"sent": "long", "seq": "long", "payload": "string", "kind": "string"}, advance, due, delay, live)
    return found.select("consumer", F.timestamp_micros("sent").alias("sent_at"), "seq", "payload", "kind")


class LastRows(StatefulProcessor):
    """The last ``n`` rows of a key by time and number: a bounded ring in the state store."""

    def __init__(self, names: list[str], schema: str, output: list[str], n: int):
        self.names, self.schema, self.output, self.n = names, schema, output, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = [tuple(r) for r in self.ring.get()]
        for part in rows:
            ring = heapq.nlargest(self.n, ring + list(zip(*(part[c].tolist() for c in self.names))), key=lambda r: r[:2])
        self.ring.put(ring)
        yield from _frames((key + (place, *row[1:]) for place, row in enumerate(ring, 1)), self.output)


def stream_last_events(events: DataFrame, key: str = "scan_id", at: str = "ts", number: str = "seq", values: tuple[str, ...] = ("phase", "message"), n: int = 500) -> DataFrame:
    """At each trigger, for each key with new events, its last ``n`` events by time and number: key, place (1 the newest),
    number, values. Events may arrive in any order; none that belongs to the last ones is lost."""
    with_ordered_state(events.sparkSession)
    made = events.select(key, F.unix_micros(F.col(at)).alias("micros"), F.col(number).cast("long").alias(number), *values)
    types = {f.name: f.dataType.simpleString() for f in made.schema.fields}
    names = ["micros", number, *values]
    output = {key: types[key], "place": "int", number: "long", **{v: types[v] for v in values}}
    return made.groupBy(key).transformWithStateInPandas(LastRows(names, ", ".join(f"`{c}` {types[c]}" for c in names), list(output), n), ", ".join(f"`{c}` {t}" for c, t in output.items()), "update", "none")
