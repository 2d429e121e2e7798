"""Jobs as state: leases that are claimed, kept, lost and lapse; loads that resume and report progress.

A machine says what an event does to the state of its key, and what happens when its time comes. It runs
over a table, key by key in order of time, or on a stream with arbitrary state: there events wait in
state until the watermark has passed them, so that late ones come in order, and timers call what is due.
Both give the same rows, however the stream is cut into batches and wherever it is restarted.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

MINUTE = 60_000_000
EVENT = "at long, id long, what string, who string, body string"


class Event(NamedTuple):
    """``at`` in microseconds; ``who`` acts, or is acted on."""

    at: int
    id: int
    what: str | None
    who: str | None
    body: str | None


class Memory(ABC):
    """What a machine remembers by name beside its state: a key may have very many names."""

    @abstractmethod
    def get(self, name: str) -> str | None: ...

    @abstractmethod
    def put(self, name: str, value: str) -> None: ...


class Machine(ABC):
    #: Columns of its rows, after the key.
    rows: str

    @abstractmethod
    def start(self) -> dict:
        """The state of a key that nothing is known of."""

    @abstractmethod
    def due(self, state: dict) -> int | None:
        """When something happens by itself."""

    @abstractmethod
    def step(self, state: dict, event: Event, memory: Memory) -> list[tuple]:
        """What an event does; changes the state and gives rows."""

    @abstractmethod
    def fire(self, state: dict, memory: Memory) -> list[tuple]:
        """What happens when the time is due; nothing is due at that time afterwards."""

    def until(self, state: dict, at: int, memory: Memory) -> list[tuple]:
        """All that is due by ``at``."""
        out: list[tuple] = []
        while (due := self.due(state)) is not None and due <= at:
            out += self.fire(state, memory)
        return out


class Leases(Machine):
    """One job for each key, claimed by one worker at a time.

    ``queue`` puts a job that isn't waiting or running into the queue; ``claim`` gives it to a worker for
    ``lease`` microseconds, if it waits and its time has come; ``beat`` by its owner makes the lease begin
    anew; ``done`` and ``error`` by its owner end it, an error with another try after a wait that doubles
    from 5 to 300 seconds, ``most`` tries in all. A lease that isn't renewed lapses, and the job waits for
    another try. Whoever has no lease, or no longer, changes nothing.
    """

    rows = "id long, at long, who string, outcome string, attempt int"

    def __init__(self, lease: int, most: int = 3):
        self.lease, self.most = lease, most

    def start(self) -> dict:
        return {"status": "none", "owner": None, "until": 0, "attempt": 0, "after": 0}

    def due(self, state: dict) -> int | None:
        return state["until"] if state["status"] == "running" else None

    def fire(self, state: dict, memory: Memory) -> list[tuple]:
        lapsed = (None, state["until"], state["owner"], "lapsed", state["attempt"])
        state.update(status="retry" if state["attempt"] < self.most else "failed", after=state["until"])
        return [lapsed]

    def step(self, state: dict, event: Event, memory: Memory) -> list[tuple]:
        outcome = self._outcome(state, event)
        if outcome == "queued":
            state.update(status="queued", attempt=0, after=event.at)
        elif outcome == "granted":
            state.update(status="running", owner=event.who, until=event.at + self.lease, attempt=state["attempt"] + 1)
        elif outcome == "extended":
            state["until"] = event.at + self.lease
        elif outcome in ("done", "failed"):
            state["status"] = outcome
        elif outcome == "retry":
            state.update(status="retry", after=event.at + 1_000_000 * min(300, 5 * 2 ** (state["attempt"] - 1)))
        return [(event.id, event.at, event.who, outcome, state["attempt"])]

    def _outcome(self, state: dict, event: Event) -> str:
        status = state["status"]
        if event.what == "queue":
            return "queued" if status in ("none", "done", "failed") else "waiting"
        if event.what == "claim":
            return "granted" if event.who is not None and status in ("queued", "retry") and state["after"] <= event.at else "refused"
        if status != "running" or state["owner"] != event.who:
            return "lost"
        if event.what == "beat":
            return "extended"
        if event.what == "done":
            return "done"
        if event.what == "error":
            return "retry" if state["attempt"] < self.most else "failed"
        return "unknown"


class Loads(Machine):
    """The pages of one site for each key, loaded in runs.

    An event is a page ``who`` that came with a ``body``, or ``failed``, or ``cancel``. A page is loaded if
    its body is new, else unchanged; what comes more than ``budget`` after the run's begin is skipped and
    waits for another run. A run ends at its ``deadline``, or when it is cancelled, and the next event
    begins another: bodies and failures are remembered, so it goes on where the last one stopped.

    Rows are snapshots of the run, given only when one differs from the last: ``done`` pages of this run,
    ``failed`` ones of all runs that have not come since, ``skipped`` ones of this run.
    """

    rows = "at long, run int, status string, done int, failed int, skipped int, who string"

    def __init__(self, budget: int, deadline: int):
        self.budget, self.deadline = budget, deadline

    def start(self) -> dict:
        return {"run": 0, "began": 0, "status": "idle", "done": 0, "failed": 0, "skipped": 0}

    def due(self, state: dict) -> int | None:
        return state["began"] + self.deadline if state["status"] == "running" else None

    def fire(self, state: dict, memory: Memory) -> list[tuple]:
        state["status"] = "complete" if not state["failed"] and not state["skipped"] else "timeout"
        return [self._snapshot(state, state["began"] + self.deadline, None)]

    def _snapshot(self, state: dict, at: int, page: str | None) -> tuple:
        return (at, state["run"], state["status"], state["done"], state["failed"], state["skipped"], page)

    def step(self, state: dict, event: Event, memory: Memory) -> list[tuple]:
        before = dict(state)
        if event.what == "cancel":
            if state["status"] == "running":
                state["status"] = "cancelled"
        elif event.who is not None:
            if state["status"] != "running":
                state.update(run=state["run"] + 1, began=event.at, status="running", done=0, skipped=0)
            self._page(state, event, memory)
        return [self._snapshot(state, event.at, event.who)] if state != before else []

    def _page(self, state: dict, event: Event, memory: Memory) -> None:
        body, failed, run = json.loads(memory.get(event.who) or "[null, false, 0]")
        if event.at > state["began"] + self.budget:
            state["skipped"] += 1
            return
        if event.what == "failed":
            state["failed"] += not failed
            state["done"] -= run == state["run"] and not failed
            memory.put(event.who, json.dumps([body, True, run]))
            return
        state["failed"] -= failed
        state["done"] += run != state["run"] or failed
        if failed or run != state["run"] or body != event.body:
            memory.put(event.who, json.dumps([event.body, False, state["run"]]))


class _Names(Memory):
    """In a dictionary, for one key of a table at a time."""

    def __init__(self):
        self.held: dict[str, str] = {}

    def get(self, name: str) -> str | None:
        return self.held.get(name)

    def put(self, name: str, value: str) -> None:
        self.held[name] = value


class _Stored(Memory):
    """In the stream's state."""

    def __init__(self, state):
        self.state = state

    def get(self, name: str) -> str | None:
        return self.state.getValue((name,))[0] if self.state.containsKey((name,)) else None

    def put(self, name: str, value: str) -> None:
        self.state.updateValue((name,), (value,))


def over_table(events: DataFrame, machine: Machine, as_of: int) -> DataFrame:
    """The machine's rows for ``events(key, at, id, what, who, body)`` before ``as_of``, and for all that is due before it.

    Events of a key go by time and id. Rows without a key, time or id are left out. A task reads its keys
    in order and holds the state of one at a time, so a key with very many events is no group in memory.
    """
    key = events.schema["key"].dataType
    schema = StructType.fromDDL(f"key {key.simpleString()}, {machine.rows}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = None
        state, memory, out = machine.start(), _Names(), []

        def ended() -> None:
            out.extend((now, *row) for row in machine.until(state, as_of - 1, memory))

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            for k, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if now is not None:
                        ended()
                    now, state, memory = k, machine.start(), _Names()
                event = Event(*event)
                out.extend((k, *row) for row in machine.until(state, event.at, memory))
                out.extend((k, *row) for row in machine.step(state, event, memory))
            if out:
                yield flush()
        if now is not None:
            ended()
        if out:
            yield flush()

    rows = events.select("key", "at", "id", "what", "who", "body").where(F.col("key").isNotNull() & F.col("id").isNotNull() & (F.col("at") < as_of))
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, schema)


class _Processor(StatefulProcessor):
    """Events wait until the watermark has passed; then the machine sees them in order."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.columns = ["key", *StructType.fromDDL(machine.rows).fieldNames()]

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string")
        self.waiting = handle.getListState("waiting", EVENT)
        self.names = _Stored(handle.getMapState("names", "name string", "value string"))

    def handleInputRows(self, key, rows, timerValues):
        came = [(r["at"], r["id"], r["what"], r["who"], r["body"]) for r in rows]
        self.waiting.appendList(came)
        # A timer fires once the watermark is past it: then all events of its millisecond are here.
        for at in {x[0] // 1000 for x in came}:
            self.handle.registerTimer(at + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.machine.start()
        waiting = sorted((Event(*x) for x in self.waiting.get()), key=lambda e: (e.at, e.id))
        ready = [e for e in waiting if e.at < passed]
        rest = [tuple(e) for e in waiting[len(ready) :]]
        out = []
        for event in ready:
            out += self.machine.until(state, event.at, self.names)
            out += self.machine.step(state, event, self.names)
        out += self.machine.until(state, passed - 1, self.names)
        self.state.update((json.dumps(state),))
        if rest:
            self.waiting.put(rest)
        elif waiting:
            self.waiting.clear()
        due = self.machine.due(state)
        if due is not None:
            self.handle.registerTimer(due // 1000 + 1)
        for row in out:
            yield Row(**dict(zip(self.columns, (key[0], *row), strict=True)))

    def close(self) -> None:
        pass


#: The state store that arbitrary state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def over_stream(events: DataFrame, machine: Machine, late: str = "1 hour") -> DataFrame:
    """The machine's rows for a stream of ``events(key, ts, id, what, who, body)``; ``ts`` is a timestamp, and ``at`` its microseconds.

    Events that come more than ``late`` after later ones are dropped. The session must have the settings of ``STORE``.
    """
    key = events.schema["key"].dataType.simpleString()
    rows = events.where("key is not null and id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("key", "ts", F.unix_micros("ts").alias("at"), "id", "what", "who", "body")
    return rows.groupBy("key").transformWithState(_Processor(machine), StructType.fromDDL(f"key {key}, {machine.rows}"), "Append", "EventTime")


def store_settings(spark: SparkSession) -> None:
    """Give the session the settings of ``STORE``."""
    for name, value in STORE.items():
        spark.conf.set(name, value)
