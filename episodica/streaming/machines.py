"""Rules that carry state from tick to tick: the same in batch and over a stream.

A machine says what one tick of a key gives, given a memory of named values,
lists and maps. batch() runs it over whole episodes in groups. stream() keeps
the memory in Spark's state store: a value state for each value, a list state
that only grows by what a trigger appends, a map state whose entries are
written one by one; values are read once a trigger and written back if changed.

A tick is one row. Rows of a key are taken in the order of `at`; one that is not
after the last one was seen before (a source may send it again) and gives
nothing. A true `reset` (a column that may be missing) clears the memory before
its tick. A stream forgets a key that got no tick for `idle` milliseconds, by
the clock or by an event-time column behind a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor


@dataclass(frozen=True)
class Machine:
    """step(memory, tick) gives rows of `out`; kinds of state are written as SQL types or columns."""

    step: Callable[[Memory, Any], list[tuple]]
    out: str
    values: dict[str, str] = field(default_factory=dict)
    lists: dict[str, str] = field(default_factory=dict)
    maps: dict[str, tuple[str, str]] = field(default_factory=dict)


class Memory:
    """The state of one key, in memory."""

    def __init__(self):
        self._values: dict[str, Any] = {}
        self._lists: dict[str, list[tuple]] = {}
        self._maps: dict[str, dict[Any, tuple]] = {}

    def get(self, name: str, default: Any = None) -> Any:
        v = self._values.get(name)
        return default if v is None else v

    def set(self, name: str, value: Any) -> None:
        self._values[name] = value

    def append(self, name: str, *row: Any) -> None:
        self._lists.setdefault(name, []).append(row)

    def rows(self, name: str) -> list[tuple]:
        return self._lists.setdefault(name, [])

    def tail(self, name: str, n: int) -> list[tuple]:
        """The last n rows; those of this trigger need no reading."""
        return self.rows(name)[-n:] if n else []

    def put(self, name: str, key: Any, *row: Any) -> None:
        self._maps.setdefault(name, {})[key] = row

    def items(self, name: str) -> dict[Any, tuple]:
        return self._maps.setdefault(name, {})

    def clear(self) -> None:
        for held in (self._values, self._lists, self._maps):
            held.clear()


class Kept(Memory):
    """The state of one key in the state store, read when it is asked for."""

    def __init__(self, values: dict, lists: dict, maps: dict):
        super().__init__()
        self.of_values, self.of_lists, self.of_maps = values, lists, maps
        self.changed: set[str] = set()
        self.added: dict[str, list[tuple]] = {}
        self.placed: dict[str, set] = {}

    def get(self, name: str, default: Any = None) -> Any:
        if name not in self._values:
            found = self.of_values[name].get() if self.of_values[name].exists() else None
            self._values[name] = found[0] if found else None
        return super().get(name, default)

    def set(self, name: str, value: Any) -> None:
        if self.get(name) != value:
            self.changed.add(name)
            super().set(name, value)

    def append(self, name: str, *row: Any) -> None:
        self.added.setdefault(name, []).append(row)
        if name in self._lists:
            super().append(name, *row)

    def rows(self, name: str) -> list[tuple]:
        if name not in self._lists:
            self._lists[name] = [*map(tuple, self.of_lists[name].get()), *self.added.get(name, [])]
        return self._lists[name]

    def tail(self, name: str, n: int) -> list[tuple]:
        new = self.added.get(name, [])
        return new[len(new) - n :] if n <= len(new) else super().tail(name, n)

    def put(self, name: str, key: Any, *row: Any) -> None:
        self.items(name)[key] = row
        self.placed.setdefault(name, set()).add(key)

    def items(self, name: str) -> dict[Any, tuple]:
        if name not in self._maps:
            self._maps[name] = {k[0]: tuple(v) for k, v in self.of_maps[name].iterator()}
        return self._maps[name]

    def clear(self) -> None:
        for state in (*self.of_values.values(), *self.of_lists.values(), *self.of_maps.values()):
            state.clear()
        self._values = dict.fromkeys(self.of_values)
        self._lists, self._maps = {k: [] for k in self.of_lists}, {k: {} for k in self.of_maps}
        self.changed, self.added, self.placed = set(), {}, {}

    def flush(self) -> None:
        for name in self.changed:
            if (v := self._values[name]) is None:
                self.of_values[name].clear()
            else:
                self.of_values[name].update((v,))
        for name, rows in self.added.items():
            self.of_lists[name].appendList(rows)
        for name, keys in self.placed.items():
            for k in keys:
                self.of_maps[name].updateValue((k,), self._maps[name][k])


def _tick(machine: Machine, memory: Memory, x: Any, at: str) -> list[tuple]:
    t, last = getattr(x, at), memory.get("last_")
    if last is not None and t <= last:
        return []
    if getattr(x, "reset", False):
        memory.clear()
    memory.set("last_", int(t))
    return [(int(t), *row) for row in machine.step(memory, x)]


def _shape(ticks: DataFrame, machine: Machine, key: str, at: str) -> str:
    return f"`{key}` {dict(ticks.dtypes)[key]}, `{at}` bigint, {machine.out}"


def _frame(key: Any, rows: list[tuple], names: list[str]) -> pd.DataFrame:
    # Objects keep nulls and whole numbers as they are.
    return pd.DataFrame([(key, *r) for r in rows], columns=names, dtype=object)


def _names(ticks: DataFrame, machine: Machine, key: str, at: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(_shape(ticks, machine, key, at)).names


def _ordered(rows: pd.DataFrame, at: str) -> Iterator[Any]:
    return rows.sort_values(at, kind="stable").itertuples(index=False)


def batch(ticks: DataFrame, machine: Machine, key: str = "ep", at: str = "tick") -> DataFrame:
    """(key, at, out) of whole episodes; an episode's rows meet in one group."""
    names = _names(ticks, machine, key, at)

    def run(k, rows: pd.DataFrame) -> pd.DataFrame:
        memory, out = Memory(), []
        for x in _ordered(rows, at):
            out += _tick(machine, memory, x, at)
        return _frame(k[0], out, names)

    run.__annotations__ = {}
    return ticks.groupBy(key).applyInPandas(run, _shape(ticks, machine, key, at))


class _Processor(StatefulProcessor):
    def __init__(self, machine: Machine, names: list[str], at: str, idle: int | None, event_time: str | None):
        self.machine, self.names, self.at, self.idle, self.event_time = machine, names, at, idle, event_time

    def init(self, handle) -> None:
        m, self.handle = self.machine, handle
        self.values = {k: handle.getValueState(k, f"v {t}") for k, t in {**m.values, "last_": "bigint"}.items()}
        self.lists = {k: handle.getListState(k, c) for k, c in m.lists.items()}
        self.maps = {k: handle.getMapState(k, f"k {t}", c) for k, (t, c) in m.maps.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A trigger's rows of a key may come in several frames; order needs them all.
        whole = pd.concat(list(rows), ignore_index=True)
        memory, out = Kept(self.values, self.lists, self.maps), []
        for x in _ordered(whole, self.at):
            out += _tick(self.machine, memory, x, self.at)
        memory.flush()
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            now = int(whole[self.event_time].max().timestamp() * 1000) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.idle)
        yield _frame(key[0], out, self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        Kept(self.values, self.lists, self.maps).clear()
        yield _frame(key[0], [], self.names)

    def close(self) -> None:
        pass


STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream(ticks: DataFrame, machine: Machine, key: str = "ep", at: str = "tick", idle: int | None = None, event_time: str | None = None) -> DataFrame:
    """(key, at, out) over a stream: each trigger brings an episode's next ticks.

    The session must keep state in RocksDB (the setting STORE).
    """
    conf = ticks.sparkSession.conf
    if conf.get(STORE[0], "") != STORE[1]:
        raise RuntimeError(f"set {STORE[0]} to {STORE[1]}")
    processor = _Processor(machine, _names(ticks, machine, key, at), at, idle, event_time)
    mode = "None" if idle is None else "EventTime" if event_time else "ProcessingTime"
    return ticks.groupBy(key).transformWithStateInPandas(processor, _shape(ticks, machine, key, at), "Append", mode)
