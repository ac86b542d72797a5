"""The claim machine: admit, defer, settle, reject, refute and auto-claim, per episode.

An episode's ticks come in order. Each tick brings what its plan step's
predicate found (`fired`: the step it holds since, or null), whether vision
refutes it, and claims. The rules, in this order:

1. A settling claim hands off once its predicate has held for `settle` ticks.
2. Pending claims are admitted when the predicate fired and they name the
   current plan step.
3. A new claim of another plan step is rejected; one that is settling is
   dropped; a refuted one and one without evidence wait; others are admitted.
   Lines that claim nothing are kept unless they repeat the last one.
4. Where nothing was admitted and nothing settles, a predicate that has held
   for `grace` ticks claims by itself, and pending claims go.

After `phantom` refutations in a row, evidence up to its step counts no more.
A tick completes one plan step at most, since `fired` belongs to the step that
the tick began with; further claims of it wait for the next tick.

It is a machine (streaming.machines): the bank is a list state that grows by
the lines that are admitted, and the same rules serve batch and stream.
`over_states` finds `fired` itself, from the episode's states.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.operators.predicates import Bounds, Camera

from . import machines, scans
from .machines import Machine, Memory

OUT = "verdict string, text string, j int, bank_size int"
VALUES = {"j": "bigint", "settling": "bigint", "since": "bigint", "refuted": "bigint", "pending": "array<string>", "last_line": "string", "bank_size": "bigint"}


@dataclass(frozen=True)
class Rules:
    tick: int = 10
    settle: int = 0
    grace: int = 2
    phantom: int = 3


def _claim(text: str) -> str | None:
    """The plan step that a line claims completed."""
    head, mark, rest = text.partition("completed:")
    return rest.split("[sam]")[0].strip().lower().rstrip(".") if mark else None


def verdicts(m: Memory, plan: list[str], step: int, fired: int | None, refuted: bool, lines: list[str], rules: Rules) -> tuple[list[tuple], bool]:
    """(rows of OUT, whether the tick's plan step was completed); changes the memory."""
    out: list[tuple[str, str]] = []
    done, began = False, m.get("j", 0)
    wanted = plan[began] if began < len(plan) else None
    now = lambda: plan[m.get("j", 0)] if m.get("j", 0) < len(plan) else None

    def keep(text: str) -> None:
        m.append("bank", text)
        m.set("bank_size", m.get("bank_size", 0) + 1)
        m.set("last_line", text)

    def complete() -> None:
        nonlocal done
        done = True
        for name, v in (("j", m.get("j", 0) + 1), ("settling", None), ("since", step), ("refuted", 0)):
            m.set(name, v)

    def admit(text: str, at: int, verdict: str) -> None:
        keep(text)
        if step - at < rules.settle * rules.tick:
            m.set("settling", at)
            out.append(("settling", text))
        else:
            complete()
            out.append((verdict, text))

    def usable() -> int | None:
        # A completed step's evidence says nothing about the next one.
        return None if done or fired is None or wanted is None or fired < m.get("since", 0) else fired

    if m.get("settling") is not None and step - m.get("settling") >= rules.settle * rules.tick:
        out.append(("settled", wanted or ""))
        complete()
    if usable() is not None:
        m.set("refuted", m.get("refuted", 0) + 1 if refuted else 0)
        if m.get("refuted") >= rules.phantom:
            out.append(("phantom", wanted or ""))
            m.set("since", fired + 1)
            m.set("refuted", 0)
    waiting, pending = m.get("pending", []), []
    for text in waiting:
        if m.get("settling") is None and not refuted and usable() is not None and _claim(text) == now():
            admit(text, usable(), "admit-pending")
        else:
            pending.append(text)
    for text in lines:
        claim = _claim(text)
        if claim is None:
            repeats = m.get("bank_size", 0) > 0 and m.get("last_line").strip().lower() == text.strip().lower()
            out.append(("reject-dup" if repeats else "admit", text))
            if not repeats:
                keep(text)
        elif claim != now():
            out.append(("reject", text))
        elif m.get("settling") is not None:
            out.append(("settling-dup", text))
        elif usable() is None:
            pending.append(text)
            out.append(("defer", text))
        elif refuted:
            pending.append(text)
            out.append(("refute-defer", text))
        else:
            admit(text, usable(), "admit")
    at = usable()
    if at is not None and not refuted and m.get("settling") is None and step - at >= rules.grace * rules.tick:
        admit(f"[event] completed: {wanted} (auto)", at, "auto")
        pending = []
    m.set("pending", pending)
    return [(v, t, m.get("j", 0), m.get("bank_size", 0)) for v, t in out], done


def _lines(x: Any) -> list[str]:
    return [t for t in (x.lines if x.lines is not None else ()) if t]


def _known(v: Any) -> int | None:
    return None if v is None or v != v else int(v)


def machine(rules: Rules = Rules()) -> Machine:  # noqa: B008
    """A tick has plan (texts), step, fired, refuted and lines (texts; null and empty ones don't count)."""

    def step(m: Memory, x: Any) -> list[tuple]:
        refuted = bool(x.refuted) if x.refuted is not None else False
        return verdicts(m, list(x.plan), int(x.step), _known(x.fired), refuted, _lines(x), rules)[0]

    return Machine(step, OUT, VALUES, {"bank": "line string"})


def over_states(rules: Rules = Rules(), bounds: Bounds = Bounds(), camera: Camera | None = None) -> Machine:  # noqa: B008
    """The same where a tick has kinds and whats (and gates) of the plan and the new states instead of fired.

    A step's predicate scans from the step after the last completion, and from
    after a phantom. A step is the number of states so far.
    """

    def step(m: Memory, x: Any) -> list[tuple]:
        scan, j, at = scans.advance(m, x, bounds, camera)
        plan, refuted = [str(w) for w in x.whats], bool(x.refuted) if x.refuted is not None else False
        since = m.get("since", 0)
        out, done = verdicts(m, plan, m.get("n", 0), at, refuted, _lines(x), rules)
        if done and scan is not None:
            held = at if at is not None else m.get("n", 0) - 1
            scan.begin(j + 1, held + 1)
            m.set("since", held + 1)
        elif scan is not None and m.get("since", 0) != since:
            scan.begin(j, m.get("since"))
        return out

    return Machine(step, OUT, {**scans.VALUES, **VALUES}, {"series": scans.SERIES, "bank": "line string"}, scans.MAPS)


def whole_ticks(rows: DataFrame) -> DataFrame:
    """A row for each tick from rows of one line each (ep, plan, tick, step, ord, fired, refuted, text)."""
    first = lambda c: F.min_by(c, "ord").alias(c)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"])
    return rows.groupBy("ep", "tick").agg(first("plan"), first("step"), first("fired"), first("refuted"), lines.alias("lines"))


def batch(ticks: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Verdicts of whole episodes; ticks as rows of one line each, or as whole ticks."""
    whole = ticks if "lines" in ticks.columns else whole_ticks(ticks)
    return machines.batch(whole, machine(rules)).withColumn("tick", F.col("tick").cast("int"))


def stream(ticks: DataFrame, rules: Rules = Rules(), idle: int | None = None, event_time: str | None = None) -> DataFrame:  # noqa: B008
    """The same over a stream of whole ticks; a tick is one row, so no trigger can part it."""
    return machines.stream(ticks, machine(rules), idle=idle, event_time=event_time).withColumn("tick", F.col("tick").cast("int"))


def windowed_counts(events: DataFrame, at: str, late: str, width: str, by: list[str]) -> DataFrame:
    """Counts by event-time window behind a watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), *by).count()
