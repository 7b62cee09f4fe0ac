"""Runs of dependent steps on the driver: waves, retries, skips, progress and drawings.

Steps start Spark jobs; which step may run is decided from a status table of a few rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PENDING, RUNNING, COMPLETED, FAILED, SKIPPED = "PENDING", "RUNNING", "COMPLETED", "FAILED", "SKIPPED"
#: The full generation, each step with those it waits for. Plot extraction and
#: scenes wait for resolved people, and actions for dialogues, as their inputs demand.
FULL = {
    "CHAPTER_PARSE": [],
    "CHARACTER_EXTRACT": ["CHAPTER_PARSE"],
    "CHARACTER_RESOLVE": ["CHARACTER_EXTRACT"],
    "PLOT_EXTRACT": ["CHAPTER_PARSE", "CHARACTER_RESOLVE"],
    "SCENE_SEGMENT": ["PLOT_EXTRACT", "CHARACTER_RESOLVE"],
    "DIALOGUE_GENERATE": ["SCENE_SEGMENT"],
    "ACTION_GENERATE": ["SCENE_SEGMENT", "DIALOGUE_GENERATE"],
    "SCRIPT_COMPOSE": ["CHARACTER_RESOLVE", "DIALOGUE_GENERATE", "ACTION_GENERATE"],
    "YAML_EXPORT": ["SCRIPT_COMPOSE"],
}
RETRIED = {"CHARACTER_EXTRACT", "PLOT_EXTRACT", "SCENE_SEGMENT", "DIALOGUE_GENERATE", "ACTION_GENERATE"}
BACKOFF = 0.2


class Cancelled(Exception):
    pass


@dataclass
class Step:
    name: str
    action: Callable[[], object]
    after: list[str] = field(default_factory=list)
    retries: int = 0
    abort: bool = True


class Run:
    """Executes steps wave by wave; what depends on a failed step is skipped."""

    def __init__(self, steps: list[Step], sleep: Callable[[float], None] = time.sleep, done: set[str] = frozenset()):
        self.steps = {s.name: s for s in steps}
        self.status = {s.name: COMPLETED if s.name in done else PENDING for s in steps}
        self.errors: dict[str, str] = {}
        self.log: list[tuple[str, str]] = []
        self.cancelled = False
        self._sleep = sleep

    def runnable(self) -> list[str]:
        ready = (COMPLETED, SKIPPED)
        return [n for n, s in self.steps.items() if self.status[n] == PENDING and all(self.status.get(d) in ready for d in s.after)]

    def _set(self, name: str, status: str) -> None:
        self.status[name] = status
        self.log.append((name, status))

    def _one(self, name: str) -> None:
        step = self.steps[name]
        for attempt in range(step.retries + 1):
            try:
                if self.cancelled:
                    raise Cancelled(name)
                step.action()
                self._set(name, COMPLETED)
                return
            except Cancelled as e:
                self.errors[name] = f"cancelled: {e}"
                break
            except Exception as e:  # noqa: BLE001  a step's failure is a state of the run
                self.errors[name] = str(e)
                if attempt < step.retries:
                    self._sleep(BACKOFF * 2**attempt)
        self._set(name, FAILED)

    def execute(self, threads: int = 8) -> dict[str, str]:
        with ThreadPoolExecutor(threads) as pool:
            while wave := self.runnable():
                for name in wave:
                    self._set(name, RUNNING)
                list(pool.map(self._one, wave))
                for name in wave:
                    if self.status[name] == FAILED:
                        self._skip(name)
        return dict(self.status)

    def _skip(self, failed: str) -> None:
        gone = {failed}
        grew = True
        while grew:
            more = {n for n, s in self.steps.items() if self.status[n] == PENDING and gone & set(s.after)}
            grew = bool(more - gone)
            gone |= more
        for name in gone - {failed}:
            self._set(name, SKIPPED)

    def progress(self) -> float:
        return 100.0 * sum(s in (COMPLETED, SKIPPED) for s in self.status.values()) / max(1, len(self.status))


def resumed(run: Run, steps: list[Step]) -> Run:
    """A new run of the same steps that keeps what is completed."""
    return Run(steps, run._sleep, {n for n, s in run.status.items() if s == COMPLETED})


def waves(edges: DataFrame, steps: DataFrame, rounds: int | None = None) -> DataFrame:
    """step, wave: 1 without dependencies, else one more than the latest of them. edges: (step, dep).

    Each round settles one wave; the table is as small as the workflow, and a cycle ends the loop.
    """
    spark = steps.sparkSession
    known = steps.join(edges, "step", "left_anti").select("step", F.lit(1).alias("wave"))
    n = rounds or steps.count()
    for _ in range(n):
        after = edges.join(known.withColumnsRenamed({"step": "dep", "wave": "w"}), "dep", "left").groupBy("step").agg(F.max("w").alias("w"), F.count_if(F.col("w").isNull()).alias("open")).where("open = 0").select("step", (F.col("w") + 1).alias("wave"))
        grown = known.unionByName(after).groupBy("step").agg(F.max("wave").alias("wave"))
        rows = grown.collect()  # one for each step
        if len(rows) == known.count():
            break
        known = spark.createDataFrame(rows, "step string, wave int")
    return known


def skipped(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Steps that depend on a failed one, directly or not."""
    spark = edges.sparkSession
    gone = failed.select("step")
    reached = set()
    while True:
        more = {r[0] for r in edges.join(gone.withColumnRenamed("step", "dep"), "dep", "left_semi").select("step").distinct().collect()}  # steps of one workflow
        if more <= reached:
            break
        reached |= more
        gone = spark.createDataFrame([(s,) for s in sorted(reached)], "step string")
    return spark.createDataFrame([(s,) for s in sorted(reached)], "step string")


def latest(events: DataFrame) -> DataFrame:
    """run_id, step and the last status of each."""
    return events.groupBy("run_id", "step").agg(F.max_by("status", "ts").alias("status"))


def percent(states: DataFrame) -> DataFrame:
    """run_id and the share of its steps that are completed or skipped."""
    return states.groupBy("run_id").agg((F.count_if(F.col("status").isin(COMPLETED, SKIPPED)) * 100.0 / F.count(F.lit(1))).alias("progress"))


def mermaid(graph: dict[str, list[str]]) -> str:
    rows = ["```mermaid", "flowchart TD"]
    for step, after in graph.items():
        rows.append(f'    {step}["{step}"]')
        rows += [f"    {d} --> {step}" for d in after if d in graph]
    return "\n".join([*rows, "```", ""])


def bar(percent_: float, width: int = 30) -> str:
    full = int(width * percent_ / 100 + 0.5)
    tip = ">" if 0 < full < width else ""
    return f"[{'=' * full}{tip}{' ' * (width - full - len(tip))}] {percent_:5.1f}%"


def status_text(name: str, states: dict[str, str], percent_: float, message: str | None) -> str:
    icons = {PENDING: "○", RUNNING: "●", COMPLETED: "✓", FAILED: "✗", SKIPPED: "⤳"}
    head = [f"Workflow: {name}", f"Progress: {bar(percent_)}", f"Message:  {message or '—'}", "Steps:"]
    return "\n".join([*head, *(f"  {icons[s]} {n} — {s}" for n, s in states.items())])
