"""Phases of a run, as Spark saw them: jobs, tasks, shuffle, and the peak memory of each executor; samples while a fit goes on.

Everything comes from the driver's status store, which Spark fills from its executors' heartbeats, with the UI on or off.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Phase:
    """One phase: its stages' sums, and peaks in MB by executor (heap, other memory of the JVM, and the process with its Python)."""

    name: str
    seconds: float = 0.0
    jobs: int = 0
    tasks: int = 0
    failed: int = 0
    read_mb: float = 0.0
    shuffle_mb: float = 0.0
    spill_mb: float = 0.0
    peaks: dict[str, dict[str, float]] = field(default_factory=dict)
    error: str | None = None


_PEAKS = {"heap": "JVMHeapMemory", "off_heap": "JVMOffHeapMemory", "execution": "OnHeapExecutionMemory", "jvm": "ProcessTreeJVMRSSMemory", "python": "ProcessTreePythonRSSMemory"}


class Monitor:
    """Records phases, and tells `report` how far the jobs are, every so many seconds."""

    def __init__(self, spark: SparkSession, every: float = 1.0, report: Callable[[dict], None] | None = None) -> None:
        self.spark, self.every, self.report = spark, every, report
        self.store = spark.sparkContext._jsc.sc().statusStore()
        self.phases: list[Phase] = []

    def _executors(self) -> list:
        got = self.store.executorList(True)
        return [got.apply(i) for i in range(got.size())]

    def executors(self) -> dict[str, dict[str, float]]:
        """{executor: MB of what its heartbeats have told so far}: the highest of each kind."""
        out = {}
        for e in self._executors():
            told = e.peakMemoryMetrics()
            if told.isDefined():
                out[e.id()] = {k: round(told.get().getMetricValue(name) / 1e6, 1) for k, name in _PEAKS.items()}
        return out

    def _stages(self) -> dict[int, dict[str, float]]:
        jvm = self.spark.sparkContext._jvm
        got = self.store.stageList(None, False, False, self.spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        out = {}
        for i in range(got.size()):
            s = got.apply(i)
            out[s.stageId(), s.attemptId()] = {"tasks": s.numCompleteTasks(), "failed": s.numFailedTasks(), "read_mb": s.inputBytes() / 1e6, "shuffle_mb": s.shuffleWriteBytes() / 1e6, "spill_mb": s.diskBytesSpilled() / 1e6}
        return out

    def _jobs(self) -> int:
        return self.store.jobsList(None).size()

    def sample(self) -> dict:
        """Where the jobs are now."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x]
        return {"time": time.time(), "jobs": len(tracker.getActiveJobsIds()), "stages": [s.name for s in stages], "tasks": sum(s.numTasks for s in stages), "done": sum(s.numCompletedTasks for s in stages), "executors": self.executors()}

    @contextmanager
    def phase(self, name: str):
        """What runs inside, as one phase; an error ends it and is recorded with it."""
        found, began, jobs, stages, ended = Phase(name), time.perf_counter(), self._jobs(), self._stages(), threading.Event()
        ticker = threading.Thread(target=self._tick, args=(ended, name), daemon=True)
        ticker.start()
        try:
            yield found
        except BaseException as error:
            found.error = f"{type(error).__name__}: {error}"[:500]
            raise
        finally:
            ended.set()
            ticker.join()
            self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
            found.seconds, found.jobs = round(time.perf_counter() - began, 3), self._jobs() - jobs
            for key, now in self._stages().items():
                before = stages.get(key, {})
                for k, v in now.items():
                    setattr(found, k, getattr(found, k) + v - before.get(k, 0))
            found.peaks = self.executors()
            self.phases.append(found)

    def _tick(self, ended: threading.Event, name: str) -> None:
        while self.report and not ended.wait(self.every):
            self.report({"phase": name} | self.sample())

    def record(self, path: str | None = None) -> list[dict]:
        """The phases; also appended to a file of JSON lines, if asked."""
        rows = [asdict(p) for p in self.phases]
        if path:
            with open(path, "a", encoding="utf-8") as f:
                f.writelines(json.dumps(r, sort_keys=True) + "\n" for r in rows)
        return rows
