"""Who may become champion: proposals, a choice on half of the days confirmed on the other, refusals, and run records."""

from __future__ import annotations

import json
import resource
import time
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from .sources.registry import append_entry, content_key


def proposals(members: Sequence[str], new: str) -> list[tuple[str, tuple[str, ...]]]:
    """The ways in which a new member can enter: for each old one, added, or alone."""
    swaps = [(f"swap:{m}", tuple(new if x == m else x for x in members)) for m in members]
    return [*swaps, ("add", (*members, new)), ("alone", (new,))]


def choose(options: Iterable[tuple[str, tuple[str, ...]]], on_a: Callable[[tuple[str, ...]], float], passes_a: Callable[[tuple[str, ...]], bool], confirm: Callable[[tuple[str, ...]], bool]) -> tuple[str, tuple[str, ...]] | None:
    """Of the options that pass on half A the one that gains most there; only that one is confirmed on half B."""
    passing = [(on_a(members), name, members) for name, members in options if passes_a(members)]
    if not passing:
        return None
    _, name, members = max(passing, key=lambda x: (x[0], x[1]))
    return (name, members) if confirm(members) else None


def leaked(run: dict, holdout: Iterable[int]) -> bool:
    """Whether a run was distilled from a source that saw the holdout's months."""
    return bool(set(run.get("source_months", ())) & set(holdout))


def may_promote(run: dict, champion: dict, holdout: Iterable[int]) -> bool:
    """A run without leak whose base is the champion's or is new."""
    return not leaked(run, holdout) and run.get("base") in {None, *champion.get("bases", ()), run.get("id")}


@dataclass
class Run:
    """A run's record: phases with their seconds, metrics, peak memory, and a key of its configuration."""

    name: str
    config: dict
    registry: str | None = None
    phases: dict[str, float] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)

    def __enter__(self) -> Run:
        self.began = time.time()
        return self

    @contextmanager
    def phase(self, name: str):
        began = time.time()
        try:
            yield
        finally:
            self.phases[name] = self.phases.get(name, 0.0) + time.time() - began

    def metric(self, **values: float) -> None:
        self.metrics |= values

    @property
    def id(self) -> str:
        return f"{self.name}-{content_key(self.config)}"

    def record(self, state: str) -> dict:
        return {
            "id": self.id, "config": self.config, "state": state, "seconds": round(time.time() - self.began, 3), "phases": {k: round(v, 3) for k, v in self.phases.items()}, "metrics": self.metrics,
            "driver_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024,
        }

    def __exit__(self, kind, error, trace) -> None:
        if self.registry:
            append_entry(self.registry, self.record("failed" if kind else "done"))

    def __str__(self) -> str:
        return json.dumps(self.record("running"), sort_keys=True)
