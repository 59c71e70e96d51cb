"""The benchmark loop: warm-up runs are dropped, every timed run is averaged."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import fmean, median


@dataclass(frozen=True)
class Timing:
    seconds: list[float]

    @property
    def mean(self) -> float:
        return fmean(self.seconds)

    @property
    def median(self) -> float:
        return median(self.seconds)


def repeat(action: Callable[[], object], total: int = 5, warmup: int = 1) -> Timing:
    """Times of all runs from ``warmup`` on."""
    if not 0 <= warmup < total:
        raise ValueError("at least one run is timed")
    out = []
    for i in range(total):
        began = time.perf_counter()
        action()
        if i >= warmup:
            out.append(time.perf_counter() - began)
    return Timing(out)


def sweep(make: Callable[..., Callable[[], object]], settings: list[dict], total: int = 2, warmup: int = 1) -> list[tuple[dict, Timing]]:
    """Timings over a list of settings (strategies, numbers of partitions)."""
    return [(s, repeat(make(**s), total, warmup)) for s in settings]
