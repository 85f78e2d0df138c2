"""How long a piece of work takes."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable


def timed(work: Callable[[], object], repeats: int = 5, warm_up: int = 1) -> dict[str, float | list[float]]:
    """Median and sample standard deviation (0 for one repeat) of the seconds of ``repeats`` runs, after ``warm_up`` others."""
    if repeats < 1 or warm_up < 0:
        raise ValueError("there must be a run to time")
    for _ in range(warm_up):
        work()
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        work()
        took.append(time.perf_counter() - began)
    return {"median_s": statistics.median(took), "std_s": statistics.stdev(took) if repeats > 1 else 0.0, "all_times": took}
