"""The worker-count policy as an ordered fold over samples (t, completed, running, workers).

A tick's decision is the first rule, in a fixed order, that applies to the tick's facts; each rule says what
to do with the worker count and what to remember.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from millrace.operators import keyed

#: Weight of the newest throughput, gain that counts, ticks between probes, ticks held after settling.
WEIGHT, GAIN, PROBE_TICKS, HOLD_TICKS = 0.3, 0.05, 20, 3


@dataclass(frozen=True)
class Memory:
    width: int = 1
    low: int = 1
    high: int = 1
    seeded: bool = False
    rate: float = 0.0
    base: float = 0.0
    climbing: bool = False
    ceiling: int = 0
    hold: int = 0
    since_probe: int = 0

    def __post_init__(self):
        if not 1 <= self.low <= self.high:
            raise ValueError("1 <= low <= high must hold")


def bounded(target: int, m: Memory) -> int:
    return m.low if target < m.low else min(target, m.high)


def decide(m: Memory, before: tuple, now: tuple) -> tuple[Memory, int]:
    """(memory, change of the worker count) after samples (seconds, completed, running, workers)."""
    seconds = now[0] - before[0]
    if seconds <= 0:
        return m, 0
    rate = (now[1] - before[1]) / seconds
    if not m.seeded:
        return replace(m, seeded=True, rate=rate, base=rate), 0
    m = replace(m, rate=WEIGHT * rate + (1 - WEIGHT) * m.rate)
    if m.hold:
        return replace(m, hold=m.hold - 1), 0
    probing = m.since_probe + 1 >= PROBE_TICKS
    m = replace(m, since_probe=0 if probing else m.since_probe + 1, ceiling=0 if probing else m.ceiling)

    running, workers = now[2], now[3]
    full, room, better = running >= workers, workers < m.high, m.rate > m.base * (1 + GAIN)
    up, down = bounded(workers + m.width, m) - workers, bounded(workers - m.width, m) - workers
    settled = replace(m, climbing=False, ceiling=workers, hold=HOLD_TICKS)
    whole = -(-(running + 1) // m.width) * m.width  # whole pipelines that hold one more than what runs
    rules = (
        (workers > max(2 * running, m.low), replace(m, climbing=False, ceiling=0), max(m.low, min(whole, workers)) - workers),
        (m.climbing and better and full and room, replace(m, base=m.rate), up),
        (m.climbing and better, settled, 0),
        (m.climbing, settled, down),
        (full and room and not m.ceiling, replace(m, base=m.rate, climbing=True), up),
    )
    return next(((after, change) for applies, after, change in rules if applies), (m, 0))


def trace(samples: DataFrame, key: str, width: int, low: int, high: int) -> DataFrame:
    """key, tick, rate, change for samples (key, tick, t, completed, running, workers), folded in order."""
    start = Memory(width, low, high)

    def step(state, row):
        memory, before = state
        now = (row.t, row.completed, row.running, row.workers)
        memory, change = (memory, 0) if before is None else decide(memory, before, now)
        return (memory, now), [(getattr(row, key), row.tick, float(memory.rate), int(change))]

    kind = dict(samples.dtypes)[key]
    return keyed.fold(samples, key, "tick", step, lambda: (start, None), f"{key} {kind}, tick long, rate double, change int")
