"""The collector's operating state for each worker as a stateful stream: mode with hysteresis, caps on calls, stale runs.

Reports of runs may come out of order and more than once. A report waits in list state until the watermark has passed the
end of its slot of time; a timer then takes all that is due in order of (time, event_id), and sets the timer of the first slot
still waiting. A worker so has a timer or two, however many slots its reports lie in. So the rows that
come out do not depend on how reports were dealt into micro-batches, as long as none is later than the watermark's delay;
later ones, also repeated ones, are dropped by Spark and counted in its metric. Reports are stored as they come, packed by
PART at most: a key's batch is never put together, and what waits is bounded by the delay. A worker that is silent for long is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass, replace
from datetime import datetime, timedelta, timezone
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Modes from lightest to heaviest with their shares of calls, thresholds of the queue, and estimates without observations.
OPERATION_MODES = ("expansion", "balanced", "drain", "emergency-drain")
SHARES = {"expansion": (50, 20), "balanced": (25, 15), "drain": (5, 5), "emergency-drain": (0, 0)}
BALANCED_SHARES = {"game": 25, "identity": 55, "user": 15, "maintenance": 5}
ENTER = {"balanced": 5000, "drain": 10000, "emergency-drain": 20000}
EXIT = {"balanced": 3500, "drain": 7000, "emergency-drain": 14000}
HARD_CAP, DRAIN_RATIO, EMERGENCY_RATIO, EMERGENCY_GROWTH, HOLD_SECONDS = 100_000, 2.0, 5.0, 0.25, 300
SAFETY, LEAST_SAMPLES, ALPHA, RISE, FALLBACK_PERCENT = 0.9, 3, 0.25, 1, 1
DEFAULT_RATES = (0.35, 0.08, 0.55)

STATE = "mode long, entered_us long, last_us long, told boolean, samples long, per_game double, per_user double, per_identity double, game_percent long, user_percent long, next_game long, next_user long"
OUT = "worker long, at timestamp, event_id long, kind string, mode string, reason string, game_cap long, user_cap long, cap_reason string, samples long"


@dataclass(frozen=True)
class Worker:
    """What is known of a worker after its last report.

    told: whether that run was reported as stale; game_percent, user_percent: the last caps that an observation confirmed;
    next_game, next_user: those that its next run is given."""

    mode: int = -1
    entered_us: int = 0
    last_us: int = 0
    told: bool = False
    samples: int = 0
    per_game: float | None = None
    per_user: float | None = None
    per_identity: float | None = None
    game_percent: int = FALLBACK_PERCENT
    user_percent: int = FALLBACK_PERCENT
    next_game: int = FALLBACK_PERCENT
    next_user: int = FALLBACK_PERCENT


@dataclass(frozen=True)
class Report:
    at_us: int
    event_id: int
    calls: int
    pending_before: int
    pending: int
    game_api: int
    user_api: int
    identity_api: int
    maintenance_api: int
    added_game: int
    added_user: int
    processed: int


def share(calls: int, percent: float) -> int:
    return max(0, int(calls * percent // 100))


def percent_of(calls: int, cap: int) -> int:
    return int(cap / calls * 100 + 0.5) if calls > 0 else 0


def wanted_mode(r: Report) -> tuple[int, str]:
    """The mode that a report asks for by itself, and why: the first rule that holds."""
    added = r.added_game + r.added_user
    inflow = added / r.processed if r.processed > 0 and added > 0 else 0.0
    growth = (r.pending - r.pending_before) / r.pending_before if r.pending_before > 0 else 0.0
    rules = (
        (3, "identity-queue-hard-cap", r.pending >= HARD_CAP),
        (3, "pending-emergency-enter", r.pending >= ENTER["emergency-drain"]),
        (3, "inflow-emergency-ratio", inflow >= EMERGENCY_RATIO),
        (3, "run-growth-emergency", growth >= EMERGENCY_GROWTH),
        (2, "pending-drain-enter", r.pending >= ENTER["drain"]),
        (2, "inflow-drain-ratio", inflow >= DRAIN_RATIO),
        (1, "pending-balanced-enter", r.pending >= ENTER["balanced"]),
        (0, "processed-covers-inflow", 0 < r.processed >= added),
        (0, "pending-low", r.pending < EXIT["balanced"]),
        (1, "fallback-balanced", True),
    )
    return next((mode, reason) for mode, reason, holds in rules if holds)


def next_mode(w: Worker, r: Report) -> tuple[int, str]:
    """Heavier modes at once; lighter ones one step at a time, after the mode's least time and under its exit threshold."""
    mode, reason = wanted_mode(r)
    if mode >= w.mode:
        return mode, reason
    name = OPERATION_MODES[w.mode]
    held = name != "emergency-drain" and (r.at_us - w.entered_us) // 1_000_000 < HOLD_SECONDS
    if held or r.pending > EXIT[name]:
        return w.mode, f"hysteresis-hold:{name}"
    return w.mode - 1, f"hysteresis-step-down:{OPERATION_MODES[w.mode - 1]}"


def calculated_caps(calls: int, rates: tuple[float, float, float]) -> tuple[int, int]:
    """The most calls for games and users, the larger cut first, whose projected inflow the identity calls left over can take.

    What is left over grows as caps fall, so the number of calls kept is found by bisection."""
    most_game, most_user = share(calls, BALANCED_SHARES["game"]), share(calls, BALANCED_SHARES["user"])
    least, upkeep = share(calls, BALANCED_SHARES["identity"]), share(calls, BALANCED_SHARES["maintenance"])

    def split(kept: int) -> tuple[int, int]:
        game = min(most_game, max(kept - most_user, kept // 2))
        return game, kept - game

    def fits(kept: int) -> bool:
        game, user = split(kept)
        return game * rates[0] + user * rates[1] <= max(least, calls - kept - upkeep) * rates[2] * SAFETY

    if most_game * rates[0] + most_user * rates[1] <= least * rates[2] * SAFETY:
        return most_game, most_user
    low, high = 0, most_game + most_user
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    return split(low)


def effective_caps(w: Worker, calls: int, unstable: bool) -> tuple[int, int, str]:
    """Caps on calls for games and users of the next run, and why.

    Modes but balanced have fixed shares. Balanced has one percent while observations are few, then what is calculated, of
    which it takes one percent more a run; after a run that found more than it worked off, what is calculated stands as it is."""
    name = OPERATION_MODES[w.mode]
    most = tuple(share(calls, p) for p in SHARES[name])
    if name != "balanced":
        return *most, "mode-share"
    if w.samples < LEAST_SAMPLES:
        return share(calls, FALLBACK_PERCENT), share(calls, FALLBACK_PERCENT), "insufficient-observations-fallback"
    seen = (w.per_game, w.per_user, w.per_identity)
    rates = tuple(d if v is None else v for v, d in zip(seen, DEFAULT_RATES)) if w.per_identity is not None else DEFAULT_RATES
    free = calculated_caps(calls, rates)
    safe = (w.game_percent, w.user_percent)
    asked = tuple(percent_of(calls, c) for c in free)
    risen = asked if unstable else tuple(min(a, s + RISE) for a, s in zip(asked, safe))
    game, user = (min(m, share(calls, p)) for m, p in zip(most, risen))
    left = max(share(calls, BALANCED_SHARES["identity"]), calls - sum(free) - share(calls, BALANCED_SHARES["maintenance"]))
    if unstable:
        why = "emergency-cap-reduction"
    elif risen != asked:
        why = "gradual-cap-increase"
    elif (game, user) == tuple(share(calls, s) for s in safe):
        why = "previous-safe-cap"
    else:
        # Nothing fits where even no calls for games and users leave too little: all caps are then zero.
        why = "stable-cap-maintained" if free[0] * rates[0] + free[1] * rates[1] <= left * rates[2] * SAFETY else "projected-inflow-too-high"
    return game, user, why


def average(old: float | None, part: int, whole: int) -> float | None:
    """The exponential average after one more rate; unchanged where nothing was called."""
    if whole <= 0:
        return old
    return part / whole if old is None else old * (1 - ALPHA) + part / whole * ALPHA


def observed(r: Report) -> bool:
    """Whether a report can be learned from: calls that add up, nothing negative."""
    return 0 < r.calls == r.game_api + r.user_api + r.identity_api + r.maintenance_api and min(r.pending_before, r.pending, r.processed, r.added_game + r.added_user) >= 0


def take(w: Worker, r: Report) -> tuple[Worker, tuple]:
    """The worker after a report, and the row with the mode and caps of its next run. Only balanced runs are learned from."""
    if w.mode == OPERATION_MODES.index("balanced") and observed(r):
        w = replace(
            w, samples=w.samples + 1, per_game=average(w.per_game, r.added_game, r.game_api), per_user=average(w.per_user, r.added_user, r.user_api),
            per_identity=average(w.per_identity, r.processed, r.identity_api), game_percent=w.next_game, user_percent=w.next_user,
        )
    mode, reason = next_mode(w, r)
    w = replace(w, mode=mode, entered_us=w.entered_us if mode == w.mode else r.at_us, last_us=r.at_us, told=False)
    game, user, why = effective_caps(w, r.calls, r.added_game + r.added_user > r.processed)
    w = replace(w, next_game=percent_of(r.calls, game), next_user=percent_of(r.calls, user))
    return w, (r.at_us, r.event_id, "run", OPERATION_MODES[mode], reason, game, user, why, w.samples)


#: Reports that wait as one packed value of the state, at most.
PART = 10_000
FIELDS = [f for f in Report.__dataclass_fields__ if f != "at_us"]
OUT_ROW, EPOCH = Row("worker", "at", "event_id", "kind", "mode", "reason", "game_cap", "user_cap", "cap_reason", "samples"), datetime(1970, 1, 1, tzinfo=timezone.utc)


def _packed(reports: list[tuple]) -> tuple[bytes]:
    return (np.array(reports, "<i8").tobytes(),)


def _unpacked(packed: bytes) -> list[tuple]:
    return list(map(tuple, np.frombuffer(packed, "<i8").reshape(-1, len(FIELDS) + 1).tolist()))


class CollectorProcessor(StatefulProcessor):
    """stale_us: how long a run may be silent before a row of kind stale tells of it; forget_us: when the worker is forgotten."""

    def __init__(self, stale_us: int, forget_us: int, slot_us: int):
        self.stale_us, self.forget_us, self.slot_us = stale_us, forget_us, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.worker = handle.getValueState("worker", STATE)
        self.waiting = handle.getListState("waiting", "reports binary")

    def close(self) -> None:
        pass

    def _call_at(self, us: int) -> None:
        """A timer at the end of the slot of a time."""
        self.handle.registerTimer(-(-us // self.slot_us) * self.slot_us // 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, told = None, ((r.at_us, *(r[n] for n in FIELDS)) for r in rows if r.event_id is not None)
        while part := list(islice(told, PART)):
            self.waiting.appendList([_packed(part)])
            least = min(r[0] for r in part)
            first = least if first is None else min(first, least)
        if first is not None:
            self._call_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000 // self.slot_us * self.slot_us
        before = Worker(*(self.worker.get() or ()))
        parts = [_unpacked(p[0]) for p in self.waiting.get()]
        due = sorted({r for p in parts for r in p if r[0] <= until})
        w, out = before, []
        for r in due:
            w = self._pass_time(w, r[0] - 1, out)
            w, row = take(w, Report(*r))
            out.append(row)
        w = self._pass_time(w, until, out)
        if due:
            later = [r for p in parts for r in p if r[0] > until]
            if later:
                self.waiting.put([_packed(later[i : i + PART]) for i in range(0, len(later), PART)])
                self._call_at(min(r[0] for r in later))
            else:
                self.waiting.clear()
        if w != before:
            if w.mode < 0:
                self.worker.clear()
            else:
                self.worker.update(astuple(w))
                self._call_at(w.last_us + (self.forget_us if w.told else self.stale_us))
        for at, *row in out:
            yield OUT_ROW(key[0], EPOCH + timedelta(microseconds=at), *row)

    def _pass_time(self, w: Worker, until: int, out: list) -> Worker:
        """What happens without a report up to a time: a run becomes stale, a worker is forgotten."""
        if w.mode >= 0 and not w.told and w.last_us + self.stale_us <= until:
            out.append((w.last_us + self.stale_us, None, "stale", OPERATION_MODES[w.mode], "no-report", None, None, None, w.samples))
            w = replace(w, told=True)
        return Worker() if w.mode >= 0 and w.last_us + self.forget_us <= until else w


def collector_states(reports: DataFrame, delay: str, stale_seconds: int = 180, forget_seconds: int = 30 * 86400, slot_seconds: int = 3600) -> DataFrame:
    """A row for each report (worker, at and the fields of Report) and for each run that became stale.

    Rows without event_id only let time pass. A repeated report counts once. stale_seconds must not exceed forget_seconds.
    The state needs the RocksDB store: start the stream inside rocksdb_state()."""
    return reports.withWatermark("at", delay).groupBy("worker").transformWithState(
        CollectorProcessor(stale_seconds * 1_000_000, forget_seconds * 1_000_000, slot_seconds * 1_000_000), OUT, "Append", "EventTime"
    )


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def caps_of(calls: Column, per_game: Column, per_user: Column, per_identity: Column) -> Column:
    """calculated_caps as a column: a struct of game and user. One element a call that may be kept, so calls of a run should be bounded."""
    part = lambda name: F.floor(calls * BALANCED_SHARES[name] / 100)
    game, user, least, upkeep = part("game"), part("user"), part("identity"), part("maintenance")
    kept_game = lambda kept: F.least(game, F.greatest(kept - user, F.floor(kept / 2)))
    fits = lambda kept: kept_game(kept) * per_game + (kept - kept_game(kept)) * per_user <= F.greatest(least, calls - kept - upkeep) * per_identity * F.lit(SAFETY)
    most = F.when(game * per_game + user * per_user <= least * per_identity * F.lit(SAFETY), game + user)
    kept = F.coalesce(most, F.array_max(F.filter(F.sequence(F.lit(0).cast("long"), game + user), fits)), F.lit(0))
    return F.struct(kept_game(kept).alias("game"), (kept - kept_game(kept)).alias("user"))
