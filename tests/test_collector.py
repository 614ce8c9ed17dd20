"""The collector's stream against plain loops, and its independence from how reports are dealt into micro-batches."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from matchloom.plans import registry
from matchloom.streaming.collector import DEFAULT_RATES, OPERATION_MODES, CollectorProcessor, Report, Worker, calculated_caps, caps_of, collector_states, next_mode, rocksdb_state, take
from matchloom.streaming.jobs import run_once

FIELDS = [f for f in Report.__dataclass_fields__]


def cut_down(calls, game_rate, user_rate, identity_rate):
    """Caps by taking one call away at a time."""
    game, user = calls * 25 // 100, calls * 15 // 100
    if game * game_rate + user * user_rate <= calls * 55 // 100 * identity_rate * 0.9:
        return game, user
    while (game or user) and game * game_rate + user * user_rate > max(calls * 55 // 100, calls - game - user - calls * 5 // 100) * identity_rate * 0.9:
        game, user = (game - 1, user) if game >= user else (game, user - 1)
    return game, user


def test_caps_equal_cutting_one_call_at_a_time(spark):
    rng = random.Random(4)
    cases = [(n, rng.choice([0.0, rng.random() * 3]), rng.choice([0.0, rng.random()]), rng.choice([0.0, rng.random() * 2])) for n in [0, 1, 2, 7, 19, 20, 100, 500] + [rng.randint(1, 900) for _ in range(120)]]
    want = [cut_down(*c) for c in cases]
    assert [calculated_caps(c[0], c[1:]) for c in cases] == want and len(set(want)) > 40
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n long, g double, u double, p double")
    got = df.select("i", caps_of(F.col("n"), F.col("g"), F.col("u"), F.col("p")).alias("c")).orderBy("i").collect()
    assert [tuple(r.c) for r in got] == want
    assert calculated_caps(500, (0.1, 0.05, 1.5)) == (125, 75)
    game, user = calculated_caps(500, (2.0, 0.5, 0.4))
    assert game < 125 and user <= 75


def report(second, event, **other):
    base = dict(calls=100, pending_before=100, pending=100, game_api=10, user_api=5, identity_api=80, maintenance_api=5, added_game=1, added_user=0, processed=40)
    return Report(at_us=second * 1_000_000, event_id=event, **(base | other))


def test_modes_rise_at_once_and_fall_by_steps():
    w = Worker()
    seen = []
    for second, pending in [(0, 25_000), (10, 13_000), (20, 13_000), (400, 6_900), (800, 6_900), (1200, 3_000), (1300, 12_000), (1400, 100), (1700, 100)]:
        w, row = take(w, report(second, second, pending_before=pending, pending=pending))
        seen.append((row[3], row[4]))
    assert seen == [
        ("emergency-drain", "pending-emergency-enter"), ("drain", "hysteresis-step-down:drain"), ("drain", "pending-drain-enter"), ("balanced", "hysteresis-step-down:balanced"),
        ("balanced", "pending-balanced-enter"), ("expansion", "hysteresis-step-down:expansion"), ("drain", "pending-drain-enter"), ("drain", "hysteresis-hold:drain"),
        ("balanced", "hysteresis-step-down:balanced"),
    ]
    assert next_mode(Worker(), report(0, 1, pending=100_000)) == (3, "identity-queue-hard-cap")
    assert next_mode(Worker(), report(0, 1, added_game=90, processed=40)) == (2, "inflow-drain-ratio")
    assert next_mode(Worker(), report(0, 1, added_game=200, processed=40)) == (3, "inflow-emergency-ratio")
    assert next_mode(Worker(), report(0, 1, added_game=9, processed=0, pending=4000, pending_before=4000)) == (1, "fallback-balanced")
    assert next_mode(Worker(), report(0, 1, pending=125)) == (3, "run-growth-emergency")


def test_caps_start_at_one_percent_and_rise_slowly():
    w, rows = Worker(), []
    for k in range(8):
        w, row = take(w, report(k * 400, k, calls=500, pending_before=6000, pending=6000, game_api=25, user_api=5, identity_api=465, maintenance_api=5, added_game=2, processed=400))
        rows.append(row)
    assert [r[3] for r in rows] == ["balanced"] * 8
    assert [r[7] for r in rows] == ["insufficient-observations-fallback"] * 3 + ["gradual-cap-increase"] * 5
    assert [r[5] for r in rows] == [5, 5, 5, 10, 15, 20, 25, 30] and [r[8] for r in rows] == [0, 1, 2, 3, 4, 5, 6, 7]
    # Calls that do not add up teach nothing; a run that finds more than it works off gets what is calculated, not a percent more.
    w2, _ = take(w, report(9000, 9, calls=500, pending_before=6000, pending=6000))
    assert w2.samples == w.samples
    _, row = take(w, report(9000, 9, calls=500, pending_before=6000, pending=6000, game_api=25, user_api=5, identity_api=465, maintenance_api=5, added_game=50, processed=40))
    assert row[7] == "emergency-cap-reduction" and (row[5], row[6]) == tuple(int(500 * int(c / 5 + 0.5) // 100) for c in cut_down(500, w.per_game * 0.75 + 0.5, w.per_user * 0.75, w.per_identity * 0.75 + 40 / 465 * 0.25))


def replay(reports, stale_us, forget_us, end_us):
    """All rows of a worker by one loop over its reports in order of time, up to a time."""
    w, rows = Worker(), []
    for at, event in sorted({(r.at_us, r.event_id) for r in reports}):
        r = next(x for x in reports if (x.at_us, x.event_id) == (at, event))
        if w.mode >= 0 and at - w.last_us > stale_us:
            rows.append((w.last_us + stale_us, None, "stale", OPERATION_MODES[w.mode], "no-report", None, None, None, w.samples))
        if w.mode >= 0 and at - w.last_us > forget_us:
            w = Worker()
        w, row = take(w, r)
        rows.append(row)
    if w.mode >= 0 and w.last_us + stale_us <= end_us:
        rows.append((w.last_us + stale_us, None, "stale", OPERATION_MODES[w.mode], "no-report", None, None, None, w.samples))
    return rows


def as_rows(df):
    return sorted(((r.worker, r.at_us, r.event_id, r.kind, r["mode"], r.reason, r.game_cap, r.user_cap, r.cap_reason, r.samples) for r in df.withColumn("at_us", F.unix_micros("at")).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_do_not_depend_on_micro_batches(spark, tmp_path, seed):
    """Reports up to two hours out of order, some twice, in one, two or four parts; a worker that is silent for long; one report too late."""
    rng = random.Random(seed)
    reports = {w: [] for w in (1, 2, 3)}
    for e in range(90):
        worker = rng.choice([1, 1, 2])
        second = int(e * 1300 + rng.randint(0, 5000))
        reports[worker].append(Report(second * 1_000_000 + rng.randint(0, 999), e, 100, rng.randint(4000, 6000), rng.choice([100, 5500, 5600, 12_000, 25_000]), 10, 5, 80, 5, rng.randint(0, 12), 0, rng.choice([0, 10, 60])))
    reports[3] = [Report(s * 3600 * 1_000_000, 1000 + s, 100, 100, 6000, 10, 5, 80, 5, 1, 0, 50) for s in (1, 31)]
    epoch = datetime(1970, 1, 1)
    rows = [(w, epoch + timedelta(microseconds=r.at_us), *(getattr(r, f) for f in FIELDS)) for w, x in reports.items() for r in x]
    schema = "worker long, at timestamp, " + ", ".join(f"{f} long" for f in FIELDS)
    twice = rows + rng.sample(rows, 10)
    stale, forget, end = 2 * 3_600_000_000, 20 * 3_600_000_000, 80 * 3_600_000_000
    want = sorted(((w, *row) for w, x in reports.items() for row in replay(x, stale, forget, end)), key=str)
    assert {r[3] for r in want} == {"run", "stale"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for parts in ((1, 3) if seed == 1 else (2,)):
            folder = str(tmp_path / f"p{parts}")
            order = sorted(twice, key=lambda r: r[1] + timedelta(seconds=rng.randint(0, 7200)))
            size = -(-len(order) // parts)
            late = [(1, epoch + timedelta(hours=1), 3_600_000_000, 9999, 100, 1, 1, 10, 5, 80, 5, 0, 0, 0)]
            batches = [order[i * size : (i + 1) * size] for i in range(parts)] + [[(None, epoch + timedelta(hours=84, seconds=1), *[None] * len(FIELDS))], late]
            for k, batch in enumerate(batches):
                rng.shuffle(batch)
                spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
                states = collector_states(spark.readStream.schema(schema).parquet(f"{folder}/in"), "4 hours", stale // 1_000_000, forget // 1_000_000, 600)
                with rocksdb_state(spark):
                    run_once(states.writeStream.format("parquet").option("path", f"{folder}/out"), f"{folder}/state")
            assert as_rows(spark.read.parquet(f"{folder}/out")) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


class _Handle:
    """State of one key in memory; timers is what was registered."""

    def __init__(self):
        self.timers, self.value, self.list, self.asked = [], None, [], 0

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        return _Waiting(self)

    def registerTimer(self, ms):
        self.timers.append(ms)

    def get(self):
        self.asked += 1
        return self.value

    def exists(self):
        self.asked += 1
        return self.value is not None

    def update(self, value):
        self.value = value


class _Waiting:
    def __init__(self, handle):
        self.h = handle

    def exists(self):
        return bool(self.h.list)

    def get(self):
        return iter(self.h.list)

    def appendList(self, rows):
        self.h.list += rows

    def put(self, rows):
        self.h.list = rows

    def clear(self):
        self.h.list = []


def test_a_worker_has_one_timer_for_all_its_slots():
    """A timer for each slot was set before, each a call of its own once the watermark had passed them all."""
    h, hour = _Handle(), 3600
    p = CollectorProcessor(10**15, 10**15, hour * 1_000_000)
    p.init(h)
    reports = [report(hour * k + 60, k) for k in range(50)]
    p.handleInputRows((1,), (Row(**{f: getattr(r, f) for f in FIELDS}) for r in reports[25:] + reports[:25]), None)
    assert h.timers == [hour * 1000]
    rows = list(p.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: hour * 10_000), None))
    assert len(rows) == 10 and h.timers[1] == hour * 11_000 and len(h.timers) == 3
    rows = list(p.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: hour * 90_000), None))
    assert [r.event_id for r in rows] == list(range(10, 50)) and not h.list


def test_collector_modes_equals_a_plain_loop(spark, sf):
    from matchloom.plans.streams import run_reports

    reports = {}
    for r in run_reports(spark, sf).collect():
        reports.setdefault(r.worker, []).append(Report(*(r[f] for f in FIELDS)))
    end = 10**18
    want = sorted(((w, *row) for w, x in reports.items() for row in replay(x, 86_400_000_000, 30 * 86_400_000_000, end)), key=str)
    got = as_rows(registry.queries()["collector_modes"](spark, sf))
    assert got == want and {r[4] for r in got} == set(OPERATION_MODES)


def test_rates_without_observations():
    assert DEFAULT_RATES == (0.35, 0.08, 0.55)
