"""State of overdue queries: a group is read and written once, however many queries it has."""

import random

import pandas as pd

from siltstone.streaming import alerts


class Handle:
    """Stands for Spark's handle of one group."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Times:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentWatermarkInMs


def step(state, handle, rows, now):
    """What a micro-batch tells: query_id and reason."""
    said = []
    if rows:
        frame = pd.DataFrame(rows, columns=["query_id", "started_us", "ended_us", "allowed_us"])
        said += [x for f in state.handleInputRows((0,), iter([frame[:3], frame[3:]]), Times(now)) for x in zip(f.query_id, f.reason)]
    for at in sorted(t for t in handle.timers if t < now):
        handle.timers.discard(at)
        expired = Times(now)
        expired.getExpiryTimeInMs = lambda at=at: at
        said += [x for f in state.handleExpiredTimer((0,), Times(now), expired) for x in zip(f.query_id, f.reason)]
    return said


def test_state_calls_do_not_grow_with_queries():
    handle, state = Handle(), alerts._Overdue(3600)
    state.init(handle)
    none = alerts._NONE
    step(state, handle, [(f"q{i}", i * 1000, none, 10_000_000) for i in range(1000)], 0)
    assert handle.calls <= 2 and len(handle.timers) == 1
    told = step(state, handle, [], 10_501)
    assert told == [(f"q{i}", "STILL_RUNNING") for i in range(501)] and handle.calls <= 4
    assert [x[0] for x in step(state, handle, [], 20_000)] == [f"q{i}" for i in range(501, 1000)]
    assert not step(state, handle, [], 4_000_000) and handle.value is None and not handle.timers


def test_random_batches_tell_each_query_once():
    rng, none = random.Random(5), alerts._NONE
    for _ in range(30):
        handle, state = Handle(), alerts._Overdue(10**6)
        state.init(handle)
        runs = {f"q{i}": (s := rng.randrange(1000), s + rng.randrange(1, 60) if rng.random() < 0.7 else None, rng.randrange(1, 40)) for i in range(40)}
        told, now = [], 0
        for second in range(0, 1200, 50):
            rows = [(q, s * 10**6, none, limit * 10**6) for q, (s, _, limit) in runs.items() if second <= s < second + 50 for _ in range(2)]
            rows += [(q, none, e * 10**6, none) for q, (_, e, _) in runs.items() if e is not None and second <= e < second + 50]
            rng.shuffle(rows)
            told += step(state, handle, rows, now)
            now = (second + 50) * 1000
            told += step(state, handle, [], now)
        assert sorted(q for q, _ in told) == sorted(q for q, (s, e, limit) in runs.items() if e is None or e > s + limit)
