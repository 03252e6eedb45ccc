"""Buckets of samples lie on pages: a backlog is written at once, and what isn't kept is never written."""

import math

import numpy as np

from kymo.streaming.operators import PAGE, Samples


class State:
    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]


def test_a_backlog_is_written_by_pages():
    state, times = State(), np.arange(500) * 10.0
    store = Samples(state, 1.0, [], [], [])
    store.add(times, times[:, None] * 2)
    saved = store.save()
    assert state.calls == -(-500 // PAGE)
    again = Samples(state, 1.0, *saved)
    t, v = again.first(1234.0, 300)
    assert t.tolist() == times[124:424].tolist() and (v[:, 0] == t * 2).all()


def test_what_is_dropped_at_once_is_never_written():
    state, times = State(), np.arange(500) * 10.0
    store = Samples(state, 1.0, [], [], [])
    store.add(times, times[:, None])
    assert store.drop_before(4985.0) == 4980.0
    assert [len(x) for x in store.save()] == [1, 1, 1] and state.calls == 1


def test_equal_to_a_plain_list():
    """Late samples, drops and saves in any order; pages whose buckets are all gone go."""
    rng, state, held, ids, at = np.random.default_rng(3), State(), [], ([], [], []), 0.0
    for n in range(200):
        store = Samples(state, 1.0, *ids)
        new = np.sort(at + rng.uniform(-5, 20, rng.integers(1, 60)))
        new = new[new >= math.floor(at - 5)]
        if len(new):
            store.add(new, new[:, None])
            held = sorted([*held, *new.tolist()])
        start = at - rng.uniform(0, 5)
        assert store.count(start) == sum(t >= start for t in held)
        some = [t for t in held if t >= start][:7]
        if some:
            assert store.first(start, 7)[0].tolist() == some
        assert store.latest(9)[0].tolist() == held[-9:]
        at += rng.uniform(0, 8)
        last = store.drop_before(at - 5)
        gone = [t for t in held if (math.floor(t) + 1) <= at - 5]
        assert last == (gone[-1] if gone else -math.inf)
        held = held[len(gone) :]
        ids = store.save()
        assert sum(ids[1]) == len(held) and {(p,) for p in ids[2]} == set(state.held)
