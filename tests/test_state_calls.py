"""Keyed streams ask the state store for a key's values a fixed number of times, whatever its rows: each call leaves the process."""

from types import SimpleNamespace

from pyspark.sql import Row

from tessera.streaming import state


class Store:
    """Values, lists and timers of one key, and the calls made."""

    def __init__(self):
        self.calls, self.values, self.timers = [], {}, set()

    def _variable(self, name):
        def call(what, change=None):
            self.calls.append(what)
            if change is not None:
                self.values[name] = change(self.values.get(name))
            return self.values.get(name)

        return SimpleNamespace(
            get=lambda: call("get"), update=lambda v: call("update", lambda _: v), clear=lambda: self.values.pop(name, None),
            put=lambda v: call("put", lambda _: v), appendList=lambda v: call("append", lambda old: [*(old or []), *v])
        )

    def getValueState(self, name, schema):
        return self._variable(name)

    def getListState(self, name, schema):
        found = self._variable(name)
        return SimpleNamespace(**{**vars(found), "get": lambda get=found.get: iter(get() or [])})

    def registerTimer(self, at):
        self.calls.append("timer"), self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("timer"), self.timers.discard(at)


def batch(processor, store, rows, mark=0):
    store.calls.clear()
    return list(processor.handleInputRows(("k",), iter(rows), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)))


def test_sessions_read_and_write_a_key_once(monkeypatch):
    """ten thousand triggers of a key need no more calls than one; repeats count once, old ones are forgotten."""
    store, p = Store(), state.Sessions(1000)
    p.init(store)
    rows = [Row(trigger=i % 10_000, at_ms=i % 10_000) for i in range(20_000)]
    assert batch(p, store, rows) == [Row(key="k", triggers=10_000, last=9999, at_ms=9999, idle=False)] and len(store.calls) <= 6
    assert batch(p, store, rows) == [] and store.timers == {10_999}
    assert batch(p, store, [Row(trigger=10_000, at_ms=9998)], 9000)[0].triggers == 10_001 and len(store.calls) <= 6
    assert len(store.values["recent"]) == 1001 and store.timers == {10_999}


def test_changes_read_and_write_a_key_once():
    """one read and one write a key; a key whose rows change nothing is not written."""
    store, p = Store(), state.FileChanges()
    p.init(store)
    rows = [Row(seq=i, hash=str(i // 2), deleted=False) for i in range(6)]
    assert [(r.change, r.hash) for r in batch(p, store, rows)] == [("added", "0"), ("modified", "1"), ("modified", "2")] and store.calls == ["get", "update"]
    assert batch(p, store, rows) == [] and store.calls == ["get"]
