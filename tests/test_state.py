"""How often a key's steps ask the state store, which answers over a socket."""

import pandas as pd

from auralake.streaming.trajectories import OrderedSteps


class _Store:
    """A state of each kind that counts what it is asked."""

    def __init__(self):
        self.calls, self.rows, self.value, self.map = 0, [], None, {}

    def getListState(self, *_):
        return self

    getValueState = getMapState = getListState

    def registerTimer(self, _):
        self.calls += 1

    def appendValue(self, row):
        self.calls += 1
        self.rows.append(row)

    def appendList(self, rows):
        self.calls += 1
        self.rows += rows

    def get(self):
        self.calls += 1
        return self.rows if self.value is None else self.value

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def clear(self):
        self.calls += 1
        self.rows = []

    def update(self, value):
        self.calls += 1
        self.value = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.map

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value


class _Watermark:
    def getCurrentWatermarkInMs(self):
        return 1 << 50


def test_calls_do_not_grow_with_the_steps_of_a_key():
    calls = []
    for n in (20, 2000):
        steps, store = OrderedSteps(), _Store()
        steps.init(store)
        frame = pd.DataFrame({"ts": pd.to_datetime(range(n), unit="s"), "event_id": range(n), "event_type": [("click", "view")[i % 2] for i in range(n)], "value": 1.0})
        (out,) = steps.handleInputRows(("7",), iter([frame]), _Watermark())
        assert list(out["of_kind"]) == [i // 2 + 1 for i in range(n)]
        calls.append(store.calls)
    assert calls[0] == calls[1] < 20
