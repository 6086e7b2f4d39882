"""The matcher's calls to the state store don't grow with the rows."""

from types import SimpleNamespace

import pandas as pd

from capsight.streaming import matching


class _Store:
    """A list and a map state in memory that count their calls."""

    def __init__(self):
        self.calls, self.rows, self.map, self.timers = 0, [], {}, []

    def getListState(self, name, schema):
        return SimpleNamespace(appendList=lambda new: self._did(self.rows.extend(new)), get=lambda: iter(self._did(list(self.rows))), put=lambda new: self._did(self.rows.__setitem__(slice(None), new)), clear=lambda: self._did(self.rows.clear()))

    def getMapState(self, name, keys, values):
        return SimpleNamespace(iterator=lambda: iter(self._did(list(self.map.items()))), updateValue=lambda k, v: self._did(self.map.update({k: v})), removeKey=lambda k: self._did(self.map.pop(k)))

    def registerTimer(self, ms):
        self.timers.append(ms)

    def _did(self, value):
        self.calls += 1
        return value


def test_calls_to_the_store_are_few(spark):
    store, matcher = _Store(), matching.Matcher(3600.0)
    matcher.init(store)
    n = 3000
    rows = pd.DataFrame({"seq": range(n), "time": pd.to_datetime([k * 1_000_000 for k in range(n)], unit="us"), "is_response": [k % 2 == 1 for k in range(n)], "id": 7,
                         "src": ["a" if k % 2 == 0 else "s" for k in range(n)], "dst": ["s" if k % 2 == 0 else "a" for k in range(n)], "name": [None if k % 3 else "n" for k in range(n)]})
    list(matcher.handleInputRows((7,), iter([rows]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    (found,) = matcher.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2_000_000), None)
    assert len(found) == 1000 and found["tier"].notna().all() and len(store.rows) == 999 and store.timers[-1] == 2_001_000
    assert store.calls < 12
