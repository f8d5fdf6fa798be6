"""What rows cost that wait in the state store, counted on a store that only counts."""

from types import SimpleNamespace

from lodestar.streaming import keyed


class Store:
    def __init__(self):
        self.entries, self.value, self.calls = [], None, 0

    def appendValue(self, entry):
        self.entries.append(entry)
        self.calls += 1

    def appendList(self, entries):
        self.entries += entries
        self.calls += 1

    def put(self, entries):
        self.entries = entries
        self.calls += 1

    def get(self):
        self.calls += 1
        return iter(self.entries)

    def clear(self):
        self.entries = []
        self.calls += 1


class Held(Store):
    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_a_batchs_rows_wait_as_one_entry():
    waiting, held, timers = Store(), Held(), []
    handle = SimpleNamespace(getValueState=lambda *_: held, getListState=lambda *_: waiting, registerTimer=timers.append)
    processor = keyed.Batches(30, 3600)
    processor.init(handle)
    row = lambda i: SimpleNamespace(at=i * 1_000_000, id=i, word="")
    for part in (range(50, 100), range(50)):
        assert list(processor.handleInputRows((7,), map(row, part), None)) == []
    assert len(waiting.entries) == 2 and waiting.calls == 2 and timers == [50_001, 1]
    fire = lambda ms: [tuple(r) for r in processor.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: ms), None)]
    assert fire(70_000) == [(7, 0, 30, 0.0), (7, 1, 30, 30.0)]
    assert len(waiting.entries) == 1 and sum(len(x) for x in waiting.entries[0]) == 3 * 29
    assert fire(10_000_000) == [(7, 2, 30, 60.0), (7, 3, 10, 90.0)] and waiting.entries == []
