"""What workers hold and how often they call the state, without a session."""

import pandas as pd
import pyarrow as pa

from veilframe.operators import gazetteer
from veilframe.streaming import state


def test_spans_of_slices_are_those_of_texts():
    root = gazetteer.trie([("red car", "thing", None, 0.9), ("car", "thing", "auto", 0.5)])
    texts = ["A Red  car", None, "", "none"] * 3
    told = gazetteer._found(root, pa.array(texts, pa.string())).to_pylist()
    names = [f.name for f in gazetteer._FIELDS]
    assert told == [[dict(zip(names, s, strict=True)) for s in gazetteer.walk(root, t)] if t else [] for t in texts]
    assert gazetteer._found(root, pa.array([], pa.string())).to_pylist() == []


class _Value:
    def __init__(self):
        self.now, self.calls = None, []

    def exists(self):
        self.calls.append("exists")
        return self.now is not None

    def get(self):
        self.calls.append("get")
        return self.now

    def update(self, value):
        self.calls.append("update")
        self.now = value


def test_cache_calls_the_state_once_a_batch():
    cache = state._LastKnown(60, "k", "payload")
    cache.known = _Value()
    frame = lambda *rows: pd.DataFrame(rows, columns=["request_id", "k", "payload", "is_put"])
    run = lambda *frames: [tuple(r) for f in cache.handleInputRows((1,), iter(frames), None) for r in f.itertuples(index=False)]
    assert run(frame((1, 7, None, False))) == [(1, 7, None, False)] and cache.known.calls == ["get"]
    assert run(frame((None, 7, "a", True), (None, 7, "b", True))) == [] and cache.known.calls[1:] == ["update"]
    assert run(frame((2, 7, None, False)), frame((3, 7, None, False))) == [(2, 7, "b", True), (3, 7, "b", True)] and cache.known.calls[2:] == ["get"]
    assert run(frame((4, 7, None, False), (None, 7, None, True))) == [(4, 7, None, True)] and cache.known.calls[3:] == ["update"]
