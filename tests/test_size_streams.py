"""Calls of the state store don't grow with the rows."""

import pandas as pd

from quillon.streaming import stateful


class _State:
    """A list or a value in memory that counts its calls."""

    def __init__(self, calls):
        self.held, self.calls = [], calls

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "appendValue":
                self.held.append(args[0])
            elif name == "update":
                self.held = list(args)
            elif name == "clear":
                self.held = []
            elif name == "exists":
                return bool(self.held)
            elif name == "get":
                return iter(self.held) if self.pieces else self.held[0]
            return None

        return call


class _Handle:
    def __init__(self):
        self.calls = []

    def _state(self, pieces):
        state = _State(self.calls)
        state.pieces = pieces
        return state

    def getListState(self, *_):  # noqa: N802
        return self._state(True)

    def getValueState(self, *_):  # noqa: N802
        return self._state(False)

    def getMapState(self, *_):  # noqa: N802
        return self._state(True)

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("registerTimer")

    deleteTimer = registerTimer  # noqa: N815


class _Now:
    def getCurrentWatermarkInMs(self):  # noqa: N802
        return stateful._closes(500)


def test_state_is_called_by_piece_not_by_row():
    n = 3000
    frame = pd.DataFrame({"day": [i % 600 for i in range(n)], "rank": 0, "seq": 0, "id": [f"r{i}" for i in range(n)], "key": "shop", "flow": 1, "printed": None, "amount": 5})
    for kind in (stateful._Balance, stateful._Claims):
        handle, processor = _Handle(), kind()
        processor.init(handle)
        list(processor.handleInputRows((1,), iter([frame]), _Now()))
        out = list(processor.handleExpiredTimer((1,), _Now(), None))
        assert len(handle.calls) < 40
        if kind is stateful._Balance:
            assert out[0]["balance"].tolist() == list(range(1, 5 * 501 + 1))
        assert sum(1 for _ in stateful._in_pieces(processor.waiting)) == n - 5 * 501
