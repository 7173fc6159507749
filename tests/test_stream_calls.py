import pandas as pd

from tallyloom.streaming import targets


class Handle:
    """Counts calls of the state store, each of which is a round trip on a cluster."""

    def __init__(self):
        self.state, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.state is not None

    def get(self):
        return self.state

    def update(self, state):
        self.state = state

    def registerTimer(self, at):
        self.calls, self.timers = self.calls + 1, self.timers | {at}

    def deleteTimer(self, at):
        self.calls, self.timers = self.calls + 1, self.timers - {at}


def test_days_within_a_batch_set_one_timer():
    day, handle, processor = 86_400_000_000, Handle(), targets._processor()
    processor.init(handle)
    rows = pd.DataFrame({"us": [d * day + 5 for d in range(20, 0, -1)], "seq": range(20), "score": [70.0] * 20})
    list(processor.handleInputRows((1,), iter([rows[:9], rows[9:]]), None))
    assert handle.calls == 1 and handle.timers == {21 * day // 1000} and handle.state[0] == 20
    list(processor.handleInputRows((1,), iter([rows]), None))
    assert handle.calls == 1 and handle.state[0] == 20
    later = rows.assign(us=rows["us"] + 20 * day)
    list(processor.handleInputRows((1,), iter([later]), None))
    assert handle.calls == 3 and handle.timers == {41 * day // 1000} and handle.state[0] == 40
