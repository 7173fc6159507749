import tracemalloc

import numpy as np
import pyarrow as pa

from tallyloom.operators import semantics


class Rows:
    """Takes what a task would run."""

    def select(self, *_):
        return self

    groupBy = applyInArrow = select

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def toLocalIterator(self):
        return iter([])


def test_a_task_holds_some_rows_of_a_batch_at_a_time():
    rows, n, each, rng = Rows(), 8000, 200, np.random.default_rng(1)
    semantics.gram_times(rows, np.ones(512), rng.standard_normal((512, 4)))
    words = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * each, each), pa.int32()), pa.array(rng.integers(0, 512, n * each), pa.int32()))
    batch = pa.RecordBatch.from_arrays([words], names=["words"])
    tracemalloc.start()
    assert sum(len(b) for b in rows.run(iter([batch]))) == 512
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # one object a word would be some 60 MB
