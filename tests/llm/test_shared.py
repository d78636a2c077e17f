import os

import pyarrow as pa
import pytest

from trilect.llm import shared


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="reads Linux's memory figures")
def test_a_worker_gives_its_memory_back():
    """What is freed below a block in use stays with the process until it is given back."""

    def rows():
        blocks = [bytes(1000) for _ in range(100_000)]
        held.append(bytes(1000))
        held.append(resident())
        del blocks
        yield batch

    held, batch = [], pa.RecordBatch.from_pydict({"x": [1]})
    assert list(shared.lean(rows())) == [batch]
    assert resident() < held[1] - (50 << 20)
    assert shared.lean_table(pa.table({"x": [1]})).num_rows == 1
