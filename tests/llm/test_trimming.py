"""Workers of near-duplicate steps give memory back."""

import numpy as np
import pyarrow as pa


def test_batches_and_large_groups_give_memory_back(monkeypatch):
    from tabloom.llm import common as c
    from tabloom.llm import near_dup as n

    seen = []
    monkeypatch.setattr(c, "trimmed", lambda: seen.append(1))
    x = c.mix(np.arange(100, dtype=np.uint64))
    regs = n.registers(x, np.array([100]))[0].tobytes()
    for step, names, row in (
        (n._bands(), ["id", "regs"], [1, regs]),
        (n._signed, ["id", "n", "regs"], [1, 100, regs]),
        (n._verified(85, 0.7), ["a", "b", "ra", "rb", "na", "nb", "xa", "xb"], [1, 2, regs, regs, 100, 100, x.tobytes(), x.tobytes()]),
    ):
        seen.clear()
        out = list(step(iter([pa.record_batch([pa.array([v]) for v in row], names)])))
        assert out[0].num_rows and seen == [1]

    def group(size):
        seen.clear()
        run = n._trimming(lambda table: table)
        return run(pa.table({"id": np.arange(size)})).num_rows, len(seen)

    assert group(n.TRIM_ROWS) == (n.TRIM_ROWS, 0)
    assert group(n.TRIM_ROWS + 1) == (n.TRIM_ROWS + 1, 1)
