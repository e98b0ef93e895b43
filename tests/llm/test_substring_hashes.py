import numpy as np
import pyarrow as pa

from archivolt.llm import substring_dedup as op


def test_windows_of_one_anchor_are_told_apart_by_all_64_bits():
    text = " ".join(f"w{k}" for k in range(40))
    edges = np.concatenate([x[2] for x in op.paths(pa.array([text]))])
    assert edges.dtype == np.uint64 and (edges >> np.uint64(32)).any()
    pair = np.array([5, 5 + (1 << 40)], np.uint64)
    column = op._lists(pair, np.array([0, 1]), np.array([0, 1]))
    batch = pa.RecordBatch.from_arrays([pa.array([9, 9]), pa.array([1, 2]), pa.array([False, False]), column], names=["anchor", "doc_id", "many", "edges"])
    assert op._Held.of(batch).compact().answers().num_rows == 0
