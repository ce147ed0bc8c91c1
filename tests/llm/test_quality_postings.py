import numpy as np

from sparkloom.llm import quality


def test_postings_hold_each_document_of_a_key_once():
    (row,) = quality._posted(np.zeros(4, np.int32), np.array([9, 5, 5, 5]), np.array([2, 3, 1, 3]), 0)
    sizes, at, times = (quality._unplaned(row.column(c)[0].as_buffer()).tolist() for c in ("sizes", "at", "times"))
    assert quality._unpacked(row.column("keys")[0].as_buffer()).tolist() == [5, 9]
    assert (sizes, at, times) == ([2, 1], [1, 3, 2], [1, 2, 1])
