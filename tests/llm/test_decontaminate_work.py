"""What the search for benchmark items compares."""

import numpy as np
import pyarrow as pa

from quillon.llm import decontaminate

from .test_operators import prose


def test_common_words_alone_are_compared(monkeypatch):
    """The subsequence is sought among the words that the item has, and not where these are too few."""
    seen = []
    plain = decontaminate.lcs
    monkeypatch.setattr(decontaminate, "lcs", lambda a, b: seen.append((a, b)) or plain(a, b))
    items = [prose(900 + k, 24) for k in range(3)]
    texts = [f"{prose(k, 60)} {items[k % 3]} {prose(50 + k, 60)}" for k in range(6)] + [prose(70, 90), None]
    vectors = np.random.default_rng(1).standard_normal((decontaminate.DIMS, 16)).astype(np.float32)
    shared = type("Shared", (), {"value": (vectors, decontaminate._Items([0, 1, 2], items, vectors, decontaminate.DIMS))})
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array(range(8), pa.int64()), pa.array(texts)], ["doc_id", "row", "text"])
    (out,) = decontaminate._search(shared, 0.3, decontaminate.LCS, decontaminate.ANSWER, decontaminate.DIMS)([batch])
    found = set(zip(out.column("doc_id").to_pylist(), out.column("item_id").to_pylist()))
    assert {(k, k % 3) for k in range(6)} <= found
    assert seen and all(set(b) <= set(shared.value[1].lists[0]) | set(shared.value[1].lists[1]) | set(shared.value[1].lists[2]) for _, b in seen)
