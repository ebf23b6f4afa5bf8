"""Units that a packing task has met."""

import random

import numpy as np
import pyarrow as pa

from quillon.llm import packing

from .test_operators import make


class Captured:
    """Stands for documents: runs the function of mapInArrow on batches."""

    columns = ["text"]

    class schema:  # noqa: N801
        fields = ()

    def mapInArrow(self, function, _):  # noqa: N802
        self.function = function
        return self

    def select(self, *_):
        return self


def test_words_of_a_task_go():
    """Known units stay within two generations, and none stays after a task; the often used ones are made once."""
    encode = packing.encoder()
    docs = Captured()
    packing.pieces(docs)
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["the cat, the dog\nthe end"])], ["doc_id", "text"])
    assert sum(x.num_rows for x in docs.function([batch])) == 1
    assert not encode.known and not encode.known.older


def test_generations(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 50)
    made = []
    known = packing._Known(lambda key: made.append(key) or key.encode())
    for k in range(1000):
        assert known["often"] == b"often" and known[f"w{k}"] == f"w{k}".encode()
        assert len(known) <= 50 and len(known.older) <= 50
    assert made.count("often") == 1


def test_encoder_white_space():
    """Texts that are split at spaces and line ends, as the tokenizer does the whole."""
    encode = packing.encoder()
    rng = random.Random(5)
    parts = [" ", " ", "\n", "a", "The", "café", "end.", "no!?", "it's", "7", "x1,", "###", "...", "漢", "\U0001f600"]
    texts = ["", " ", "  ", "\n", "\n\n", " \n", "\n ", "a ", "a  ", "a\n", " a", "  a", "\n\na", "a \n b", "a\n\n\nb", "a \n"]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(4000)] + [make(k, 300) for k in range(20)]
    assert [x for x in texts if encode(x) != encode.whole(x)] == []
    assert all(encode.packed(x) == np.array(encode(x), "<u4").tobytes() for x in texts[:200])
