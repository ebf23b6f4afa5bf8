"""What the operators hold at a time."""

import tracemalloc

import pandas as pd
import pyarrow as pa

from quillon.llm import language_id, ngram_join

from .test_operators import prose


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


def peak(work):
    tracemalloc.start()
    work()
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return held / 1e6


def test_memory_of_a_chunk():
    """4 MB of short documents are worked on in small parts."""
    texts = [prose(k, 100) for k in range(100)]
    texts = (texts * (1 + 4_000_000 // sum(map(len, texts))))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert peak(lambda: [len(x[2]) for x in ngram_join._sets(batch, 5)]) < 25

    class Profiles:
        def toPandas(self):  # noqa: N802
            return pd.DataFrame({"lang": ["en", "fr"], "gram": [1, 2], "place": [1, 1]})

    docs = Captured()
    language_id.identify(docs, Profiles())
    assert peak(lambda: sum(x.num_rows for x in docs.function([batch]))) < 50
