"""Best-fit packing of tokenised documents into sequences of fixed length.

A document is its token ids and a closing id.  Only one longer than a sequence
is cut, from the end, so that its first piece alone may be shorter.

1. Texts are tokenised once; the pieces (not the ids) are written.  A byte-level
   vocabulary's words (in its own pattern's sense) are looked up among those that
   the task has met; only others go through the vocabulary's merges.  A text
   that holds a special token or characters beyond ``_PLAIN``, of which programs
   might disagree whether they are letters or white space, and every text of
   another kind of vocabulary, goes through the tokenizer as it is.
2. The histogram of piece lengths, one number for each length, goes to the
   driver.  Patterns of one to three lengths that fill a sequence exactly are
   enumerated; their repeat counts are fitted to the histogram by non-negative
   least squares, rounded down, and held to what the histogram has.
3. What is left is packed best fit, longest first, by counts of equal
   sequences rather than one by one.
4. Both give runs "the pieces of this length with ranks from .. to go to
   sequences base .. at this offset".  A piece finds its place from its rank
   among the pieces of its length: a count of each written partition and
   length, summed up, and a row number within them.

The driver's work depends on the sequence length, not on the documents.  Null
texts are empty and take one closing id.  Null or repeated doc_ids are packed
like others.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Workspace

LENGTH = 1024
CLOSING = 2
#: Vocabulary: a file of the installed package, or a path.
VOCABULARY = "byte_bpe_50k.json"
#: Steps of the least-squares fit.
STEPS = 400
#: Units whose ids a task keeps, twice.  Longer ones aren't kept.
KNOWN, LONG = 100_000, 64
#: Characters whose kind is the same in all versions of Unicode.
_PLAIN = re.compile("[\0-\x1b\x20-\x84\x86-\x9f\xa1-\u024f\u2010-\u2027\u2030-\u205e\u4e00-\u9fa5\U0001f300-\U0001f64f]*")
#: Where that pattern always cuts: before a run without white space, with one
#: space before it, and before a run of white space.
_UNITS = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: White space of few texts, and where a split at spaces and line ends would cut a run of white space.
_RARE = ("\t", "\v", "\f", "\r")
_INSIDE = ("   ", "  \n ", " \n  ", " \n \n ")
#: Marks that are one word of the pattern wherever they stand together after letters.
_MARKS = ".,;:!?#"
# Fixed value: the pattern of byte-level vocabularies.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_encoders: dict = {}


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as they are and
    the others, in order, as code points from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


class _Known(dict):
    """Ids of units that a task has met, of two generations of ``KNOWN``: what
    the older one alone has moves over when it is met again, the rest goes."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= LONG:
            if len(self) >= KNOWN:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Encoder:
    """Token ids of texts by a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks have a core each
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        self.by_word = made["model"]["type"] == "BPE" and not made["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.letters = _byte_letters()
        self.space = chr(self.letters[0x20])
        self.known = _Known(self._units)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _ids(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        return self._ids(word.encode().decode("latin-1").translate(self.letters))

    def _units(self, key: str) -> bytes:
        """Ids of what a key of the known ones stands for: a unit without the space
        before it, or, after ``\\n``, that and a unit, or, after ``\\r``, a unit."""
        if key.isalpha():  # one word
            return self._ids(self.space + key) if key.isascii() else self._word(" " + key)
        core = key.rstrip(_MARKS)
        if core.isalpha():  # a word and a run of marks
            return self.known[core] + self.known["\r" + key[len(core) :]]
        if key[:1] == "\n":
            return self._word("\n") + (self.known["\r" + key[1:]] if len(key) > 1 else b"")
        unit = key[1:] if key[:1] == "\r" else " " + key
        words = _WORDS.findall(unit)
        if len(words) < 2:
            return self._word(unit) if unit else b""
        return b"".join([self.known[w[1:] if w[0] == " " and len(w) > 1 else "\r" + w] for w in words])

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not self.by_word or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.whole(text), "<u4").tobytes()
        known = self.known.__getitem__
        if not any(s in text for s in _RARE):
            # A space or line end cuts unless it has white space on both sides
            # (the text's end is such): then each part that a split gives is by itself.
            lines = text.replace("\n", " \n")
            if not (("  " in lines or " \n " in lines or lines[-1:] in (" ", "\n")) and any(s in lines + " " for s in _INSIDE)):
                parts = lines.split(" ")
                parts[0] = "\r" + parts[0]
                return b"".join(map(known, parts))
        return b"".join([known("\r" + u) for u in _UNITS.findall(text)])

    def __call__(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """``vocabulary`` is a path, or the name of a file of the installed package."""
    if vocabulary not in _encoders:
        if "/" in vocabulary:
            path = vocabulary
        else:
            import public_tokenizers

            path = str(public_tokenizers.path(vocabulary))
        _encoders[vocabulary] = Encoder(path)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, length: int = LENGTH, closing: int = CLOSING, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of docs (doc_id, text)."""

    def rows(batches):
        own, close = encoder(vocabulary), np.array([closing], "<u4").tobytes()
        encode = own.packed
        try:
            for batch in batches:
                out = [], [], [], [], []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = memoryview(encode(text or "") + close)
                    ends = list(range(len(ids) // 4, 0, -length))[::-1]
                    for piece, (a, b) in enumerate(zip([0, *ends], ends)):
                        for k, x in enumerate((doc, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                            out[k].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:  # workers stay, and other operators' tasks need the memory
            own.known.forget()

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(length: int) -> np.ndarray:
    """All ways to fill a sequence with one to three lengths, (n, 3), 0 for none."""
    found = [np.array([[length, 0, 0]])]
    a = np.arange(1, length // 2 + 1)
    found.append(np.stack([length - a, a, 0 * a], 1))
    for c in range(1, length // 3 + 1):
        b = np.arange(c, (length - c) // 2 + 1)
        found.append(np.stack([length - c - b, b, np.full(len(b), c)], 1))
    return np.concatenate(found)


def fit(histogram: np.ndarray, ways: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with the least squared difference to
    the histogram (index: length), by projected gradient steps with momentum."""
    scale = max(1.0, float(histogram.max()))
    target = histogram / scale
    target[0] = 0

    def uses(x):
        out = sum(np.bincount(ways[:, k], x, len(histogram)) for k in range(ways.shape[1]))
        out[0] = 0
        return out

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[ways].sum(1)

    v = np.ones(len(ways))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(uses(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (1.02 * norm)
    x = y = np.zeros(len(ways))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0.0, y - step * back(uses(y) - target))
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t1 * (after - x)
        x, t = after, t1
    return x * scale


def plan(histogram: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (piece length, first rank, pieces, first sequence, offset), and the
    number of sequences, for a histogram of piece lengths."""
    have = np.zeros(length + 1, np.int64)
    for k, n in histogram.items():
        have[k] = n
    left, used = have.copy(), np.zeros(length + 1, np.int64)
    runs, sequences = [], 0

    def put(size, n, base, offset):
        runs.append((size, int(used[size]), n, base, offset))
        used[size] += n
        left[size] -= n

    if have.sum():
        ways = patterns(length)
        counts = np.floor(fit(have.astype(float), ways) + 1e-6).astype(np.int64)
        for w in np.argsort(-counts, kind="stable"):
            sizes = [int(s) for s in ways[w] if s]
            n = int(min(counts[w], *(left[s] // sizes.count(s) for s in sizes))) if counts[w] else 0
            if counts[w] == 0:
                break
            if n > 0:
                offset = 0
                for s in sizes:
                    put(s, n, sequences, offset)
                    offset += s
                sequences += n
    space: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, sequences)
    for size in range(length, 0, -1):
        while left[size] > 0:
            room = next((r for r in range(size, length) if space.get(r)), None)
            if room is None:
                each = length // size
                n, here = (int(left[size]) // each, each) if left[size] >= each else (1, int(left[size]))
                for k in range(here):
                    put(size, n, sequences, k * size)
                space.setdefault(length - here * size, []).append((sequences, n))
                sequences += n
                continue
            base, n = space[room].pop()
            take = min(n, int(left[size]))
            put(size, take, base, length - room)
            if n > take:
                space[room].append((base + take, n - take))
            space.setdefault(room - size, []).append((base, take))
    return runs, sequences


def pack(docs: DataFrame, length: int = LENGTH, closing: int = CLOSING, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    work = Workspace(docs.sparkSession, "packing")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = work.table(pieces(docs, length, closing, vocabulary).withColumn("part", F.spark_partition_id()), "pieces")
    counts = work.table(made.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    # one row for each length
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, length)
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    starts = runs[:, 0] << 44 | runs[:, 1]

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = made.withColumn("rank", F.row_number().over(within) - 1).join(counts, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            run = runs[np.searchsorted(starts, size << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
