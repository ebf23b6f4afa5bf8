"""Benchmark decontamination by latent semantic retrieval and verification.

1. Words (lower-cased A-Z) are hashed to ``DIMS`` terms; their document
   frequency is counted over all passages (``PASSAGE`` words each) of all
   documents, which gives the inverse document frequencies.
2. A randomised SVD of the passages' TF-IDF matrix A: tasks add up their part
   of ``A.T @ (A @ G)`` for a fixed Gaussian G, term by term; the sum (terms by
   rank, whatever the corpus) is decomposed on the driver.  Directions are
   scaled by their singular values, so common wording doesn't outweigh the rest.
3. Latent vectors are added up over blocks of two words, and blocks to windows
   of four widths at strides of a quarter.  Each benchmark item is compared by
   cosine to the windows of the width nearest to its own length, those of the
   least width also to the next.  Items of fewer than ``SHORT`` words are besides
   looked up word for word (cosine 1), as a window's other words may drown them.
4. Candidates with enough of the item's words are read again around the window:
   the longest common subsequence must cover ``LCS`` of the item's words and
   ``ANSWER`` of its last quarter (where an answer stands), in order.

The benchmark is taken in blocks of ``BLOCK`` items.  Items without words are
ignored; one of fewer than ``SHORT`` words must be there in full.  Null or
empty texts match nothing.  Rows with a null doc_id or item_id are reported
with it.  Repeated rows are reported once each pair.  Empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Workspace
from ._words import Words, chunks, rolling, text_buffers

DIMS = 4096
RANK = 128
PASSAGE = 32
WIDTHS = (8, 16, 32, 64)
COSINE = 0.5
LCS = 0.6
ANSWER = 0.5
SHORT = 8
BLOCK = 2000
#: Bytes of text that are held as latent vectors at a time (some MB of them).
CHUNK = 1 << 17
#: Terms of a block in which tasks send their sums.
SENT = 256


def _parts(batch, limit=CHUNK):
    data, offsets = text_buffers(batch.column("text"))
    for i, j in chunks(offsets, limit):
        words = Words(data, offsets, i, j)
        if len(words.starts):
            yield i, words, words.hashes(True)


def _terms(hashes, dims):
    return (hashes % np.uint64(dims)).astype(np.int64)


def _passages(words, passage):
    """First word of each passage of a chunk."""
    n = -(-words.counts // passage)
    doc = np.repeat(np.arange(words.n_docs), n)
    return words.first_word[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * passage


def _padded(words, term, multiple, extra, zero):
    """Terms with each document filled up with ``zero`` to a multiple and some
    more: (terms, place of each word, first place of each document)."""
    full = np.where(words.counts > 0, -(-words.counts // multiple) * multiple + extra, 0)
    begin = np.cumsum(full) - full
    at = np.arange(len(term)) + np.repeat(begin - words.first_word[:-1], words.counts)
    out = np.full(int(full.sum()), zero, np.int64)
    out[at] = term
    return out, at, begin


def _summed(rows, q):
    """Sum of the rows that each line of q names, without a row for each word."""
    out = np.take(rows, q[:, 0], axis=0, mode="clip")
    held = np.empty_like(out)
    for k in range(1, q.shape[1]):
        out += np.take(rows, q[:, k], axis=0, out=held, mode="clip")
    return out


def frequencies(docs: DataFrame, dims: int = DIMS, passage: int = PASSAGE) -> tuple[np.ndarray, int]:
    """Passages with each term, and the number of passages."""

    def counts(batches):
        df, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for _, words, hashes in _parts(batch):
                first = _passages(words, passage)
                own = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(hashes)]))
                key = own * dims + _terms(hashes, dims)
                key.sort()
                df += np.bincount(key[np.r_[True, key[1:] != key[:-1]]] % dims, minlength=dims)
                n += len(first)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims, dtype=np.int32)), pa.array(np.r_[n, df])], ["term", "n"])

    rows = docs.select("text").mapInArrow(counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(dims + 1, np.int64)
    if rows.num_rows:
        out[rows.column("term").to_numpy() + 1] = rows.column("n").to_numpy()
    return out[1:], int(out[0])


def latent(docs: DataFrame, dims: int = DIMS, rank: int = RANK, passage: int = PASSAGE) -> np.ndarray:
    """(dims, rank): the latent vector of each term, weighted by its idf."""
    df, n = frequencies(docs, dims, passage)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(1e-3)
    wide = rank + 8
    gauss = np.random.Generator(np.random.PCG64(11)).standard_normal((dims, wide)).astype(np.float32) * idf[:, None]

    gauss = np.vstack([gauss, np.zeros((1, wide), np.float32)])
    weight = np.append(idf**2, np.float32(0))

    def sums(batches):
        total = np.zeros((wide, dims))
        for batch in batches:
            for _, words, hashes in _parts(batch):
                term = _terms(hashes, dims)
                padded, at, _ = _padded(words, term, passage, 0, dims)
                q = padded.reshape(-1, passage)
                y = _summed(gauss, q) / weight[q].sum(1)[:, None]
                y, own = np.ascontiguousarray(y.T, np.float64), at // passage
                held = np.empty(len(own))
                for k in range(wide):
                    total[k] += np.bincount(term, np.take(y[k], own, out=held, mode="clip"), dims)
        total = (total.T * idf[:, None]).astype(np.float32)
        for b in range(0, dims, SENT):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([total[b : b + SENT].tobytes()], pa.binary())], ["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    # dims * wide numbers, however large the corpus
    rows = docs.select("text").mapInArrow(sums, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").toArrow()
    whole = np.zeros((dims, wide))
    for block, part in zip(rows.column("block").to_pylist(), rows.column("sums").to_pylist()):
        whole[block : block + SENT] = np.frombuffer(part).reshape(-1, wide)
    u, s, _ = np.linalg.svd(whole, full_matrices=False)
    keep = s[:rank] > 1e-9 * max(s[0], 1e-30)
    u = u[:, :rank] * np.where(keep, 1 / np.sqrt(np.where(keep, s[:rank], 1)), 0)
    return (u * idf[:, None]).astype(np.float32)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each element of a."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = where.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class _Items:
    """A block of benchmark items, ready to be compared."""

    def __init__(self, ids, texts, vectors, dims):
        data, offsets = text_buffers(pa.array(texts, pa.large_string()))
        words = Words(data, offsets, 0, len(texts)) if len(texts) else None
        hashes = words.hashes(True) if len(texts) else np.zeros(0, np.uint64)
        used = [k for k in range(len(texts)) if words.counts[k]]
        self.ids = [ids[k] for k in used]
        self.words = [hashes[words.first_word[k] : words.first_word[k + 1]] for k in used]
        self.lists = [w.tolist() for w in self.words]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.latent = _unit(np.stack([vectors[_terms(w, dims)].sum(0) for w in self.words])) if used else np.zeros((0, vectors.shape[1]), np.float32)
        self.vocabulary = np.unique(np.concatenate(self.words)) if used else np.zeros(0, np.uint64)
        self.has = np.zeros((len(used), len(self.vocabulary) + 1), bool)
        for k, w in enumerate(self.words):
            self.has[k, np.searchsorted(self.vocabulary, w)] = True
        bounds = np.sqrt(np.array(WIDTHS[:-1]) * np.array(WIDTHS[1:]))
        self.width = np.searchsorted(bounds, self.sizes)
        #: Words of short items -> hash of their run -> the items.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k in np.flatnonzero(self.sizes < SHORT).tolist():
            size = int(self.sizes[k])
            self.short.setdefault(size, {}).setdefault(int(rolling(self.words[k], size)[0]), []).append(k)


def find(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, least: float = LCS, answer: float = ANSWER, dims: int = DIMS, rank: int = RANK, row: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) of each document and benchmark
    item found in it; docs (doc_id, text), benchmark (item_id, text).

    ``row`` names a long column by which the caller knows rows again: with it,
    rows are reported each, and it is returned as ``row``.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontaminate")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(row) if row else F.lit(0)).cast("long").alias("row"), "text")
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    vectors = latent(docs, dims, rank)
    blocks = max(1, -(-benchmark.count() // BLOCK))
    found = None
    for b in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK rows
        items = _Items([r["item_id"] for r in own], [r["text"] for r in own], vectors, dims)
        shared = spark.sparkContext.broadcast((vectors, items))
        part = docs.mapInArrow(_search(shared, cosine, least, answer, dims), "doc_id long, row long, item_id long, cosine double, lcs double, answer double")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("lcs", "cosine", "answer")).alias("b")
    found = found.groupBy("doc_id", "row", "item_id").agg(best)
    return work.table(found.select("doc_id", *(["row"] if row else []), "item_id", *(F.round(f"b.{c}", 6).alias(c) for c in ("cosine", "lcs", "answer"))), "found")


def _search(shared, cosine, least, answer, dims):
    def rows(batches):
        vectors, items = shared.value
        vectors = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            out = [], [], [], [], [], []
            lowest = int(items.width.min()) if len(items.ids) else 0
            for i, words, hashes in _parts(batch) if len(items.ids) else ():
                padded, _, first = _padded(words, _terms(hashes, dims), WIDTHS[-1] // 4, WIDTHS[-1] * 3 // 4, dims)
                block = _summed(vectors, padded.reshape(-1, WIDTHS[lowest] // 4))
                at = np.searchsorted(items.vocabulary, hashes)
                at[(at < len(items.vocabulary)) & (items.vocabulary[np.minimum(at, len(items.vocabulary) - 1)] != hashes)] = len(items.vocabulary)
                best: dict = {}
                for k, width in enumerate(WIDTHS[lowest:], lowest):
                    stride = width // 4
                    if k > lowest:  # blocks of twice the words
                        block = block[0::2] + block[1::2]
                    mine = np.flatnonzero((items.width == k) | ((items.width == 0) & (k == 1)))
                    if not len(mine):
                        continue
                    window = block[:-3] + block[1:-2]
                    window += block[2:-1]
                    window += block[3:]
                    least_dot = cosine * np.sqrt(np.einsum("ij,ij->i", window, window))
                    near = window @ items.latent[mine].T
                    hit = np.flatnonzero(near.max(1) >= np.maximum(least_dot, 1e-12))
                    doc = np.searchsorted(first, hit * stride, side="right") - 1
                    place = hit * stride - first[doc]
                    hit, doc, place = (x[place < words.counts[doc]] for x in (hit, doc, place))
                    begin = words.first_word[doc] + place
                    end = np.minimum(begin + width, words.first_word[doc + 1])
                    near = near[hit] / (least_dot[hit] / cosine)[:, None]
                    w, m = np.nonzero(near >= cosine)
                    if not len(w):
                        continue
                    # words of the window that the item has: no subsequence is longer
                    item = mine[m]
                    span = begin[w][:, None] + np.arange(width)
                    inside = span < end[w][:, None]
                    common = (items.has[item[:, None], at[np.minimum(span, len(at) - 1)]] & inside).sum(1)
                    some = common >= 0.5 * least * np.minimum(items.sizes[item], end[w] - begin[w])
                    for x, y, c in zip(w[some].tolist(), item[some].tolist(), near[w[some], m[some]].tolist()):
                        best.setdefault((int(doc[x]), y), []).append((int(begin[x]), int(end[x]), c))
                for size, known in items.short.items():
                    runs = rolling(hashes, size)
                    at_run = np.flatnonzero(np.isin(runs, np.array(list(known), np.uint64)))
                    doc = np.searchsorted(words.first_word, at_run, side="right") - 1
                    inside = at_run + size <= words.first_word[doc + 1]
                    for d, h in set(zip(doc[inside].tolist(), runs[at_run[inside]].tolist())):
                        for y in known[h]:
                            for o, v in zip(out, (ids[i + d], keys[i + d], items.ids[y], 1.0, 1.0, 1.0)):
                                o.append(v)
                for (d, y), spans in best.items():
                    size = int(items.sizes[y])
                    low, high = int(words.first_word[d]), int(words.first_word[d + 1])
                    target, tail = items.lists[y], items.lists[y][-max(1, size // 4) :]
                    done = -1
                    for begin, end, c in sorted(spans):
                        a, b = max(low, begin - size), min(high, end + size)
                        if (a, b) == done:
                            continue
                        done = (a, b)
                        # words that the item lacks are in no common subsequence
                        region = hashes[a:b][items.has[y, at[a:b]]].tolist()
                        enough = (least if size >= SHORT else 1.0) - 1e-9
                        length = lcs(target, region) / size if len(region) >= enough * size else 0.0
                        if length >= enough:
                            end_part = lcs(tail, region) / len(tail)
                            if end_part >= answer:
                                for o, v in zip(out, (ids[i + d], keys[i + d], items.ids[y], c, length, end_part)):
                                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], ["doc_id", "row", "item_id", "cosine", "lcs", "answer"])

    return rows
