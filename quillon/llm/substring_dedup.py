"""Substring dedup: removes words inside windows that a document with a smaller id has too.

A window is ``WINDOW`` consecutive words.  Its minimiser is the least hash
among the ``GRAM``-word runs inside it, so equal windows have equal minimisers,
and consecutive windows mostly share theirs.  Such a run of windows (a
super-k-mer) travels as one packed string of word hashes to its minimiser's
bucket, where the windows are sorted and each one's first document is found.

1. Minimisers are counted: smallest and largest doc_id and runs, pre-aggregated
   in each batch.  One that only a single document has can't repeat.
2. The shared ones make a Bloom filter of bounded size (a false positive only
   costs traffic).  Only runs that pass it are packed and sent; equal strings
   are aggregated to their smallest doc_id before they are dealt out.
3. Buckets sort the windows of their strings.  A minimiser with more runs than
   ``HOT`` is not gathered in a bucket: its windows are aggregated by their own
   hash instead, which pre-aggregates and spreads, with the same result.
4. Spans that an earlier document has go back to each occurrence, and each
   text is rewritten once.

Words are known by 64-bit hashes, windows by 64 bits more beside the minimiser.
Null texts have no words.  Rows with a null doc_id are kept whole and mark
nothing.  Rows with equal doc_ids never remove from each other.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Workspace
from ._words import Words, chunks, mix64, rolling, rolling_long, text_buffers

WINDOW = 50
GRAM = 8
#: Runs of one minimiser that a bucket takes; others go the aggregated way.
HOT = 20_000
#: Bytes of packed strings that a bucket is to hold.
BUCKET_BYTES = 24 << 20
#: Most bits of the Bloom filter (32 MB).
BLOOM_BITS = 1 << 28


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _runs(batch, window: int, gram: int):
    """Of each chunk: (first row, row of each run, its first word in the row,
    windows, minimiser, its first word in the chunk, word hashes)."""
    data, offsets = text_buffers(batch.column("text"))
    for i, j in chunks(offsets):
        words = Words(data, offsets, i, j)
        if len(words.starts) < window:
            continue
        hashes = words.hashes()
        least = _sliding_min(rolling(hashes, gram), window - gram + 1)
        doc = np.repeat(np.arange(words.n_docs), words.counts)
        at = np.arange(len(least))
        valid = doc[at] == doc[at + window - 1]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (doc[at[1:]] != doc[at[:-1]])
        first = np.flatnonzero(begins)
        if not len(first):
            continue
        run = np.cumsum(begins)[valid] - 1
        length = np.bincount(run, minlength=len(first))
        rows = doc[first]
        yield i, rows, first - words.first_word[rows], length, least[first], first, hashes


def _minimisers(window: int, gram: int):
    def rows(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            found = [(least, ids[i + rows_]) for i, rows_, _, _, least, _, _ in _runs(batch, window, gram)]
            if found:
                m, d = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                order = np.lexsort((d, m))
                m, d = m[order], d[order]
                first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
                last = np.r_[first[1:], len(m)] - 1
                yield pa.RecordBatch.from_arrays([pa.array(m[first].view(np.int64)), pa.array(d[first]), pa.array(d[last]), pa.array(last - first + 1)], ["m", "lo", "hi", "runs"])

    return rows


def _bits(m: np.ndarray, bits: int):
    a, b = m & np.uint64(0xFFFFFFFF), (m >> np.uint64(32)) | np.uint64(1)
    return [(a + np.uint64(k) * b) & np.uint64(bits - 1) for k in range(4)]


def bloom(keys: DataFrame, column: str, n: int) -> tuple[np.ndarray, int]:
    """A Bloom filter over a column of mixed 64-bit hashes: its words, its bits.

    Its size follows n up to BLOOM_BITS, so what reaches the driver is bounded.
    """
    bits = 1 << 16
    while bits < min(16 * n, BLOOM_BITS):
        bits *= 2

    def words(batches):
        for batch in batches:
            m = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate(_bits(m, bits)))
            if len(at):
                word = at >> np.uint64(6)
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(value.view(np.int64))], ["w", "v"])

    got = keys.select(column).mapInArrow(words, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    if got.num_rows:
        out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return out, bits


def _passing(m: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(m), dtype=bool)
    for at in _bits(m, bits):
        ok &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return ok


def _string_ids(hashes, first, length, window):
    """A 64-bit hash of each packed string."""
    n_words = length + window - 1
    begin = np.cumsum(n_words) - n_words
    at = np.arange(int(n_words.sum())) - np.repeat(begin, n_words)
    part = mix64(hashes[at + np.repeat(first, n_words)] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix64(np.add.reduceat(part, begin) + n_words.astype(np.uint64)).view(np.int64) if len(first) else np.zeros(0, np.int64)


def _sent(filter_, window: int, gram: int, packed: bool):
    """Runs that pass the filter: strings (m, sid, lo, hi, packed), or occurrences (sid, doc_id, tkey, start)."""

    def rows(batches):
        words, bits = filter_.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column("tkey").to_numpy(zero_copy_only=False).astype(np.int64)
            out = []
            for i, own, start, length, least, first, hashes in _runs(batch, window, gram):
                keep = _passing(least, words, bits)
                own, start, length, least, first = own[keep] + i, start[keep], length[keep], least[keep], first[keep]
                sid = _string_ids(hashes, first, length, window)
                if not packed:
                    out.append((sid, ids[own], keys[own], start))
                    continue
                order = np.lexsort((ids[own], sid))
                new = np.flatnonzero(np.r_[True, sid[order][1:] != sid[order][:-1]][: len(sid)])
                last = np.r_[new[1:], len(sid)] - 1
                pick, doc = order[new], ids[own][order]
                blobs = [hashes[f : f + n + window - 1].tobytes() for f, n in zip(first[pick].tolist(), length[pick].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(least[pick].view(np.int64)), pa.array(sid[pick]), pa.array(doc[new]), pa.array(doc[last] if len(new) else doc[:0]), pa.array(blobs, pa.binary())], ["m", "sid", "lo", "hi", "packed"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["sid", "doc_id", "tkey", "start"])

    return rows


def _windows(blobs, window):
    """Window hashes of packed strings, flat, and how many each has."""
    n_words = np.array([len(b) // 8 for b in blobs], np.int64)
    flat = np.frombuffer(b"".join(blobs), np.uint64)
    begin = np.cumsum(n_words) - n_words
    n = n_words - window + 1
    all_ = rolling_long(flat, window)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    return all_[at], n


def _spans(sid, hi, n, least):
    """(sid, j0, j1, doc): runs of windows with one smallest doc, if below hi."""
    at = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    use = least < hi[at]
    at, j, least = at[use], j[use], least[use]
    new = np.r_[True, (at[1:] != at[:-1]) | (j[1:] != j[:-1] + 1) | (least[1:] != least[:-1])][: len(at)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    last = last if len(first) else first
    return pa.table({"sid": pa.array(sid[at[first]]), "j0": pa.array(j[first]), "j1": pa.array(j[last] + 1), "doc": pa.array(least[first])})


def _sorted_bucket(window: int):
    def first_docs(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        m, sid, lo, hi = (table.column(c).to_numpy() for c in ("m", "sid", "lo", "hi"))
        hashes, n = _windows(table.column("packed").to_pylist(), window)
        at = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((lo[at], m[at], hashes))
        h, own = hashes[order], m[at][order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])])
        size = np.diff(np.r_[first, len(h)])
        least = np.empty(len(h), np.int64)
        least[order] = np.repeat(lo[at][order][first], size)
        return _spans(sid, hi, n, least)

    return first_docs


def _exploded(window: int):
    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                hashes, n = _windows(batch.column("packed").to_pylist(), window)
                at = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                cols = [batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("m", "sid", "lo", "hi")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(hashes.view(np.int64)), pa.array(j)], ["m", "sid", "lo", "hi", "w", "j"])

    return rows


def repeated_spans(work: Workspace, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, tkey, spans): word spans [from, to) of each row of docs (doc_id,
    tkey, text) that windows of documents with smaller ids cover."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    counted = docs.select("doc_id", "text").mapInArrow(_minimisers(window, gram), "m long, lo long, hi long, runs long")
    shared = counted.groupBy("m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("runs").alias("runs")).where("lo < hi").select("m", "runs")
    shared = work.table(shared, "minimisers")
    n, runs = shared.agg(F.count("*"), F.coalesce(F.sum("runs"), F.lit(0))).first()
    filter_ = spark.sparkContext.broadcast(bloom(shared, "m", n))
    strings = docs.mapInArrow(_sent(filter_, window, gram, True), "m long, sid long, lo long, hi long, packed binary")
    strings = strings.groupBy("m", "sid", "packed").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    many = work.table(shared.where(F.col("runs") > hot).select("m"), "hot")
    many_n = many.count()
    buckets = max(4, -(-int(runs) * 8 * (window + (window - gram) // 2) // BUCKET_BYTES))
    usual = strings
    if many_n:
        strings = work.table(strings, "strings")
        usual = strings.join(work.small(many), "m", "left_anti")
    spans = usual.withColumn("bucket", F.expr(f"pmod(m, {buckets})")).groupBy("bucket").applyInArrow(_sorted_bucket(window), "sid long, j0 long, j1 long, doc long")
    if many_n:
        flat = strings.join(work.small(many), "m", "left_semi").select("m", "sid", "lo", "hi", "packed").mapInArrow(_exploded(window), "m long, sid long, lo long, hi long, w long, j long")
        least = flat.groupBy("m", "w").agg(F.min("lo").alias("doc"))
        spans = spans.unionByName(flat.join(least, ["m", "w"]).where("doc < hi").select("sid", F.col("j").alias("j0"), (F.col("j") + 1).alias("j1"), "doc"))
    spans = spans.groupBy("sid").agg(F.collect_list(F.struct("j0", "j1", "doc")).alias("spans"))
    spans = work.table(spans, "spans")
    seen = docs.mapInArrow(_sent(filter_, window, gram, False), "sid long, doc_id long, tkey long, start long")
    seen = seen.join(work.small(spans), "sid")
    hit = f"transform(filter(spans, s -> s.doc < doc_id), s -> struct(start + s.j0 as a, start + s.j1 + {window - 1} as b))"
    seen = seen.select("doc_id", "tkey", F.expr(hit).alias("spans")).where("size(spans) > 0")
    return work.table(seen.groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("spans")).alias("spans")), "removed")


def _rewritten(batches):
    for batch in batches:
        n_words, n_removed, kept, digest = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = (text or "").encode().split()  # at the six ASCII separators only
            n_words.append(len(words))
            if spans:
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, [s["a"] for s in spans], 1)
                np.add.at(gone, [s["b"] for s in spans], -1)
                left = np.cumsum(gone[:-1]) == 0
                words = [w for w, k in zip(words, left.tolist()) if k]
            n_removed.append(n_words[-1] - len(words))
            text = b" ".join(words)
            kept.append(text.decode())
            digest.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by
    one space) of each row of docs; see the module."""
    work = Workspace(docs.sparkSession, "substring-dedup")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tkey", F.xxhash64("text"))
    removed = work.small(repeated_spans(work, docs, window, gram, hot))
    out = docs.join(removed, ["doc_id", "tkey"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_rewritten, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
