"""Document fingerprints: MinHash signatures, and near duplicates by them.

A signature keeps, for each of ``SLOTS`` multiply-shift hash permutations
``(a * x + b) mod 2**64`` with odd ``a``, the least value over a document's
5-word shingles (lower-cased A-Z, words between ASCII white space), cut to 32
bits.  The share of equal slots of two signatures estimates the Jaccard
similarity of their shingle sets; equal texts have equal signatures.

``near_duplicates`` joins signature bands in Spark and verifies the Jaccard
similarity of what they bring together with the exact shingle sets;
``fingerprints`` gives both for each document.

1. Documents with equal sets are one class.  A band's slots make a key; keys of
   two classes at least are kept.  Of the classes with such a key, only those of
   whose shingles enough are in other ones, too, can have a partner; a support
   count drops the rest.
2. In a key's bucket every class is paired with the most central one (whose
   shingles occur most in other classes), so a bucket of m near copies gives
   about m pairs.  Pairs are verified, and links give components.
3. Where a bucket still has several components, classes are paired with those of
   the commonest one and of other ones; pairs whose signatures agree in a share
   ``ESTIMATE`` of the slots or more are verified, too.  (Of pairs of similarity
   .8, 1 in 100 agrees in fewer; slots are compared by a byte of each.)

A null or empty text, or one without words, has the signature of the empty
set, which is equal to itself only; it links with nothing.  Rows with a null
doc_id come last in ``chained``, have a null component and link nothing.
Repeated rows are reported each.  An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import Workspace, partitions
from ._words import Words, chunks, mix64, set_hashes, shingle_sets, text_buffers
from .ngram_join import FRAGMENT, segments, supported

SLOTS = 128
#: Bands of SLOTS // BANDS slots: a pair of similarity .8 shares one with
#: probability 1 - (1 - .8**7)**18 = .986, one of .9 with .99999, one of .4 with .03.
BANDS = 18
WIDTH = 5
#: Least share of equal slots of a pair that is verified.
ESTIMATE = 0.72
#: Bytes of text that a range of ``chained`` is to hold, and the most ranges (a
#: task streams its range, whose size bounds its time but not its memory).
RANGE_BYTES = 32 << 20
RANGES = 2048

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**63, size=512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, size=512, dtype=np.uint64)


def sketches(texts: pa.Array, slots: int = SLOTS, width: int = WIDTH):
    """Signatures (uint32 array (texts, slots)), set sizes and set hashes of texts."""
    data, offsets = text_buffers(texts)
    n = len(offsets) - 1
    out, sizes, sids = np.full((n, slots), 0xFFFFFFFF, np.uint32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, j in chunks(offsets, 1 << 19):
        words = Words(data, offsets, i, j)
        values, counts = shingle_sets(words, words.hashes(True), width)
        full = np.flatnonzero(counts)
        sizes[i:j], sids[i:j] = counts, set_hashes(values, counts)
        if not len(full):
            continue
        begin = (np.cumsum(counts) - counts)[full]
        values = mix64(values)
        for k in range(slots):
            out[i + full, k] = np.minimum.reduceat(values * _A[k] + _B[k], begin) >> np.uint64(32)
    return out, sizes, sids


def signatures(texts: pa.Array, slots: int = SLOTS, width: int = WIDTH) -> np.ndarray:
    """uint32 array (texts, slots)."""
    return sketches(texts, slots, width)[0]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=1)


def _edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def chained(docs: DataFrame, slots: int = SLOTS, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness,
    and the document's set hash ``sid``.

    Documents follow each other by descending id (ties by a hash of the text,
    then the text; null ids last) and the first follows the last.  The table is
    dealt by ranges of that order, about equal in rows; an id with very many
    rows has several.  The first document of a range travels to the range before
    it as well, so no task needs more than its own rows.
    """
    spark = docs.sparkSession
    Workspace(spark, "minhash")
    low = -(2**63)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.select("doc_id", "text", F.bitwise_not(F.coalesce("doc_id", F.lit(low))).alias("o"), F.xxhash64("text").alias("h"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = min(RANGES, max(4, 2 * partitions(spark), -(-size // RANGE_BYTES)))
    cuts = docs.agg(F.percentile_approx("o", [k / n for k in range(1, n)], 10_000)).first()[0]
    docs = docs.withColumn("range", _range_of(sorted(cuts or [])))
    # one row for each range: its first document, and the range before it
    known = sorted((r["range"], r["head"]["o"], r["head"]["h"]) for r in docs.groupBy("range").agg(F.min(F.struct("o", "h")).alias("head")).collect())
    before = [(o, h, known[k - 1][0]) for k, (_, o, h) in enumerate(known)]
    heads = F.broadcast(spark.createDataFrame(before, "o long, h long, before int"))
    both = F.array(F.struct("range", F.lit(False).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(True).alias("guest")))
    dealt = docs.join(heads, ["o", "h"], "left").withColumn("copy", F.explode(F.when(F.col("before").isNull(), F.slice(both, 1, 1)).otherwise(both)))
    dealt = dealt.select("doc_id", "o", "h", "text", "copy.range", "copy.guest").repartition(max(1, len(known)), "range")
    return dealt.sortWithinPartitions("range", "guest", "o", "h", F.asc_nulls_first("text")).select("doc_id", "text", "guest").mapInArrow(_chain(slots, width), SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, sid long"


def _range_of(cuts):
    """Number of cuts below o, as a balanced tree of comparisons.  Rows at a value
    that is a cut m times are dealt by their hash to m + 1 ranges."""
    values, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    below = np.r_[0, np.cumsum(times)].tolist()
    values = values.tolist()

    def tree(lo, hi):  # o lies above values[lo - 1] and not above values[hi]
        if lo >= hi:
            base = F.lit(below[lo])
            if lo < len(values) and below[lo + 1] - below[lo] > 1:
                share = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * (below[lo + 1] - below[lo]))
                return F.when(F.col("o") == F.lit(values[lo]), base + F.least(F.greatest(share, F.lit(0)), F.lit(below[lo + 1] - below[lo] - 1))).otherwise(base)
            return base
        mid = (lo + hi) // 2
        return F.when(F.col("o") <= F.lit(values[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(values)).cast("int")


def _chain(slots, width):
    def finish(ids, texts, following):
        texts, following = [t or "" for t in texts], [t or "" for t in following]
        edited = [_edited(a, b) for a, b in zip(texts, following)]
        own, _, sids = sketches(pa.array([*texts, following[-1]], pa.large_string()), slots, width)
        # the next document of each is the row after it, but where a guest ends a range
        nxt = np.vstack([own[1:-1], own[-1:]]) if len(texts) > 1 else own[-1:]
        breaks = [k for k in range(len(texts) - 1) if following[k] is not texts[k + 1] and following[k] != texts[k + 1]]
        if breaks:
            nxt[breaks] = signatures(pa.array([following[k] for k in breaks], pa.large_string()), slots, width)
        own = own[:-1]
        other = signatures(pa.array(edited, pa.large_string()), slots, width)
        hexes = lambda s: [x.tobytes().hex() for x in s.astype(">u4")]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(hexes(own), pa.string()), pa.array(hexes(other), pa.string()),
            pa.array(likeness(own, other)), pa.array(likeness(own, nxt)), pa.array(sids[:-1]),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "sid"])

    def rows(batches):
        held = None  # a document whose next one hasn't come yet
        ids, texts, following, size = [], [], [], 0
        for batch in batches:
            for i, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest"))):
                if held is not None:
                    ids.append(held[0])
                    texts.append(held[1])
                    following.append(text)
                    size += len(held[1] or "")
                    held = None
                if not guest:
                    held = (i, text)
                if size >= 1 << 20:
                    yield finish(ids, texts, following)
                    ids, texts, following, size = [], [], [], 0
        if held is not None:
            raise ValueError("a range came without the document that follows it")
        if texts:
            yield finish(ids, texts, following)

    return rows


def _banded(slots, bands, width):
    """doc_id, n_shingles, sid, bands (keys), sketch (a byte of each slot, eight to a number) of texts."""
    per = slots // bands

    def rows(batches):
        for batch in batches:
            sig, sizes, sids = sketches(batch.column("text"), slots, width)
            keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
            for b in range(bands):
                for k in range(b * per, (b + 1) * per):
                    keys[:, b] = mix64(keys[:, b] * np.uint64(31) + sig[:, k])
            sketch = np.ascontiguousarray((sig & np.uint32(0xFF)).astype(np.uint8)).view(np.int64)
            flat = [pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (keys.view(np.int64), sketch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(sids), *flat], ["doc_id", "n_shingles", "sid", "bands", "sketch"])

    return rows


def _shingles(width):
    """sid, shingles (sorted hashes) of texts whose set is the wanted one."""

    def rows(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            want = batch.column("want").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in chunks(offsets):
                words = Words(data, offsets, i, j)
                values, n = shingle_sets(words, words.hashes(True), width)
                cuts = np.r_[0, np.cumsum(n)].tolist()
                sids = set_hashes(values, n)
                pick = np.flatnonzero(sids == want[i:j]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(sids[pick]), pa.array([values[cuts[k] : cuts[k + 1]].tobytes() for k in pick], pa.binary())], ["sid", "shingles"])

    return rows


def _alike(percent):
    def rows(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * n >= percent * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return rows


#: Slots in which two sketches differ: the bits of each byte of x ^ y are folded into its last one.
_X = "(x ^ y)"
_Y = f"({_X} | shiftrightunsigned({_X}, 4))"
_Y = f"({_Y} | shiftrightunsigned({_Y}, 2))"
_Y = f"({_Y} | shiftrightunsigned({_Y}, 1))"
_UNEQUAL = f"aggregate(zip_with(sa, sb, (x, y) -> bit_count({_Y} & {0x0101010101010101})), 0, (s, n) -> s + n)"


def _classes(work: Workspace, docs: DataFrame, percent: int, slots: int, bands: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The table (doc_id, n_shingles, sid), and (sid, component_id) of the classes
    whose component_id may differ from the doc_id of one of their rows."""
    docs = docs.where("doc_id is not null")
    made = docs.select("doc_id", "text").mapInArrow(_banded(slots, bands, width), "doc_id long, n_shingles long, sid long, bands array<long>, sketch array<long>")
    table = work.table(made, "signatures")
    full = table.where("n_shingles > 0")
    classes = work.table(full.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.max("n_shingles").alias("size")), "classes")
    band = full.select("sid", F.explode("bands").alias("key"))
    shared = work.table(band.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("key"), "shared")
    hits = work.table(band.join(work.small(shared), "key").distinct(), "hits")
    some = work.table(classes.join(work.small(work.table(hits.select("sid").distinct(), "some")), "sid"), "candidates")
    many = max(4, -(-int(some.agg(F.sum("size")).first()[0] or 0) // FRAGMENT))
    reps = work.small(work.table(some.select(F.col("rep").alias("doc_id")).distinct(), "reps"))
    support = supported(segments(docs.join(reps, "doc_id"), width, percent, 1.0, many), many)
    # nodes: the most central classes have the smallest numbers
    nodes = some.join(support, "sid").where(f"100 * n >= {percent} * size").withColumn("pri", F.expr("-cast(1000000 * w / size as long)"))
    nodes = nodes.repartitionByRange("pri", "sid").sortWithinPartitions("pri", "sid")
    nodes = work.table(nodes.select(F.monotonically_increasing_id().alias("node"), "sid", "rep"), "nodes")
    small_nodes = work.small(nodes)
    hits = work.table(hits.join(small_nodes, "sid").select("key", "node"), "hits")

    def verified(pairs):
        pairs = work.table(pairs.select("a", "b").distinct(), "pairs")
        some = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = work.table(some.join(small_nodes, "node").select("node", F.col("rep").alias("doc_id"), F.col("sid").alias("want")), "wanted")
        wanted = work.small(wanted)
        sets = docs.join(wanted, "doc_id").select("text", "want").mapInArrow(_shingles(width), "sid long, shingles binary")
        sets = work.table(sets.join(wanted.select("node", F.col("want").alias("sid")), "sid").select("node", "shingles"), "sets")
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        links = work.table(both.mapInArrow(_alike(percent), "a long, b long, ok boolean").where("ok").select("a", "b").distinct(), "links")
        work.drop(sets)
        return links

    first = work.table(hits.groupBy("key").agg(F.min("node").alias("a")), "first")
    stars = verified(hits.join(work.small(first), "key").where("a <> node").select("a", F.col("node").alias("b")))
    known = work.table(components(work, stars), "known")
    named = hits.join(work.small(known), "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    mixed = work.table(named.join(work.small(work.table(mixed, "mixed-keys")), "key"), "mixed")
    major = mixed.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", "n").alias("major"))
    own = nodes.join(work.small(work.table(mixed.select("node").distinct(), "left")), "node").select("sid", F.col("rep").alias("doc_id"), "node")
    sketches_ = full.join(work.small(work.table(own, "own")), ["sid", "doc_id"]).select("node", "sketch").dropDuplicates(["node"])
    mixed = mixed.join(work.small(work.table(sketches_, "sketches")), "node")
    x = mixed.join(work.small(work.table(major, "major")), "key").where("label <> major").select("key", "major", F.col("node").alias("a"), F.col("label").alias("la"), F.col("sketch").alias("sa"))
    y = mixed.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("sketch").alias("sb"))
    rest = verified(x.join(y, "key").where(f"la <> lb and (lb = major or a < b) and {_UNEQUAL} <= {int((1 - ESTIMATE) * slots)}"))
    comp = components(work, work.table(stars.unionByName(rest), "all-links")).join(small_nodes, "node")
    comp = work.table(comp.select("component", "sid", "rep"), "components")
    least = comp.groupBy("component").agg(F.min("rep").alias("least"))
    names = classes.join(comp.join(least, "component").select("sid", "least"), "sid", "left").where("rows > 1 or least is not null")
    return table, work.table(names.select("sid", F.coalesce("least", "rep").alias("component_id")), "names")


_COMPONENT = "case when doc_id is null then null else coalesce(component_id, doc_id) end"


def near_duplicates(docs: DataFrame, percent: int = 80, slots: int = SLOTS, bands: int = BANDS, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by verified
    links) of each row of docs with a doc_id; see the module."""
    work = Workspace(docs.sparkSession, "near-duplicates")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table, names = _classes(work, docs, percent, slots, bands, width)
    return table.join(work.small(names), "sid", "left").select("doc_id", "n_shingles", F.expr(_COMPONENT).alias("component_id"))


def fingerprints(docs: DataFrame, percent: int = 80, slots: int = SLOTS, bands: int = BANDS, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """chained() and the component_id of near_duplicates() of each row of docs."""
    work = Workspace(docs.sparkSession, "fingerprints")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    _, names = _classes(work, docs, percent, slots, bands, width)
    out = chained(docs, slots, width, "doc_id", "text").join(work.small(names), "sid", "left")
    return out.withColumn("component_id", F.expr(_COMPONENT)).drop("sid")
