"""N-gram Jaccard join: all documents whose 5-word shingle sets are alike.

Two documents link when ``|A & B| / |A | B| >= 0.8``; the result is exact up to
the hashing of words to 64 bits.  The n-grams' global order is that of their
hashes, cut into fragments (ranges).

1. Documents with equal sets are one class, known by the set's hash.
2. *Support.*  A class can only have a partner if enough of the first part of
   its set, in the global order, occurs in other classes too.  Fragments count
   that separately, the counts are summed per class, and classes short of the
   bound go.  This is the prefix bound of set joins with a longer prefix, first
   with a part of the set and then with all of it.  Segments and counts travel
   packed, by (fragment) and by (range of classes); an n-gram that a task sees
   in several classes is settled there and sent once.
3. *Stars.*  What is left is joined by n-gram: a row for each n-gram of a class.
   Classes that share an n-gram are paired with the most central of them (whose
   n-grams occur most in other classes, so the original rather than an edit of
   it).  Every task of that join holds a fragment and counts its partial
   overlaps, which are summed per pair.  The sum never exceeds the true overlap,
   so a pair that reaches the bound is a link.  A group of m near copies gives
   about m pairs here, not m * m.
4. *Rest.*  Components of those links are known.  Prefixes in order of document
   frequency, rare n-grams first, then give the candidate pairs between
   different components.  A bucket is an n-gram and a range of set sizes of
   which only neighbours can be alike; in it, the commonest component is paired
   with the other rows, never with itself; length and position bounds cut the
   pairs.  Their sets, cut into ``PARTS`` fragments, give partial overlaps, which
   are summed per pair and decide.
5. Components over all links.

Nulls and empty texts have no n-grams and link with nothing.  Rows with a null
doc_id get a null component and take no part.  Repeated rows are one class; a
doc_id that comes with several texts is a document each.  Other columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._store import Workspace, partitions
from ._words import Words, chunks, set_hashes, shingle_sets, text_buffers

WIDTH = 5
#: n-grams that one fragment of a support count is to hold; their number follows the data.
FRAGMENT = 400_000
#: n-grams that a task gathers before it deals them out.
GATHERED = 500_000
#: Share of a set by which the prefix of the first support count is longer.
LONGER = 0.2
#: An n-gram's document frequency counts up to this in a class's centrality.
CENTRAL = 5
#: Fragments into which a candidate pair's sets are cut for the final counts.
PARTS = 4


def _sets(batch, width):
    """(first row, counts, values, set hashes) of each chunk of a batch's texts."""
    data, offsets = text_buffers(batch.column("text"))
    for i, j in chunks(offsets):
        words = Words(data, offsets, i, j)
        values, counts = shingle_sets(words, words.hashes(True), width)
        yield i, counts, values, set_hashes(values, counts)


def _need(size: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with any partner: 100 * overlap >= percent * size."""
    return -(-percent * size // 100)


def set_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, row, n_shingles, sid (hash of the set) of each row of docs (doc_id, row, text)."""

    def rows(batches):
        for batch in batches:
            n, sid = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, counts, _, own in _sets(batch, width):
                n.append(counts)
                sid.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("row").cast(pa.int64()), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(sid))], ["doc_id", "row", "n_shingles", "sid"])

    return docs.select("doc_id", "row", "text").mapInArrow(rows, "doc_id long, row long, n_shingles long, sid long")


def _dealt(keys, *columns, n):
    """Ranges of the sorted keys, n of them all in all, and the columns as one blob for each."""
    fragment = (keys // np.uint64((1 << 64) // n + 1)).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]]) if len(keys) else np.zeros(0, np.int64)
    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]))
    blobs = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in columns]
    return fragment[cuts], blobs


def segments(docs: DataFrame, width: int, percent: int, longer: float, n_fragments: int) -> DataFrame:
    """Segments (fragment, hashes, sids, ws) of the texts; longer >= 1 takes whole sets.

    n-grams of two classes of a task's texts are settled there: it counts them
    itself (fragment -1 - range of classes: counts as ``hashes``, centralities
    as ``ws``) and sends one marker (sid 0) per n-gram, so that an n-gram that
    very many documents share is one row each time a task has gathered
    ``GATHERED`` n-grams.
    """
    names = ["fragment", "hashes", "sids", "ws"]

    def flush(hashes, sids):
        h, s = np.concatenate(hashes), np.concatenate(sids)
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])]  # copies count once
        h, s = h[new], s[new]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        many = np.diff(np.r_[first, len(h)])
        shared = np.repeat(many > 1, many)
        if shared.any():
            ids, at, n = np.unique(s[shared].view(np.uint64), return_inverse=True, return_counts=True)
            w = np.bincount(at, np.repeat(np.minimum(many, CENTRAL), many)[shared], minlength=len(ids))
            place, blobs = _dealt(ids, n.astype(np.int32), ids, w.astype(np.int32), n=n_fragments)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - place, pa.int32()), *blobs], names)
        alone = ~shared | np.r_[True, h[1:] != h[:-1]]  # the first of a shared n-gram becomes its marker
        h, s = h[alone], np.where(shared, 0, s)[alone]
        place, blobs = _dealt(h, h, s, n=n_fragments)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *blobs, pa.array([b""] * len(place), pa.binary())], names)

    def rows(batches):
        hashes, sids, gathered = [], [], 0
        for batch in batches:
            for _, counts, values, own in _sets(batch, width):
                size = counts.astype(np.int64)
                take = size if longer >= 1 else np.minimum(size, size - _need(size, percent) + np.maximum(1, (longer * size).astype(np.int64)))
                keep = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(take, size)
                hashes.append(values[keep])
                sids.append(np.repeat(own, size)[keep])
                gathered += len(hashes[-1])
                if gathered >= GATHERED:
                    yield from flush(hashes, sids)
                    hashes, sids, gathered = [], [], 0
        if gathered:
            yield from flush(hashes, sids)

    return docs.select("text").mapInArrow(rows, "fragment int, hashes binary, sids binary, ws binary")


def _blob(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for c in table.column(name).chunks for x in c.to_pylist()), kind)


def supported(segments: DataFrame, buckets: int) -> DataFrame:
    """(sid, n, w): how many of the n-grams sent other classes have too, and
    the sum of their document frequencies (up to CENTRAL each).

    A fragment's partial counts travel as one row for each of ``buckets``
    ranges of classes, where they are summed.
    """
    names = ["bucket", "sids", "ns", "ws"]

    def packed(ids, n, w):
        place, blobs = _dealt(ids, ids, n.astype(np.int32), w.astype(np.int32), n=buckets)
        return pa.table([pa.array(place, pa.int32()), *blobs], names=names)

    def count(table: pa.Table) -> pa.Table:
        if table.column("fragment")[0].as_py() < 0:  # counts that tasks have settled
            ids, at = np.unique(_blob(table, "sids", np.uint64), return_inverse=True)
            n, w = (np.bincount(at, _blob(table, c, np.int32), minlength=len(ids)) for c in ("hashes", "ws"))
            return packed(ids, n, w)
        h, s = _blob(table, "hashes", np.uint64), _blob(table, "sids", np.uint64)
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])]
        h, s = h[new], s[new]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        df = np.diff(np.r_[first, len(h)])
        shared = np.repeat((df > 1) | (s[first] == 0), df) & (s != 0)
        ids, at = np.unique(s[shared], return_inverse=True)
        w = np.bincount(at, np.repeat(np.minimum(df, CENTRAL), df)[shared], minlength=len(ids))
        return packed(ids, np.bincount(at, minlength=len(ids)), w)

    def add(table: pa.Table) -> pa.Table:
        ids, at = np.unique(_blob(table, "sids", np.int64), return_inverse=True)
        sums = [pa.array(np.bincount(at, _blob(table, c, np.int32), minlength=len(ids)).astype(np.int64)) for c in ("ns", "ws")]
        return pa.table([pa.array(ids), *sums], names=["sid", "n", "w"])

    dealt = segments.groupBy("fragment").applyInArrow(count, "bucket int, sids binary, ns binary, ws binary")
    return dealt.groupBy("bucket").applyInArrow(add, "sid long, n long, w long")


def _named_sets(batch, width):
    """(nodes, sizes, values) of a batch's texts whose set is the wanted one."""
    want, node = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("want", "node"))
    for first, counts, values, own in _sets(batch, width):
        size = counts.astype(np.int64)
        rows = slice(first, first + len(size))
        keep = own == want[rows]
        yield node[rows][keep], size[keep], values[np.repeat(keep, size)]


def _postings(width):
    """(hash, node): a row for each n-gram of a class."""

    def rows(batches):
        for batch in batches:
            for node, size, values in _named_sets(batch, width):
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.repeat(node, size))], ["hash", "node"])

    return rows


def _cut(width, parts):
    """(node, part, hashes): a class's set in fragments of the global order."""
    bounds = np.array([k * ((1 << 64) // parts + 1) for k in range(1, parts)], np.uint64)

    def rows(batches):
        for batch in batches:
            for node, size, values in _named_sets(batch, width):
                out = [], [], []
                for n, a, b in zip(node.tolist(), (np.cumsum(size) - size).tolist(), np.cumsum(size).tolist()):
                    at = [a, *(a + np.searchsorted(values[a:b], bounds)).tolist(), b]
                    for part, (i, j) in enumerate(zip(at, at[1:])):
                        for o, v in zip(out, (n, part, values[i:j].tobytes())):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.binary()))], ["node", "part", "hashes"])

    return rows


def _overlaps(batches):
    for batch in batches:
        n = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n, pa.int64())], ["a", "b", "n"])


def _links(work: Workspace, named: DataFrame, nodes: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b): links between nodes, enough of them to connect each component.

    nodes (node, sid, rep, size, mult) are the classes, the most central ones
    with the smallest numbers; mult rows of docs have a class's rep and its set,
    so whatever is counted over their texts is so many times too large.
    """

    def texts(some):
        wanted = some.select(F.col("rep").alias("doc_id"), F.col("sid").alias("want"), "node")
        return named.join(work.small(work.table(wanted, "wanted")), "doc_id").select("text", "want", "node")

    need = f"ceil({percent} * size / 100)"
    enough = f"n * {100 + percent} >= {percent} * (sa + sb)"
    postings = work.table(texts(nodes).mapInArrow(_postings(width), "hash long, node long"), "postings")
    shared = work.table(postings.groupBy("hash").agg(F.min("node").alias("centre"), F.count("*").alias("df")).where("df > 1"), "shared")
    common = work.table(postings.join(shared, "hash"), "common")
    work.drop(postings)
    sizes = work.small(work.table(nodes.select("node", "size", "mult"), "sizes"))
    stars = common.where("node <> centre").groupBy("centre", "node").agg(F.count("*").alias("n"))
    stars = stars.join(sizes.select(F.col("node").alias("centre"), F.col("size").alias("sa")), "centre").join(sizes.withColumnRenamed("size", "sb"), "node")
    stars = work.table(stars.withColumn("n", F.expr("n div mult")).where(enough).select(F.col("centre").alias("a"), F.col("node").alias("b")), "stars")
    known = work.table(components(work, stars), "known")

    label = work.table(nodes.join(known, "node", "left").select("node", "size", "mult", F.coalesce("component", "node").alias("label")), "labels")
    own = Window.partitionBy("node")
    ranked = common.select("node", "hash", "df").withColumn("at", F.dense_rank().over(own.orderBy("df", "hash"))).withColumn("had", F.count("*").over(own))
    prefix = ranked.join(work.small(label), "node").withColumn("had", F.expr("had div mult"))
    # n-grams that no other class has come first; their number is size - had
    prefix = prefix.where(f"at <= had - {need} + 1").select("hash", "node", "size", "label", F.expr("size - had + at - 1").alias("place"))
    prefix = work.table(prefix.distinct() if nodes.where("mult > 1").head(1) else prefix, "prefix")
    mixed = prefix.groupBy("hash").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("hash")
    bucket = F.floor(F.log("size") / F.lit(1.0001 * math.log(100 / percent))).cast("int")
    mixed = work.table(prefix.join(work.table(mixed, "mixed-hashes"), "hash").withColumn("range", bucket), "mixed")
    work.drop(common, prefix)
    x = mixed.select("hash", F.explode(F.array(*(F.col("range") + k for k in (-1, 0, 1)))).alias("range"), F.col("node").alias("a"), F.col("size").alias("sa"), F.col("label").alias("la"), F.col("place").alias("pa"))
    y = mixed.select("hash", "range", F.col("node").alias("b"), F.col("size").alias("sb"), F.col("label").alias("lb"), F.col("place").alias("pb"))
    # rows of the commonest component of an n-gram are paired from the other side only
    major = mixed.groupBy("hash", "label").agg(F.count("*").alias("n")).groupBy("hash").agg(F.max_by("label", "n").alias("major"))
    x = x.join(work.small(work.table(major, "major")), "hash").where("la <> major")
    near = f"100 * least(sa, sb) >= {percent} * greatest(sa, sb) and least(sa - pa, sb - pb) * {100 + percent} >= {percent} * (sa + sb)"
    pairs = x.join(y, ["hash", "range"]).where(f"la <> lb and (lb = major or a < b) and {near}").select("a", "b").distinct()
    pairs = work.table(pairs, "pairs")
    some = work.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "some")
    cut = work.table(texts(nodes.join(work.small(some), "node")).mapInArrow(_cut(width, PARTS), "node long, part int, hashes binary"), "cut")
    both = pairs.join(cut.toDF("a", "part", "ha"), "a").join(cut.toDF("b", "part", "hb"), ["b", "part"])
    counts = both.select("a", "b", "ha", "hb").mapInArrow(_overlaps, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = counts.join(sizes.toDF("a", "sa", "ma"), "a").join(sizes.toDF("b", "sb", "mb"), "b").withColumn("n", F.expr("n div (ma * mb)"))
    links = work.table(stars.unionByName(counts.where(enough).select("a", "b")), "links")
    work.drop(mixed, cut)
    return links


def jaccard_join(docs: DataFrame, percent: int = 80, width: int = WIDTH, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs; see the module.

    ``row`` names a long column by which the caller knows rows again; it is
    returned as ``row`` then, beside ``sid``, which equal sets share, and
    ``group``, which linked sets share (component_id may be that of two groups
    if a doc_id comes with several texts).
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ngram-join")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(row) if row else F.lit(0)).cast("long").alias("row"))
    table = work.table(set_table(docs, width), "sets")
    full = table.where("n_shingles > 0 and doc_id is not null")
    classes = work.table(full.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size")), "classes")
    named = docs.where("doc_id is not null").select("doc_id", "text")

    def fragments(df, share=1.0, least=4):
        return max(least, -(-int((df.agg(F.sum("size")).first()[0] or 0) * share) // FRAGMENT))

    # support by a part of each set, over all rows
    many = fragments(classes, 0.2 + LONGER, partitions(spark))
    part = segments(named, width, percent, LONGER, many)
    need = F.expr(f"greatest(1, floor({LONGER} * ceil({percent} * size / 100)))")
    alive = work.table(classes.join(supported(part, many), "sid").where(F.col("n") >= need).select("sid", "rep", "size"), "alive")
    # then by whole sets, over one row a class at least
    many = fragments(alive)
    reps = work.table(alive.select(F.col("rep").alias("doc_id")).distinct(), "reps")
    whole = segments(named.join(work.small(reps), "doc_id"), width, percent, 1.0, many)
    left = alive.join(supported(whole, many), "sid").where(f"100 * n >= {percent} * size")
    left = work.table(left.select("sid", "rep", "size", F.expr("-cast(1000000 * w / size as long)").alias("pri")), "left")
    mult = full.join(work.small(left).select("sid", F.col("rep").alias("doc_id")), ["sid", "doc_id"]).groupBy("sid").agg(F.count("*").alias("mult"))
    nodes = left.join(work.table(mult, "mult"), "sid").repartitionByRange("pri", "sid").sortWithinPartitions("pri", "sid")
    nodes = work.table(nodes.select(F.monotonically_increasing_id().alias("node"), "sid", "rep", "size", "mult"), "nodes")
    links = _links(work, named, nodes, percent, width)

    linked = work.table(components(work, links).join(nodes.select("node", "sid", "rep"), "node"), "components")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"), F.min("sid").alias("group"))
    name = linked.join(least, "component").select("sid", "least", "group")
    name = classes.join(name, "sid", "left").select("sid", F.coalesce("least", "rep").alias("component_id"), *([F.coalesce("group", "sid").alias("group")] if row else []))
    name = work.table(name, "names")
    component = "case when doc_id is null then null when n_shingles = 0 then doc_id else component_id end"
    return table.join(work.small(name), "sid", "left").select("doc_id", "n_shingles", F.expr(component).alias("component_id"), *(["row", "sid", "group"] if row else []))
