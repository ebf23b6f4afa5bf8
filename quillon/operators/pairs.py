"""Distances between rows: nearest neighbours, radius pairs, kernels.

Rows are (id, vector).  Every row is dealt to the pairs of blocks it belongs
to, and a task multiplies two blocks as matrices; the work is that of all
pairs, the traffic rows * blocks, and no task holds more than two blocks.  In
up to three dimensions a grid of cells gives radius pairs by an equi-join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 4096


def blocks_of(df: DataFrame, rows: int = BLOCK) -> int:
    return max(1, -(-df.count() // rows))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact differences, a slice of rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def _dealt(df: DataFrame, n: int, side: str):
    """Rows of the left side go to all (own block, j), of the right to all (i, own block)."""
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    out = df.select("id", "v", own.alias("own"), other)
    i, j = ("own", "other") if side == "a" else ("other", "own")
    # names of its own for each side: both may come from one table
    return out.select(F.col("id").alias(f"id_{side}"), F.col("v").alias(f"v_{side}"), F.col(i).alias("i"), F.col(j).alias("j"))


def dealt_within(df: DataFrame, blocks: int | None = None, rows: int = BLOCK):
    """Rows (id, v, g) as a cogroup of pairs of blocks of each group g: the left
    table has id_a and v_a, the right one id_b and v_b."""
    df = df.where("g is not null")
    n = blocks or max(1, -(-(df.groupBy("g").count().agg(F.max("count")).first()[0] or 0) // rows))
    own, other = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    dealt = df.select("id", "v", "g", own.alias("own"), other)
    left = dealt.select(F.col("id").alias("id_a"), F.col("v").alias("v_a"), F.col("g").alias("g_a"), F.col("own").alias("i_a"), F.col("other").alias("j_a"))
    right = dealt.select(F.col("id").alias("id_b"), F.col("v").alias("v_b"), F.col("g").alias("g_b"), F.col("other").alias("i_b"), F.col("own").alias("j_b"))
    return left.groupBy("g_a", "i_a", "j_a").cogroup(right.groupBy("g_b", "i_b", "j_b"))


def nearest(queries: DataFrame, train: DataFrame, k: int, skip_self: bool = False, blocks: int | None = None) -> DataFrame:
    """(q, id, d2, place): the k nearest rows of train (id, v) of each query;
    ties by id.  Each pair of blocks sends its own k best."""
    n = blocks or max(blocks_of(queries), blocks_of(train))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        q, t = left.column("id_a").to_numpy(), right.column("id_b").to_numpy()
        if not len(q) or not len(t):
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "d2": pa.array([], pa.float64())})
        d = _squared(_matrix(left, "v_a"), _matrix(right, "v_b"))
        if skip_self:
            d[q[:, None] == t[None, :]] = np.inf
        order = np.lexsort((np.broadcast_to(t, d.shape), d), axis=1)[:, :k]
        d = np.take_along_axis(d, order, 1)
        keep = np.isfinite(d)
        return pa.table({"q": pa.array(np.repeat(q, order.shape[1])[keep.ravel()]), "id": pa.array(t[order][keep]), "d2": pa.array(d[keep])})

    pairs = _dealt(queries, n, "a").groupBy("i", "j").cogroup(_dealt(train, n, "b").groupBy("i", "j"))
    found = pairs.applyInArrow(best, "q long, id long, d2 double")
    place = F.row_number().over(Window.partitionBy("q").orderBy("d2", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def knn_classify(queries: DataFrame, train: DataFrame, labels: DataFrame, k: int = 3, skip_self: bool = False) -> DataFrame:
    """(q, prediction): the commonest label (id, label) of the k nearest, ties to the smallest."""
    if k < 1:
        raise ValueError("k must be at least 1")
    votes = nearest(queries, train, k, skip_self).join(labels, "id").groupBy("q", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("q").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("q", F.col("b.label").alias("prediction"))


def knn_regress(queries: DataFrame, train: DataFrame, targets: DataFrame, k: int = 3, skip_self: bool = False) -> DataFrame:
    """(q, prediction): mean target (id, y) of the k nearest."""
    return nearest(queries, train, k, skip_self).join(targets, "id").groupBy("q").agg(F.avg("y").alias("prediction"))


def within(df: DataFrame, radius: float, blocks: int | None = None) -> DataFrame:
    """(a, b, d2) of all ordered pairs, self included, with d <= radius."""
    n = blocks or blocks_of(df)

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("id_a").to_numpy(), right.column("id_b").to_numpy()
        d = _squared(_matrix(left, "v_a"), _matrix(right, "v_b")) if len(a) and len(b) else np.zeros((len(a), len(b)))
        i, j = np.nonzero(np.sqrt(d) <= radius)
        return pa.table({"a": pa.array(a[i], pa.int64()), "b": pa.array(b[j], pa.int64()), "d2": pa.array(d[i, j], pa.float64())})

    pairs = _dealt(df, n, "a").groupBy("i", "j").cogroup(_dealt(df, n, "b").groupBy("i", "j"))
    return pairs.applyInArrow(near, "a long, b long, d2 double")


def row_sums(df: DataFrame, functions: dict, blocks: int | None = None) -> DataFrame:
    """(id, a column for each function): sums over all rows of a function of the
    squared distances, self included.  Block tasks send sums, not pairs."""
    n, names = blocks or blocks_of(df), list(functions)

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        a, got = left.column("id_a"), left.num_rows and right.num_rows
        d = _squared(_matrix(left, "v_a"), _matrix(right, "v_b")) if got else np.zeros((left.num_rows, 1))
        return pa.table({"id": a} | {name: pa.array(f(d).sum(1) if got else np.zeros(left.num_rows)) for name, f in functions.items()})

    dealt = _dealt(df, n, "a").groupBy("i", "j").cogroup(_dealt(df, n, "b").groupBy("i", "j"))
    return dealt.applyInArrow(sums, "id long, " + ", ".join(f"{c} double" for c in names)).groupBy("id").agg(*(F.sum(c).alias(c) for c in names))


def within_grid(df: DataFrame, radius: float, dims: int) -> DataFrame:
    """As within() for few dimensions: a row meets those of its own and the neighbouring cells."""
    cell = F.transform("v", lambda x: F.floor(x / radius).cast("long"))
    left = df.select(F.col("id").alias("a"), F.col("v").alias("va"), cell.alias("cell"))
    moves = F.array(F.array().cast("array<long>"))
    for _ in range(dims):
        moves = F.flatten(F.transform(moves, lambda m: F.transform(F.array(*(F.lit(x).cast("long") for x in (-1, 0, 1))), lambda s: F.concat(m, F.array(s)))))
    right = df.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.explode(moves).alias("m"), cell.alias("c0"))
    right = right.select("b", "vb", F.zip_with("c0", "m", lambda c, m: c + m).alias("cell"))
    d2 = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return left.join(right, "cell").select("a", "b", d2.alias("d2")).where(F.sqrt("d2") <= radius)


def rbf(d2, length: float = 1.0, scale: float = 1.0):
    return scale**2 * F.exp(-d2 / (2 * length**2))


def matern52(d2, length: float = 1.0, scale: float = 1.0):
    r = F.sqrt(5.0 * d2) / length
    return scale**2 * (1 + r + r * r / 3) * F.exp(-r)


def periodic(d, length: float = 1.0, period: float = 1.0, scale: float = 1.0):
    s = F.sin(F.lit(np.pi) * d / period)
    return scale**2 * F.exp(-2.0 * s * s / length**2)


def linear(dot, scale: float = 1.0):
    return scale**2 * dot
