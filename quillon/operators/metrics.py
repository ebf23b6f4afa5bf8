"""Evaluation of predictions; each is one or two aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cut import cut


def accuracy(actual: Column, predicted: Column) -> Column:
    return F.avg(F.when(actual == predicted, 1.0).otherwise(0.0))


def binary_cross_entropy(y: Column, p: Column, eps: float = 1e-12) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))


def categorical_cross_entropy(p_true: Column, eps: float = 1e-12) -> Column:
    """Of the probabilities given to the true classes."""
    return F.avg(-F.log(F.greatest(p_true, F.lit(eps))))


def regression(df: DataFrame, y: Column, prediction: Column) -> DataFrame:
    """mse, mae, r2 (0 if y doesn't vary)."""
    e = y - prediction
    return df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (F.count(y) * F.var_pop(y)).alias("t"), F.sum(e * e).alias("s")).select("mse", "mae", F.when(F.col("t") > 0, 1 - F.col("s") / F.col("t")).otherwise(0.0).alias("r2"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support; from the confusion matrix alone."""
    cells = confusion(df, actual, predicted)
    sides = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).alias("pp"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").cast("int").alias("pp"), F.lit(0).cast("long").alias("tp")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("pp").alias("pp"), F.sum("tp").alias("tp"))

    def share(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    return sums.select("label", share(F.col("tp"), F.col("pp")).alias("precision"), share(F.col("tp"), F.col("support")).alias("recall"), share(2.0 * F.col("tp"), F.col("pp") + F.col("support")).alias("f1"), "support")


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr), one row a distinct score, highest first.

    Scores are counted before they are ordered, and running sums go over
    ranges of scores: within a range by a window, between ranges by one row each.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    counts = _running(counts, "threshold", ["p", "n"])
    total = counts.agg(F.max("p_run").alias("tp"), F.max("n_run").alias("tn"))
    return counts.crossJoin(F.broadcast(total)).select("threshold", (F.col("p_run") / F.col("tp")).alias("tpr"), ((F.col("n_run") - F.col("p_run")) / (F.col("tn") - F.col("tp"))).alias("fpr"), "p", "n", "p_run", "n_run")


def _running(df: DataFrame, order: str, values: list[str], ranges: int = 64) -> DataFrame:
    """Running sums of values by descending order, as value_run; no task holds all rows."""
    df = cut(df.repartitionByRange(ranges, F.desc(order)).withColumn("_r", F.spark_partition_id()))  # ranges are drawn once
    sums = df.groupBy("_r").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_r", *(F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values))  # a row for each range
    own = Window.partitionBy("_r").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    for v in values:
        df = df.withColumn(f"{v}_run", F.sum(v).over(own))
    df = df.join(F.broadcast(sums), "_r")
    for v in values:
        df = df.withColumn(f"{v}_run", F.col(f"{v}_run") + F.col(f"_{v}"))
    return df.drop("_r", *(f"_{v}" for v in values))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc: share of (positive, negative) pairs in order, ties counting half."""
    curve = roc_curve(df, label, score)
    below = F.col("n_run") - F.col("p_run") - (F.col("n") - F.col("p"))  # negatives with higher scores
    wrong = F.sum(F.col("p") * (below + (F.col("n") - F.col("p")) / 2.0))
    return curve.agg((1 - wrong / (F.max("p_run") * (F.max("n_run") - F.max("p_run")))).alias("auc"))


def kl_normal(mu: Column, log_sigma: Column, prior: float = 1.0) -> Column:
    """KL(N(mu, sigma) | N(0, prior))."""
    import math

    return math.log(prior) - log_sigma + (F.exp(2 * log_sigma) + mu * mu) / (2 * prior * prior) - 0.5


def entropy_bits(p: Column) -> Column:
    """Base-2 entropy of an array of probabilities; 2 to its power is the perplexity."""
    return F.aggregate(p, F.lit(0.0), lambda s, v: s - F.when(v > 0, v * F.log2(v)).otherwise(0.0))


def perplexity(p: Column) -> Column:
    """2 to the power of the entropy of an array of probabilities."""
    return F.pow(F.lit(2.0), entropy_bits(p))


def _assignment(cost):
    """Column of each row of a square matrix with the least total cost, by
    shortest augmenting paths with potentials."""
    import numpy as np

    n = len(cost)
    row_u, col_u, owner = np.zeros(n), np.zeros(n), np.full(n, -1)
    for start in range(n):
        dist, before, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, column, length = start, -1, 0.0
        while True:
            reach = length + cost[row] - row_u[row] - col_u
            better = ~done & (reach < dist)
            dist[better], before[better] = reach[better], column
            column = int(np.where(done, np.inf, dist).argmin())
            length, done[column] = dist[column], True
            if owner[column] < 0:
                break
            row = owner[column]
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                row_u[owner[j]] += length - dist[j]
            col_u[j] -= length - dist[j]
        row_u[start] += length
        while column >= 0:
            owner[column] = owner[before[column]] if before[column] >= 0 else start
            column = before[column]
    out = np.empty(n, int)
    out[owner] = np.arange(n)
    return out


def match_labels(df: DataFrame, actual: str, cluster: str) -> tuple[dict, float]:
    """The one-to-one mapping of clusters to labels with the most rows in
    agreement, and the share of rows that agree; the confusion counts (labels
    times clusters) go to the driver.  Clusters beyond the labels map to None."""
    import numpy as np

    cells = confusion(df.where(F.col(actual).isNotNull() & F.col(cluster).isNotNull()), actual, cluster).collect()
    labels, clusters = sorted({r["actual"] for r in cells}), sorted({r["predicted"] for r in cells})
    n = max(len(labels), len(clusters))
    counts = np.zeros((n, n))
    for r in cells:
        counts[clusters.index(r["predicted"]), labels.index(r["actual"])] = r["n"]
    if not n:
        return {}, 0.0
    best = _assignment(counts.max() - counts)
    mapping = {c: labels[best[i]] if best[i] < len(labels) else None for i, c in enumerate(clusters)}
    return mapping, float(counts[np.arange(n), best].sum() / counts.sum())
