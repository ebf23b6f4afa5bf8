"""CART trees and forests, grown level by level for all trees at once.

A row goes left if x < threshold.  Thresholds are midpoints between adjacent
distinct values; a split must improve its node and leave each side at least
``min_rows`` rows; the first best in (feature, threshold) order wins.  Leaves
predict the commonest label (ties: smallest) or the mean.

A level's counts are one aggregate per (tree, node, feature, value), so what is
windowed grows with the distinct values of a node, not with its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import uniform
from ._cut import cut

#: Levels of a tree (node numbers are 64-bit), and levels after which rows are written.
DEEPEST, CUT = 61, 4
#: Splits of a level up to which they are broadcast.
SPLITS = 1_000_000


def _best_splits(rows: DataFrame, features: list[str], min_rows: int, regression: bool) -> DataFrame:
    """(tree, node, feature, threshold) of the nodes that split; rows (tree, node, w, y, features)."""
    long = rows.select("tree", "node", "w", "y", F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("x")) for i, f in enumerate(features)))).alias("p")).select("tree", "node", "w", "y", "p.*")
    key = ["tree", "node", "feature"]
    if regression:
        at = long.groupBy(*key, "x").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("q"))
        cols = ["n", "s", "q"]
    else:
        at = long.groupBy(*key, "x", "y").agg(F.sum("w").alias("n")).groupBy(*key, "x").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("c"), F.sum("n").alias("n"))
        classes = [r[0] for r in rows.select("y").distinct().sort("y").collect()]  # the classes
        at = at.select(*key, "x", "n", *(F.coalesce(F.try_element_at("c", F.lit(c)), F.lit(0)).alias(f"k{i}") for i, c in enumerate(classes)))
        cols = [f"k{i}" for i in range(len(classes))]
    by = Window.partitionBy(*key).orderBy("x")
    run, every = by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    at = at.select(*key, "x", F.lead("x").over(by).alias("up"), *(F.sum(c).over(run).alias(f"l_{c}") for c in cols), *(F.sum(c).over(every).alias(f"t_{c}") for c in cols))

    def impurity(prefix: str, less: str | None = None) -> tuple[Column, Column]:
        """(rows, rows * impurity)."""
        v = [F.col(f"{prefix}{c}") - F.col(f"{less}{c}") if less else F.col(f"{prefix}{c}") for c in cols]
        if regression:
            return v[0], v[2] - v[1] * v[1] / v[0]
        n = sum(v[1:], v[0])
        return n, n - sum((x * x for x in v[1:]), v[0] * v[0]) / n

    (nl, il), (nr, ir), (nt, it) = impurity("l_"), impurity("t_", "l_"), impurity("t_")
    gain = (it - il - ir) / nt
    cand = at.where(F.col("up").isNotNull()).select("tree", "node", "feature", ((F.col("x") + F.col("up")) / 2).alias("threshold"), F.round(gain, 12).alias("gain"), nl.alias("nl"), nr.alias("nr"))
    cand = cand.where((F.col("nl") >= min_rows) & (F.col("nr") >= min_rows) & (F.col("gain") > 1e-12))
    best = cand.groupBy("tree", "node").agg(F.min(F.struct((-F.col("gain")).alias("g"), "feature", "threshold")).alias("b"))
    return best.select("tree", "node", F.col("b.feature").alias("feature"), F.col("b.threshold").alias("threshold"), (-F.col("b.g")).alias("gain"))


def _leaves(rows: DataFrame, regression: bool) -> DataFrame:
    if regression:
        return rows.groupBy("tree", "node").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value"))
    votes = rows.groupBy("tree", "node", "y").agg(F.sum("w").alias("k"))
    return votes.groupBy("tree", "node").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "y")).alias("b")).select("tree", "node", "n", F.col("b.y").alias("value"))


def grow(rows: DataFrame, features: list[str], max_depth: int | None, min_rows: int = 2, regression: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """Nodes (tree, node, depth, n, value, feature, threshold) of trees over rows
    (tree, w, y, features).  The root is 1, children of k are 2k and 2k + 1;
    inner nodes have a feature.  allowed: (tree, feature) that a tree may use.
    Without a depth a tree grows until no node splits, to DEEPEST at most, where
    node numbers end."""
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    nodes = None
    max_depth = DEEPEST if max_depth is None else min(max_depth, DEEPEST)
    for depth in range(max_depth + 1):
        if depth and depth % CUT == 0:
            rows = cut(rows)
        level = _leaves(rows, regression).withColumn("depth", F.lit(depth))
        if depth == max_depth:
            level = level.withColumn("feature", F.lit(None).cast("int")).withColumn("threshold", F.lit(None).cast("double"))
            nodes = level if nodes is None else nodes.unionByName(level)
            break
        splits = _best_splits(rows, features, min_rows, regression) if allowed is None else _restricted(rows, features, min_rows, regression, allowed)
        splits = cut(splits.select("tree", "node", "feature", "threshold"))
        level = level.join(splits, ["tree", "node"], "left")
        nodes = level if nodes is None else nodes.unionByName(level)
        if not splits.limit(1).count():
            break
        value = F.element_at(F.array(*(F.col(f).cast("double") for f in features)), F.col("feature") + 1)
        moved = rows.join(F.broadcast(splits) if splits.count() <= SPLITS else splits, ["tree", "node"])
        rows = moved.withColumn("node", F.when(value < F.col("threshold"), 2 * F.col("node")).otherwise(2 * F.col("node") + 1)).select("tree", "w", "y", "node", *features)
    return cut(nodes)


def _restricted(rows, features, min_rows, regression, allowed):
    """Splits by each tree's own features only."""
    own = allowed.groupBy("tree").agg(F.collect_set("feature").alias("own"))
    rows = rows.join(F.broadcast(own), "tree")
    masked = rows.select("tree", "node", "w", "y", *(F.when(F.array_contains("own", i), F.col(f)).alias(f) for i, f in enumerate(features)))
    return _best_splits(masked, features, min_rows, regression)


def fit(df: DataFrame, features: list[str], label: str, max_depth: int | None = None, min_rows: int = 2, regression: bool = False) -> DataFrame:
    """Nodes of one tree (see grow)."""
    y = F.col(label).cast("double") if regression else F.col(label)
    xs, names = _named(features)
    return grow(df.select(F.lit(0).alias("tree"), F.lit(1).alias("w"), y.alias("y"), *xs), names, max_depth, min_rows, regression)


def _named(features: list[str]):
    """Features under names of their own, so that they can't clash."""
    names = [f"_x{i}" for i in range(len(features))]
    return [F.col(f).alias(n) for f, n in zip(features, names)], names


def forest(df: DataFrame, key: str, features: list[str], label: str, n_trees: int = 100, max_depth: int | None = None, min_rows: int = 2, max_features: str | int | None = "sqrt", seed: int = 0, regression: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """Nodes of a forest.  Bootstrap counts are Poisson(1) from a hash of (tree,
    row), or given as weights (tree, key, w); features are drawn per tree."""
    d = len(features)
    if max_features not in (None, "sqrt", "log2") and not isinstance(max_features, int):
        raise ValueError(f"unknown max_features {max_features}")
    k = {"sqrt": int(d**0.5), "log2": max(1, d.bit_length() - 1), None: d}.get(max_features, max_features)
    spark = df.sparkSession
    trees = spark.range(n_trees).select(F.col("id").cast("int").alias("tree"))
    allowed = trees.crossJoin(spark.range(d).select(F.col("id").cast("int").alias("feature")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(uniform(seed, "tree", "feature"), "feature"))
    allowed = allowed.withColumn("p", place).where(F.col("p") <= max(1, min(d, k))).select("tree", "feature")
    y = F.col(label).cast("double") if regression else F.col(label)
    xs, names = _named(features)
    rows = df.select(F.col(key).alias("key"), y.alias("y"), *xs)
    if weights is None:
        u = uniform(seed + 1, "tree", "key")
        steps, total, term = F.lit(0), 0.0, 0.36787944117144233
        for i in range(8):
            total += term
            steps = steps + (u >= total).cast("int")
            term /= i + 1
        rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn("w", steps)
    else:
        rows = rows.join(weights.toDF("tree", "key", "w"), "key")
    return grow(rows.where("w > 0").select("tree", "w", "y", *names), names, max_depth, min_rows, regression, allowed)


def predict(df: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """df with tree_values: the value of each tree, as a map tree -> value."""
    table = F.broadcast(nodes.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "threshold", "value")))).alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("tree", "t"))).alias("_trees")))
    deep = nodes.agg(F.max("depth")).first()[0] or 0
    x = F.array(*(F.col(f).cast("double") for f in features))

    def walk(t: Column) -> Column:
        def step(node, _):
            n = F.try_element_at(t, node)
            return F.when(n["feature"].isNull(), node).when(F.element_at(x, n["feature"] + 1) < n["threshold"], 2 * node).otherwise(2 * node + 1)

        return F.try_element_at(t, F.aggregate(F.sequence(F.lit(0), F.lit(deep)), F.lit(1).cast("long"), step))["value"]

    return df.crossJoin(table).withColumn("tree_values", F.transform_values("_trees", lambda k, t: walk(t))).drop("_trees")


def vote(values: Column) -> Column:
    """The commonest value of a map tree -> value; ties to the smallest."""
    v = F.map_values(values)
    counts = F.transform(F.array_sort(F.array_distinct(v)), lambda c: F.struct((-F.size(F.filter(v, lambda x: x == c))).alias("n"), c.alias("c")))
    return F.array_min(counts)["c"]


def mean(values: Column) -> Column:
    v = F.map_values(values)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def importances(nodes: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): share of a tree's splits on a feature, over trees that split."""
    names = F.array(*map(F.lit, features))
    own = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.count("*").alias("n"))
    all_ = own.groupBy("tree").agg(F.sum("n").alias("t"))
    trees = F.broadcast(all_.agg(F.count("*").alias("trees")))
    out = own.join(all_, "tree").crossJoin(trees).groupBy("feature").agg(F.sum(F.col("n") / F.col("t") / F.col("trees")).alias("importance"))
    return out.select(F.element_at(names, F.col("feature") + 1).alias("feature"), "importance")


def explain(nodes: DataFrame, features: list[str]) -> DataFrame:
    """(tree, node, line): a tree as text, indented by depth."""
    names = F.array(*map(F.lit, features))
    inner = F.concat(F.element_at(names, F.col("feature") + 1), F.lit(" < "), F.col("threshold").cast("string"))
    return nodes.select("tree", "node", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.coalesce(inner, F.concat(F.lit("-> "), F.col("value").cast("string")))).alias("line"))
