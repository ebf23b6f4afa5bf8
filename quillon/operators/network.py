"""Discrete Bayesian networks as relations: a factor is a table of its
variables and ``p``; evidence is a filter, product a natural join, and summing
out a group-by, done as soon as no later factor needs a variable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import uniform


class Network:
    def __init__(self):
        self.parents: dict[str, list[str]] = {}
        self.tables: dict[str, DataFrame] = {}

    def add(self, name: str, parents: list[str], cpt: DataFrame) -> "Network":
        """cpt: columns of the parents, of the variable, and p."""
        if missing := [p for p in parents if p not in self.parents]:
            raise ValueError(f"{name}: unknown parents {missing}")
        self.parents[name], self.tables[name] = list(parents), cpt.select(*parents, name, F.col("p").cast("double").alias("p"))
        return self

    def learn(self, name: str, parents: list[str], df: DataFrame, alpha: float = 0.0) -> "Network":
        """Adds a variable with its table counted from data."""
        if alpha:
            grid = reduce(lambda a, b: a.crossJoin(b), [df.select(c).distinct() for c in [*parents, name]])  # of the domains
            counts = grid.join(df.groupBy(*parents, name).agg(F.count("*").alias("n")), [*parents, name], "left").withColumn("n", F.coalesce("n", F.lit(0)) + alpha)
        else:
            counts = df.groupBy(*parents, name).agg(F.count("*").alias("n"))
        total = counts.groupBy(*parents).agg(F.sum("n").alias("t"))
        out = counts.join(total, parents) if parents else counts.crossJoin(total)
        return self.add(name, parents, out.select(*parents, name, (F.col("n") / F.col("t")).alias("p")))

    def order(self) -> list[str]:
        return list(self.parents)  # parents come first by construction

    def query(self, name: str, evidence: dict | None = None) -> DataFrame:
        """(name, p): the distribution given evidence, by variable elimination.
        Hidden variables go in order of the smallest joined scope."""
        evidence = evidence or {}
        needed, stack = set(), [name, *evidence]
        while stack:  # other variables sum to one
            v = stack.pop()
            if v not in needed:
                needed.add(v)
                stack += self.parents[v]
        factors = []
        for v in self.order():
            if v in needed:
                t = self.tables[v]
                scope = [c for c in t.columns if c != "p"]
                for c in [c for c in scope if c in evidence]:
                    t = t.where(F.col(c) == F.lit(evidence[c])).drop(c)
                factors.append(([c for c in scope if c not in evidence], t))
        hidden = [v for v in self.order() if v in needed and v != name and v not in evidence]
        while hidden:
            v = min(hidden, key=lambda h: (len(set().union(*(set(s) for s, _ in factors if h in s))), h))
            hidden.remove(v)
            scope, t = _product([f for f in factors if v in f[0]])
            rest = [c for c in scope if c != v]
            factors = [f for f in factors if v not in f[0]] + [(rest, t.groupBy(*rest).agg(F.sum("p").alias("p")))]
        _, t = _product(factors)
        t = t.groupBy(name).agg(F.sum("p").alias("p"))
        return t.crossJoin(t.agg(F.sum("p").alias("z"))).select(name, (F.col("p") / F.col("z")).alias("p"))

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """n rows by ancestral sampling; draws depend on (seed, variable, row) only."""
        out = spark.range(n)
        for i, v in enumerate(self.order()):
            parents = self.parents[v]
            t = self.tables[v].groupBy(*parents).agg(F.array_sort(F.collect_list(F.struct(F.col(v).alias("v"), "p"))).alias("_d"))
            out = out.join(F.broadcast(t), parents) if parents else out.crossJoin(F.broadcast(t))  # tables of the domains
            u = uniform(seed * 1000 + i, F.col("id"))
            out = out.withColumn("_u", u).withColumn(v, F.expr("aggregate(_d, struct(0D as c, cast(null as double) as _, _d[0].v as v, false as hit), (a, x) -> case when a.hit then a when a.c + x.p > _u then struct(a.c + x.p as c, a._ as _, x.v as v, true as hit) else struct(a.c + x.p as c, a._ as _, x.v as v, false as hit) end).v")).drop("_d", "_u")
        return out


def _product(factors):
    def join(a, b):
        shared = [c for c in a[0] if c in b[0]]
        right = b[1].withColumnRenamed("p", "_p")
        t = a[1].join(right, shared) if shared else a[1].crossJoin(right)
        return [*a[0], *(c for c in b[0] if c not in shared)], t.withColumn("p", F.col("p") * F.col("_p")).drop("_p")

    return reduce(join, factors)
