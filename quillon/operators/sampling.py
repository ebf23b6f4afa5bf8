"""Markov chain Monte Carlo: chains are independent rows of a table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _chains(spark: SparkSession, n_chains: int, run, schema: str) -> DataFrame:
    def rows(batches):
        for pdf in batches:
            for chain in pdf["id"].tolist():
                yield run(chain)

    return spark.range(n_chains, numPartitions=n_chains).mapInPandas(rows, schema)


def metropolis(spark: SparkSession, log_target: Callable, start, steps: int, width: float = 1.0, n_chains: int = 4, seed: int = 0) -> DataFrame:
    """(chain, step, x array, accepted) of random-walk chains; step 0 is the start."""
    start = np.atleast_1d(np.asarray(start, float))

    def run(chain):
        rng = np.random.Generator(np.random.PCG64([seed, chain]))
        x, lp = start, log_target(start)
        out, ok = [x.tolist()], [True]
        for _ in range(steps):
            y = x + width * rng.standard_normal(len(x))
            ly = log_target(y)
            hit = np.log(rng.random()) < ly - lp
            if hit:
                x, lp = y, ly
            out.append(x.tolist())
            ok.append(bool(hit))
        return pd.DataFrame({"chain": chain, "step": np.arange(steps + 1), "x": out, "accepted": ok})

    return _chains(spark, n_chains, run, "chain long, step long, x array<double>, accepted boolean")


def gibbs(spark: SparkSession, conditionals: list[Callable], start, steps: int, n_chains: int = 4, seed: int = 0) -> DataFrame:
    """(chain, step, x array); conditionals draw a coordinate from (x, rng)."""
    start = np.asarray(start, float)

    def run(chain):
        rng = np.random.Generator(np.random.PCG64([seed, chain]))
        x, out = start.copy(), [start.tolist()]
        for _ in range(steps):
            for i, draw in enumerate(conditionals):
                x[i] = draw(x, rng)
            out.append(x.tolist())
        return pd.DataFrame({"chain": chain, "step": np.arange(steps + 1), "x": out})

    return _chains(spark, n_chains, run, "chain long, step long, x array<double>")


def bivariate_normal(rho: float) -> list[Callable]:
    """Conditionals of a standard bivariate normal with correlation rho."""
    spread = (1 - rho * rho) ** 0.5
    return [lambda x, rng: rho * x[1] + spread * rng.standard_normal(), lambda x, rng: rho * x[0] + spread * rng.standard_normal()]


def diagnostics(samples: DataFrame, burn_in: int = 0) -> DataFrame:
    """(coordinate, mean, variance, r_hat) over chains."""
    long = samples.where(F.col("step") >= burn_in).select("chain", F.posexplode("x").alias("coordinate", "v"))
    per = long.groupBy("coordinate", "chain").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    out = per.groupBy("coordinate").agg(F.avg("n").alias("n"), F.avg("m").alias("mean"), F.avg("s").alias("w"), F.var_samp("m").alias("b"))
    return out.select("coordinate", "mean", F.col("w").alias("variance"), F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w")).alias("r_hat"))
