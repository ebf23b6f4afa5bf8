"""Gaussian mixtures by expectation maximisation; one pass a round."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import plus_plus
from .pairs import _matrix


def em_1d(df: DataFrame, value: str, means, variances, weights, rounds: int) -> list[tuple[float, float, float]]:
    """(mean, variance, weight) after rounds of one aggregate each, as SQL."""
    m, v, w = list(means), list(variances), list(weights)
    x = F.col(value).cast("double")
    for _ in range(rounds):
        # logarithms, so that far values don't make 0 / 0
        log = [math.log(w[k]) - 0.5 * math.log(2 * math.pi * v[k]) - (x - m[k]) * (x - m[k]) / (2 * v[k]) for k in range(len(m))]
        share = [1 / sum((F.exp(F.least(o - own, F.lit(700.0))) for o in log), F.lit(0.0)) for own in log]
        sums = [s for r in share for s in (F.sum(r), F.sum(r * x), F.sum(r * x * x))]
        row = df.agg(F.count(x), *sums).first()
        for k in range(len(m)):
            n, s, q = row[1 + 3 * k : 4 + 3 * k]
            w[k], m[k] = n / row[0], s / n
            v[k] = q / n - m[k] ** 2
    return list(zip(m, v, w))


def _log_density(x, means, covs, weights):
    out = np.empty((len(x), len(means)))
    for k, (m, c, w) in enumerate(zip(means, covs, weights)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, k] = np.log(w) - 0.5 * ((z * z).sum(0) + x.shape[1] * math.log(2 * math.pi)) - np.log(np.diag(low)).sum()
    return out


def _responsibilities(x, *model):
    ld = _log_density(x, *model)
    top = ld.max(1, keepdims=True)
    ll = top[:, 0] + np.log(np.exp(ld - top).sum(1))
    return np.exp(ld - ll[:, None]), ll


def gmm(df: DataFrame, k: int, max_iter: int = 100, tol: float = 1e-4, reg: float = 1e-6, means=None, seed: int = 0):
    """(means, covariances, weights, log-likelihood, rounds) of rows (id, v).

    Starts from identity times the mean variance and equal weights, at the given
    means or at spread-out rows.  Densities stay logarithms.
    """
    means = np.asarray(means if means is not None else plus_plus(df, k, seed), float)
    d = means.shape[1]

    def moments(batches):
        n, s, q = 0, np.zeros(d), np.zeros(d)
        for b in batches:
            x = _matrix(pa.Table.from_batches([b]), "v")
            if b.num_rows:
                n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[n, s, q].tobytes()], pa.binary())], ["s"])

    def total(function):
        return sum(np.frombuffer(r["s"]) for r in df.select("v").mapInArrow(function, "s binary").toLocalIterator())  # one row a task

    t = total(moments)
    spread = float((t[1 + d :] / t[0] - (t[1 : 1 + d] / t[0]) ** 2).mean())
    covs, weights, before = np.stack([np.eye(d) * max(spread, reg)] * k), np.full(k, 1 / k), -np.inf
    for rounds in range(1, max_iter + 1):

        def sums(batches, model=(means, covs, weights)):
            out, ll = np.zeros((k, 1 + d + d * d)), 0.0
            for b in batches:
                x = _matrix(pa.Table.from_batches([b]), "v")
                if b.num_rows:
                    r, own = _responsibilities(x, *model)
                    ll += own.sum()
                    for j in range(k):
                        out[j] += np.r_[r[:, j].sum(), r[:, j] @ x, ((x * r[:, j : j + 1]).T @ x).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([np.r_[ll, out.ravel()].tobytes()], pa.binary())], ["s"])

        got = total(sums)
        ll, out = float(got[0]), got[1:].reshape(k, -1)
        for j in range(k):
            n = out[j, 0]
            if n >= 1e-8:
                means[j] = out[j, 1 : 1 + d] / n
                covs[j] = out[j, 1 + d :].reshape(d, d) / n - np.outer(means[j], means[j]) + reg * np.eye(d)
                weights[j] = n / t[0]
        if abs(ll - before) < tol:
            break
        before = ll
    return means, covs, weights, ll, rounds


def gmm_predict(df: DataFrame, means, covs, weights) -> DataFrame:
    """(id, cluster, probability array)."""

    def rows(batches):
        for b in batches:
            r = _responsibilities(_matrix(pa.Table.from_batches([b]), "v"), means, covs, weights)[0] if b.num_rows else np.zeros((0, len(means)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(r.argmax(1).astype(np.int32) if len(r) else [], pa.int32()), pa.array(list(r), pa.list_(pa.float64()))], ["id", "cluster", "probability"])

    return df.select("id", "v").mapInArrow(rows, "id long, cluster int, probability array<double>")
