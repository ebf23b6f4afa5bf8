"""Linear models from one pass of sums of squares and products.

Least squares, ridge, lasso, Bayesian regression and gradient descent on a
squared loss depend on the data only through ``Gram``; their steps run on the
driver on d x d numbers.  Logistic regression and the linear SVM take one
aggregate per epoch.  Rows with a null or NaN in a feature or the label are
left out of a fit and get a null prediction.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import dot, sigmoid, total

#: Features up to which sums are columns of one aggregate; beyond, tasks send
#: partial matrices made by Arrow batches.
WIDE = 16


@dataclass(frozen=True)
class Gram:
    """n, X'X, X'y, y'y with a leading column of ones in X."""

    n: int
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    def centred(self):
        """Means, centred X'X and X'y, centred y'y."""
        mean, my = self.xx[0, 1:] / self.n, self.xy[0] / self.n
        return mean, my, self.xx[1:, 1:] - self.n * np.outer(mean, mean), self.xy[1:] - self.n * mean * my, self.yy - self.n * my * my


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def gram(df: DataFrame, features: list[str], label: str, wide: int = WIDE) -> Gram:
    df = complete(df, [*features, label]).select(*(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, label])))
    d = len(features) + 1
    if d <= wide:
        cols = [F.lit(1.0), *(F.col(f) for f in features)]
        every = {f"{i}_{j}": F.sum(cols[i] * cols[j]) for i in range(d) for j in range(i, d)}
        every |= {f"y_{i}": F.sum(cols[i] * F.col(label)) for i in range(d)} | {"yy": F.sum(F.col(label) * F.col(label))}
        row = df.agg(*(v.alias(k) for k, v in every.items())).first()
        if not row["0_0"]:
            raise ValueError("no samples to fit")
        xx = np.array([[row[f"{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        return Gram(int(row["0_0"]), xx, np.array([row[f"y_{i}"] for i in range(d)]), row["yy"])

    def partial(batches):
        sums = np.zeros((d + 1, d + 1))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *(b.column(c).to_numpy() for c in [*features, label])])
            sums += x.T @ x
        i, j = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(sums.ravel())], ["i", "j", "s"])

    sums = np.zeros((d + 1, d + 1))
    for r in df.select(*features, label).mapInArrow(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # (d + 1)^2 rows
        sums[r["i"], r["j"]] = r["s"]
    if not sums[0, 0]:
        raise ValueError("no samples to fit")
    return Gram(int(sums[0, 0]), sums[:d, :d], sums[:d, d], float(sums[d, d]))


@dataclass(frozen=True)
class LinearModel:
    features: list[str]
    coef: np.ndarray
    intercept: float
    history: list[float] = field(default_factory=list)

    def margin(self) -> Column:
        return dot([F.col(f).cast("double") for f in self.features], self.coef, self.intercept)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.margin())

    def score(self, df: DataFrame, label: str) -> float:
        """R2; 0 if the label doesn't vary."""
        return r2(complete(df, [*self.features, label]), F.col(label).cast("double"), self.margin())


def r2(df: DataFrame, y: Column, prediction: Column) -> float:
    mean = df.agg(F.avg(y)).first()[0]
    row = df.agg(F.sum((y - prediction) ** 2).alias("e"), F.sum((y - F.lit(mean)) ** 2).alias("t")).first()
    return 1.0 - row["e"] / row["t"] if row["t"] else 0.0


def ols(df: DataFrame, features: list[str], label: str, intercept: bool = True) -> LinearModel:
    """Least squares; of several solutions that of least norm."""
    g = gram(df, features, label)
    if intercept:
        mean, my, xx, xy, _ = g.centred()
        w = np.linalg.lstsq(xx, xy, rcond=None)[0]
        return LinearModel(features, w, float(my - mean @ w))
    return LinearModel(features, np.linalg.lstsq(g.xx[1:, 1:], g.xy[1:], rcond=None)[0], 0.0)


def ridge(df: DataFrame, features: list[str], label: str, alpha: float = 1.0, penalise_intercept: bool = False) -> LinearModel:
    g = gram(df, features, label)
    penalty = alpha * np.eye(len(features) + 1)
    penalty[0, 0] = alpha if penalise_intercept else 0.0
    w = np.linalg.solve(g.xx + penalty, g.xy)
    return LinearModel(features, w[1:], float(w[0]))


def lasso(df: DataFrame, features: list[str], label: str, alpha: float = 1.0, max_iter: int = 1000, tol: float = 1e-4) -> LinearModel:
    """Cyclic coordinate descent on centred data, in covariance form."""
    g = gram(df, features, label)
    mean, my, xx, xy, _ = g.centred()
    xx, xy, w, history = xx / g.n, xy / g.n, np.zeros(len(features)), []
    for _ in range(max_iter):
        before = w.copy()
        for j in range(len(w)):
            rho = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / (xx[j, j] or 1.0)
        history.append(float(np.abs(w - before).max(initial=0.0)))
        if history[-1] < tol:
            break
    return LinearModel(features, w, float(my - mean @ w), history)


def gradient_descent(df: DataFrame, features: list[str], label: str, rate: float = 0.01, epochs: int = 1000, scale: float = 2.0, decay: float = 0.0, fallback: bool = True) -> LinearModel:
    """Full-batch steps ``w -= rate * (scale / n * X'(Xw - y) + decay * w)`` from
    zero; an epoch that raises the loss is undone and the rate halved."""
    g = gram(df, features, label)
    w, history = np.zeros(len(features) + 1), []

    def loss(w):
        return float(w @ g.xx @ w - 2 * w @ g.xy + g.yy) / g.n

    now = loss(w)
    for _ in range(epochs):
        shrink = np.r_[0.0, w[1:]] * decay
        after = w - rate * (scale / g.n * (g.xx @ w - g.xy) + shrink)
        value = loss(after)
        if fallback and not value <= now + 1e-12:
            rate /= 2
        else:
            w, now = after, value
        history.append(now)
    return LinearModel(features, w[1:], float(w[0]), history)


@dataclass(frozen=True)
class BayesianModel(LinearModel):
    covariance: np.ndarray = None
    alpha: float = 1.0
    beta: float = 1.0

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        xs = [F.lit(1.0), *(F.col(f).cast("double") for f in self.features)]
        quad = total([xs[i] * xs[j] * F.lit(float(self.covariance[i, j])) for i in range(len(xs)) for j in range(len(xs))])
        return super().transform(df, output).withColumn(f"{output}_std", F.sqrt(F.lit(1.0 / self.beta) + quad))


def bayesian(df: DataFrame, features: list[str], label: str, alpha: float = 1.0, beta: float = 1.0, evidence: bool = False, max_iter: int = 300, tol: float = 1e-5) -> BayesianModel:
    """Conjugate Gaussian posterior, intercept shrunk as well; with ``evidence``
    alpha and beta maximise the marginal likelihood."""
    g = gram(df, features, label)
    eye, eig = np.eye(len(g.xy)), np.linalg.eigvalsh(g.xx)

    def posterior():
        s = np.linalg.inv(alpha * eye + beta * g.xx)
        return s, beta * s @ g.xy

    s, m = posterior()
    for _ in range(max_iter if evidence else 0):
        gamma = float((beta * eig / (alpha + beta * eig)).sum())
        rest = float(m @ g.xx @ m - 2 * m @ g.xy + g.yy)
        new = gamma / max(m @ m, 1e-12), max(g.n - gamma, 1e-12) / max(rest, 1e-12)
        moved = abs(new[0] - alpha) + abs(new[1] - beta)
        alpha, beta = new
        s, m = posterior()
        if moved < tol:
            break
    return BayesianModel(features, m[1:], float(m[0]), [], s, alpha, beta)


@dataclass(frozen=True)
class LogisticModel(LinearModel):
    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        p = sigmoid(self.margin())
        return df.withColumn("probability", p).withColumn(output, (p >= 0.5).cast("int"))


def logistic(df: DataFrame, features: list[str], label: str, rate: float = 0.01, epochs: int = 100) -> LogisticModel:
    """Full-batch gradient steps ``w -= rate * avg((p - y) * x)`` from zero; one
    aggregate an epoch.  Labels must be 0 or 1."""
    df = complete(df, [*features, label])
    if df.where(~F.col(label).isin(0, 1)).limit(1).count():
        raise ValueError("binary labels 0 and 1 are needed")
    w, history = np.zeros(len(features) + 1), []
    xs = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    y = F.col(label).cast("double")
    for _ in range(epochs):
        p = sigmoid(dot(xs[1:], w[1:], w[0]))
        clipped = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        loss = F.avg(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped)))
        row = df.agg(*(F.avg((p - y) * x) for x in xs), loss).first()
        w = w - rate * np.array(row[:-1])
        history.append(row[-1])
    return LogisticModel(features, w[1:], float(w[0]), history)


@dataclass(frozen=True)
class MarginModel(LinearModel):
    classes: tuple = (0, 1)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn("margin", self.margin()).withColumn(output, F.when(F.col("margin") >= 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))


def svm(df: DataFrame, features: list[str], label: str, rate: float = 1e-3, epochs: int = 100, c: float = 1.0, regularise_bias: bool = False) -> MarginModel:
    """Batch sub-gradient of ``|w|^2 / 2 + c * avg(hinge)``; the bias isn't
    regularised unless asked for.  Exactly two classes, the larger is positive."""
    df = complete(df, features).where(F.col(label).isNotNull())
    classes = [r[0] for r in df.select(label).distinct().sort(label).limit(3).collect()]
    if len(classes) != 2:
        raise ValueError("exactly two classes are needed")
    xs = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    y = F.when(F.col(label) == F.lit(classes[1]), 1.0).otherwise(-1.0)
    w = np.zeros(len(xs))
    for _ in range(epochs):
        inside = y * dot(xs[1:], w[1:], w[0]) < 1
        row = df.agg(*(F.avg(F.when(inside, -c * y * x).otherwise(0.0)) for x in xs)).first()
        keep = np.r_[w[0] if regularise_bias else 0.0, w[1:]]
        w = w - rate * (keep + np.array(row))
    return MarginModel(features, w[1:], float(w[0]), [], tuple(classes))


def conjugate_normal_mean(df: DataFrame, value: str, by: list[str], prior_mean: float, prior_std: float) -> DataFrame:
    """Posterior mean and std of each group's mean under a normal prior, with
    the group's own population std as the known noise."""
    v = F.col(value).cast("double")
    stats = df.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))
    precision = F.lit(1.0 / prior_std**2) + F.col("n") / F.col("v")
    mean = (F.lit(prior_mean / prior_std**2) + F.col("n") * F.col("m") / F.col("v")) / precision
    return stats.where("v > 0").select(*by, "n", mean.alias("posterior_mean"), F.sqrt(1.0 / precision).alias("posterior_std"))


def variational_normal(df: DataFrame, value: str, iterations: int = 100, rate: float = 0.01) -> tuple[float, float]:
    """Mean-field fit of N(mu, sigma): gradient steps on the mean and on log
    sigma, whose fixed point is the sample mean and standard deviation."""
    v = F.col(value).cast("double")
    n, m, q = df.agg(F.count(v), F.avg(v), F.avg(v * v)).first()
    mu, s = 0.0, 0.0
    for _ in range(iterations if n else 0):
        spread = q - 2 * mu * m + mu * mu
        mu, s = mu + rate * (m - mu), s + rate * (spread / np.exp(2 * s) - 1)
    return mu, float(np.exp(s))
