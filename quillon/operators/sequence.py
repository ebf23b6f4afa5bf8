"""Recurrences over ordered rows: hidden Markov models, Kalman filters, folds.

Sequences are independent, so a group is one sequence; each is held by one
task, as its recurrence demands, and is bounded by its own length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ordered(df: DataFrame, key: str, *values: str) -> DataFrame:
    """(key, steps): each sequence as an array of structs, in order of the values."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*values))).alias("steps"))


def kalman_1d(steps: Column, value: str, f=1.0, q=1e-4, h=1.0, r=1.0, x0=0.0, p0=1e6) -> Column:
    """struct<x, p, ll> after a sequence, as a fold that stays in the JVM."""
    import math

    def step(a, s):
        x, p = f * a["x"], f * f * a["p"] + q
        z = s[value].cast("double")
        e, v = z - h * x, h * h * p + r
        g = p * h / v
        return F.struct((x + g * e).alias("x"), ((1 - g * h) * p).alias("p"), (a["ll"] - 0.5 * (math.log(2 * math.pi) + F.log(v) + e * e / v)).alias("ll"))

    return F.aggregate(steps, F.struct(F.lit(float(x0)).alias("x"), F.lit(float(p0)).alias("p"), F.lit(0.0).alias("ll")), step)


@dataclass(frozen=True)
class Kalman:
    f: np.ndarray
    h: np.ndarray
    q: np.ndarray
    r: np.ndarray
    x0: np.ndarray | None = None
    p0: np.ndarray | None = None

    def _run(self, zs):
        f, h, q, r = map(np.atleast_2d, (self.f, self.h, self.q, self.r))
        d = len(f)
        x = np.zeros(d) if self.x0 is None else np.asarray(self.x0, float)
        p = np.eye(d) * 1e6 if self.p0 is None else np.asarray(self.p0, float)
        out, ll = [], 0.0
        for z in zs:
            xp, pp = f @ x, f @ p @ f.T + q
            e, s = np.atleast_1d(z) - h @ xp, h @ pp @ h.T + r
            g = np.linalg.solve(s, h @ pp).T
            x, p = xp + g @ e, (np.eye(d) - g @ h) @ pp
            sign, logdet = np.linalg.slogdet(s)
            if sign > 0:
                ll -= 0.5 * (len(e) * np.log(2 * np.pi) + logdet + e @ np.linalg.solve(s, e))
            out.append((xp, pp, x, p, ll))
        return out

    def _smooth(self, run):
        f = np.atleast_2d(self.f)
        xs, ps = run[-1][2], run[-1][3]
        out = [(xs, ps)]
        for t in range(len(run) - 2, -1, -1):
            xp, pp = run[t + 1][:2]
            c = run[t][3] @ f.T @ np.linalg.inv(pp)
            xs, ps = run[t][2] + c @ (xs - xp), run[t][3] + c @ (ps - pp) @ c.T
            out.append((xs, ps))
        return out[::-1]

    def predict_obs(self, states: DataFrame) -> DataFrame:
        """states (with an array column x) with z: the observation expected, h x."""
        rows = [[float(c) for c in r] for r in np.atleast_2d(self.h)]
        return states.withColumn("z", F.array(*(sum((F.col("x")[i] * c for i, c in enumerate(r) if c), F.lit(0.0)) for r in rows)))

    def apply(self, df: DataFrame, key: str = "key", order: str = "t", value: str = "z", smooth: bool = False) -> DataFrame:
        """(key, t, x, p, log_likelihood so far), filtered or smoothed (RTS)."""

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t")
            run = self._run([np.asarray(z, float) for z in pdf["z"]])
            state = self._smooth(run) if smooth else [(s[2], s[3]) for s in run]
            return pd.DataFrame({"key": pdf["key"].to_numpy(), "t": pdf["t"].to_numpy(), "x": [s[0].tolist() for s in state], "p": [s[1].tolist() for s in state], "log_likelihood": [s[4] for s in run]})

        t = df.schema[order].dataType.simpleString()
        k = df.schema[key].dataType.simpleString()
        rows = df.select(F.col(key).alias("key"), F.col(order).alias("t"), F.col(value).alias("z"))
        return rows.groupBy("key").applyInPandas(one, f"key {k}, t {t}, x array<double>, p array<array<double>>, log_likelihood double")


@dataclass(frozen=True)
class HMM:
    pi: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @staticmethod
    def random(n_states: int, n_obs: int, seed: int = 0) -> "HMM":
        rng = np.random.Generator(np.random.PCG64(seed))
        norm = lambda m: m / m.sum(-1, keepdims=True)
        return HMM(*(norm(rng.random(s) + 0.1) for s in ((n_states,), (n_states, n_states), (n_states, n_obs))))

    def forward(self, obs):
        alpha, scale = np.empty((len(obs), len(self.pi))), np.empty(len(obs))
        for t, o in enumerate(obs):
            v = (self.pi if t == 0 else alpha[t - 1] @ self.a) * self.b[:, o]
            scale[t] = max(v.sum(), 1e-300)
            alpha[t] = v / scale[t]
        return alpha, scale

    def backward(self, obs, scale):
        beta = np.ones((len(obs), len(self.pi)))
        for t in range(len(obs) - 2, -1, -1):
            beta[t] = self.a @ (self.b[:, obs[t + 1]] * beta[t + 1]) / scale[t + 1]
        return beta

    def viterbi(self, obs):
        log = lambda m: np.log(np.maximum(m, 1e-300))
        v, back = log(self.pi) + log(self.b[:, obs[0]]), []
        for o in obs[1:]:
            s = v[:, None] + log(self.a)
            back.append(s.argmax(0))
            v = s.max(0) + log(self.b[:, o])
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def sample(self, spark: SparkSession, sequences: int, length: int, seed: int = 0) -> DataFrame:
        """(seq_id, t, state, obs) of sequences drawn from the model, each from its own generator."""

        def draw(batches):
            for ids in batches:
                for seq in ids["id"].tolist():
                    rng = np.random.Generator(np.random.PCG64([seed, seq]))
                    u, states = rng.random((2, length)), np.empty(length, np.int64)
                    for t in range(length):
                        states[t] = np.searchsorted(np.cumsum(self.pi if t == 0 else self.a[states[t - 1]])[:-1], u[0, t], side="right")
                    below = np.cumsum(self.b, 1)[states, :-1]
                    yield pd.DataFrame({"seq_id": seq, "t": np.arange(length), "state": states, "obs": (below <= u[1][:, None]).sum(1)})

        return spark.range(sequences).mapInPandas(draw, "seq_id long, t int, state int, obs int")

    def _grouped(self, df, function, schema):
        return df.groupBy("seq_id").applyInPandas(function, schema)

    def log_likelihood(self, df: DataFrame) -> DataFrame:
        """(seq_id, log_likelihood) of rows (seq_id, t, obs)."""
        return self._grouped(df, lambda p: pd.DataFrame({"seq_id": [p["seq_id"].iloc[0]], "log_likelihood": [float(np.log(self.forward(p.sort_values("t")["obs"].to_numpy())[1]).sum())]}), "seq_id long, log_likelihood double")

    def decode(self, df: DataFrame) -> DataFrame:
        """(seq_id, t, state): the likeliest path; ties to the lowest state."""

        def one(p):
            p = p.sort_values("t")
            return pd.DataFrame({"seq_id": p["seq_id"].to_numpy(), "t": p["t"].to_numpy(), "state": self.viterbi(p["obs"].to_numpy())})

        return self._grouped(df, one, f"seq_id long, t {df.schema['t'].dataType.simpleString()}, state int")

    def fit(self, df: DataFrame, rounds: int = 100, tol: float = 1e-4) -> tuple["HMM", list[float]]:
        """Baum-Welch over all sequences: groups send expected counts, which are
        summed by a group-by; the driver sees states * (states + symbols) numbers."""
        now, history = self, []
        k, m = self.b.shape
        for _ in range(rounds):
            model = now

            def expect(p):
                obs = p.sort_values("t")["obs"].to_numpy()
                alpha, scale = model.forward(obs)
                beta = model.backward(obs, scale)
                gamma = alpha * beta
                xi = np.zeros((k, k))
                for t in range(len(obs) - 1):
                    xi += alpha[t][:, None] * model.a * (model.b[:, obs[t + 1]] * beta[t + 1])[None] / scale[t + 1]
                emit = np.stack([np.bincount(obs, gamma[:, i], m) for i in range(k)])
                flat = np.r_[np.log(scale).sum(), gamma[0], xi.ravel(), emit.ravel()]
                return pd.DataFrame({"i": np.arange(len(flat), dtype=np.int32), "v": flat})

            got = self._grouped(df, expect, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).sort("i").collect()
            flat = np.array([r["v"] for r in got])
            ll, g, xi, emit = flat[0], flat[1 : 1 + k], flat[1 + k : 1 + k + k * k].reshape(k, k), flat[1 + k + k * k :].reshape(k, m)
            norm = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1e-300)
            now = HMM(norm(g), norm(xi), norm(emit))
            history.append(float(ll))
            if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
                break
        return now, history


def hmm_forward(steps: Column, obs: str, model: HMM) -> Column:
    """struct<ll, alpha> after a sequence, as a fold that stays in the JVM."""
    k = len(model.pi)
    pi = F.array(*(F.lit(float(x)) for x in model.pi))
    a = [[float(x) for x in row] for row in model.a]
    b = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in model.b))

    def step(acc, s):
        prior = F.when(acc["n"] == 0, pi).otherwise(F.array(*(sum((acc["alpha"][i] * a[i][j] for i in range(1, k)), acc["alpha"][0] * a[0][j]) for j in range(k))))
        v = F.transform(prior, lambda x, j: x * F.element_at(F.element_at(b, j + 1), s[obs] + 1))
        scale = F.aggregate(v, F.lit(0.0), lambda t, x: t + x)
        return F.struct((acc["n"] + 1).alias("n"), (acc["ll"] + F.log(scale)).alias("ll"), F.transform(v, lambda x: x / scale).alias("alpha"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("ll"), F.array_repeat(F.lit(0.0), k).alias("alpha")), step)


def transitions(df: DataFrame, key: str, order: str | Column, state: str) -> DataFrame:
    """(state, next, n, p): counts of adjacent states and their row shares."""
    from pyspark.sql import Window

    nxt = F.lead(state).over(Window.partitionBy(key).orderBy(order))
    n = df.select(F.col(state).alias("state"), nxt.alias("next")).where("next is not null").groupBy("state", "next").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def discounted(steps: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages: array of A_t of steps (r, v, done), by a reverse
    fold; the value after the last step is 0."""

    def step(acc, s):
        live = F.when(s["done"], 0.0).otherwise(1.0)
        delta = s["r"] + gamma * acc["v"] * live - s["v"]
        adv = delta + gamma * lam * live * acc["a"]
        return F.struct(s["v"].alias("v"), adv.alias("a"), F.concat(F.array(adv), acc["out"]).alias("out"))

    return F.aggregate(F.reverse(steps), F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("out")), step, lambda acc: acc["out"])


def recurrent(steps: Column, value: str, w_in: float, w_back: float, bias: float = 0.0) -> Column:
    """Hidden state of a one-unit tanh network after each step."""

    def step(acc, s):
        h = F.tanh(w_in * s[value].cast("double") + w_back * acc["h"] + bias)
        return F.struct(h.alias("h"), F.concat(acc["out"], F.array(h)).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0.0).alias("h"), F.array().cast("array<double>").alias("out")), step, lambda acc: acc["out"])
