"""Sequential decisions: models and experience are tables, rollouts run in
parallel tasks with a frozen policy, and only sampled batches reach a learner."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import normal, uniform
from ._cut import cut
from .neural import MLP

# Rewards of the grid world; step, drag and bounds of the point mass.
GOAL, PIT, STEP = 10.0, -10.0, -0.1
DT, DRAG, BOUND, FORCES = 0.05, 0.1, 2.0, (-1.0, -0.5, 0.0, 0.5, 1.0)


def grid_world(spark: SparkSession, size: int = 4, pit: tuple[int, int] = (1, 1)) -> DataFrame:
    """(s, a, s2, r, done): moves up, down, left, right, stopped by walls; the goal is the last cell."""
    cells = spark.range(size * size).select(F.col("id").cast("int").alias("s")).crossJoin(spark.range(4).select(F.col("id").cast("int").alias("a")))
    row, col = F.floor(F.col("s") / size).cast("int"), F.col("s") % size
    row = F.when(F.col("a") == 0, F.greatest(row - 1, F.lit(0))).when(F.col("a") == 1, F.least(row + 1, F.lit(size - 1))).otherwise(row)
    col = F.when(F.col("a") == 2, F.greatest(col - 1, F.lit(0))).when(F.col("a") == 3, F.least(col + 1, F.lit(size - 1))).otherwise(col)
    s2, goal, hole = (row * size + col), size * size - 1, pit[0] * size + pit[1]
    out = cells.select("s", "a", s2.cast("int").alias("s2"))
    return out.select("s", "a", "s2", F.when(F.col("s2") == goal, GOAL).when(F.col("s2") == hole, PIT).otherwise(STEP).alias("r"), F.col("s2").isin(goal, hole).alias("done"))


def rollout(actions: Column, x0: Column, v0: Column) -> Column:
    """array<struct<x, v, r>> of a point mass under an array of forces, as a fold."""
    clip = lambda c: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), c))

    def step(acc, u):
        v = clip(acc["v"] + DT * (u - DRAG * acc["v"]))
        x = clip(acc["x"] + DT * v)
        r = -(x * x + 0.1 * v * v + 0.001 * u * u)
        return F.struct(x.alias("x"), v.alias("v"), F.concat(acc["out"], F.array(F.struct(x.alias("x"), v.alias("v"), r.alias("r")))).alias("out"))

    start = F.struct(x0.cast("double").alias("x"), v0.cast("double").alias("v"), F.array().cast("array<struct<x:double,v:double,r:double>>").alias("out"))
    return F.aggregate(actions, start, step, lambda acc: acc["out"])


def discrete_force(a: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, FORCES)), a + 1)


def ring(df: DataFrame, order: str, capacity: int) -> DataFrame:
    """The newest rows; a replay buffer's content.  The bound is a top-k."""
    return df.orderBy(F.desc(order)).limit(capacity)


def replay_sample(df: DataFrame, key: str, batch: int, seed: int = 0) -> DataFrame:
    """Rows without replacement: those with the least hash of (seed, key)."""
    return df.orderBy(uniform(seed, F.col(key)), key).limit(batch)


def prioritised_sample(df: DataFrame, key: str, delta: str, draws: list[float], alpha: float = 0.6, beta: float = 0.4, eps: float = 1e-5) -> DataFrame:
    """(draw, key, weight): one row from each of len(draws) equal segments of
    cumulative priority (|delta| + eps)**alpha, at the given place in it, with
    importance weights scaled by the largest.

    Running sums go over ranges of keys, so no task holds all rows; a draw is a
    range join with the ranges first and the rows of one range after.
    """
    p = df.select(F.col(key).alias("k"), F.pow(F.abs(F.col(delta)) + eps, F.lit(alpha)).alias("p")).repartitionByRange(32, "k").withColumn("part", F.spark_partition_id())
    p = cut(p)
    sums = p.groupBy("part").agg(F.sum("p").alias("t"))
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("part", "t", F.sum("t").over(run).alias("hi")).withColumn("lo", F.col("hi") - F.col("t"))  # a row for each range
    rows = p.join(F.broadcast(sums.select("part", "lo")), "part")
    own = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hi", F.col("lo") + F.sum("p").over(own)).withColumn("lo", F.col("hi") - F.col("p"))
    n = p.count()
    total = sums.agg(F.max("hi")).first()[0]
    points = [(i, (i + u) * total / len(draws)) for i, u in enumerate(draws)]
    points = F.broadcast(df.sparkSession.createDataFrame(points, "draw int, at double"))
    hit = rows.join(points, (F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi"))).withColumn("w", F.pow(n * F.col("p") / total, F.lit(-beta)))
    top = F.broadcast(hit.agg(F.max("w").alias("top")))
    return hit.crossJoin(top).select("draw", F.col("k").alias(key), (F.col("w") / F.col("top")).alias("weight"))


def ou_noise(n: Column, key: Column, seed: int = 0, mu=0.0, theta=0.15, sigma=0.2, dt=1e-2) -> Column:
    """array of n values of an Ornstein-Uhlenbeck path of a key."""

    def step(acc, i):
        x = acc["x"] + theta * (mu - acc["x"]) * dt + sigma * dt**0.5 * normal(seed, key, i)
        return F.struct(x.alias("x"), F.concat(acc["out"], F.array(x)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit(0.0).alias("x"), F.array().cast("array<double>").alias("out")), step, lambda acc: acc["out"])


def gaussian_noise(step: Column, key: Column, seed: int = 0, sigma=0.1, least=0.01, decay=1.0) -> Column:
    return F.greatest(F.lit(least), sigma * F.pow(F.lit(decay), step)) * normal(seed, key, step)


def ou_decay(steps: int, x0: float, mu=0.0, theta=0.15, dt=1e-2) -> list[float]:
    out, x = [], x0
    for _ in range(steps):
        x += theta * (mu - x) * dt
        out.append(x)
    return out


def q_sweeps(model: DataFrame, sweeps: int, gamma: float = 0.99) -> DataFrame:
    """(s, a, q) after synchronous Bellman sweeps over (s, a, s2, r, done) from 0;
    repeated transitions of (s, a) average."""
    model = cut(model.groupBy("s", "a", "s2", "done").agg(F.sum("r").alias("r"), F.count("*").alias("n")))
    q = model.select("s", "a").distinct().withColumn("q", F.lit(0.0))
    for _ in range(sweeps):
        v = q.groupBy(F.col("s").alias("s2")).agg(F.max("q").alias("v"))
        target = F.col("r") + F.when(F.col("done"), 0.0).otherwise(gamma * F.coalesce("v", F.lit(0.0))) * F.col("n")
        q = cut(model.join(v, "s2", "left").groupBy("s", "a").agg((F.sum(target) / F.sum("n")).alias("q")))
    return q


def policy(q: DataFrame) -> DataFrame:
    """(s, a, v): the best action, ties to the lowest, and its value."""
    return q.groupBy("s").agg(F.min(F.struct((-F.col("q")).alias("n"), "a")).alias("b")).select("s", F.col("b.a").alias("a"), (-F.col("b.n")).alias("v"))


def td_target(r: Column, done: Column, next_value: Column, gamma: float = 0.99) -> Column:
    return r + F.when(done, 0.0).otherwise(1.0) * gamma * next_value


def double_q_target(r, done, online: Column, target: Column, gamma: float = 0.99) -> Column:
    """The target network's value of the online network's best action (arrays)."""
    best = F.array_position(online, F.array_max(online)).cast("int")
    return td_target(r, done, F.element_at(target, best), gamma)


def dueling(v: Column, advantages: Column) -> Column:
    mean = F.aggregate(advantages, F.lit(0.0), lambda s, x: s + x) / F.size(advantages)
    return F.transform(advantages, lambda a: v + a - mean)


def twin_target(r, done, q1: Column, q2: Column, gamma: float = 0.99) -> Column:
    return td_target(r, done, F.least(q1, q2), gamma)


def soft_target(r, done, q1, q2, log_p, alpha: float = 0.2, gamma: float = 0.99) -> Column:
    return td_target(r, done, F.least(q1, q2) - alpha * log_p, gamma)


def ppo_surrogate(ratio: Column, advantage: Column, eps: float = 0.2) -> Column:
    return F.least(ratio * advantage, F.greatest(F.lit(1 - eps), F.least(F.lit(1 + eps), ratio)) * advantage)


def squashed_log_prob(u: Column, mu: Column, log_std: Column) -> Column:
    """log-density of tanh(u) for u ~ N(mu, exp(log_std))."""
    import math

    z = (u - mu) / F.exp(log_std)
    return -0.5 * z * z - log_std - 0.5 * math.log(2 * math.pi) - F.log(1 - F.tanh(u) * F.tanh(u) + 1e-6)


def lstd_q(df: DataFrame, features: list[str], next_features: list[str], reward: str, gamma: float = 0.99, ridge: float = 1e-6) -> np.ndarray:
    """Weights of linear action values from one pass of sums of products."""
    d = len(features)
    x, y = [F.col(c) for c in features], [F.col(c) for c in next_features]
    row = df.agg(*(F.sum(x[i] * (x[j] - gamma * y[j])) for i in range(d) for j in range(d)), *(F.sum(x[i] * F.col(reward)) for i in range(d))).first()
    return np.linalg.solve(np.array(row[: d * d]).reshape(d, d) + ridge * np.eye(d), np.array(row[d * d :]))


def q_learning(spark: SparkSession, size: int, episodes: int, seeds: int = 4, alpha=0.1, gamma=0.99, eps=1.0, eps_min=0.01, eps_decay=0.995, max_steps=200, double: bool = False) -> DataFrame:
    """(seed, s, a, q): tabular learners on the grid world, one independent
    learner a seed, in parallel; ``double`` keeps two tables."""

    def run(batches):
        for pdf in batches:
            for seed in pdf["id"].tolist():
                rng = np.random.Generator(np.random.PCG64(seed))
                q, e = np.zeros((2, size * size, 4)), eps
                for _ in range(episodes):
                    s = 0
                    for _ in range(max_steps):
                        both = q.sum(0) if double else q[0]
                        a = int(rng.integers(4)) if rng.random() < e else int(both[s].argmax())
                        r, c = divmod(s, size)
                        r, c = min(max(r + (a == 1) - (a == 0), 0), size - 1), min(max(c + (a == 3) - (a == 2), 0), size - 1)
                        s2 = r * size + c
                        done = s2 in (size * size - 1, size + 1)
                        reward = GOAL if s2 == size * size - 1 else PIT if done else STEP
                        k = int(rng.integers(2)) if double else 0
                        other = q[1 - k] if double else q[0]
                        value = 0.0 if done else gamma * other[s2, q[k, s2].argmax()]
                        q[k, s, a] += alpha * (reward + value - q[k, s, a])
                        s = s2
                        if done:
                            break
                    e = max(eps_min, e * eps_decay)
                out = q.mean(0) if double else q[0]
                i, j = np.indices(out.shape)
                yield pd.DataFrame({"seed": seed, "s": i.ravel(), "a": j.ravel(), "q": out.ravel()})

    return spark.range(seeds, numPartitions=seeds).mapInPandas(run, "seed long, s int, a int, q double")


def collect_rollouts(spark: SparkSession, act, episodes: int, steps: int, seed: int = 0, noise=None, warmup: int = 0) -> DataFrame:
    """(episode, t, s, u, r, s2, done) of a point mass under act(state, rng) plus
    noise(rng, steps)[t]; the first ``warmup`` steps of an episode are uniform."""

    def run(batches):
        for pdf in batches:
            for ep in pdf["id"].tolist():
                rng, rows = np.random.Generator(np.random.PCG64([seed, ep])), []
                s = np.array([rng.uniform(-1, 1), 0.0])
                extra = np.zeros(steps) if noise is None else noise(rng, steps)
                for t in range(steps):
                    u = float(rng.uniform(-1, 1) if t < warmup else np.clip(act(s, rng) + extra[t], -1, 1))
                    v = float(np.clip(s[1] + DT * (u - DRAG * s[1]), -BOUND, BOUND))
                    x = float(np.clip(s[0] + DT * v, -BOUND, BOUND))
                    rows.append((ep, t, s.tolist(), u, -(x * x + 0.1 * v * v + 0.001 * u * u), [x, v], t == steps - 1))
                    s = np.array([x, v])
                yield pd.DataFrame(rows, columns=["episode", "t", "s", "u", "r", "s2", "done"])

    return spark.range(episodes, numPartitions=min(episodes, 64)).mapInPandas(run, "episode long, t int, s array<double>, u double, r double, s2 array<double>, done boolean")


def ou_path(theta: float = 0.15, sigma: float = 0.2, dt: float = 1e-2):
    """Exploration noise for collect_rollouts: an Ornstein-Uhlenbeck path."""

    def path(rng, steps):
        out, x = np.empty(steps), 0.0
        for t in range(steps):
            x += -theta * x * dt + sigma * dt**0.5 * rng.standard_normal()
            out[t] = x
        return out

    return path


def gaussian_path(sigma: float = 0.1, least: float = 0.01, decay: float = 1.0):
    """Exploration noise for collect_rollouts: normal, with a spread that decays to ``least``."""
    return lambda rng, steps: np.maximum(least, sigma * decay ** np.arange(steps)) * rng.standard_normal(steps)


#: Transitions that a learner's replay buffer holds: the newest ones.
CAPACITY = 100_000


def _buffer(df: DataFrame, capacity: int):
    """The newest transitions of a table, as arrays of a learner's replay buffer."""
    pdf = df.orderBy(F.desc("episode"), F.desc("t")).limit(capacity).toPandas().sort_values(["episode", "t"])
    return np.stack(pdf["s"]), pdf["u"].to_numpy(), pdf["r"].to_numpy(), np.stack(pdf["s2"]), pdf["done"].to_numpy().astype(float)


@dataclass
class Values:
    """A network of action values, plain or dueling: a dueling one's outputs are
    the state's value and the advantages, and q = value + advantage - mean."""

    net: MLP
    dueling: bool = False

    def q(self, x):
        out = self.net.forward(x)[-1]
        return out[:, :1] + out[:, 1:] - out[:, 1:].mean(1, keepdims=True) if self.dueling else out

    def descend(self, x, delta, rate: float):
        """A step against the gradient ``delta`` of a loss with respect to q."""
        if self.dueling:
            delta = np.column_stack([delta.sum(1), delta - delta.mean(1, keepdims=True)])
        self.net.apply(self.net.backward(self.net.forward(x), delta), rate, True)


@dataclass
class DQN:
    """Q-learning over the five forces on a replay buffer of a table's transitions:
    plain or double, plain or dueling, uniform or prioritised batches, soft or hard
    updates of the target network."""

    online: Values
    target: Values

    @staticmethod
    def create(hidden=(32, 32), seed: int = 0, dueling: bool = False) -> "DQN":
        sizes = [2, *hidden, len(FORCES) + dueling]
        return DQN(*(Values(MLP.create(sizes, seed=seed), dueling) for _ in range(2)))

    def act(self, s, rng=None, eps: float = 0.0) -> float:
        if rng is not None and rng.random() < eps:
            return float(rng.choice(FORCES))
        return FORCES[int(self.online.q(np.atleast_2d(s))[0].argmax())]

    def learn(self, df: DataFrame, rounds: int, batch: int = 256, rate: float = 1e-3, gamma: float = 0.99, tau: float | None = 0.05, every: int = 20, double: bool = True, prioritised: bool = False, alpha: float = 0.6, beta: float = 0.4, capacity: int = CAPACITY) -> list[float]:
        """Losses of the rounds.  Without ``tau`` the target network is replaced
        every ``every`` rounds.  Prioritised batches are drawn by (|error| + 1e-5) **
        alpha, new transitions by the largest so far, and weighted by their odds."""
        s, u, r, s2, done = _buffer(df, capacity)
        a, losses = np.abs(u[:, None] - np.array(FORCES)).argmin(1), []
        rng, priority = np.random.Generator(np.random.PCG64(1)), np.ones(len(s))
        for k in range(1, rounds + 1):
            n, weight = min(batch, len(s)), 1.0
            if prioritised:
                share = np.cumsum(priority**alpha)
                i = np.minimum(np.searchsorted(share, (np.arange(n) + rng.random(n)) * share[-1] / n, side="right"), len(s) - 1)
                weight = (len(s) * priority[i] ** alpha / share[-1]) ** -beta
                weight /= weight.max()
            else:
                i = rng.integers(0, len(s), n)
            rows, q2 = np.arange(n), self.target.q(s2[i])
            pick = (self.online.q(s2[i]) if double else q2).argmax(1)
            error = r[i] + gamma * (1 - done[i]) * q2[rows, pick] - self.online.q(s[i])[rows, a[i]]
            delta = np.zeros((n, len(FORCES)))
            delta[rows, a[i]] = -2 * weight * error / n
            self.online.descend(s[i], delta, rate)
            priority[i] = np.abs(error) + 1e-5
            if tau is not None or k % every == 0:
                self.target.net.blend(self.online.net, 1.0 if tau is None else tau)
            losses.append(float(np.mean(weight * error**2)))
        return losses


@dataclass
class ActorCritic:
    """Deterministic (DDPG, TD3) or entropy-regularised (SAC) control of the
    point mass from a table of transitions; twin critics start differently."""

    actor: MLP
    critics: list[MLP]
    actor_t: MLP
    critics_t: list[MLP]
    kind: str = "td3"
    log_alpha: float = -3.0

    @staticmethod
    def create(kind: str = "td3", hidden=(32, 32), seed: int = 0) -> "ActorCritic":
        if kind not in ("ddpg", "td3", "sac"):
            raise ValueError(f"unknown learner {kind}")
        outs = 2 if kind == "sac" else 1
        make = lambda: (MLP.create([2, *hidden, outs], output="linear" if kind == "sac" else "tanh", seed=seed), [MLP.create([3, *hidden, 1], seed=seed + 1 + k) for k in range(1 if kind == "ddpg" else 2)])
        (a, c), (at, ct) = make(), make()
        return ActorCritic(a, c, at, ct, kind)

    def act(self, s, rng=None):
        out = self.actor.forward(np.atleast_2d(s))[-1]
        return np.tanh(out[:, 0]) if self.kind == "sac" else out[:, 0]

    def learn(self, df: DataFrame, rounds: int, batch: int = 128, rate: float = 1e-3, gamma: float = 0.99, tau: float = 0.01, delay: int = 2, noise: float = 0.2, clip: float = 0.5, alpha: float | None = 0.05, target_entropy: float = -1.0, capacity: int = CAPACITY) -> list[float]:
        """Critic losses of the rounds.  For SAC, no ``alpha`` means that its
        logarithm follows the gradient towards the target entropy."""
        s, u, r, s2, done = _buffer(df, capacity)
        tune, alpha = alpha is None, float(np.exp(self.log_alpha)) if alpha is None else alpha
        rng, losses = np.random.Generator(np.random.PCG64(3)), []
        for step in range(rounds):
            i = rng.integers(0, len(s), min(batch, len(s)))
            n = len(i)
            if self.kind == "sac":
                mu, ls = np.split(self.actor.forward(s2[i])[-1], 2, 1)
                e = rng.standard_normal(mu.shape)
                raw = mu + np.exp(np.clip(ls, -5, 2)) * e
                u2 = np.tanh(raw)
                log_p = (-0.5 * e * e - np.clip(ls, -5, 2) - 0.5 * np.log(2 * np.pi) - np.log(1 - u2 * u2 + 1e-6))[:, 0]
            else:
                e = np.clip(noise * rng.standard_normal((n, 1)), -clip, clip) if self.kind == "td3" else 0.0
                u2, log_p = np.clip(self.actor_t.forward(s2[i])[-1] + e, -1, 1), 0.0
            q2 = np.min([c.forward(np.column_stack([s2[i], u2]))[-1][:, 0] for c in self.critics_t], 0) - (alpha * log_p if self.kind == "sac" else 0)
            y = (r[i] + gamma * (1 - done[i]) * q2)[:, None]
            loss = 0.0
            for c in self.critics:
                grads, own = c.gradients(np.column_stack([s[i], u[i]]), y)
                c.apply([(w / n, b / n) for w, b in grads], rate, True)
                loss += own / n
            losses.append(loss)
            if self.kind != "td3" or step % delay == 0:
                log_p = self._improve(s[i], rng, rate, alpha)
                if tune and self.kind == "sac":
                    self.log_alpha += rate * alpha * float(np.mean(log_p) + target_entropy)
                    alpha = float(np.exp(self.log_alpha))
                self.actor_t.blend(self.actor, tau)
                for t, c in zip(self.critics_t, self.critics):
                    t.blend(c, tau)
        return losses

    def _improve(self, s, rng, rate, alpha):
        """Climbs the critic's gradient with respect to the action, by the chain
        rule; returns the log-probabilities of SAC's actions."""
        log_p = 0.0
        acts = self.actor.forward(s)
        out, n = acts[-1], len(s)
        if self.kind == "sac":
            e = rng.standard_normal((n, 1))
            ls = np.clip(out[:, 1:], -5, 2)
            raw = out[:, :1] + np.exp(ls) * e
            u = np.tanh(raw)
            log_p = (-0.5 * e * e - ls - 0.5 * np.log(2 * np.pi) - np.log(1 - u * u + 1e-6))[:, 0]
            x = np.column_stack([s, u])
            least = np.argmin([c.forward(x)[-1][:, 0] for c in self.critics], 0)[:, None]
            dq = sum(np.where(least == k, c.input_gradient(x, np.ones((n, 1)))[:, 2:], 0.0) for k, c in enumerate(self.critics))
            d_raw = -dq * (1 - u * u) + alpha * 2 * u * (1 - u * u) / (1 - u * u + 1e-6)
            delta = np.column_stack([d_raw, d_raw * np.exp(ls) * e - alpha])
        else:
            dq = self.critics[0].input_gradient(np.column_stack([s, out]), np.ones((n, 1)))[:, 2:]
            delta = -dq * (1 - out * out)
        self.actor.apply([(w / n, b / n) for w, b in self.actor.backward(acts, delta)], rate, True)
        return log_p

    def train(self, spark: SparkSession, rounds: int = 3, episodes: int = 8, steps: int = 50, updates: int = 30, noise=None, warmup: int = 10, seed: int = 0, capacity: int = CAPACITY) -> list[float]:
        """Rounds of parallel rollouts under the frozen actor with exploration
        noise (SAC draws its own), and of updates on the newest transitions; in
        the first round the ``warmup`` steps of each episode are uniform.  Returns
        the mean return of each round."""
        history, buffer = [], None
        noise = noise or (None if self.kind == "sac" else ou_path() if self.kind == "ddpg" else gaussian_path())
        for k in range(rounds):
            actor, kind = MLP(self.actor.weights, self.actor.hidden, self.actor.output), self.kind

            def act(s, rng, actor=actor, kind=kind):
                out = actor.forward(np.atleast_2d(s))[-1][0]
                return float(np.tanh(out[0] + np.exp(np.clip(out[1], -5, 2)) * rng.standard_normal())) if kind == "sac" else float(out[0])

            data = collect_rollouts(spark, act, episodes, steps, seed + k, noise, warmup if k == 0 else 0)
            data = cut(data.withColumn("episode", F.col("episode") + k * episodes))
            history.append(float(data.agg(F.sum("r")).first()[0] / episodes))
            buffer = data if buffer is None else buffer.unionByName(data)
            self.learn(buffer, updates, capacity=capacity)
        return history


def _log_softmax(z):
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def ppo(spark: SparkSession, rounds: int = 5, episodes: int = 16, steps: int = 50, rate: float = 3e-3, gamma: float = 0.99, lam: float = 0.95, eps: float = 0.2, epochs: int = 4, seed: int = 0, discrete: bool = False, kl: float | None = None, entropy: float = 0.0) -> tuple[MLP, list[float]]:
    """(policy network, mean return a round): rollouts in parallel tasks, one
    bounded batch a round on the driver.

    The policy is a mean with a fixed spread, or ``discrete``, a choice of the
    five forces.  The surrogate is clipped, or with ``kl`` it is penalised by kl
    times (ratio - 1 - log ratio).  ``entropy`` weighs the entropy of a discrete
    policy (that of a fixed spread is constant).
    """
    std, history = 0.3, []
    net = MLP.create([2, 16, len(FORCES)], "tanh", "linear", seed) if discrete else MLP.create([2, 16, 1], "tanh", "tanh", seed)
    value = MLP.create([2, 16, 1], "tanh", "linear", seed + 1)
    for k in range(rounds):
        frozen = MLP(net.weights, net.hidden, net.output)
        if discrete:
            act = lambda s, rng, p=frozen: FORCES[int(rng.choice(len(FORCES), p=np.exp(_log_softmax(p.forward(s[None])[-1]))[0]))]
        else:
            act = lambda s, rng, p=frozen: p.forward(s[None])[-1][0, 0] + std * rng.standard_normal()
        data = collect_rollouts(spark, act, episodes, steps, seed + k).toPandas().sort_values(["episode", "t"])
        s, u, r = np.stack(data["s"]), data["u"].to_numpy(), data["r"].to_numpy()
        v, done = value.forward(s)[-1][:, 0], data["done"].to_numpy()
        adv, run = np.zeros(len(r)), 0.0
        for t in range(len(r) - 1, -1, -1):
            nxt = 0.0 if done[t] else v[t + 1]
            run = r[t] + gamma * nxt - v[t] + (0.0 if done[t] else gamma * lam * run)
            adv[t] = run
        goal, a, n = (adv + v)[:, None], (adv - adv.mean()) / (adv.std() + 1e-8), len(s)
        chosen, rows = np.abs(u[:, None] - np.array(FORCES)).argmin(1), np.arange(n)

        def log_prob(out):
            return _log_softmax(out)[rows, chosen] if discrete else -0.5 * ((u - out[:, 0]) / std) ** 2

        old = log_prob(frozen.forward(s)[-1])
        for _ in range(epochs):
            acts = net.forward(s)
            out = acts[-1]
            new = log_prob(out)
            ratio = np.exp(new - old)
            if kl is None:
                gain = a * ratio * ~(((a > 0) & (ratio > 1 + eps)) | ((a < 0) & (ratio < 1 - eps)))
            else:
                gain = a * ratio - kl * (ratio - 1)
            # gain is the surrogate's gradient with respect to the log-probability
            if discrete:
                log_p = _log_softmax(out)
                p = np.exp(log_p)
                delta = -gain[:, None] * (np.eye(len(FORCES))[chosen] - p)
                delta += entropy * p * (log_p - (p * log_p).sum(1, keepdims=True))
            else:
                delta = (-gain * (u - out[:, 0]) / std**2 * (1 - out[:, 0] ** 2))[:, None]
            net.apply([(w / n, b / n) for w, b in net.backward(acts, delta)], rate, True)
            g, _ = value.gradients(s, goal)
            value.apply([(w / n, b / n) for w, b in g], rate, True)
        history.append(float(r.sum() / episodes))
    return net, history
