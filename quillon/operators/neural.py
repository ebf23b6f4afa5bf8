"""Neural networks: weights are small arrays on the driver, forward and
backward passes run on Arrow batches, and a step sums the tasks' gradients."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import array_dot, array_sum, let, softmax, uniform
from .pairs import _matrix, dealt_within

ACTIVATIONS = {
    "linear": (lambda z: z, lambda a: np.ones_like(a)),
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1 - a)),
}


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class MLP:
    """weights: (matrix, bias) a layer; hidden and output name activations; an
    output of softmax goes with cross entropy, sigmoid with binary cross
    entropy, others with squared error."""

    weights: list[tuple[np.ndarray, np.ndarray]]
    hidden: str = "relu"
    output: str = "linear"
    moments: list = field(default_factory=list)
    steps: int = 0

    @staticmethod
    def create(sizes: list[int], hidden: str = "relu", output: str = "linear", seed: int = 0) -> "MLP":
        rng = np.random.Generator(np.random.PCG64(seed))
        return MLP([(rng.standard_normal((a, b)) * np.sqrt(2 / a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])], hidden, output)

    def forward(self, x):
        acts = [x]
        for i, (w, b) in enumerate(self.weights):
            z = acts[-1] @ w + b
            last = i == len(self.weights) - 1
            acts.append(_softmax(z) if last and self.output == "softmax" else ACTIVATIONS[self.output if last else self.hidden][0](z))
        return acts

    def gradients(self, x, y):
        """Summed over rows, of the loss with respect to all weights, and the loss."""
        acts = self.forward(x)
        out = acts[-1]
        if self.output == "softmax":
            loss, delta = -(y * np.log(np.maximum(out, 1e-12))).sum(), out - y
        elif self.output == "sigmoid":
            p = np.clip(out, 1e-12, 1 - 1e-12)
            loss, delta = -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), out - y
        else:
            loss, delta = ((out - y) ** 2).sum(), 2 * (out - y) * ACTIVATIONS[self.output][1](out)
        return self.backward(acts, delta), float(loss)

    def backward(self, acts, delta):
        """Gradients of all weights, summed over rows, from that of the last
        layer before its activation."""
        grads = []
        for i in range(len(self.weights) - 1, -1, -1):
            grads.append((acts[i].T @ delta, delta.sum(0)))
            if i:
                delta = delta @ self.weights[i][0].T * ACTIVATIONS[self.hidden][1](acts[i])
        return grads[::-1]

    def input_gradient(self, x, delta):
        """Of sum(output * delta) with respect to the input rows."""
        acts = self.forward(x)
        delta = delta * ACTIVATIONS[self.output][1](acts[-1])
        for i in range(len(self.weights) - 1, -1, -1):
            delta = delta @ self.weights[i][0].T
            if i:
                delta = delta * ACTIVATIONS[self.hidden][1](acts[i])
        return delta

    def apply(self, grads, rate: float, adam: bool = False):
        if not adam:
            self.weights = [(w - rate * gw, b - rate * gb) for (w, b), (gw, gb) in zip(self.weights, grads)]
            return
        self.steps += 1
        self.moments = self.moments or [[np.zeros_like(p) for p in (w, w, b, b)] for w, b in self.weights]
        out = []
        for (w, b), (gw, gb), m in zip(self.weights, grads, self.moments):
            after = []
            for p, g, i in ((w, gw, 0), (b, gb, 2)):
                m[i] = 0.9 * m[i] + 0.1 * g
                m[i + 1] = 0.999 * m[i + 1] + 0.001 * g * g
                after.append(p - rate * (m[i] / (1 - 0.9**self.steps)) / (np.sqrt(m[i + 1] / (1 - 0.999**self.steps)) + 1e-8))
            out.append(tuple(after))
        self.weights = out

    def blend(self, other: "MLP", tau: float = 1.0):
        """Moves towards another network; tau 1 copies it."""
        self.weights = [((1 - tau) * w + tau * ow, (1 - tau) * b + tau * ob) for (w, b), (ow, ob) in zip(self.weights, other.weights)]

    def fit(self, df: DataFrame, rounds: int, rate: float, adam: bool = False) -> list[float]:
        """Full-batch steps on rows (v, y array); a task sends one row of sums."""
        history = []
        for _ in range(rounds):
            now = MLP(self.weights, self.hidden, self.output)

            def sums(batches, net=now):
                flat, n = None, 0
                for b in batches:
                    if b.num_rows:
                        t = pa.Table.from_batches([b])
                        grads, loss = net.gradients(_matrix(t, "v"), _matrix(t, "y"))
                        own = np.concatenate([[loss], *(x.ravel() for g in grads for x in g)])
                        flat, n = own if flat is None else flat + own, n + b.num_rows
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([flat.tobytes()], pa.binary())], ["n", "s"])

            n, flat = 0, 0.0
            for r in df.select("v", "y").mapInArrow(sums, "n long, s binary").toLocalIterator():
                n, flat = n + r["n"], flat + np.frombuffer(r["s"])
            history.append(float(flat[0]) / n)
            at, grads = 1, []
            for w, b in self.weights:
                gw = flat[at : at + w.size].reshape(w.shape) / n
                gb = flat[at + w.size : at + w.size + b.size] / n
                grads.append((gw, gb))
                at += w.size + b.size
            self.apply(grads, rate, adam)
        return history

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, output array)."""

        def rows(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(self.forward(_matrix(pa.Table.from_batches([b]), "v"))[-1]), pa.list_(pa.float64()))], ["id", "output"])

        return df.select("id", "v").mapInArrow(rows, "id long, output array<double>")

    def misclassified(self, df: DataFrame) -> DataFrame:
        """(id, actual, predicted) of the rows (id, v, y one-hot) that the largest output gets wrong."""
        place = lambda c: F.array_position(F.col(c), F.array_max(c)).cast("int") - 1
        both = df.select("id", place("y").alias("actual")).join(self.predict(df).select("id", place("output").alias("predicted")), "id")
        return both.where("actual <> predicted")

    def expression(self, x: Column) -> Column:
        """The forward pass of a small network as one expression of an array."""
        for i, (w, b) in enumerate(self.weights):
            last = i == len(self.weights) - 1
            rows = F.array(*(F.array(*(F.lit(float(v)) for v in col)) for col in w.T))
            bias = F.array(*(F.lit(float(v)) for v in b))
            z = F.zip_with(_dots(x, rows), bias, lambda a, c: a + c)
            name = self.output if last else self.hidden
            one = {"linear": lambda v: v, "relu": lambda v: F.greatest(v, F.lit(0.0)), "tanh": F.tanh, "sigmoid": lambda v: 1 / (1 + F.exp(-v))}
            x = softmax(z) if name == "softmax" else F.transform(z, one[name])
        return x


def _dots(x: Column, rows: Column) -> Column:
    return F.transform(rows, lambda r: array_dot(x, r))


def search(train: DataFrame, test: DataFrame, sizes: tuple[int, int], trials: int = 10, hidden: tuple[int, ...] = (4, 8, 16, 32), rates: tuple[float, float] = (1e-3, 1.0), rounds: tuple[int, int] = (5, 50), output: str = "softmax", seed: int = 0) -> tuple[MLP, list[dict]]:
    """Random hyper-parameter search: (best network, trials).  Hidden size,
    activation, rate (log-uniform) and rounds are drawn by seed; the share of
    rows (id, v, y one-hot) of test that a network gets right decides (ties: the
    first trial)."""
    rng, done, best, top, n = np.random.Generator(np.random.PCG64(seed)), [], None, -1.0, test.count()
    for k in range(trials):
        width, kind = int(rng.choice(hidden)), str(rng.choice(["relu", "tanh", "sigmoid"]))
        rate, steps = float(np.exp(rng.uniform(*np.log(rates)))), int(rng.integers(rounds[0], rounds[1] + 1))
        net = MLP.create([sizes[0], width, sizes[1]], kind, output, seed + k)
        loss = net.fit(train, steps, rate)[-1]
        score = 1 - net.misclassified(test).count() / max(1, n)
        done.append({"hidden": width, "activation": kind, "rate": rate, "rounds": steps, "loss": loss, "accuracy": score})
        if score > top:
            best, top = net, score
    return best, done


def autoencoder(size: int, code: int, seed: int = 0) -> MLP:
    """Sigmoid code, linear reconstruction; fit on rows with y = v."""
    return MLP.create([size, code, size], "sigmoid", "linear", seed)


def attention(q: Column, keys: Column, values: Column, size: int) -> Column:
    """softmax(q.k / sqrt(size)) over arrays of keys, applied to values."""
    w = softmax(F.transform(keys, lambda k: array_dot(q, k) / math.sqrt(size)))
    # one pass over the values: the running sum of weighted arrays
    zero = F.array_repeat(F.lit(0.0), size)
    return let(w, lambda w: F.aggregate(F.arrays_zip(w.alias("w"), values.alias("v")), zero, lambda acc, e: F.zip_with(acc, e["v"], lambda s, x: s + e["w"] * x)))


def attention_within(df: DataFrame, group: str, blocks: int | None = None) -> DataFrame:
    """(id, o): attention of each row (id, v, group) over the rows of its group.

    Rows are dealt to pairs of blocks of their group; a pair sends for each query
    the largest score, the sum of weights and the weighted values relative to it,
    and these are merged, so no task or row holds a group.
    """
    def part(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "m": pa.array([], pa.float64()), "s": pa.array([], pa.float64()), "o": pa.array([], pa.list_(pa.float64()))})
        q, k = _matrix(a, "v_a"), _matrix(b, "v_b")
        score = q @ k.T / math.sqrt(q.shape[1])
        top = score.max(1)
        w = np.exp(score - top[:, None])
        return pa.table({"id": a.column("id_a"), "m": pa.array(top), "s": pa.array(w.sum(1)), "o": pa.array(list(w @ k), pa.list_(pa.float64()))})

    parts = dealt_within(df.select("id", "v", F.col(group).alias("g")), blocks).applyInArrow(part, "id long, m double, s double, o array<double>")
    own = parts.groupBy("id").agg(F.collect_list(F.struct("m", "s", "o")).alias("p"))  # a part for each block
    own = own.withColumn("top", F.array_max(F.transform("p", lambda x: x["m"])))
    total = F.aggregate("p", F.lit(0.0), lambda t, x: t + x["s"] * F.exp(x["m"] - F.col("top")))
    zero = F.transform(F.col("p")[0]["o"], lambda x: x * 0.0)
    out = F.aggregate("p", zero, lambda t, x: F.zip_with(t, x["o"], lambda c, v: c + v * F.exp(x["m"] - F.col("top"))))
    return own.withColumn("total", total).select("id", F.transform(out, lambda x: x / F.col("total")).alias("o"))


def multi_head(x: np.ndarray, wq, wk, wv, heads: int) -> np.ndarray:
    """Self-attention of a sequence (t, d) with given projections."""
    t, d = x.shape[0], wq.shape[1] // heads
    out = []
    for h in range(heads):
        q, k, v = (x @ w[:, h * d : (h + 1) * d] for w in (wq, wk, wv))
        out.append(_softmax(q @ k.T / np.sqrt(d)) @ v)
    return np.concatenate(out, 1)


def positional_encoding(position: Column, i: Column, size: int) -> Column:
    angle = position / F.pow(F.lit(10000.0), (2 * F.floor(i / 2)) / F.lit(float(size)))
    return F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def hopfield_weights(patterns: DataFrame) -> DataFrame:
    """(i, j, w) of rows (id, v array of -1 and 1): sums of products, zero
    diagonal; a task sends units squared numbers."""

    def products(batches):
        out = None
        for b in batches:
            if b.num_rows:
                x = _matrix(pa.Table.from_batches([b]), "v").astype(float)
                out = x.T @ x if out is None else out + x.T @ x
        if out is not None:
            i, j = np.nonzero(~np.eye(len(out), dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(out[i, j].astype(np.int64))], ["i", "j", "w"])

    return patterns.select("v").mapInArrow(products, "i int, j int, w long").groupBy("i", "j").agg(F.sum("w").alias("w"))


def hopfield_recall(states: DataFrame, weights: DataFrame, rounds: int = 1) -> DataFrame:
    """(id, v) after synchronous sign updates; a zero sum counts as 1.  Weights,
    units squared, go to the driver and the tasks."""
    cells = weights.toPandas()
    n = int(max(cells["i"].max(), cells["j"].max())) + 1 if len(cells) else 0
    w = np.zeros((n, n))
    w[cells["i"], cells["j"]] = cells["w"]

    def rows(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(pa.Table.from_batches([b]), "v").astype(float)
                for _ in range(rounds):
                    x = np.where(x @ w.T >= 0, 1.0, -1.0)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(x.astype(np.int32)), pa.list_(pa.int32()))], ["id", "v"])

    return states.select("id", "v").mapInArrow(rows, "id long, v array<int>")


def boltzmann_energy(v: Column, h: Column, w: np.ndarray) -> Column:
    """-v'Wh."""
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in w))
    return -array_sum(F.zip_with(v, rows, lambda a, r: a * array_dot(r, h)))


def boltzmann_sample(df: DataFrame, w: np.ndarray, rounds: int, seed: int = 0) -> DataFrame:
    """(id, v, h) after block Gibbs rounds from rows (id, v); draws by (seed, id,
    round, unit), so they don't depend on partitioning, and all stays in the JVM."""

    def drawn(rows, x, k, side):
        table = F.array(*(F.array(*(F.lit(float(c)) for c in r)) for r in rows))
        return F.transform(table, lambda r, j: F.when(uniform(seed, F.col("id"), F.lit(f"{side}{k}"), j) < 1 / (1 + F.exp(-array_dot(x, r))), 1.0).otherwise(0.0))

    def from_round(v, k):  # each state is bound once
        after = lambda h, v: F.struct(v.alias("v"), h.alias("h")) if k == rounds - 1 else from_round(v, k + 1)
        return let(drawn(w.T, v, k, "h"), lambda h: let(drawn(w, h, k, "v"), lambda v: after(h, v)))

    return df.select("id", let(F.col("v").cast("array<double>"), lambda v: from_round(v, 0)).alias("s")).select("id", "s.v", "s.h")


def rbf_activations(v: Column, centres: np.ndarray, sigma: float = 1.0) -> Column:
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in centres))
    return F.transform(rows, lambda c: F.exp(-array_sum(F.zip_with(v, c, lambda a, b: (a - b) * (a - b))) / (2 * sigma**2)))


def rbf_fit(df: DataFrame, centres: np.ndarray, sigma: float = 1.0, ridge: float = 1e-8) -> np.ndarray:
    """Least-squares output weights (bias first) of rows (v, y): one pass."""
    from .linear import gram

    names = [f"a{i}" for i in range(len(centres))]
    act = df.withColumn("_a", rbf_activations(F.col("v"), centres, sigma)).select("y", *(F.col("_a")[i].alias(n) for i, n in enumerate(names)))
    g = gram(act, names, "y")
    return np.linalg.solve(g.xx + ridge * np.eye(len(g.xy)), g.xy)


def lstm(xs: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden and cell states (t, n); gates stand in the order f, i, g, o."""
    n = wh.shape[0]
    sig = ACTIVATIONS["sigmoid"][0]
    h, c, hs, cs = np.zeros(n), np.zeros(n), [], []
    for x in xs:
        f, i, g, o = np.split(x @ wx + h @ wh + b, 4)
        c = sig(f) * c + sig(i) * np.tanh(g)
        h = sig(o) * np.tanh(c)
        hs.append(h)
        cs.append(c)
    return np.array(hs), np.array(cs)


def encoder_decoder(xs, we, ue, ud, vo, steps: int) -> np.ndarray:
    """Outputs (steps, k): a tanh encoder's last state drives a tanh decoder."""
    h = np.zeros(ue.shape[0])
    for x in xs:
        h = np.tanh(x @ we + h @ ue)
    out = []
    for _ in range(steps):
        h = np.tanh(h @ ud)
        out.append(_softmax((h @ vo)[None])[0])
    return np.array(out)


def transformer_block(x, w: dict, heads: int, eps: float = 1e-6) -> np.ndarray:
    """Attention and a GELU feed-forward layer, each with a residual and layer norm."""
    norm = lambda v: (v - v.mean(1, keepdims=True)) / (v.std(1, keepdims=True) + eps)
    gelu = lambda v: 0.5 * v * (1 + np.tanh(np.sqrt(2 / np.pi) * (v + 0.044715 * v**3)))
    x = norm(x + multi_head(x, w["q"], w["k"], w["v"], heads))
    return norm(x + gelu(x @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"])


def over_sequences(df: DataFrame, key: str, order: str, function, schema_out: str = "array<array<double>>") -> DataFrame:
    """(key, out): a function of each ordered sequence (t, d) of rows (key, order, v)."""
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "v"))).alias("s")).select(key, F.transform("s", lambda e: e["v"]).alias("s"))
    kind = df.schema[key].dataType.simpleString()

    def rows(batches):
        for b in batches:
            out = [np.asarray(function(np.array(s, float))).tolist() for s in b.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.list_(pa.list_(pa.float64())))], [key, "out"])

    return grouped.mapInArrow(rows, f"{key} {kind}, out {schema_out}")


def conv2d(x: np.ndarray, kernels: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Valid convolution of (b, c, h, w) by (k, c, p, q)."""
    p, q = kernels.shape[2:]
    win = np.lib.stride_tricks.sliding_window_view(x, (p, q), axis=(2, 3))
    return np.einsum("bchwpq,kcpq->bkhw", win, kernels) + bias[None, :, None, None]


def conv2d_table(pixels: DataFrame, kernel: DataFrame) -> DataFrame:
    """(img, k, y, x, v) of pixels (img, c, y, x, v) by weights (k, c, dy, dx, w):
    a join on the channel and a sum, kept where the whole kernel fits."""
    size = F.broadcast(kernel.agg((F.max("dy")).alias("my"), F.max("dx").alias("mx")))
    edge = pixels.groupBy("img").agg(F.max("y").alias("h"), F.max("x").alias("w0"))
    out = pixels.join(F.broadcast(kernel), "c").select("img", "k", (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"), (F.col("v") * F.col("w")).alias("v"))
    out = out.join(edge, "img").crossJoin(size).where("y >= 0 and x >= 0 and y + my <= h and x + mx <= w0")
    return out.groupBy("img", "k", "y", "x").agg(F.sum("v").alias("v"))


def max_pool_table(pixels: DataFrame, size: int) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / size).alias(c)
    edge = pixels.groupBy("img").agg(F.floor((F.max("y") + 1) / size).alias("h"), F.floor((F.max("x") + 1) / size).alias("w"))
    out = pixels.select("img", "k", cell("y"), cell("x"), "v").groupBy("img", "k", "y", "x").agg(F.max("v").alias("v"))
    return out.join(edge, "img").where("y < h and x < w").drop("h", "w")


def complex_multiply(a: Column, b: Column) -> Column:
    """Structs of re and im."""
    return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def complex_relu(a: Column) -> Column:
    """ReLU on the real part; the imaginary part stays where the real one is positive."""
    return F.struct(F.greatest(a["re"], F.lit(0.0)).alias("re"), F.when(a["re"] > 0, a["im"]).otherwise(0.0).alias("im"))


def complex_descent(df: DataFrame, rounds: int, rate: float) -> complex:
    """w of y = w x for complex pairs (xr, xi, yr, yi), by steps on sums of one pass."""
    n, xx, re, im = df.agg(F.count("*"), F.sum(F.col("xr") ** 2 + F.col("xi") ** 2), F.sum(F.col("xr") * F.col("yr") + F.col("xi") * F.col("yi")), F.sum(F.col("xr") * F.col("yi") - F.col("xi") * F.col("yr"))).first()
    w = 0j
    for _ in range(rounds):
        w -= rate * (w * xx - complex(re, im)) / n
    return w


def gan_1d(df: DataFrame, value: str, rounds: int = 200, rate: float = 0.05, seed: int = 0) -> tuple[MLP, MLP]:
    """(generator, discriminator) for one column: the discriminator's step sums
    gradients over the rows, the generator's over fresh noise on the driver."""
    rng = np.random.Generator(np.random.PCG64(seed))
    gen, disc = MLP.create([1, 1], "relu", "linear", seed), MLP.create([1, 1], "relu", "sigmoid", seed + 1)
    rows = df.select(F.array(F.col(value).cast("double")).alias("v"), F.array(F.lit(1.0)).alias("y"))
    for _ in range(rounds):
        fake = gen.forward(rng.standard_normal((64, 1)))[-1]
        grads, _ = disc.gradients(fake, np.zeros((64, 1)))
        disc.fit(rows, 1, rate)
        disc.apply([(a / 64, b / 64) for a, b in grads], rate)
        z = rng.standard_normal((64, 1))
        fake = gen.forward(z)[-1]
        p = disc.forward(fake)[-1]
        up = disc.input_gradient(fake, -1 / np.maximum(p, 1e-9))
        gen.apply([((z.T @ up) / 64, up.sum(0) / 64)], rate)
    return gen, disc


@dataclass
class BayesianMLP:
    """Mean-field network of one hidden tanh layer: means and log deviations,
    trained by the reparameterised gradient with common noise in all tasks."""

    mean: MLP
    rho: list[tuple[np.ndarray, np.ndarray]]
    prior: float = 1.0

    @staticmethod
    def create(sizes, output="sigmoid", prior=1.0, seed=0) -> "BayesianMLP":
        net = MLP.create(sizes, "tanh", output, seed)
        return BayesianMLP(net, [(np.full_like(w, -3.0), np.full_like(b, -3.0)) for w, b in net.weights], prior)

    def kl(self) -> float:
        total = 0.0
        for layer, spread in zip(self.mean.weights, self.rho):
            for m, r in zip(layer, spread):
                total += float((np.log(self.prior) - r + (np.exp(2 * r) + m * m) / (2 * self.prior**2) - 0.5).sum())
        return total

    def draw(self, rng):
        noise = [tuple(rng.standard_normal(p.shape) for p in layer) for layer in self.mean.weights]
        drawn = [tuple(m + np.exp(r) * e for m, r, e in zip(*x)) for x in zip(self.mean.weights, self.rho, noise)]
        return MLP(drawn, self.mean.hidden, self.mean.output), noise

    def fit(self, df: DataFrame, rounds: int, rate: float, kl_weight: float = 1.0, seed: int = 0) -> list[float]:
        rng, n, history = np.random.Generator(np.random.PCG64(seed)), df.count(), []
        for _ in range(rounds):
            net, noise = self.draw(rng)
            before = net.weights
            loss = net.fit(df, 1, 1.0)[0]
            grads = [tuple(a - b for a, b in zip(x, y)) for x, y in zip(before, net.weights)]
            means, rhos = [], []
            for layer, spread, g, e in zip(self.mean.weights, self.rho, grads, noise):
                means.append(tuple(m - rate * (gm + kl_weight / n * m / self.prior**2) for m, gm in zip(layer, g)))
                rhos.append(tuple(r - rate * (gm * x * np.exp(r) + kl_weight / n * (np.exp(2 * r) / self.prior**2 - 1)) for r, gm, x in zip(spread, g, e)))
            self.mean.weights, self.rho = means, rhos
            history.append(loss + kl_weight * self.kl() / n)
        return history

    def predict(self, df: DataFrame, draws: int = 20, seed: int = 1) -> DataFrame:
        """(id, mean array, std array) over draws of the weights."""
        rng = np.random.Generator(np.random.PCG64(seed))
        nets = [self.draw(rng)[0] for _ in range(draws)]

        def rows(batches):
            for b in batches:
                if b.num_rows:
                    out = np.stack([net.forward(_matrix(pa.Table.from_batches([b]), "v"))[-1] for net in nets])
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(out.mean(0)), pa.list_(pa.float64())), pa.array(list(out.std(0)), pa.list_(pa.float64()))], ["id", "mean", "std"])

        return df.select("id", "v").mapInArrow(rows, "id long, mean array<double>, std array<double>")
