"""Queries of network layers over the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.expressions import gelu, layer_norm, soft_threshold, softmax, uniform_sql
from ..operators import metrics, neural, preparation
from .cluster_queries import _E, vectors
from .registry import query, table
from .sql import history_sql, network_training


def _sum(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


@query("activations", f"""with {_E}, x as (select id, i, v[i] x from e, range(1, 65) t(i)), m as (select id, avg(x) m, stddev_pop(x) s, max(x) mx from x group by id)
select id, round(sum(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x)))), 6) as gelu, round(max(exp(x - mx)) / sum(exp(x - mx)), 8) as softmax_top,
round(first((x - m) / (s + 1e-6) order by i), 6) as norm_first, round(sum(sign(x) * greatest(abs(x) - 0.1, 0)), 6) + 0.0 as shrunk from x join m using (id) group by id""")  # fmt: skip
def activations(spark, sf_dir):
    v = F.col("v")
    return vectors(spark, sf_dir).select("id", F.round(_sum(F.transform(v, gelu)), 6).alias("gelu"), F.round(F.array_max(softmax(v)), 8).alias("softmax_top"), F.round(layer_norm(v)[0], 6).alias("norm_first"), (F.round(_sum(F.transform(v, lambda x: soft_threshold(x, 0.1))), 6) + 0.0).alias("shrunk"))


@query("attention", f"""with {_E}, s as (select a.id, b.id k, b.v, list_dot_product(a.v, b.v) / 8 s from e a join e b on a.label = b.label), w as (select id, k, v, exp(s - max(s) over (partition by id)) w from s)
select id, round(sum(w * v[1]) / sum(w), 6) as o1, round(sum(w * v[64]) / sum(w), 6) as o64 from w group by id""")  # fmt: skip
def attention(spark, sf_dir):
    out = neural.attention_within(vectors(spark, sf_dir), "label")
    return out.select("id", F.round(F.col("o")[0], 6).alias("o1"), F.round(F.col("o")[63], 6).alias("o64"))


@query("positional_encoding", "select p::int as p, i::int as i, round(case when i % 2 = 0 then sin(p / 10000.0 ** (2 * (i // 2) / 16.0)) else cos(p / 10000.0 ** (2 * (i // 2) / 16.0)) end, 8) + 0.0 as v from range(50) x(p), range(16) y(i)")
def positional(spark, sf_dir):
    p, i = spark.range(50).select(F.col("id").cast("int").alias("p")), spark.range(16).select(F.col("id").cast("int").alias("i"))
    return p.crossJoin(i).select("p", "i", (F.round(neural.positional_encoding(F.col("p"), F.col("i"), 16), 8) + 0.0).alias("v"))


@query("hopfield_weights", f"with {_E}, x as (select id, i - 1 as i, case when v[i] >= 0 then 1 else -1 end x from e, range(1, 65) t(i)) select a.i::int as i, b.i::int as j, sum(a.x * b.x)::bigint as w from x a join x b on a.id = b.id and a.i <> b.i group by a.i, b.i")
def hopfield(spark, sf_dir):
    return neural.hopfield_weights(_signs(spark, sf_dir)).select("i", "j", F.col("w").cast("long").alias("w"))


def _signs(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.transform("v", lambda x: F.when(x >= 0, 1).otherwise(-1)).alias("v"))


@query("hopfield_recall", f"""with {_E}, x as (select id, i, case when v[i] >= 0 then 1 else -1 end x from e, range(1, 65) t(i)), w as (select a.i, b.i j, sum(a.x * b.x) w from x a join x b on a.id = b.id and a.i <> b.i group by a.i, b.i)
select id, string_agg(case when s >= 0 then '+' else '-' end, '' order by i) as state from (select x.id, w.i, sum(w.w * x.x) s from x join w on w.j = x.i group by x.id, w.i) group by id""")  # fmt: skip
def recall(spark, sf_dir):
    signs = _signs(spark, sf_dir)
    out = neural.hopfield_recall(signs, neural.hopfield_weights(signs))
    return out.select("id", F.array_join(F.transform("v", lambda x: F.when(x > 0, "+").otherwise("-")), "").alias("state"))


_K = [[1.0, 0.0, -1.0], [2.0, 0.0, -2.0], [1.0, 0.0, -1.0]]


@query("conv_and_pool", f"""with {_E}, x as (select id, (i - 1) // 8 as y, (i - 1) % 8 as x, v[i] v from e, range(1, 65) t(i)),
k as (select * from (values {', '.join(f'({i}, {j}, {w})' for i, r in enumerate(_K) for j, w in enumerate(r))}) t(dy, dx, w)),
c as (select id, y - dy as y, x - dx as x, sum(v * w) v from x, k where y - dy between 0 and 5 and x - dx between 0 and 5 group by id, y - dy, x - dx)
select id as img, (y // 2)::bigint as y, (x // 2)::bigint as x, round(max(v), 6) as v from c group by id, y // 2, x // 2""")  # fmt: skip
def conv(spark, sf_dir):
    px = vectors(spark, sf_dir).select(F.col("id").alias("img"), F.posexplode("v").alias("i", "v")).select("img", F.lit(0).alias("c"), F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), "v")
    kernel = spark.createDataFrame([(0, 0, i, j, w) for i, r in enumerate(_K) for j, w in enumerate(r)], "k int, c int, dy int, dx int, w double")
    return neural.max_pool_table(neural.conv2d_table(px, kernel), 2).select("img", "y", "x", F.round("v", 6).alias("v"))


_NET = neural.MLP.create([3, 4, 2], "relu", "softmax", 5)
_NET.weights = [(np.round(w, 4), np.round(b + 0.1, 4)) for w, b in _NET.weights]


def _mlp_sql() -> str:
    (w1, b1), (w2, b2) = _NET.weights
    h = ", ".join("greatest(0, " + " + ".join([str(b1[j]), *(f"x{i} * {w1[i, j]}" for i in range(3))]) + f") h{j}" for j in range(4))
    z = ", ".join(" + ".join([str(b2[k]), *(f"h{j} * {w2[j, k]}" for j in range(4))]) + f" z{k}" for k in range(2))
    return f"with x as (select o_orderkey, (o_totalprice / 100000)::double x0, (o_custkey % 7)::double x1, (o_orderkey % 5)::double x2 from orders), h as (select o_orderkey, {h} from x), z as (select o_orderkey, {z} from h) select o_orderkey, round(1 / (1 + exp(z1 - z0)), 8) as p0 from z"


@query("mlp_forward", _mlp_sql())
def mlp_forward(spark, sf_dir):
    x = F.array(F.col("o_totalprice") / 100000, (F.col("o_custkey") % 7).cast("double"), (F.col("o_orderkey") % 5).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(_NET.expression(x)[0], 8).alias("p0"))


def _labelled(spark, sf_dir, classes=10):
    e = vectors(spark, sf_dir)
    return e.select("id", "v", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == F.col("label"), 1.0).otherwise(0.0)).alias("y"))


def _history(spark, h):
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(h)], "round int, loss double")


_NX = f"{_E}, x as (select id, i, v[i] x from e, range(1, 65) t(i))"
_ONE_HOT = "y as (select id, (k + 1)::int as k, case when label = k then 1.0 else 0.0 end::double as y from e, range(10) t(k))"
_HALF = "y as (select id, 1 as k, case when label < 5 then 1.0 else 0.0 end::double as y from e)"


def _training(target: str, net, rounds: int, rate: float, adam: bool = False) -> str:
    return f"with {_NX}, {target}, {network_training('x', 'y', net.weights, net.hidden, net.output, rounds, rate, adam)} {history_sql(rounds)}"


@query("mlp_training", _training(_ONE_HOT, neural.MLP.create([64, 16, 10], "sigmoid", "softmax", 0), 5, 0.05, True))
def mlp_training(spark, sf_dir):
    return _history(spark, neural.MLP.create([64, 16, 10], "sigmoid", "softmax", 0).fit(_labelled(spark, sf_dir), 5, 0.05, True))


@query("perceptron_training", _training(_HALF, neural.MLP.create([64, 1], "linear", "sigmoid", 0), 5, 0.5))
def perceptron(spark, sf_dir):
    e = vectors(spark, sf_dir).select("id", "v", F.array((F.col("label") < 5).cast("double")).alias("y"))
    return _history(spark, neural.MLP.create([64, 1], "linear", "sigmoid", 0).fit(e, 5, 0.5))


@query("perceptron_regression", _training("y as (select id, 1 as k, label::double as y from e)", neural.MLP.create([64, 1], "linear", "linear", 0), 5, 0.1))
def perceptron_regression(spark, sf_dir):
    e = vectors(spark, sf_dir).select("id", "v", F.array(F.col("label").cast("double")).alias("y"))
    return _history(spark, neural.MLP.create([64, 1], "linear", "linear", 0).fit(e, 5, 0.1))


@query("autoencoder_training", _training("y as (select id, i::int as k, x as y from x)", neural.autoencoder(64, 8), 5, 0.01, True))
def auto(spark, sf_dir):
    e = vectors(spark, sf_dir).select("id", "v", F.col("v").alias("y"))
    return _history(spark, neural.autoencoder(64, 8).fit(e, 5, 0.01, True))


@query("bayesian_network_training")
def bnn(spark, sf_dir):
    e = vectors(spark, sf_dir).select("id", "v", F.array((F.col("label") < 5).cast("double")).alias("y"))
    return _history(spark, neural.BayesianMLP.create([64, 4, 1]).fit(e, 4, 0.05))


@query("kl_divergence", f"with {_E}, x as (select id, i, v[i] x from e, range(1, 65) t(i)) select id, round(sum(ln(0.5) + 3 + (exp(-6) + x * x) / (2 * 0.25) - 0.5), 6) as kl from x group by id")
def kl(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.round(_sum(F.transform("v", lambda x: metrics.kl_normal(x, F.lit(-3.0), 0.5))), 6).alias("kl"))


def _weights(n: int, m: int) -> np.ndarray:
    return np.array([[((i * 3 + j * 5) % 7 - 3) / 10 for j in range(m)] for i in range(n)])


_WSQL = "(((i * 3 + j * 5) % 7 - 3) / 10.0)::double"


@query("boltzmann_energy", f"with {_E}, w as (select i, j, {_WSQL} w from range(32) a(i), range(32) b(j)) select id, round(-sum(v[i + 1] * w * v[j + 33]), 7) + 0.0 as energy from e, w group by id")
def energy(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", (F.round(neural.boltzmann_energy(F.slice("v", 1, 32), F.slice("v", 33, 32), _weights(32, 32)), 7) + 0.0).alias("energy"))


def _gibbs(rounds: int, units: int) -> str:
    ctes = [f"w as (select i, j, {_WSQL} w from range(64) a(i), range({units}) b(j))", "v0 as (select id, i - 1 as i, case when v[i] > 0 then 1.0 else 0.0 end x from e, range(1, 65) t(i))"]
    for k in range(rounds):
        name, back = f"'h{k}'", f"'v{k}'"
        ctes.append(f"h{k} as (select id, j, case when {uniform_sql(0, 'id', name, 'j')} < 1 / (1 + exp(-sum(x * w))) then 1.0 else 0.0 end x from v{k} join w using (i) group by id, j)")
        ctes.append(f"v{k + 1} as (select id, i, case when {uniform_sql(0, 'id', back, 'i')} < 1 / (1 + exp(-sum(x * w))) then 1.0 else 0.0 end x from h{k} join w using (j) group by id, i)")
    return f"with {_E}, {', '.join(ctes)} select id, sum(x)::double as \"on\" from h{rounds - 1} group by id"


@query("boltzmann_sampling", _gibbs(3, 16))
def boltzmann(spark, sf_dir):
    return neural.boltzmann_sample(vectors(spark, sf_dir).select("id", F.transform("v", lambda x: (x > 0).cast("double")).alias("v")), _weights(64, 16), 3).select("id", _sum(F.col("h")).alias("on"))


@query("rbf_activations", f"with {_E}, c as (select row_number() over (order by id) k, v from e order by id limit 3) select e.id, round(sum(exp(-(list_distance(e.v, c.v) ** 2) / 2) * k), 6) as a from e, c group by e.id")
def rbf(spark, sf_dir):
    from .cluster_queries import first

    e = vectors(spark, sf_dir)
    a = neural.rbf_activations(F.col("v"), first(e.select("id", "v"), 3))
    return e.select("id", F.round(_sum(F.transform(a, lambda x, i: x * (i + 1))), 6).alias("a"))


@query("complex_layer", f"with {_E}, m as (select id, v[1] * v[3] - v[2] * v[4] re, v[1] * v[4] + v[2] * v[3] im from e) select id, round(greatest(re, 0), 8) as re, round(case when re > 0 then im else 0 end, 8) + 0.0 as im from m")
def complex_layer(spark, sf_dir):
    v = F.col("v")
    z = neural.complex_relu(neural.complex_multiply(F.struct(v[0].alias("re"), v[1].alias("im")), F.struct(v[2].alias("re"), v[3].alias("im"))))
    return vectors(spark, sf_dir).select("id", z.alias("z")).select("id", F.round("z.re", 8).alias("re"), (F.round("z.im", 8) + 0.0).alias("im"))


_RNG = np.random.Generator(np.random.PCG64(2))
_LSTM = _RNG.standard_normal((2, 12)) / 4, _RNG.standard_normal((3, 12)) / 4, np.zeros(12)


def _lstm_sql() -> str:
    wx, wh, b = _LSTM
    gate = lambda c: f"{float(wx[0, c])!r} * (r.v / 50) + {float(wx[1, c] + b[c])!r} + " + " + ".join(f"{float(wh[i, c])!r} * k.h{i}" for i in range(3))
    sig = lambda z: f"(1 / (1 + exp(-({z}))))"
    cells = ", ".join(f"{sig(gate(j))} * k.c{j} + {sig(gate(3 + j))} * tanh({gate(6 + j)}) c{j}, {sig(gate(9 + j))} o{j}" for j in range(3))
    outs = ", ".join(f"o{j} * tanh(c{j}), c{j}" for j in range(3))
    names = ", ".join(f"h{j}, c{j}" for j in range(3))
    zeros = ", ".join(["0.0::double"] * 6)
    return f"with recursive r as (select user_id u, row_number() over (partition by user_id order by ts, value) t, value v from events), k(u, t, {names}) as (select u, 0::bigint, {zeros} from r where t = 1 union all select u, t, {outs} from (select r.u, r.t, {cells} from k join r on r.u = k.u and r.t = k.t + 1)) select u as user_id, max(t)::int as n, round(arg_max(h0, t), 6) as h0 from k group by u"


@query("lstm_states", _lstm_sql())
def lstm(spark, sf_dir):
    wx, wh, b = _LSTM
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.array(F.col("value") / 50, F.lit(1.0)).alias("v"))
    return neural.over_sequences(e, "user_id", "ts", lambda x: neural.lstm(x, wx, wh, b)[0]).select("user_id", F.size("out").alias("n"), F.round(F.element_at("out", -1)[0], 6).alias("h0"))


@query("transformer_block")
def transformer(spark, sf_dir):
    rng = np.random.Generator(np.random.PCG64(3))
    w = {k: rng.standard_normal((4, 4)) / 2 for k in "qkv"} | {"w1": rng.standard_normal((4, 8)) / 2, "b1": np.zeros(8), "w2": rng.standard_normal((8, 4)) / 2, "b2": np.zeros(4)}
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.array(F.col("value") / 50, F.sin("value"), F.cos("value"), F.lit(1.0)).alias("v"))
    return neural.over_sequences(e, "user_id", "ts", lambda x: neural.transformer_block(x, w, 2)).select("user_id", F.size("out").alias("n"), F.round(F.element_at("out", -1)[0], 5).alias("x0"))


_RNG = np.random.Generator(np.random.PCG64(4))
_CODER = tuple(_RNG.standard_normal(s) / 2 for s in ((2, 3), (3, 3), (3, 3), (3, 4)))


def _coder_sql(steps: int) -> str:
    we, ue, ud, vo = ([[repr(float(x)) for x in row] for row in w] for w in _CODER)
    code = ", ".join(f"tanh({we[0][j]} * (r.v / 50) + {we[1][j]} + " + " + ".join(f"{ue[i][j]} * k.h{i}" for i in range(3)) + f") h{j}" for j in range(3))
    ctes = [f"k(u, t, h0, h1, h2) as (select u, 0::bigint, 0.0::double, 0.0::double, 0.0::double from r where t = 1 union all select r.u, r.t, {code} from k join r on r.u = k.u and r.t = k.t + 1)"]
    ctes.append("g0 as (select u, " + ", ".join(f"arg_max(h{j}, t) h{j}" for j in range(3)) + " from k group by u)")
    for n in range(steps):
        ctes.append(f"g{n + 1} as (select u, " + ", ".join("tanh(" + " + ".join(f"{ud[i][j]} * h{i}" for i in range(3)) + f") h{j}" for j in range(3)) + f" from g{n})")
    z = ", ".join(" + ".join(f"{vo[i][j]} * h{i}" for i in range(3)) + f" z{j}" for j in range(4))
    return f"with recursive r as (select user_id u, row_number() over (partition by user_id order by ts, value) t, value v from events), {', '.join(ctes)} select u as user_id, round(1 / (1 + exp(z1 - z0) + exp(z2 - z0) + exp(z3 - z0)), 6) as p0 from (select u, {z} from g{steps})"


@query("encoder_decoder", _coder_sql(3))
def encoder_decoder(spark, sf_dir):
    we, ue, ud, vo = _CODER
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.array(F.col("value") / 50, F.lit(1.0)).alias("v"))
    return neural.over_sequences(e, "user_id", "ts", lambda x: neural.encoder_decoder(x, we, ue, ud, vo, 3)).select("user_id", F.round(F.element_at("out", -1)[0], 6).alias("p0"))


@query("gan_1d")
def gan(spark, sf_dir):
    gen, _ = neural.gan_1d(table(spark, sf_dir, "events").select((F.col("value") / 50).alias("x")), "x", 3)
    return spark.createDataFrame([(float(gen.weights[0][0][0, 0]), float(gen.weights[0][1][0]))], "scale double, shift double")


@query("hyper_parameter_search")
def search(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    train, test = preparation.split(rows, 0.7, 9, "id")
    _, trials = neural.search(train, test, (64, 10), 3, rounds=(2, 4))
    return spark.createDataFrame([(i, t["hidden"], t["activation"], round(t["accuracy"], 6)) for i, t in enumerate(trials)], "trial int, hidden int, activation string, accuracy double")


@query("misclassified")
def misclassified(spark, sf_dir):
    net = neural.MLP.create([64, 8, 10], "relu", "softmax", 0)
    rows = _labelled(spark, sf_dir)
    net.fit(rows, 3, 0.1, True)
    return net.misclassified(rows)
