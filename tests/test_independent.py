"""Operators without SQL against plain NumPy versions and known answers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import __main__ as command
from quillon.operators import cluster, decompose, metrics, mixture, neural, reinforcement, sampling, sequence, tree
from quillon.sources import readers


def points(spark, x, **more):
    rows = [(i, [float(v) for v in r], *(m[i] for m in more.values())) for i, r in enumerate(np.asarray(x).tolist())]
    return spark.createDataFrame(rows, ["id", "v", *more])


def rng_of(seed):
    return np.random.Generator(np.random.PCG64(seed))


def test_trees_grow_until_nothing_splits(spark):
    x = rng_of(1).random((60, 2))
    rows = [(i, float(a), float(b), int((a > 0.5) != (b > 0.5))) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").coalesce(2).cache()
    nodes = tree.fit(df, ["a", "b"], "y", min_rows=1)
    assert nodes.agg(F.max("depth")).first()[0] > 2
    assert tree.predict(df, nodes, ["a", "b"]).where(tree.vote(F.col("tree_values")) == F.col("y")).count() == 60
    shares = {r["feature"]: r["importance"] for r in tree.importances(nodes, ["a", "b"]).collect()}
    assert sum(shares.values()) == pytest.approx(1) and min(shares.values()) > 0


def test_pam(spark):
    x = rng_of(5).standard_normal((24, 2)) + np.repeat([[0, 0], [4, 4], [0, 5]], 8, 0)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    cost = lambda m: d[:, m].min(1).sum()
    df, start = points(spark, x), [0, 1, 2]
    got = {(r["candidate"], r["medoid"]): r["cost"] for r in cluster.pam_swaps(df, start).collect()}
    want = {(h, m): cost([h if k == m else k for k in start]) for h in range(24) if h not in start for m in start}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    medoids, total = cluster.pam(df, start)
    assert total == pytest.approx(cost(medoids))
    assert all(cost([h if k == m else k for k in medoids]) >= total - 1e-9 for h in range(24) for m in medoids)
    assert total <= cluster.kmedoids(df, start)[1] + 1e-9


@pytest.mark.parametrize("linkage", ["single", "complete", "average"])
def test_dendrogram(spark, linkage):
    x = rng_of(3).random((12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    join = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
    groups, want = [[i] for i in range(12)], []
    while len(groups) > 1:
        near, a, b = min((float(join(d[np.ix_(p, q)])), p, q) for p, q in itertools.combinations(groups, 2))
        groups = [g for g in groups if g not in (a, b)] + [sorted(a + b)]
        want.append((*sorted((min(a), min(b))), near, len(a + b)))
    got = [(r["a"], r["b"], r["distance"], r["size"]) for r in cluster.dendrogram(points(spark, x), linkage).sort("step").collect()]
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_label_matching(spark):
    rng = rng_of(0)
    for k in range(60):
        n = int(rng.integers(1, 6))
        c = rng.integers(0, 5, (n, n)).astype(float)
        found = metrics._assignment(c)
        assert sorted(found) == list(range(n))
        assert c[np.arange(n), found].sum() == min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
    df = spark.createDataFrame([("a", 2), ("a", 2), ("b", 2), ("b", 7), ("c", 9), (None, 9)], "label string, cluster int")
    mapping, share = metrics.match_labels(df, "label", "cluster")
    assert mapping == {2: "a", 7: "b", 9: "c"} and share == pytest.approx(4 / 5)


def test_sampled_sequences(spark):
    model = sequence.HMM(np.array([0.9, 0.1]), np.array([[0.8, 0.2], [0.4, 0.6]]), np.array([[0.7, 0.2, 0.1], [0.0, 0.5, 0.5]]))
    rows = model.sample(spark, 400, 30, 7).toPandas()
    assert len(rows) == 12_000 and not ((rows["state"] == 1) & (rows["obs"] == 0)).any()
    assert (rows[rows["t"] == 0]["state"] == 0).mean() == pytest.approx(0.9, abs=0.05)
    rows = rows.sort_values(["seq_id", "t"])
    after = rows["state"].shift(-1)[rows["t"] < 29]
    for s in (0, 1):
        assert after[rows["state"] == s].mean() == pytest.approx(model.a[s, 1], abs=0.03)
        assert np.bincount(rows[rows["state"] == s]["obs"], minlength=3) / (rows["state"] == s).sum() == pytest.approx(model.b[s], abs=0.03)
    again = model.sample(spark, 400, 30, 7).toPandas().sort_values(["seq_id", "t"])
    assert (again.to_numpy() == rows.to_numpy()).all()


def test_expected_observation(spark):
    model = sequence.Kalman(np.eye(2), np.array([[1.0, 2.0], [0.0, 3.0]]), np.eye(2), np.eye(2))
    assert model.predict_obs(spark.createDataFrame([([2.0, 5.0],)], "x array<double>")).first()["z"] == [12.0, 15.0]


def test_mixture_rounds(spark):
    """Three rounds of expectation and maximisation, written out."""
    rng = rng_of(4)
    x = np.vstack([rng.standard_normal((60, 2)), rng.standard_normal((60, 2)) * 0.5 + [5, 1]])
    means, covs, weights, _, rounds = mixture.gmm(points(spark, x), 2, 3, tol=-1, means=[[0, 1], [4, 0]])
    m, s, w = np.array([[0.0, 1], [4, 0]]), [np.eye(2) * x.var(0).mean()] * 2, np.full(2, 0.5)
    for _ in range(3):
        p = np.stack([w[k] * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m[k], np.linalg.inv(s[k]), x - m[k])) / np.sqrt(np.linalg.det(2 * np.pi * s[k])) for k in range(2)], 1)
        r = p / p.sum(1, keepdims=True)
        m = (r.T @ x) / r.sum(0)[:, None]
        s = [((x - m[k]) * r[:, k : k + 1]).T @ (x - m[k]) / r[:, k].sum() + 1e-6 * np.eye(2) for k in range(2)]
        w = r.mean(0)
    assert rounds == 3 and means == pytest.approx(m) and weights == pytest.approx(w)
    assert covs == pytest.approx(np.array(s), abs=1e-8)


def test_som_and_components(spark):
    x = rng_of(2).random((150, 2))
    df = points(spark, x).coalesce(2).cache()
    start, book = cluster.plus_plus(df, 9, 0), cluster.som(df, 3, 0, 12, 0.7)
    error = lambda c: np.sqrt(((x[:, None] - c[None]) ** 2).sum(-1)).min(1).mean()
    assert error(book) < error(start)
    at = np.stack(np.divmod(np.arange(9), 3), 1)
    grid = np.abs(at[:, None] - at[None]).sum(-1)
    apart = np.sqrt(((book[:, None] - book[None]) ** 2).sum(-1))
    assert apart[grid == 1].mean() < apart[grid >= 3].mean()  # neighbours on the grid are near
    z = rng_of(1).standard_normal((80, 3)) * [1, 10, 0.1] + [5, 0, 2]
    model = decompose.pca(points(spark, z), standardise=True)
    zs = (z - z.mean(0)) / z.std(0)
    value = np.sort(np.linalg.eigvalsh(np.cov(zs.T)))[::-1]
    assert model.variance == pytest.approx(value) and model.ratio.sum() == pytest.approx(1)
    got = np.array([r["v"] for r in model.transform(points(spark, z)).sort("id").collect()])
    assert got.var(0, ddof=1) == pytest.approx(value) and np.corrcoef(got.T) == pytest.approx(np.eye(3), abs=1e-8)


def test_contrasts_of_independent_components(spark):
    rng = rng_of(42)
    s = np.column_stack([rng.standard_normal(600), rng.uniform(-1, 1, 600)])
    df = points(spark, s @ np.array([[1, 0.3], [0.5, 1]])).coalesce(2).cache()
    for fun, symmetric in (("logcosh", True), ("exp", False), ("exp", True)):
        w, mean = decompose.fast_ica(df, 2, 100, fun=fun, symmetric=symmetric)
        got = (s @ np.array([[1, 0.3], [0.5, 1]]) - mean) @ w.T
        assert np.abs(np.corrcoef(got.T, s.T)[:2, 2:]).max(0).min() > 0.95


def test_sequence_layers():
    rng = rng_of(9)
    x = rng.standard_normal((5, 4))
    w = {k: rng.standard_normal((4, 4)) for k in "qkv"} | {"w1": rng.standard_normal((4, 6)), "b1": rng.standard_normal(6), "w2": rng.standard_normal((6, 4)), "b2": rng.standard_normal(4)}

    def attended(t, h):
        scores = [sum((x[t] @ w["q"])[c] * (x[u] @ w["k"])[c] for c in (2 * h, 2 * h + 1)) / 2**0.5 for u in range(5)]
        share = [np.exp(s) for s in scores]
        return [sum(share[u] / sum(share) * (x[u] @ w["v"])[c] for u in range(5)) for c in (2 * h, 2 * h + 1)]

    heads = np.array([attended(t, 0) + attended(t, 1) for t in range(5)])
    assert neural.multi_head(x, w["q"], w["k"], w["v"], 2) == pytest.approx(heads)
    norm = lambda r: (r - np.mean(r)) / (np.sqrt(np.mean((r - np.mean(r)) ** 2)) + 1e-6)
    gelu = lambda z: 0.5 * z * (1 + np.tanh((2 / np.pi) ** 0.5 * (z + 0.044715 * z**3)))
    want = []
    for t in range(5):
        y = norm(x[t] + heads[t])
        want.append(norm(y + gelu(y @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"]))
    assert neural.transformer_block(x, w, 2) == pytest.approx(np.array(want))
    we, ue, ud, vo = (rng.standard_normal(s) for s in ((4, 3), (3, 3), (3, 3), (3, 2)))
    h = np.zeros(3)
    for r in x:
        h = np.array([np.tanh(sum(r[i] * we[i, j] for i in range(4)) + sum(h[i] * ue[i, j] for i in range(3))) for j in range(3)])
    for out in neural.encoder_decoder(x, we, ue, ud, vo, 3):
        h = np.array([np.tanh(sum(h[i] * ud[i, j] for i in range(3))) for j in range(3)])
        e = [np.exp(sum(h[i] * vo[i, j] for i in range(3))) for j in range(2)]
        assert out == pytest.approx(np.array(e) / sum(e))
    im, ks, b = rng.standard_normal((2, 2, 5, 4)), rng.standard_normal((3, 2, 2, 3)), rng.standard_normal(3)
    got = neural.conv2d(im, ks, b)
    for n, k, i, j in itertools.product(range(2), range(3), range(4), range(2)):
        assert got[n, k, i, j] == pytest.approx(b[k] + sum(im[n, c, i + p, j + q] * ks[k, c, p, q] for c in range(2) for p in range(2) for q in range(3)))


def test_small_networks(spark):
    rng = rng_of(6)
    x = rng.standard_normal((40, 2))
    w = 1.5 - 0.5j
    z = (x[:, 0] + 1j * x[:, 1]) * w
    pairs = spark.createDataFrame([(float(a), float(b), float(c.real), float(c.imag)) for (a, b), c in zip(x, z)], "xr double, xi double, yr double, yi double")
    assert neural.complex_descent(pairs, 200, 0.2) == pytest.approx(w, abs=1e-6)
    centres, weights = np.array([[0.0, 0], [1, 1]]), np.array([2.0, -1.0])
    act = np.exp(-((x[:, None] - centres[None]) ** 2).sum(-1) / 2)
    fitted = neural.rbf_fit(points(spark, x, y=(0.5 + act @ weights).tolist()), centres)
    assert fitted == pytest.approx([0.5, 2.0, -1.0], abs=1e-5)
    label = (x[:, 0] > 0).astype(int)
    df = points(spark, x * 3, y=np.eye(2)[label].tolist()).coalesce(2).cache()
    net, trials = neural.search(df, df, (2, 2), 3, rounds=(20, 30))
    assert len(trials) == 3 and max(t["accuracy"] for t in trials) == pytest.approx(1 - net.misclassified(df).count() / 40)
    flipped = df.withColumn("y", F.reverse("y"))
    assert net.misclassified(flipped).count() + net.misclassified(df).count() == 40
    gen, _ = neural.gan_1d(spark.range(200).select((F.lit(3.0) + F.col("id") / 400).alias("x")).coalesce(1).cache(), "x", 40, 0.1)
    assert gen.weights[0][1][0] > 0.5  # the generator has moved towards the data


def test_value_networks(spark):
    rng = rng_of(8)
    x, target = rng.standard_normal((6, 2)), rng.standard_normal((6, 5))
    values = reinforcement.DQN.create((7,), 3, dueling=True).online
    out = values.net.forward(x)[-1]
    assert values.q(x) == pytest.approx(out[:, :1] + out[:, 1:] - out[:, 1:].mean(1, keepdims=True)) and values.q(x).mean(1) == pytest.approx(out[:, 0])
    loss = lambda: float(((values.q(x) - target) ** 2).sum())
    delta = 2 * (values.q(x) - target)
    mapped = np.column_stack([delta.sum(1), delta - delta.mean(1, keepdims=True)])
    grads, before = values.net.backward(values.net.forward(x), mapped), loss()
    for layer in (0, 1):
        w, b = values.net.weights[layer]
        step = np.zeros_like(w)
        step[1, 2] = 1e-6
        values.net.weights[layer] = (w + step, b)
        assert (loss() - before) / 1e-6 == pytest.approx(grads[layer][0][1, 2], rel=1e-3, abs=1e-4)
        values.net.weights[layer] = (w, b)


def test_learners(spark):
    data = reinforcement.collect_rollouts(spark, lambda s, rng: rng.choice(reinforcement.FORCES), 8, 30, 1).cache()
    for options in ({"prioritised": True}, {"tau": None, "every": 5}, {"double": False}):
        agent = reinforcement.DQN.create(dueling=True)
        s, u, r, _, _ = reinforcement._buffer(data, 1000)
        a = np.abs(u[:, None] - np.array(reinforcement.FORCES)).argmin(1)
        error = lambda: ((r - agent.online.q(s)[np.arange(len(a)), a]) ** 2).mean()  # noqa: B023, E731
        before = error()
        assert np.isfinite(agent.learn(data, 60, gamma=0.0, **options)).all()  # without a future the rewards themselves are learned
        assert error() < 0.5 * before and np.isfinite(agent.learn(data, 20, **options)).all()
        assert agent.act(np.array([0.5, 0.0])) in reinforcement.FORCES
    newest = reinforcement._buffer(data, 31)
    assert len(newest[0]) == 31 and newest[4].sum() == 2  # the last episode and the end of the one before
    sac = reinforcement.ActorCritic.create("sac")
    start = sac.log_alpha
    sac.learn(data, 20, alpha=None, target_entropy=-50.0)
    assert sac.log_alpha < start  # more entropy than asked for
    for kind in ("ddpg", "sac"):
        assert np.isfinite(reinforcement.ActorCritic.create(kind).train(spark, 2, 4, 20, 10)).all()
    for options in ({"discrete": True, "entropy": 0.05}, {"kl": 0.5}, {}):
        net, history = reinforcement.ppo(spark, 2, 4, 20, **options)
        assert len(history) == 2 and np.isfinite(history).all() and np.isfinite(net.weights[0][0]).all()
    path = reinforcement.ou_path(0.5, 0.3, 0.1)(rng_of(1), 4000)
    assert path.std() == pytest.approx(0.3 / np.sqrt(2 * 0.5), rel=0.3)
    assert np.abs(reinforcement.gaussian_path(1.0, 0.01, 0.9)(rng_of(1), 200)[100:]).max() < 0.1


def test_gibbs_chains(spark):
    rows = sampling.gibbs(spark, sampling.bivariate_normal(0.6), [0.0, 0.0], 3000, 4, 1)
    for r in sampling.diagnostics(rows, 200).collect():
        assert abs(r["mean"]) < 0.15 and r["variance"] == pytest.approx(1, abs=0.2) and r["r_hat"] < 1.05
    x = np.array([r["x"] for r in rows.where("step >= 200").collect()])
    assert np.corrcoef(x.T)[0, 1] == pytest.approx(0.6, abs=0.05)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("d,x\n01/02/2024 03:04:05,1.5\n01/03/2024 00:00:00,bad\n")
    rows = readers.csv(spark, str(tmp_path / "a.csv"), "d timestamp, x double", "MM/dd/yyyy HH:mm:ss").sort("d").collect()
    assert [str(r["d"]) for r in rows] == ["2024-01-02 03:04:05", "2024-01-03 00:00:00"] and [r["x"] for r in rows] == [1.5, None]
    # a bitmap of 3 x 2 pixels with rows from the bottom, padded to 4 bytes, blue first
    pixels = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    body = b"".join(r.tobytes() + b"\0" * 3 for r in pixels[::-1])
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (3).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.bmp").write_bytes(head + info + body)
    got = {(r["c"], r["y"], r["x"]): r["v"] for r in readers.images(spark, str(tmp_path / "images")).collect()}
    assert got == {(c, y, x): int(pixels[y, x, c]) for c in range(3) for y in range(2) for x in range(3)}
    readers.write(spark.range(4).withColumn("k", F.col("id") % 2), str(tmp_path / "out"), ["k"])
    assert spark.read.parquet(str(tmp_path / "out")).where("k = 1").count() == 2


def test_listing(capsys):
    assert command.main(["version"]) == 0 and capsys.readouterr().out.startswith("quillon ")
    assert command.main(["list", "cluster"]) == 0
    out = capsys.readouterr().out
    assert "dbscan" in out and "pam" in out and "tree" not in out.split()
    assert command.main(["queries"]) == 0 and "kmeans_assign" in capsys.readouterr().out
