"""Operators against known answers, and the same answers for any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import cluster, decompose, gaussian_process, linear, mixture, network, neural, pairs, reinforcement, rules, sampling, sequence, tree
from quillon.plans import cluster_queries, model_queries
from quillon.sources import readers
from quillon.streaming import online


def points(spark, x, **more):
    rows = [(i, [float(v) for v in r], *(m[i] for m in more.values())) for i, r in enumerate(np.asarray(x).tolist())]
    return spark.createDataFrame(rows, ["id", "v", *more])


def test_ols_and_invariance(spark):
    df = readers.line(spark, 500, [2.0, 3.0], 0.5, 0.1)
    for n in (1, 4, 9):
        m = linear.ols(df.repartition(n), ["x1", "x2"], "y")
        assert m.coef == pytest.approx([2, 3], abs=0.1) and m.score(df, "y") > 0.99
    wide = linear.gram(df, ["x1", "x2"], "y", wide=0)
    assert np.allclose(wide.xx, linear.gram(df, ["x1", "x2"], "y").xx)
    gd = linear.gradient_descent(df, ["x1", "x2"], "y", 0.1, 3000)
    assert gd.coef == pytest.approx(m.coef, rel=0.05) and all(a >= b - 1e-9 for a, b in zip(gd.history, gd.history[1:]))
    assert linear.lasso(df, ["x1", "x2"], "y", 0.01).score(df, "y") > 0.95
    assert linear.bayesian(df, ["x1", "x2"], "y", evidence=True).coef == pytest.approx([2, 3], abs=0.3)


def test_nulls_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 1.0), (3.0, 6.0), (float("nan"), 1.0)], "x double, y double")
    m = linear.ols(df, ["x"], "y")
    assert m.coef[0] == pytest.approx(2) and m.intercept == pytest.approx(0, abs=1e-9)
    assert [r["prediction"] is None for r in m.transform(df).collect()].count(True) == 1
    with pytest.raises(ValueError, match="samples"):
        linear.ols(df.where("x > 99"), ["x"], "y")


def test_classifiers(spark):
    df = readers.blobs(spark, 200, [[-2, -2], [2, 2]], 0.5).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), "label").coalesce(2).cache()
    for model in (linear.logistic(df, ["x", "y"], "label", 0.5, 8), linear.svm(df, ["x", "y"], "label", 0.05, 8)):
        assert model.transform(df).where("prediction = label").count() >= 190
    nodes = tree.fit(df, ["x", "y"], "label", 3)
    assert tree.predict(df, nodes, ["x", "y"]).where(tree.vote(F.col("tree_values")) == F.col("label")).count() >= 190
    nodes = tree.forest(df, "id", ["x", "y"], "label", 4, 2)
    assert tree.predict(df, nodes, ["x", "y"]).where(tree.vote(F.col("tree_values")) == F.col("label")).count() >= 190
    with pytest.raises(ValueError, match="binary labels"):
        linear.logistic(df.withColumn("label", F.lit(5)), ["x"], "label")


def test_clusters(spark):
    df = readers.blobs(spark, 90, [[0, 0], [8, 0], [4, 7]], 0.4).coalesce(2).cache()
    labels = {r["id"]: r["label"] for r in df.collect()}

    def same(rows):
        seen = {}
        return all(seen.setdefault(r["cluster"], labels[r["id"]]) == labels[r["id"]] for r in rows) and len(seen) == 3

    v = df.select("id", "v")
    centres, inertia, _ = cluster.kmeans(v, cluster.plus_plus(v, 3, 1))
    assert same(cluster.assign(v, centres).collect()) and inertia < 60
    assert same(cluster.dbscan(v, 1.2, 4).collect()) and same(cluster.dbscan(v, 1.2, 4, 2).collect())
    for linkage in ("single", "complete", "average", "ward"):
        assert same(cluster.agglomerative(v, 3, linkage).collect())
    medoids, _ = cluster.kmedoids(v, [0, 1, 2])
    assert {labels[m] for m in medoids} == {0, 1, 2}
    model = mixture.gmm(v, 3, 5, means=centres)
    assert same(mixture.gmm_predict(v, *model[:3]).collect())
    assert len(cluster.som(v, 2, 0, 3)) == 4


def test_blocks_agree(spark):
    e = readers.blobs(spark, 60, [[0, 0, 0], [1, 1, 1]], 0.7).select("id", "v")
    one, many = (sorted(map(tuple, pairs.nearest(e, e, 3, True, n).select("q", "id", "place").collect())) for n in (1, 4))
    assert one == many
    a, b = (sorted(map(tuple, d.select("a", "b").collect())) for d in (pairs.within(e, 0.8, 3), pairs.within_grid(e, 0.8, 3)))
    assert a == b and len(a) > 60


def test_decompositions(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.standard_normal((80, 4))
    df = points(spark, x)
    model = decompose.pca(df)
    assert np.allclose(model.components @ model.components.T, np.eye(4), atol=1e-10)
    back = {r["id"]: r["v"] for r in model.inverse(model.transform(df)).collect()}
    assert np.allclose([back[i] for i in range(80)], x, atol=1e-8)
    s = np.stack([rng.standard_normal(300), rng.uniform(-1, 1, 300)], 1)
    mixed = points(spark, s @ np.array([[1, 0.5], [0.3, 1]]).T)
    for symmetric in (False, True):
        w, mean = decompose.fast_ica(mixed.coalesce(1).cache(), 2, 12, symmetric=symmetric)
        out = (s @ np.array([[1, 0.5], [0.3, 1]]).T - mean) @ w.T
        assert abs(np.corrcoef(out.T)[0, 1]) < 0.15
    ids, y = decompose.tsne(points(spark, np.r_[x[:8], x[8:16] + 20]), 2, 5, 300, 20.0)
    assert np.linalg.norm(y[:8].mean(0) - y[8:].mean(0)) > max(y[:8].std(), y[8:].std())


def test_sprinkler_network(spark):
    def t(rows, columns):
        return spark.createDataFrame(rows, f"{', '.join(c + ' int' for c in columns)}, p double")

    net = network.Network().add("rain", [], t([(0, 0.8), (1, 0.2)], ["rain"]))
    net.add("sprinkler", ["rain"], t([(0, 0, 0.6), (0, 1, 0.4), (1, 0, 0.99), (1, 1, 0.01)], ["rain", "sprinkler"]))
    wet = [[[1, 0], [0.1, 0.9]], [[0.2, 0.8], [0.01, 0.99]]]
    net.add("wet", ["rain", "sprinkler"], t([(r, s, w, float(wet[r][s][w])) for r in (0, 1) for s in (0, 1) for w in (0, 1)], ["rain", "sprinkler", "wet"]))
    p = lambda v, e=None: {r[v]: r["p"] for r in net.query(v, e).collect()}
    assert p("rain")[1] == pytest.approx(0.2) and p("sprinkler")[1] == pytest.approx(0.322) and p("sprinkler", {"rain": 1})[1] == pytest.approx(0.01)
    assert p("rain", {"wet": 1, "sprinkler": 1})[1] < p("rain", {"wet": 1})[1]
    assert net.sample(spark, 5000, 1).agg(F.avg("rain")).first()[0] == pytest.approx(0.2, abs=0.05)


def test_apriori(spark):
    rows = [(t, i) for t, items in enumerate(["ABC", "AB", "ABC", "AB"]) for i in items]
    sets = rules.itemsets(spark.createDataFrame(rows, "txn int, item string"), 0.5)
    assert {("".join(r["itemset"]), r["support"]) for r in sets.collect()} == {("A", 1.0), ("B", 1.0), ("C", 0.5), ("AB", 1.0), ("AC", 0.5), ("BC", 0.5), ("ABC", 0.5)}
    assert ("C", "AB", 0.5, 1.0, 1.0) in {("".join(r["antecedent"]), "".join(r["consequent"]), r["support"], r["confidence"], r["lift"]) for r in rules.rules(sets).collect()}
    assert rules.itemsets(spark.createDataFrame([], "txn int, item string")).count() == 0


def test_itemsets_of_any_size(spark, tmp_path):
    sets = rules.itemsets(spark.createDataFrame([(t, f"i{k}") for t in range(3) for k in range(9)], "txn int, item string"), 0.5)
    assert sets.count() == 2**9 - 1
    # a bundle of five brands in every other order
    lines = [(t, p) for t in range(10) for p in (range(5) if t % 2 else (5 + t // 2,))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"B{p}") for p in range(10)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["itemset"]: r["n"] for r in model_queries.itemsets(spark, str(tmp_path)).collect()}
    assert got["B0,B1,B2,B3,B4"] == 5 and sum(n == 5 for n in got.values()) == 2**5 - 1
    found = {(r["antecedent"], r["consequent"]) for r in model_queries.basket_rules(spark, str(tmp_path)).collect()}
    assert ("B0,B1", "B2,B3,B4") in found and len(found) == 3**5 - 2 * 2**5 + 1


def test_sequences(spark):
    model = sequence.HMM(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.8, 0.1, 0.1], [0.1, 0.1, 0.8]]))
    df = spark.createDataFrame([(1, t, o) for t, o in enumerate([0, 0, 0, 2, 2, 2, 0, 0])], "seq_id long, t int, obs int")
    assert [r["state"] for r in model.decode(df).sort("t").collect()] == [0, 0, 0, 1, 1, 1, 0, 0]
    _, history = sequence.HMM.random(2, 3, 1).fit(df, 5)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    k = sequence.Kalman(np.array([[1.0, 1], [0, 1]]), np.array([[1.0, 0]]), 0.01 * np.eye(2), np.array([[0.5]]), np.array([0.0, 1]), np.eye(2))
    z = spark.createDataFrame([(1, t, [float(t)]) for t in range(30)], "key long, t int, z array<double>")
    filtered, smooth = (k.apply(z, smooth=s).sort("t").collect() for s in (False, True))
    assert all(np.trace(b["p"]) <= np.trace(a["p"]) + 1e-9 for a, b in zip(filtered, smooth)) and smooth[-1]["x"] == filtered[-1]["x"]
    assert filtered[-1]["x"][1] == pytest.approx(1, abs=0.3)


def test_gaussian_process(spark):
    x = np.linspace(0, 2 * np.pi, 30)
    df = points(spark, x[:, None], y=np.sin(x).tolist())
    gp = gaussian_process.GaussianProcess.fit(df, gaussian_process.Kernel(), 1e-8)
    got = {r["id"]: r["mean"] for r in gp.predict(df).collect()}
    assert np.allclose([got[i] for i in range(30)], np.sin(x), atol=1e-4)
    assert gp.sample(x[:5, None] + 0.1, 3).shape == (3, 5)
    local = gaussian_process.fit_by_group(df.withColumn("g", F.lit(1)), df.withColumn("g", F.lit(1)), "g")
    assert local.count() == 30


def test_gaussian_process_takes_all_rows(spark, tmp_path):
    # labels of the rows after the first 100 ids matter, as one process and as local experts
    rng = np.random.Generator(np.random.PCG64(4))
    x, label = rng.uniform(-3, 3, (300, 2)), [0] * 150 + [5] * 150
    x[:, 0] = np.where(np.arange(300) < 150, -1, 1) * (0.2 + np.abs(x[:, 0]))
    spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(zip(x.tolist(), label))], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    k = gaussian_process.Kernel("rbf", 0.5)
    whole = k(x, x)
    want = whole @ np.linalg.solve(whole + 1e-3 * np.eye(300), np.array(label, float))
    got = {r["id"]: r["mean"] for r in cluster_queries.gp(spark, str(tmp_path)).collect()}
    assert np.allclose([got[i] for i in range(300)], want, atol=1e-3)
    df = points(spark, x, y=[float(v) for v in label])
    local = {r["id"]: (r["mean"], r["std"]) for r in gaussian_process.fit_predict(df, k, 1e-3, bounded=100, expert=60).collect()}
    assert sorted(local) == list(range(300)) and all(s >= 0 for _, s in local.values())
    assert np.mean(np.abs(np.array([local[i][0] for i in range(300)]) - np.array(label))) < 0.5


def test_sampling(spark):
    d = sampling.diagnostics(sampling.metropolis(spark, lambda x: -0.5 * float(x @ x), [0.0], 3000, 2.0, 4, 1), 300).first()
    assert abs(d["mean"]) < 0.2 and d["variance"] == pytest.approx(1, abs=0.3) and d["r_hat"] < 1.1


def test_networks_learn(spark):
    df = points(spark, [[0, 0], [0, 1], [1, 0], [1, 1]], y=[[0.0], [1.0], [1.0], [0.0]])
    net = neural.MLP.create([2, 8, 1], "tanh", "sigmoid", 3)
    losses = net.fit(df.coalesce(1).cache(), 60, 0.2, True)
    assert losses[-1] < 0.3 < losses[0]
    got = {r["id"]: r["output"][0] for r in net.predict(df).collect()}
    assert [round(got[i]) for i in range(4)] == [0, 1, 1, 0]
    expr = {r["id"]: r["o"] for r in df.select("id", net.expression(F.col("v"))[0].alias("o")).collect()}
    assert all(expr[i] == pytest.approx(got[i]) for i in got)
    bnn = neural.BayesianMLP.create([2, 4, 1])
    history = bnn.fit(df, 5, 0.05)
    assert len(history) == 5 and bnn.predict(df, 5).count() == 4


def test_gradients_are_right():
    rng = np.random.Generator(np.random.PCG64(0))
    x, y = rng.standard_normal((5, 3)), rng.standard_normal((5, 2))
    net = neural.MLP.create([3, 4, 2], "tanh", "linear", 1)
    grads, loss = net.gradients(x, y)
    w, b = net.weights[0]
    step = np.zeros_like(w)
    step[1, 2] = 1e-6
    net.weights[0] = (w + step, b)
    assert (net.gradients(x, y)[1] - loss) / 1e-6 == pytest.approx(grads[0][0][1, 2], rel=1e-3)


def test_control(spark):
    q = reinforcement.policy(reinforcement.q_learning(spark, 2, 300, 1).select("s", "a", "q")).collect()
    assert {r["s"]: r["a"] for r in q}[0] in (1, 3)
    exact = {r["s"]: r["v"] for r in reinforcement.policy(reinforcement.q_sweeps(reinforcement.grid_world(spark), 12, 0.9)).collect()}
    assert exact[14] == pytest.approx(10) and exact[10] == pytest.approx(-0.1 + 0.9 * 10)
    data = reinforcement.collect_rollouts(spark, lambda s, rng: rng.uniform(-1, 1), 8, 20, 1).cache()
    for kind in ("ddpg", "td3", "sac"):
        losses = reinforcement.ActorCritic.create(kind).learn(data, 30)
        assert np.isfinite(losses).all()
    dqn = reinforcement.DQN.create().learn(data, 60)
    assert np.mean(dqn[-10:]) < np.mean(dqn[:10])


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.sql(f"select * from {name}")

    got = run(online.windowed(stream, "1 day", late="2 days"), "complete", "windows")
    key = lambda d: sorted((str(r["start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in d.collect())
    assert key(got) == key(online.windowed(events, "1 day"))
    filtered = {r["user_id"]: (r["n"], r["x"]) for r in run(online.kalman_stream(stream), "update", "kalman").collect()}
    for user, part in events.toPandas().groupby("user_id"):
        x, _ = online.kalman_batch(part.sort_values(["ts", "event_id"])["value"].to_numpy())
        assert filtered[user] == (len(part), pytest.approx(x))
