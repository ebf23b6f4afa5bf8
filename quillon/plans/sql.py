"""SQL of the longer oracles, unrolled from parameters."""

from __future__ import annotations

from ..functions.expressions import uniform_sql


def tree_levels(rows: str, features: int, depth: int, classes: list[str] | None, min_rows: int = 2, allowed: str | None = None) -> str:
    """CTEs that grow trees over ``rows`` (tree, w, y, x0..): m0.. (rows at the
    nodes of a level), b0.. (tree, node, f, thr of those that split) and v (tree,
    node, n, value).  classes is None for regression; allowed (tree, f)."""
    xs = ", ".join(f"x{i}" for i in range(features))
    ctes = [f"m0 as (select tree, 1::bigint as node, w, y, {xs} from ({rows}))"]
    stats = ["sum(w) s0", "sum(w * y) s1", "sum(w * y * y) s2"] if classes is None else [f"coalesce(sum(w) filter (y = '{c}'), 0) s{i}" for i, c in enumerate(classes)]
    names = [f"s{i}" for i in range(len(stats))]

    def impurity(a):
        if classes is None:
            return f"({a[0]})::double", f"({a[2]} - ({a[1]}) * ({a[1]}) / ({a[0]}))"
        n = " + ".join(a)
        return f"({n})::double", f"({n} - ({' + '.join(f'({x}) * ({x})' for x in a)}) / ({n})::double)"

    left, total = [f"l{s}" for s in names], [f"t{s}" for s in names]
    (nl, il), (nr, ir), (nt, it) = impurity(left), impurity([f"({t} - {x})" for t, x in zip(total, left)]), impurity(total)
    for k in range(depth):
        long = " union all ".join(f"select tree, node, {i} as f, x{i}::double as x, w, y from m{k}" for i in range(features))
        ctes.append(f"p{k} as (select tree, node, f, x, {', '.join(stats)} from ({long}) {f'semi join ({allowed}) a using (tree, f)' if allowed else ''} group by tree, node, f, x)")
        run = ", ".join(f"sum({s}) over (partition by tree, node, f order by x rows unbounded preceding) l{s}, sum({s}) over (partition by tree, node, f) t{s}" for s in names)
        ctes.append(f"q{k} as (select tree, node, f, x, lead(x) over (partition by tree, node, f order by x) up, {run} from p{k})")
        ctes.append(f"g{k} as (select tree, node, f, (x + up) / 2 thr, {nl} nl, {nr} nr, round(({it} - {il} - {ir}) / {nt}, 12) gain from q{k} where up is not null)")
        ctes.append(f"b{k} as (select tree, node, f, thr from g{k} where nl >= {min_rows} and nr >= {min_rows} and gain > 1e-12 qualify row_number() over (partition by tree, node order by gain desc, f, thr) = 1)")
        side = f"case list_value({', '.join(f'x{i}::double' for i in range(features))})[f + 1] < thr when true then 0 else 1 end"
        ctes.append(f"m{k + 1} as (select tree, 2 * node + {side} as node, w, y, {xs} from m{k} join b{k} using (tree, node))")
    every = " union all ".join(f"select {k} as depth, tree, node, w, y from m{k}" for k in range(depth + 1))
    if classes is None:
        ctes.append(f"v as (select depth, tree, node, sum(w)::bigint n, sum(w * y) / sum(w) as value from ({every}) group by all)")
    else:
        ctes.append(f"v as (select depth, tree, node, sum(k)::bigint n, first(y order by k desc, y) as value from (select depth, tree, node, y, sum(w) k from ({every}) group by all) group by all)")
    return ",\n".join(ctes)


def tree_walk(rows: str, features: int, depth: int) -> str:
    """CTE z (key, tree, value) of rows (key, x0..) after tree_levels()."""
    side = f"case list_value({', '.join(f'x{i}::double' for i in range(features))})[f + 1] < thr when true then 0 else 1 end"
    ctes = [f"w0 as (select r.*, t.tree, 1::bigint as node from ({rows}) r, (select distinct tree from m0) t)"]
    for k in range(depth):
        ctes.append(f"w{k + 1} as (select w{k}.* exclude (node), case when b.thr is null then w{k}.node else 2 * w{k}.node + {side} end as node from w{k} left join b{k} b on b.tree = w{k}.tree and b.node = w{k}.node)")
    ctes.append(f"z as (select w{depth}.*, v.value from w{depth} join v using (tree, node))")
    return ",\n".join(ctes)


def poisson_sql(seed: int, *ids: str) -> str:
    """The Poisson(1) count that a hash draws for a row of a tree's bootstrap."""
    steps, total, term = [], 0.0, 0.36787944117144233
    for i in range(8):
        total += term
        steps.append(f"({uniform_sql(seed, *ids)} >= {total!r})::int")
        term /= i + 1
    return " + ".join(steps)


def network_training(x: str, y: str, weights, hidden: str, output: str, rounds: int, rate: float, adam: bool) -> str:
    """Full-batch steps of a network of one or two layers from the given weights:
    ``x`` (id, i, x) and ``y`` (id, k, y) are CTE names; gives l0.. (loss a round).

    A layer's weights are a table (i, j, w), the bias being the row i = 0.
    """
    acts = {"linear": "{z}", "relu": "greatest({z}, 0)", "tanh": "tanh({z})", "sigmoid": "1 / (1 + exp(-{z}))"}
    slopes = {"linear": "1", "relu": "case when {a} > 0 then 1 else 0 end", "tanh": "(1 - {a} * {a})", "sigmoid": "{a} * (1 - {a})"}
    ctes = [f"n as (select count(distinct id)::double n from {x})", f"a0 as (select id, i, x::double as a from {x} union all select distinct id, 0, 1.0 from {x})"]
    for k, (w, b) in enumerate(weights):
        rows = [f"({i + 1}, {j + 1}, {float(w[i, j])!r})" for i in range(w.shape[0]) for j in range(w.shape[1])] + [f"(0, {j + 1}, {float(v)!r})" for j, v in enumerate(b)]
        ctes.append(f"w{k}_0 as (select i, j, w::double as w, 0.0::double as m, 0.0::double as v from (values {', '.join(rows)}) t(i, j, w))")
    layers = len(weights)
    for r in range(rounds):
        source = "a0"
        for k in range(layers):
            last = k == layers - 1
            z = f"select id, j as i, sum(a * w) z from {source} join w{k}_{r} using (i) group by id, j"
            name = f"a{k + 1}_{r}"
            if last and output == "softmax":
                ctes.append(f"{name} as (select id, i, exp(z - max(z) over (partition by id)) / sum(exp(z)) over (partition by id) * exp(max(z) over (partition by id)) as a from ({z}))")
            else:
                kind = output if last else hidden
                bias = "" if last else f" union all select distinct id, 0, 1.0 from {x}"
                ctes.append(f"{name} as (select id, i, {acts[kind].format(z='z')} as a from ({z}){bias})")
            source = name
        out = f"a{layers}_{r}"
        if output == "softmax":
            loss, delta = "-y * ln(greatest(a, 1e-12))", "a - y"
        elif output == "sigmoid":
            loss, delta = "-(y * ln(greatest(least(a, 1 - 1e-12), 1e-12)) + (1 - y) * ln(1 - greatest(least(a, 1 - 1e-12), 1e-12)))", "a - y"
        else:
            loss, delta = "(a - y) ** 2", f"2 * (a - y) * {slopes[output].format(a='a')}"
        ctes.append(f"d{layers}_{r} as (select o.id, o.i, {delta} as d, {loss} as loss from {out} o join {y} y on y.id = o.id and y.k = o.i)")
        ctes.append(f"l{r} as (select sum(loss) / any_value(n) as loss from d{layers}_{r}, n)")
        for k in range(layers - 1, 0, -1):
            ctes.append(f"d{k}_{r} as (select a.id, a.i, any_value({slopes[hidden].format(a='a.a')}) * sum(d.d * w.w) as d from a{k}_{r} a join w{k}_{r} w on w.i = a.i join d{k + 1}_{r} d on d.id = a.id and d.i = w.j where a.i > 0 group by a.id, a.i)")
        for k in range(layers):
            a = "a0" if k == 0 else f"a{k}_{r}"
            grad = f"select a.i, d.i as j, sum(a.a * d.d) / any_value(n) as g from {a} a join d{k + 1}_{r} d using (id), n group by a.i, d.i"
            if adam:
                m, v = "(0.9 * m + 0.1 * g)", "(0.999 * v + 0.001 * g * g)"
                ctes.append(f"w{k}_{r + 1} as (select i, j, w - {rate!r} * ({m} / {1 - 0.9 ** (r + 1)!r}) / (sqrt({v} / {1 - 0.999 ** (r + 1)!r}) + 1e-8) as w, {m} as m, {v} as v from w{k}_{r} join ({grad}) using (i, j))")
            else:
                ctes.append(f"w{k}_{r + 1} as (select i, j, w - {rate!r} * g as w, m, v from w{k}_{r} join ({grad}) using (i, j))")
    return ",\n".join(ctes)


def history_sql(rounds: int) -> str:
    return " union all ".join(f'select {r} as "round", round(loss, 6) as loss from l{r}' for r in range(rounds))


def baum_welch(rows: str, pi, a, b, rounds: int) -> str:
    """Log-likelihoods (round, log_likelihood) of Baum-Welch rounds of a model of
    two states over ``rows`` (u, t, o) from t = 1."""
    m = len(b[0])
    ctes = [f"o as materialized ({rows})", "ends as (select u, max(t) n from o group by u)"]
    number = lambda x: f"{float(x)!r}::double"
    ctes.append(f"p0 as (select {', '.join(f'{number(pi[i])} pi{i}' for i in range(2))}, {', '.join(f'{number(a[i][j])} a{i}{j}' for i in range(2) for j in range(2))}, {', '.join('list_value(' + ', '.join(number(x) for x in b[i]) + f') b{i}' for i in range(2))})")
    for r in range(rounds):
        e0, e1 = "p.b0[o.o + 1]", "p.b1[o.o + 1]"
        ctes.append(f"f{r}(u, t, o, x, y, c) as (select u, t, o, x / (x + y), y / (x + y), x + y from (select u, t, o, p.pi0 * {e0} x, p.pi1 * {e1} y from o, p{r} p where t = 1) union all select u, t, o, x / (x + y), y / (x + y), x + y from (select o.u, o.t, o.o, (f.x * p.a00 + f.y * p.a10) * {e0} x, (f.x * p.a01 + f.y * p.a11) * {e1} y from f{r} f join o on o.u = f.u and o.t = f.t + 1, p{r} p))")
        ctes.append(f"z{r}(u, t, x, y) as (select u, n, 1.0::double, 1.0::double from ends union all select o.u, o.t - 1, (p.a00 * {e0} * z.x + p.a01 * {e1} * z.y) / f.c, (p.a10 * {e0} * z.x + p.a11 * {e1} * z.y) / f.c from z{r} z join o on o.u = z.u and o.t = z.t join f{r} f on f.u = o.u and f.t = o.t, p{r} p where z.t > 1)")
        ctes.append(f"s{r} as materialized (select f.u, f.t, f.o, f.c, f.x fx, f.y fy, z.x zx, z.y zy, lead(f.o) over w no, lead(f.c) over w nc, lead(z.x) over w nx, lead(z.y) over w ny from f{r} f join z{r} z using (u, t) window w as (partition by f.u order by f.t))")
        xi = {(i, j): f"sum(f{'xy'[i]} * p.a{i}{j} * p.b{j}[no + 1] * n{'xy'[j]} / nc)" for i in range(2) for j in range(2)}
        emit = {(i, k): f"coalesce(sum(f{'xy'[i]} * z{'xy'[i]}) filter (o = {k}), 0)" for i in range(2) for k in range(m)}
        first = {i: f"sum(f{'xy'[i]} * z{'xy'[i]}) filter (t = 1)" for i in range(2)}
        cols = [f"{first[i]} / ({first[0]} + {first[1]}) pi{i}" for i in range(2)]
        cols += [f"{xi[i, j]} / ({xi[i, 0]} + {xi[i, 1]}) a{i}{j}" for i in range(2) for j in range(2)]
        cols += [f"list_value({', '.join(f'{emit[i, k]} / sum(f{chr(120 + i)} * z{chr(120 + i)})' for k in range(m))}) b{i}" for i in range(2)]
        ctes.append(f"p{r + 1} as materialized (select {', '.join(cols)} from s{r}, p{r} p)")
    out = " union all ".join(f'select {r} as "round", round(sum(ln(c)), 4) as log_likelihood from s{r}' for r in range(rounds))
    return f"with recursive {', '.join(ctes)} {out}"
