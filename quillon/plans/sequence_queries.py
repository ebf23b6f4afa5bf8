"""Queries of recurrences over each user's events, of windows, and of decisions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.expressions import uniform_sql
from ..operators import reinforcement as rl
from ..operators import metrics, sequence
from ..streaming import online
from .registry import query, table
from .sql import baum_welch as baum_welch_sql

TYPES = ["click", "error", "purchase", "signup", "view"]
_CODE = "case event_type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(TYPES)) + " end"
_ROWS = f"r as (select user_id u, row_number() over (partition by user_id order by ts, event_id) t, value z, {_CODE} o, event_type from events)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _steps(spark, sf_dir, *more):
    return sequence.ordered(events(spark, sf_dir).withColumn("obs", F.expr(_CODE)), "user_id", "ts", "event_id", "value", "obs", *more)


@query("kalman_1d", f"""with recursive {_ROWS}, k(u, t, x, p, ll) as (select u, 0::bigint, 0.0::double, 1e6::double, 0.0::double from r where t = 1 union all
  select k.u, k.t + 1, k.x + (k.p + 0.01) / (k.p + 0.01 + 2) * (r.z - k.x), (1 - (k.p + 0.01) / (k.p + 0.01 + 2)) * (k.p + 0.01),
    k.ll - 0.5 * (ln(2 * pi()) + ln(k.p + 0.01 + 2) + (r.z - k.x) ** 2 / (k.p + 0.01 + 2)) from k join r on r.u = k.u and r.t = k.t + 1)
select u as user_id, max(t) as n, round(arg_max(x, t), 6) as x, round(arg_max(p, t), 8) as p, round(arg_max(ll, t), 4) as log_likelihood from k group by u""")  # fmt: skip
def kalman_1d(spark, sf_dir):
    s = _steps(spark, sf_dir).withColumn("k", sequence.kalman_1d(F.col("steps"), "value", q=0.01, r=2.0))
    return s.select("user_id", F.size("steps").cast("long").alias("n"), F.round("k.x", 6).alias("x"), F.round("k.p", 8).alias("p"), F.round("k.ll", 4).alias("log_likelihood"))


_VELOCITY = """k(u, t, x, v, a, b, c) as (select u, 0::bigint, 0.0::double, 1.0::double, 1.0::double, 0.0::double, 1.0::double from r where t = 1 union all
  select u, t, xp + pa / s * e, vp + pb / s * e, (1 - pa / s) * pa, (1 - pa / s) * pb, pc - pb / s * pb from (select *, z - xp e, pa + 0.5 s from
    (select r.u, r.t, r.z, k.x + k.v xp, k.v vp, k.a + 2 * k.b + k.c + 0.01 pa, k.b + k.c pb, k.c + 0.01 pc from k join r on r.u = k.u and r.t = k.t + 1)))"""


@query("kalman_velocity_filter", f"with recursive {_ROWS}, {_VELOCITY} select u as key, t, round(x, 5) as level, round(v, 5) as speed, round(x, 5) as expected from k where t > 0")
def kalman_velocity(spark, sf_dir):
    model = sequence.Kalman(np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]]), 0.01 * np.eye(2), np.array([[0.5]]), np.array([0.0, 1.0]), np.eye(2))
    rows = _steps(spark, sf_dir).select("user_id", F.posexplode("steps").alias("t", "s")).select("user_id", (F.col("t") + 1).cast("long").alias("t"), F.array("s.value").alias("z"))
    out = model.predict_obs(model.apply(rows, "user_id", "t"))
    return out.select("key", "t", F.round(F.col("x")[0], 5).alias("level"), F.round(F.col("x")[1], 5).alias("speed"), F.round(F.col("z")[0], 5).alias("expected"))


@query("rts_smoother", f"""with recursive {_ROWS}, k(u, t, xp, pp, x, p) as (select u, 0::bigint, 0.0::double, 0.0::double, 0.0::double, 100.0::double from r where t = 1 union all
  select k.u, k.t + 1, k.x, k.p + 0.1, k.x + (k.p + 0.1) / (k.p + 0.1 + 2) * (r.z - k.x), (1 - (k.p + 0.1) / (k.p + 0.1 + 2)) * (k.p + 0.1) from k join r on r.u = k.u and r.t = k.t + 1),
n as (select u, max(t) n from k group by u), s(u, t, x, p) as (select k.u, k.t, k.x, k.p from k join n on n.u = k.u and n.n = k.t union all
  select s.u, s.t - 1, a.x + a.p / b.pp * (s.x - b.xp), a.p + (a.p / b.pp) ** 2 * (s.p - b.pp) from s join k a on a.u = s.u and a.t = s.t - 1 join k b on b.u = s.u and b.t = s.t where s.t > 1)
select u as user_id, t, round(x, 5) as x, round(p, 6) as p from s""")  # fmt: skip
def rts(spark, sf_dir):
    model = sequence.Kalman(np.eye(1), np.eye(1), np.array([[0.1]]), np.array([[2.0]]), np.zeros(1), np.array([[100.0]]))
    rows = _steps(spark, sf_dir).select("user_id", F.posexplode("steps").alias("t", "s")).select("user_id", (F.col("t") + 1).cast("long").alias("t"), F.array("s.value").alias("z"))
    return model.apply(rows, "user_id", "t", smooth=True).select(F.col("key").alias("user_id"), "t", F.round(F.col("x")[0], 5).alias("x"), F.round(F.col("p")[0][0], 6).alias("p"))


_HMM = sequence.HMM(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.3, 0.1, 0.2, 0.1, 0.3], [0.1, 0.3, 0.1, 0.4, 0.1]]))
_B0 = "list_value(0.3, 0.1, 0.2, 0.1, 0.3)[r.o + 1]::double"
_B1 = "list_value(0.1, 0.3, 0.1, 0.4, 0.1)[r.o + 1]::double"


@query("hmm_forward", f"""with recursive {_ROWS}, k(u, t, a, b, ll) as (
  select u, t, 0.6 * {_B0} / (0.6 * {_B0} + 0.4 * {_B1}), 0.4 * {_B1} / (0.6 * {_B0} + 0.4 * {_B1}), ln(0.6 * {_B0} + 0.4 * {_B1}) from r where t = 1 union all
  select u, t, x / (x + y), y / (x + y), ll + ln(x + y) from (select r.u, r.t, k.ll, (k.a * 0.7 + k.b * 0.2) * {_B0} x, (k.a * 0.3 + k.b * 0.8) * {_B1} y from k join r on r.u = k.u and r.t = k.t + 1))
select u as user_id, round(arg_max(ll, t), 5) as log_likelihood, round(arg_max(b, t), 6) as p1 from k group by u""")  # fmt: skip
def hmm_forward(spark, sf_dir):
    s = _steps(spark, sf_dir).withColumn("k", sequence.hmm_forward(F.col("steps"), "obs", _HMM))
    return s.select("user_id", F.round("k.ll", 5).alias("log_likelihood"), F.round(F.col("k.alpha")[1], 6).alias("p1"))


def _seqs(spark, sf_dir):
    return _steps(spark, sf_dir).select(F.col("user_id").alias("seq_id"), F.posexplode("steps").alias("t", "s")).select("seq_id", "t", "s.obs")


@query("hmm_viterbi", f"""with recursive {_ROWS}, k(u, t, a, b, pa, pb) as (
  select u, t, ln(0.6) + ln({_B0}), ln(0.4) + ln({_B1}), '0', '1' from r where t = 1 union all
  select u, t, case when a0 >= a1 then a0 else a1 end + l0, case when b0 >= b1 then b0 else b1 end + l1, case when a0 >= a1 then pa else pb end || '0', case when b0 >= b1 then pa else pb end || '1'
  from (select r.u, r.t, k.pa, k.pb, k.a + ln(0.7) a0, k.b + ln(0.2) a1, k.a + ln(0.3) b0, k.b + ln(0.8) b1, ln({_B0}) l0, ln({_B1}) l1 from k join r on r.u = k.u and r.t = k.t + 1))
select u as seq_id, arg_max(case when a >= b then pa else pb end, t) as path from k group by u""")  # fmt: skip
def hmm_viterbi(spark, sf_dir):
    d = _HMM.decode(_seqs(spark, sf_dir))
    return d.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "state"))), lambda s: s["state"].cast("string")), "").alias("path"))


_START = sequence.HMM.random(2, 5, 1)


@query("hmm_baum_welch", baum_welch_sql(f"select user_id u, row_number() over (partition by user_id order by ts, event_id) t, {_CODE} o from events", _START.pi, _START.a, _START.b, 3))
def baum_welch(spark, sf_dir):
    model, history = _START.fit(_seqs(spark, sf_dir), 3)
    return spark.createDataFrame([(i, round(float(x), 4)) for i, x in enumerate(history)], "round int, log_likelihood double")


@query("hmm_samples")
def hmm_samples(spark, sf_dir):
    drawn = _HMM.sample(spark, 200, 50, 3)
    return drawn.groupBy("state", "obs").agg(F.count("*").alias("n"))


@query("markov_transitions", f"""with {_ROWS}, x as (select o as state, lead(o) over (partition by u order by t) as next from r)
select state, next, count(*) as n, round(count(*) / sum(count(*)) over (partition by state)::double, 8) as p from x where next is not null group by state, next""")  # fmt: skip
def markov(spark, sf_dir):
    out = sequence.transitions(events(spark, sf_dir).withColumn("o", F.expr(_CODE)), "user_id", F.struct("ts", "event_id"), "o")
    return out.select("state", "next", "n", F.round("p", 8).alias("p"))


@query("gae", f"""with recursive {_ROWS}, q as (select *, row_number() over (partition by u order by t desc) b from r),
k(u, b, v, a) as (select u, 1::bigint, z / 2, z - z / 2 from q where b = 1 union all
  select q.u, q.b, q.z / 2, q.z + case when q.o = 1 then 0 else 0.9 * k.v end - q.z / 2 + case when q.o = 1 then 0 else 0.9 * 0.95 * k.a end from k join q on q.u = k.u and q.b = k.b + 1)
select u as user_id, count(*) as n, round(sum(a), 4) as total, round(arg_max(a, b), 6) as first from k group by u""")  # fmt: skip
def gae(spark, sf_dir):
    s = _steps(spark, sf_dir).withColumn("a", sequence.discounted(F.transform("steps", lambda e: F.struct(e["value"].alias("r"), (e["value"] / 2).alias("v"), (e["obs"] == 1).alias("done"))), 0.9, 0.95))
    return s.select("user_id", F.size("a").cast("long").alias("n"), F.round(F.aggregate("a", F.lit(0.0), lambda t, x: t + x), 4).alias("total"), F.round(F.col("a")[0], 6).alias("first"))


@query("recurrent_network", f"""with recursive {_ROWS}, k(u, t, h) as (select u, 0::bigint, 0.0::double from r where t = 1 union all
  select k.u, k.t + 1, tanh(0.02 * r.z + 0.5 * k.h - 0.3) from k join r on r.u = k.u and r.t = k.t + 1)
select u as user_id, round(sum(h), 6) as total, round(arg_max(h, t), 8) as last from k group by u""")  # fmt: skip
def rnn(spark, sf_dir):
    s = _steps(spark, sf_dir).withColumn("h", sequence.recurrent(F.col("steps"), "value", 0.02, 0.5, -0.3))
    return s.select("user_id", F.round(F.aggregate("h", F.lit(0.0), lambda t, x: t + x), 6).alias("total"), F.round(F.element_at("h", -1), 8).alias("last"))


@query("tumbling_windows", "select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling(spark, sf_dir):
    return online.windowed(events(spark, sf_dir), "1 day").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("sliding_windows", "select time_bucket(interval '1 day', ts) - k * interval '1 day' as start, event_type, count(*) as n, round(sum(value), 4) as total from events, (values (0), (1)) t(k) group by all")
def sliding(spark, sf_dir):
    return online.windowed(events(spark, sf_dir), "2 days", "1 day").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_windows", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from g)
select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*) as n from s group by user_id, k""")  # fmt: skip
def session(spark, sf_dir):
    return online.sessions(events(spark, sf_dir), "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


_GRID = """g as (select s::int s, a::int a, case a when 0 then greatest(s // 4 - 1, 0) * 4 + s % 4 when 1 then least(s // 4 + 1, 3) * 4 + s % 4 when 2 then s // 4 * 4 + greatest(s % 4 - 1, 0) else s // 4 * 4 + least(s % 4 + 1, 3) end::int s2 from range(16) x(s), range(4) y(a)),
m as (select s, a, s2, case when s2 = 15 then 10.0 when s2 = 5 then -10.0 else -0.1 end::double r, s2 in (15, 5) as done from g)"""


@query("grid_world", f"with {_GRID} select s, a, s2, r, done from m")
def grid(spark, sf_dir):
    return rl.grid_world(spark)


def _sweep(k: int, model: str = "m", gamma: float = 0.9) -> str:
    before = f"(select s as s2, max(q) v from q{k} group by s)"
    return f"q{k + 1} as (select s, a, avg(r + case when done then 0 else {gamma} * coalesce(v, 0) end) q from {model} left join {before} using (s2) group by s, a)"


@query("q_iteration", f"with {_GRID}, q0 as (select s, a, 0.0::double q from m), {', '.join(map(_sweep, range(6)))} select s, a, round(q, 8) as q from q6")
def q_iteration(spark, sf_dir):
    return rl.q_sweeps(rl.grid_world(spark), 6, 0.9).select("s", "a", F.round("q", 8).alias("q"))


_EV = f"{_ROWS}, p as (select lag(o) over (partition by u order by t) s, o a, o s2, z r, event_type = 'error' as done from r), m as (select * from p where s is not null)"


@query("offline_q_events", f"with {_EV}, q0 as (select distinct s, a, 0.0::double q from m), {', '.join(map(_sweep, range(3)))} select s, a, round(q, 5) as q from q3")
def offline_q(spark, sf_dir):
    return rl.q_sweeps(_transitions(spark, sf_dir), 3, 0.9).select("s", "a", F.round("q", 5).alias("q"))


def _transitions(spark, sf_dir):
    s = _steps(spark, sf_dir, "event_type")
    p = s.select(F.posexplode("steps").alias("i", "e"), "steps").where("i > 0").select(F.expr("steps[i - 1].obs").alias("s"), F.col("e.obs").alias("a"), F.col("e.obs").alias("s2"), F.col("e.value").alias("r"), (F.col("e.event_type") == "error").alias("done"))
    return p


@query("greedy_policy", f"with {_EV}, q0 as (select distinct s, a, 0.0::double q from m), {', '.join(map(_sweep, range(3)))} select s, first(a order by q desc, a) as a, round(max(q), 5) as v from q3 group by s")
def greedy(spark, sf_dir):
    return rl.policy(rl.q_sweeps(_transitions(spark, sf_dir), 3, 0.9)).select("s", "a", F.round("v", 5).alias("v"))


@query("point_mass_rollout", f"""with recursive {_ROWS}, a as (select u, t, list_value(-1.0, -0.5, 0.0, 0.5, 1.0)[o + 1]::double f from r),
k(u, t, x, v, r) as (select u, 0::bigint, 0.5::double, 0.0::double, 0.0::double from a where t = 1 union all
  select u, t, x, v, -(x * x + 0.1 * v * v + 0.001 * f * f) from (select u, t, greatest(-2, least(2, x0 + 0.05 * v)) x, v, f from
    (select k.u, a.t, k.x x0, greatest(-2, least(2, k.v + 0.05 * (a.f - 0.1 * k.v))) v, a.f from k join a on a.u = k.u and a.t = k.t + 1)))
select u as user_id, round(arg_max(x, t), 6) as x, round(arg_max(v, t), 6) as v, round(sum(r), 6) as total from k group by u""")  # fmt: skip
def point_mass(spark, sf_dir):
    s = _steps(spark, sf_dir).withColumn("p", rl.rollout(F.transform("steps", lambda e: rl.discrete_force(e["obs"])), F.lit(0.5), F.lit(0.0)))
    return s.select("user_id", F.round(F.element_at("p", -1)["x"], 6).alias("x"), F.round(F.element_at("p", -1)["v"], 6).alias("v"), F.round(F.aggregate("p", F.lit(0.0), lambda t, e: t + e["r"]), 6).alias("total"))


@query("replay_ring", "select event_id from events order by event_id desc limit 100")
def replay_ring(spark, sf_dir):
    return rl.ring(events(spark, sf_dir).select("event_id"), "event_id", 100)


@query("replay_sample", f"select event_id from events order by {uniform_sql(1, 'event_id')}, event_id limit 64")
def replay(spark, sf_dir):
    return rl.replay_sample(events(spark, sf_dir), "event_id", 64, 1).select("event_id")


_DRAWS = [0.13, 0.37, 0.5, 0.61, 0.08, 0.92, 0.44, 0.71]


@query("prioritised_replay", f"""with p as (select event_id, (abs(value - 25) + 1e-5) ** 0.6 p from events), c as (select *, sum(p) over (order by event_id rows unbounded preceding) hi from p),
d as (select i - 1 as draw, (i - 1 + list_value({', '.join(map(str, _DRAWS))})[i]) * (select sum(p) from p) / 8 x from range(1, 9) t(i)),
h as (select draw, event_id, (c.p * (select count(*) from p) / (select sum(p) from p)) ** -0.4 w from d join c on hi - c.p <= x and x < hi)
select draw::int as draw, event_id, round(w / max(w) over (), 6) as weight from h""")  # fmt: skip
def per(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("delta", F.col("value") - 25)
    return rl.prioritised_sample(df, "event_id", "delta", _DRAWS).select("draw", "event_id", F.round("weight", 6).alias("weight"))


@query("ou_noise", f"with u as (select distinct user_id from events) select user_id, round(sum((1 - 0.15 * 0.01) ** (50 - i) * 0.2 * sqrt(0.01) * sqrt(-2 * ln(1 - {uniform_sql(5, 'user_id', 'i')})) * cos(2 * pi() * {uniform_sql(7924, 'user_id', 'i')})), 8) as x from u, range(1, 51) t(i) group by user_id")
def ou(spark, sf_dir):
    return events(spark, sf_dir).select("user_id").distinct().select("user_id", F.round(F.element_at(rl.ou_noise(F.lit(50), F.col("user_id"), 5), -1), 8).alias("x"))


_V = "value / 50"


@query("learning_targets", """select event_id, round(value + case when event_type = 'error' then 0 else 1 end * 0.99 * least(value / 2, value / 3 + 1), 6) as twin,
round(value + case when event_type = 'error' then 0 else 1 end * 0.99 * (least(value / 2, value / 3 + 1) - 0.2 * ln(1 + value)), 6) as soft,
round(value + case when event_type = 'error' then 0 else 1 end * 0.99 * case when value > 20 then 3.0 else value end, 6) as double_q,
round(least(exp(value / 50 - 0.5) * (value - 25), greatest(0.8, least(1.2, exp(value / 50 - 0.5))) * (value - 25)), 6) as surrogate,
round(-0.5 * ((value / 50 - 0.1) / exp(-0.5)) ** 2 + 0.5 - 0.5 * ln(2 * pi()) - ln(1 - tanh(value / 50) ** 2 + 1e-6), 6) as log_prob, round(value + 1 - (1 + 2 + 6) / 3.0, 6) as dueling_first from events""")  # fmt: skip
def targets(spark, sf_dir):
    v, done = F.col("value"), F.col("event_type") == "error"
    # equal values take the first action, which in the SQL is the one worth 20
    online_q, target_q = F.array(F.lit(20.0), v), F.array(F.when(v > 20, 5.0).otherwise(v), F.when(v > 20, 3.0).otherwise(-1.0))
    ratio = F.exp(v / 50 - 0.5)
    cols = {
        "twin": rl.twin_target(v, done, v / 2, v / 3 + 1),
        "soft": rl.soft_target(v, done, v / 2, v / 3 + 1, F.log(1 + v)),
        "double_q": rl.double_q_target(v, done, online_q, target_q),
        "surrogate": rl.ppo_surrogate(ratio, v - 25),
        "log_prob": rl.squashed_log_prob(v / 50, F.lit(0.1), F.lit(-0.5)),
        "dueling_first": rl.dueling(v, F.array(F.lit(1.0), F.lit(2.0), F.lit(6.0)))[0],
    }
    return events(spark, sf_dir).select("event_id", *(F.round(c, 6).alias(k) for k, c in cols.items()))


@query("lstd_q", f"""with {_ROWS}, p as (select 1.0 x0, z / 50 x1, 1.0 y0, lead(z) over (partition by u order by t) / 50 y1, z rw from r), m as (select * from p where y1 is not null),
s as (select sum(x0 * (x0 - 0.9 * y0)) + 1e-6 a, sum(x0 * (x1 - 0.9 * y1)) b, sum(x1 * (x0 - 0.9 * y0)) c, sum(x1 * (x1 - 0.9 * y1)) + 1e-6 d, sum(x0 * rw) e, sum(x1 * rw) f from m)
select 'w0' as term, round((e * d - b * f) / (a * d - b * c), 4) as value from s union all select 'w1', round((a * f - c * e) / (a * d - b * c), 4) from s""")  # fmt: skip
def lstd(spark, sf_dir):
    s = _steps(spark, sf_dir).select(F.posexplode("steps").alias("i", "e"), "steps").where("i + 1 < size(steps)")
    s = s.select(F.lit(1.0).alias("x0"), (F.col("e.value") / 50).alias("x1"), F.lit(1.0).alias("y0"), F.expr("steps[i + 1].value / 50").alias("y1"), F.col("e.value").alias("r"))
    w = rl.lstd_q(s, ["x0", "x1"], ["y0", "y1"], "r", 0.9)
    return spark.createDataFrame([("w0", round(float(w[0]), 4)), ("w1", round(float(w[1]), 4))], "term string, value double")


@query("tabular_q_learning")
def q_learning(spark, sf_dir):
    return rl.policy(rl.q_learning(spark, 4, 200, 1).select("s", "a", "q"))


@query("double_q_learning")
def double_q(spark, sf_dir):
    return rl.policy(rl.q_learning(spark, 4, 200, 1, double=True).select("s", "a", "q"))


def _losses(spark, losses):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "step int, loss double")


def _experience(spark):
    return rl.collect_rollouts(spark, lambda s, rng: rng.uniform(-1, 1), 32, 50, 1)


@query("dqn_losses")
def dqn(spark, sf_dir):
    return _losses(spark, rl.DQN.create().learn(_experience(spark), 60))


@query("dueling_dqn_losses")
def dueling_dqn(spark, sf_dir):
    return _losses(spark, rl.DQN.create(dueling=True).learn(_experience(spark), 60, tau=None, every=10, prioritised=True))


@query("ddpg_losses")
def ddpg(spark, sf_dir):
    return _losses(spark, rl.ActorCritic.create("ddpg").learn(_experience(spark), 60))


@query("ddpg_returns")
def ddpg_returns(spark, sf_dir):
    return _losses(spark, rl.ActorCritic.create("ddpg").train(spark, 2))


@query("td3_losses")
def td3(spark, sf_dir):
    return _losses(spark, rl.ActorCritic.create("td3").learn(_experience(spark), 60))


@query("sac_losses")
def sac(spark, sf_dir):
    return _losses(spark, rl.ActorCritic.create("sac").learn(_experience(spark), 60, alpha=None))


@query("ppo_returns")
def ppo(spark, sf_dir):
    return _losses(spark, rl.ppo(spark, 3)[1])


@query("ppo_discrete_returns")
def ppo_discrete(spark, sf_dir):
    return _losses(spark, rl.ppo(spark, 2, discrete=True, entropy=0.01)[1])


@query("ppo_penalised_returns")
def ppo_penalised(spark, sf_dir):
    return _losses(spark, rl.ppo(spark, 2, kl=1.0)[1])


@query("perplexity", "with p as (select user_id, event_type, count(*) / sum(count(*)) over (partition by user_id)::double p from events group by user_id, event_type) select user_id, round(-sum(p * log2(p)), 8) as entropy, round(2 ** -sum(p * log2(p)), 8) as perplexity from p group by user_id")
def perplexity(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.collect_list("n").alias("n"))
    p = F.transform("n", lambda x: x / F.aggregate("n", F.lit(0).cast("long"), lambda t, y: t + y))
    return n.select("user_id", p.alias("p")).select("user_id", F.round(metrics.entropy_bits(F.col("p")), 8).alias("entropy"), F.round(metrics.perplexity(F.col("p")), 8).alias("perplexity"))
