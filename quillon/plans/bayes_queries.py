"""Queries of naive Bayes and of column preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import uniform_sql
from ..operators import bayes, preparation
from ..operators._cut import cut
from .registry import query, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
_STATS = ", ".join(f"avg({f}) m_{f}, var_pop({f}) + 1e-9 v_{f}" for f in FEATURES)
_JLL = "ln(n / total) - " + " - ".join(f"0.5 * (ln(2 * pi() * v_{f}) + ({f} - m_{f}) * ({f} - m_{f}) / v_{f})" for f in FEATURES)
_FIT = f"g as (select l_returnflag as label, count(*)::double n, {_STATS} from lineitem group by l_returnflag), m as (select *, sum(n) over () total from g)"


@query("gaussian_nb_params", f"with {_FIT} select label, n::bigint as n, round(n / total, 6) as prior, " + ", ".join(f"round(m_{f}, 4) as mean_{f}, round(v_{f}, 4) as var_{f}" for f in FEATURES) + " from m")
def gaussian_nb_params(spark, sf_dir):
    m = bayes.gaussian_fit(table(spark, sf_dir, "lineitem"), FEATURES, "l_returnflag")
    return m.select("label", "n", F.round("prior", 6).alias("prior"), *(F.round(f"{k}_{f}", 4).alias(f"{k}_{f}") for f in FEATURES for k in ("mean", "var")))


@query("gaussian_nb_predict", f"""with {_FIT}, r as (select row_number() over () as id, * from lineitem),
s as (select id, l_returnflag as actual, label, {_JLL} as jll from r, m),
b as (select id, any_value(actual) actual, arg_max(label, jll) as predicted from s group by id)
select actual, predicted, count(*) as n from b group by actual, predicted""")  # fmt: skip
def gaussian_nb_predict(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *FEATURES)
    out = bayes.gaussian_predict(df, bayes.gaussian_fit(df, FEATURES, "l_returnflag"), FEATURES)
    return out.groupBy(F.col("l_returnflag").alias("actual"), F.col("prediction").alias("predicted")).agg(F.count("*").alias("n"))


@query("gaussian_nb_probability", f"""with {_FIT}, r as (select row_number() over () as id, * from lineitem),
s as (select id, {_JLL} as jll from r, m), p as (select id, 1 / sum(exp(jll - mx)) p from (select *, max(jll) over (partition by id) mx from s) group by id)
select round(avg(p), 6) as mean_probability, round(min(p), 6) as least, round(max(p), 6) as greatest from p""")  # fmt: skip
def gaussian_nb_probability(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *FEATURES)
    out = bayes.gaussian_predict(df, bayes.gaussian_fit(df, FEATURES, "l_returnflag"), FEATURES)
    return out.agg(F.round(F.avg("probability"), 6).alias("mean_probability"), F.round(F.min("probability"), 6).alias("least"), F.round(F.max("probability"), 6).alias("greatest"))


_TOKENS = """t as (select doc_id as id, lang as label, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as token from documents),
c as (select id, label, token, count(*) n from t group by all),
per as (select label, token, sum(n) n from c group by all),
cl as (select label, sum(n) total, (select count(distinct token) from per) v, (select count(distinct id) from c where c.label = per.label) docs, (select count(distinct id) from c) al from per group by label)"""


@query("multinomial_nb_logprob", f"with {_TOKENS} select label, token, round(ln(n + 1) - ln(total + v), 6) as log_p from per join cl using (label)")
def multinomial_nb_logprob(spark, sf_dir):
    counts = bayes.tokens(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return bayes.multinomial_fit(counts)[1].select("label", "token", F.round("log_p", 6).alias("log_p"))


@query("multinomial_nb_predict", f"""with {_TOKENS}, w as (select id, token, n from c),
sc as (select w.id, cl.label, any_value(ln(docs / al)) + sum(w.n * (ln(coalesce(per.n, 0) + 1) - ln(total + v))) s from w cross join cl left join per on per.label = cl.label and per.token = w.token group by w.id, cl.label)
select id, arg_max(label, s) as prediction from sc group by id""")  # fmt: skip
def multinomial_nb_predict(spark, sf_dir):
    counts = cut(bayes.tokens(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"))
    classes, tokens = bayes.multinomial_fit(counts)
    return bayes.multinomial_predict(counts.select("id", "token", "n"), classes, tokens)


_B = ["big", "cheap", "taxed"]
_BX = "select l_returnflag as label, l_quantity - 25 as big, 20000 - l_extendedprice as cheap, l_tax - 0.04 as taxed from lineitem"


@query("bernoulli_nb_predict", f"""with x as ({_BX}), g as (select label, count(*)::double n, {', '.join(f'(sum(case when {b} > 0 then 1 else 0 end) + 1) / (count(*) + 2.0) p_{b}' for b in _B)} from x group by label),
m as (select *, n / sum(n) over () prior from g), r as (select row_number() over () id, * from x),
s as (select id, m.label, ln(prior) + {' + '.join(f'case when {b} > 0 then ln(p_{b}) else ln(1 - p_{b}) end' for b in _B)} j, big > 0 a, cheap > 0 b, taxed > 0 c from r, m),
p as (select id, arg_max(label, j) prediction, any_value(a) a, any_value(b) b, any_value(c) c from s group by id)
select a as big, b as cheap, c as taxed, prediction, count(*) as n from p group by all""")  # fmt: skip
def bernoulli_nb_predict(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as label", "l_quantity - 25 as big", "20000 - l_extendedprice as cheap", "l_tax - 0.04 as taxed")
    out = bayes.bernoulli_predict(df, bayes.bernoulli_fit(df, _B, "label"), _B)
    return out.groupBy(*((F.col(b) > 0).alias(b) for b in _B), "prediction").agg(F.count("*").alias("n"))


@query("zscore", """with s as (select avg(o_totalprice) m, stddev_pop(o_totalprice) s from orders) select o_orderkey, round((o_totalprice - m) / s, 5) + 0.0 as z from orders, s""")
def zscore(spark, sf_dir):
    return preparation.zscore(table(spark, sf_dir, "orders"), ["o_totalprice"]).select("o_orderkey", (F.round("o_totalprice_z", 5) + 0.0).alias("z"))


@query("minmax", """with s as (select min(o_totalprice) a, max(o_totalprice) b from orders) select o_orderkey, round((o_totalprice - a) / (b - a), 6) as x from orders, s""")
def minmax(spark, sf_dir):
    return preparation.minmax(table(spark, sf_dir, "orders"), ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice_01", 6).alias("x"))


@query("one_hot", "select o_orderkey, (o_orderstatus = 'F')::int as s_f, (o_orderstatus = 'O')::int as s_o, (o_orderstatus = 'P')::int as s_p from orders")
def one_hot(spark, sf_dir):
    out = preparation.one_hot(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"])
    return out.select("o_orderkey", *(F.col(f"o_orderstatus_{v}").alias(f"s_{v.lower()}") for v in "FOP"))


@query("encode_categories", "select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 end as code from orders")
def encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", preparation.encode(F.col("o_orderstatus"), {"F": 0, "O": 1}).alias("code"))


@query("impute_mean", "with x as (select p_partkey, case when p_size % 7 = 0 then null else p_retailprice end v from part) select p_partkey, round(coalesce(v, (select avg(v) from x)), 4) as v from x")
def impute(spark, sf_dir):
    df = table(spark, sf_dir, "part").selectExpr("p_partkey", "case when p_size % 7 = 0 then null else p_retailprice end as v")
    return preparation.impute_mean(df, ["v"]).select("p_partkey", F.round("v", 4).alias("v"))


@query("describe", " union all ".join(f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c})::double as least, max({c})::double as greatest from lineitem" for c in FEATURES))
def describe(spark, sf_dir):
    return preparation.describe(table(spark, sf_dir, "lineitem"), FEATURES).select("column", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "least", "greatest")


@query("value_counts", "select p_brand, count(*) as n from part group by p_brand")
def value_counts(spark, sf_dir):
    return preparation.value_counts(table(spark, sf_dir, "part"), "p_brand")


@query("stable_split", f"select o_orderkey, case when {uniform_sql(42, 'o_orderkey')} < 0.8 then 'train' else 'test' end as part from orders")
def stable_split(spark, sf_dir):
    train, test = preparation.split(table(spark, sf_dir, "orders"), 0.8, 42, "o_orderkey")
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(test.select("o_orderkey", F.lit("test").alias("part")))
