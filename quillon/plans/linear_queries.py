"""Queries of the linear family over lineitem and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import sigmoid
from ..operators import linear, metrics
from .registry import query, table


def terms(spark, values: dict[str, float], digits: int = 6):
    rows = [(k, round(float(v), digits) + 0.0) for k, v in values.items()]
    return spark.createDataFrame(rows, "term string, value double")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


_SUMS = """s as (select count(*)::double n, sum(l_quantity) sx, sum(l_extendedprice) sy, sum(l_quantity * l_quantity) sxx,
  sum(l_quantity * l_extendedprice) sxy, sum(l_extendedprice * l_extendedprice) syy from lineitem)"""


@query("ols_simple", """select 'intercept' as term, round(regr_intercept(l_extendedprice, l_quantity), 4) as value from lineitem
union all select 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) from lineitem
union all select 'r2', round(regr_r2(l_extendedprice, l_quantity), 4) from lineitem""")  # fmt: skip
def ols_simple(spark, sf_dir):
    df = _lines(spark, sf_dir)
    m = linear.ols(df, ["l_quantity"], "l_extendedprice")
    return terms(spark, {"intercept": m.intercept, "l_quantity": m.coef[0], "r2": m.score(df, "l_extendedprice")}, 4)


_TWO = """c as (select avg(l_quantity) m1, avg(l_discount) m2, avg(l_extendedprice) my, var_pop(l_quantity) a, covar_pop(l_quantity, l_discount) b,
  var_pop(l_discount) d, covar_pop(l_quantity, l_extendedprice) p, covar_pop(l_discount, l_extendedprice) q from lineitem)"""


@query("ols_two_features", f"""with {_TWO}, w as (select *, (p * d - q * b) / (a * d - b * b) w1, (a * q - b * p) / (a * d - b * b) w2 from c)
select 'intercept' as term, round(my - w1 * m1 - w2 * m2, 3) as value from w union all select 'l_quantity', round(w1, 3) from w union all select 'l_discount', round(w2, 3) from w""")  # fmt: skip
def ols_two(spark, sf_dir):
    m = linear.ols(_lines(spark, sf_dir), ["l_quantity", "l_discount"], "l_extendedprice")
    return terms(spark, {"intercept": m.intercept, "l_quantity": m.coef[0], "l_discount": m.coef[1]}, 3)


@query("gram_matrix", """select 0 as i, 0 as j, round(count(*)::double, 2) as s from lineitem union all select 0, 1, round(sum(l_quantity), 2) from lineitem
union all select 0, 2, round(sum(l_discount), 2) from lineitem union all select 1, 1, round(sum(l_quantity * l_quantity), 2) from lineitem
union all select 1, 2, round(sum(l_quantity * l_discount), 2) from lineitem union all select 2, 2, round(sum(l_discount * l_discount), 2) from lineitem""")  # fmt: skip
def gram_matrix(spark, sf_dir):
    g = linear.gram(_lines(spark, sf_dir), ["l_quantity", "l_discount"], "l_tax", wide=0)
    return spark.createDataFrame([(i, j, round(float(g.xx[i, j]), 2)) for i in range(3) for j in range(i, 3)], "i int, j int, s double")


@query("ridge_simple", f"""with {_SUMS}, w as (select *, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1000) w1 from s)
select 'intercept' as term, round(sy / n - w1 * sx / n, 4) as value from w union all select 'l_quantity', round(w1, 4) from w""")  # fmt: skip
def ridge_simple(spark, sf_dir):
    m = linear.ridge(_lines(spark, sf_dir), ["l_quantity"], "l_extendedprice", 1000.0)
    return terms(spark, {"intercept": m.intercept, "l_quantity": m.coef[0]}, 4)


@query("ridge_penalised_intercept", f"""with {_SUMS}, w as (select *, (n + 1000) * (sxx + 1000) - sx * sx det from s)
select 'intercept' as term, round((sy * (sxx + 1000) - sx * sxy) / det, 4) as value from w union all select 'l_quantity', round(((n + 1000) * sxy - sx * sy) / det, 4) from w""")  # fmt: skip
def ridge_penalised(spark, sf_dir):
    m = linear.ridge(_lines(spark, sf_dir), ["l_quantity"], "l_extendedprice", 1000.0, True)
    return terms(spark, {"intercept": m.intercept, "l_quantity": m.coef[0]}, 4)


@query("lasso_two_features", f"""with recursive {_TWO}, w(k, w1, w2) as (select 0, 0.0::double, 0.0::double union all
  select k + 1, x1, sign(q - b * x1) * greatest(abs(q - b * x1) - 5, 0) / d from
  (select k, q, b, d, sign(p - b * w2) * greatest(abs(p - b * w2) - 5, 0) / a as x1 from w, c where k < 40) t)
select 'intercept' as term, round(my - w1 * m1 - w2 * m2, 3) as value from w, c where k = 40 union all select 'l_quantity', round(w1, 3) from w where k = 40
union all select 'l_discount', round(w2, 3) + 0.0 from w where k = 40""")  # fmt: skip
def lasso_two(spark, sf_dir):
    m = linear.lasso(_lines(spark, sf_dir), ["l_quantity", "l_discount"], "l_extendedprice", 5.0, 40, 0.0)
    return terms(spark, {"intercept": m.intercept, "l_quantity": m.coef[0], "l_discount": m.coef[1]}, 3)


_DT = """s as (select count(*)::double n, sum(l_discount) sx, sum(l_tax) sy, sum(l_discount * l_discount) sxx, sum(l_discount * l_tax) sxy from lineitem)"""


def _descent(scale: float, decay: float) -> str:
    return f"""with recursive {_DT}, w(k, b, a) as (select 0, 0.0::double, 0.0::double union all
  select k + 1, b - 0.1 * {scale} / n * (n * b + sx * a - sy), a - 0.1 * ({scale} / n * (sx * b + sxx * a - sxy) + {decay} * a) from w, s where k < 60)
select 'intercept' as term, round(b, 6) as value from w where k = 60 union all select 'l_discount', round(a, 6) from w where k = 60"""


@query("gradient_descent_regression", _descent(2.0, 0.0))
def descent(spark, sf_dir):
    m = linear.gradient_descent(_lines(spark, sf_dir), ["l_discount"], "l_tax", 0.1, 60)
    return terms(spark, {"intercept": m.intercept, "l_discount": m.coef[0]})


@query("gradient_descent_plain", _descent(1.0, 0.0))
def descent_plain(spark, sf_dir):
    m = linear.gradient_descent(_lines(spark, sf_dir), ["l_discount"], "l_tax", 0.1, 60, 1.0, fallback=False)
    return terms(spark, {"intercept": m.intercept, "l_discount": m.coef[0]})


@query("svm_regression", _descent(1.0, 0.01))
def svm_regression(spark, sf_dir):
    m = linear.gradient_descent(_lines(spark, sf_dir), ["l_discount"], "l_tax", 0.1, 60, 1.0, 0.01, False)
    return terms(spark, {"intercept": m.intercept, "l_discount": m.coef[0]})


def _unrolled(step: str, steps: int) -> str:
    """step: SQL of one row (b, w1, w2) from the rows x (x1, x2, y) and the last step p."""
    ctes = ["x as (select l_discount * 10 x1, l_tax * 10 x2, case when l_linestatus = 'O' then 1.0 else 0.0 end y from lineitem)", "p0 as (select 0.0::double b, 0.0::double w1, 0.0::double w2)"]
    ctes += [f"p{k + 1} as ({step.replace('#', str(k))})" for k in range(steps)]
    return f"with {', '.join(ctes)} select 'intercept' as term, round(b, 6) as value from p{steps} union all select 'x1', round(w1, 6) from p{steps} union all select 'x2', round(w2, 6) from p{steps}"


def _xy(spark, sf_dir):
    return _lines(spark, sf_dir).selectExpr("l_discount * 10 as x1", "l_tax * 10 as x2", "case when l_linestatus = 'O' then 1 else 0 end as y")


@query("logistic_regression", _unrolled("""select any_value(b) - 0.5 * avg(e) as b, any_value(w1) - 0.5 * avg(e * x1) as w1, any_value(w2) - 0.5 * avg(e * x2) as w2 from
  (select *, 1 / (1 + exp(-(b + w1 * x1 + w2 * x2))) - y as e from x, p#)""", 4))  # fmt: skip
def logistic(spark, sf_dir):
    m = linear.logistic(_xy(spark, sf_dir), ["x1", "x2"], "y", 0.5, 4)
    return terms(spark, {"intercept": m.intercept, "x1": m.coef[0], "x2": m.coef[1]})


def _svm(bias: str) -> str:
    return _unrolled(f"""select any_value(b) - 0.1 * ({bias}avg(g)) as b, any_value(w1) - 0.1 * (any_value(w1) + avg(g * x1)) as w1, any_value(w2) - 0.1 * (any_value(w2) + avg(g * x2)) as w2 from
  (select *, case when (2 * y - 1) * (b + w1 * x1 + w2 * x2) < 1 then -(2 * y - 1) else 0.0 end as g from x, p#)""", 4)  # fmt: skip


@query("linear_svm", _svm(""))
def linear_svm(spark, sf_dir):
    m = linear.svm(_xy(spark, sf_dir), ["x1", "x2"], "y", 0.1, 4)
    return terms(spark, {"intercept": m.intercept, "x1": m.coef[0], "x2": m.coef[1]})


@query("linear_svm_regularised_bias", _svm("any_value(b) + "))
def linear_svm_bias(spark, sf_dir):
    m = linear.svm(_xy(spark, sf_dir), ["x1", "x2"], "y", 0.1, 4, 1.0, True)
    return terms(spark, {"intercept": m.intercept, "x1": m.coef[0], "x2": m.coef[1]})


@query("bayesian_regression", """with s as (select 2.0 + 1.5 * count(*) a, 1.5 * sum(l_discount) b, 2.0 + 1.5 * sum(l_discount * l_discount) d, 1.5 * sum(l_tax) p, 1.5 * sum(l_discount * l_tax) q from lineitem),
w as (select *, a * d - b * b det from s)
select 'intercept' as term, round((d * p - b * q) / det, 6) as value from w union all select 'l_discount', round((a * q - b * p) / det, 6) from w
union all select 'var_intercept', round(d / det, 9) from w union all select 'var_l_discount', round(a / det, 9) from w""")  # fmt: skip
def bayesian(spark, sf_dir):
    m = linear.bayesian(_lines(spark, sf_dir), ["l_discount"], "l_tax", 2.0, 1.5)
    one = terms(spark, {"intercept": m.intercept, "l_discount": m.coef[0]})
    return one.unionByName(terms(spark, {"var_intercept": m.covariance[0, 0], "var_l_discount": m.covariance[1, 1]}, 9))


@query("conjugate_normal_mean", """with g as (select c_nationkey, count(*) n, avg(c_acctbal) m, var_pop(c_acctbal) v from customer group by c_nationkey)
select c_nationkey, n, round((1000.0 / 250000 + n * m / v) / (1.0 / 250000 + n / v), 4) as posterior_mean, round(sqrt(1 / (1.0 / 250000 + n / v)), 4) as posterior_std from g where v > 0""")  # fmt: skip
def conjugate(spark, sf_dir):
    out = linear.conjugate_normal_mean(table(spark, sf_dir, "customer"), "c_acctbal", ["c_nationkey"], 1000.0, 500.0)
    return out.select("c_nationkey", "n", F.round("posterior_mean", 4).alias("posterior_mean"), F.round("posterior_std", 4).alias("posterior_std"))


@query("variational_normal", """with recursive s as (select avg(l_tax * 100) m, avg(l_tax * 100 * l_tax * 100) q from lineitem), w(k, mu, t) as (select 0, 0.0::double, 0.0::double union all
  select k + 1, mu + 0.05 * (m - mu), t + 0.05 * ((q - 2 * mu * m + mu * mu) / exp(2 * t) - 1) from w, s where k < 100)
select 'mu' as term, round(mu, 6) as value from w where k = 100 union all select 'sigma', round(exp(t), 6) from w where k = 100""")  # fmt: skip
def variational(spark, sf_dir):
    mu, sigma = linear.variational_normal(_lines(spark, sf_dir).selectExpr("l_tax * 100 as x"), "x", 100, 0.05)
    return terms(spark, {"mu": mu, "sigma": sigma})


@query("regression_metrics", """select round(avg((l_extendedprice - 1500 * l_quantity) ** 2), 2) as mse, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 4) as mae,
round(1 - sum((l_extendedprice - 1500 * l_quantity) ** 2) / (count(*) * var_pop(l_extendedprice)), 6) as r2 from lineitem""")  # fmt: skip
def regression_metrics(spark, sf_dir):
    out = metrics.regression(_lines(spark, sf_dir), F.col("l_extendedprice"), 1500 * F.col("l_quantity"))
    return out.select(F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"))


_P = "1 / (1 + exp(-(l_discount * 20 - 1)))"


@query("cross_entropy", f"select round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) as bce, round(avg((p >= 0.5) = (y = 1)), 8) as accuracy from (select {_P} p, case when l_linestatus = 'O' then 1.0 else 0.0 end y from lineitem)".replace("avg((p >= 0.5) = (y = 1))", "avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end)"))
def cross_entropy(spark, sf_dir):
    df = _lines(spark, sf_dir).select(sigmoid(F.col("l_discount") * 20 - 1).alias("p"), F.expr("case when l_linestatus = 'O' then 1 else 0 end").alias("y"))
    return df.agg(F.round(metrics.binary_cross_entropy(F.col("y"), F.col("p")), 8).alias("bce"), F.round(metrics.accuracy(F.col("y") == 1, F.col("p") >= 0.5), 8).alias("accuracy"))


@query("confusion_matrix", """with p as (select l_linestatus as actual, case when l_shipdate > timestamp '1995-06-17' then 'O' else 'F' end as predicted from lineitem)
select actual, predicted, count(*) as n from p group by actual, predicted""")  # fmt: skip
def confusion(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumn("predicted", F.expr("case when l_shipdate > timestamp_ntz'1995-06-17 00:00:00' then 'O' else 'F' end"))
    return metrics.confusion(df, "l_linestatus", "predicted")


@query("classification_report", """with p as (select l_linestatus as a, case when l_shipdate > timestamp '1995-06-17' then 'O' else 'F' end as b from lineitem),
k as (select distinct a as label from p union select distinct b from p),
c as (select label, (select count(*) from p where a = label and b = label) tp, (select count(*) from p where b = label) pp, (select count(*) from p where a = label) support from k)
select label, round(case when pp > 0 then tp / pp else 0 end, 6) as "precision", round(case when support > 0 then tp / support else 0 end, 6) as recall,
round(case when pp + support > 0 then 2.0 * tp / (pp + support) else 0 end, 6) as f1, support from c""")  # fmt: skip
def report(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumn("predicted", F.expr("case when l_shipdate > timestamp_ntz'1995-06-17 00:00:00' then 'O' else 'F' end"))
    out = metrics.report(df, "l_linestatus", "predicted")
    return out.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("roc_auc", """with r as (select case when l_linestatus = 'O' then 1 else 0 end y, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as rk from lineitem)
select round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))::double), 8) as auc from r""")  # fmt: skip
def roc_auc(spark, sf_dir):
    df = _lines(spark, sf_dir).selectExpr("l_linestatus = 'O' as y", "l_quantity as score")
    return metrics.roc_auc(df, "y", "score").select(F.round("auc", 8).alias("auc"))
