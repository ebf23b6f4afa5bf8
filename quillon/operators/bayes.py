"""Naive Bayes: models are small tables, scoring is a broadcast join.

Ties of the joint log-likelihood go to the smallest label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cut import cut
from .linear import complete

#: Classes up to which a model is broadcast; its rows are one a class.
CLASSES = 100_000


def _model(model: DataFrame) -> DataFrame:
    return F.broadcast(model) if model.count() <= CLASSES else model


def gaussian_fit(df: DataFrame, features: list[str], label: str, smoothing: float = 1e-9) -> DataFrame:
    """One row a class: label, n, prior, mean_f and var_f (population, plus smoothing as it is)."""
    df = complete(df, features).where(F.col(label).isNotNull())
    stats = [s for f in features for s in (F.avg(f).alias(f"mean_{f}"), (F.var_pop(f) + smoothing).alias(f"var_{f}"))]
    model = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *stats)
    total = F.broadcast(model.agg(F.sum("n").alias("total")))
    return model.crossJoin(total).withColumn("prior", F.col("n") / F.col("total")).drop("total")


def gaussian_predict(df: DataFrame, model: DataFrame, features: list[str]) -> DataFrame:
    """df with prediction and probability (of the predicted label)."""
    classes = model.select(F.struct("label", "prior", *(c for f in features for c in (f"mean_{f}", f"var_{f}"))).alias("c"))
    # one row: the classes as an array, so scoring needs no shuffle
    table = F.broadcast(classes.agg(F.array_sort(F.collect_list("c")).alias("classes")))

    def jll(c: Column) -> Column:
        out = F.log(c["prior"])
        for f in features:
            d = F.col(f) - c[f"mean_{f}"]
            out = out - 0.5 * (F.log(2 * math.pi * c[f"var_{f}"]) + d * d / c[f"var_{f}"])
        return out

    scored = df.crossJoin(table).withColumn("_s", F.transform("classes", lambda c: F.struct(jll(c).alias("v"), c["label"].alias("label"))))
    best = F.expr("reduce(_s, _s[0], (a, s) -> case when s.v > a.v then s else a end)")
    return scored.withColumn("_b", best).withColumn("prediction", F.col("_b.label")).withColumn("probability", F.expr("1 / aggregate(_s, 0D, (a, s) -> a + exp(s.v - _b.v))")).drop("_s", "_b", "classes")


def multinomial_fit(counts: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(label, log_prior, log_absent) and (label, token, log_p) of rows (id, label,
    token, n).  Tokens that a class lacks have its log_absent, and aren't listed.
    The counts are written once, as they are read for each part of the model."""
    counts = cut(counts)
    docs = counts.select("id", "label").distinct().groupBy("label").agg(F.count("*").alias("docs"))
    per = counts.groupBy("label", "token").agg(F.sum("n").alias("n"))
    vocabulary = F.broadcast(per.select("token").distinct().agg(F.count("*").alias("v")))
    total = F.broadcast(docs.agg(F.sum("docs").alias("all")))
    sums = per.groupBy("label").agg(F.sum("n").alias("total")).join(docs, "label").crossJoin(vocabulary).crossJoin(total)
    classes = sums.select("label", F.log(F.col("docs") / F.col("all")).alias("log_prior"), (math.log(alpha) - F.log(F.col("total") + alpha * F.col("v"))).alias("log_absent"), F.log(F.col("total") + alpha * F.col("v")).alias("log_total"))
    tokens = per.join(_model(classes), "label").select("label", "token", (F.log(F.col("n") + alpha) - F.col("log_total")).alias("log_p"))
    return cut(classes.drop("log_total")), cut(tokens)


def multinomial_predict(counts: DataFrame, classes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, prediction) of rows (id, token, n).  Unseen tokens are ignored.

    A document's score is its prior and n * log_absent for all of its known
    tokens, corrected by the tokens a class does have; so nothing is crossed
    with the vocabulary.
    """
    classes = _model(classes)
    known = counts.join(tokens.select("token").distinct(), "token", "left_semi")
    base = known.groupBy("id").agg(F.sum("n").alias("n")).crossJoin(classes).select("id", "label", (F.col("log_prior") + F.col("n") * F.col("log_absent")).alias("s"))
    seen = known.join(tokens, "token").join(classes.select("label", "log_absent"), "label").select("id", "label", (F.col("n") * (F.col("log_p") - F.col("log_absent"))).alias("s"))
    score = base.unionByName(seen).groupBy("id", "label").agg(F.sum("s").alias("s"))
    return score.groupBy("id").agg(F.max(F.struct(F.round("s", 9), F.lit(0))).alias("m"), F.collect_list(F.struct("label", "s")).alias("all")).select("id", F.expr("array_min(transform(filter(all, x -> round(x.s, 9) >= m.col1), x -> x.label))").alias("prediction"))


def bernoulli_fit(df: DataFrame, features: list[str], label: str, alpha: float = 1.0, threshold: float | None = 0.0) -> DataFrame:
    """One row a class: label, n, prior, p_f."""
    one = [(F.col(f) > threshold).cast("double") if threshold is not None else F.col(f).cast("double") for f in features]
    model = complete(df, features).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *(((F.sum(x) + alpha) / (F.count("*") + 2 * alpha)).alias(f"p_{f}") for f, x in zip(features, one)))
    return model.crossJoin(F.broadcast(model.agg(F.sum("n").alias("total")))).withColumn("prior", F.col("n") / F.col("total")).drop("total")


def bernoulli_predict(df: DataFrame, model: DataFrame, features: list[str], threshold: float | None = 0.0) -> DataFrame:
    classes = F.broadcast(model.select(F.struct("label", "prior", *(f"p_{f}" for f in features)).alias("c")).agg(F.array_sort(F.collect_list("c")).alias("classes")))

    def jll(c):
        out = F.log(c["prior"])
        for f in features:
            x = (F.col(f) > threshold).cast("double") if threshold is not None else F.col(f).cast("double")
            out = out + x * F.log(c[f"p_{f}"]) + (1 - x) * F.log(1 - c[f"p_{f}"])
        return out

    scored = df.crossJoin(classes).withColumn("_s", F.transform("classes", lambda c: F.struct(jll(c).alias("v"), c["label"].alias("label"))))
    return scored.withColumn("prediction", F.expr("reduce(_s, _s[0], (a, s) -> case when s.v > a.v + 1e-12 then s else a end).label")).drop("_s", "classes")


def tokens(df: DataFrame, key: str, text: str, label: str | None = None) -> DataFrame:
    """(id, [label,] token, n): words of two or more letters, digits or underscores."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("token")
    keep = [F.col(key).alias("id"), *([F.col(label).alias("label")] if label else [])]
    return df.select(*keep, words).groupBy("id", *(["label"] if label else []), "token").agg(F.count("*").alias("n"))
