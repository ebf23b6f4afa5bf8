"""Column expressions that several operators share; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def dot(xs: Sequence[Column], weights: Sequence[float], intercept: float = 0.0) -> Column:
    return total([F.lit(float(intercept)), *(x * F.lit(float(w)) for x, w in zip(xs, weights))])


def sigmoid(z: Column, bound: float = 500.0) -> Column:
    z = F.least(F.greatest(z, F.lit(-bound)), F.lit(bound))
    return 1.0 / (1.0 + F.exp(-z))


def soft_threshold(x: Column, t: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - F.lit(float(t)), F.lit(0.0))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1.0 + F.tanh(F.lit(math.sqrt(2 / math.pi)) * (x + 0.044715 * x * x * x)))


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def let(x: Column, body) -> Column:
    """body(x) with x evaluated once: a lambda's expression is evaluated anew for
    every element, its variable isn't."""
    return F.element_at(F.transform(F.array(x), lambda v: body(v)), 1)


def softmax(a: Column) -> Column:
    def share(e):
        return let(array_sum(e), lambda s: F.transform(e, lambda v: v / s))

    def powers(a):
        return let(F.array_max(a), lambda top: let(F.transform(a, lambda v: F.exp(v - top)), share))

    return let(a, powers)


def layer_norm(a: Column, eps: float = 1e-6) -> Column:
    """(x - mean) / (std + eps), population std."""

    def centred(d):
        return let(F.sqrt(array_sum(F.transform(d, lambda v: v * v)) / F.size(d)), lambda std: F.transform(d, lambda v: v / (std + eps)))

    return let(a, lambda a: let(array_sum(a) / F.size(a), lambda mean: let(F.transform(a, lambda v: v - mean), centred)))


def uniform(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) that depends on the seed and ids only, so results
    don't change with partitioning or a repeated task: the first 40 bits of the
    MD5 of "seed:id:id..", which other engines have, too."""
    names = [F.col(i) if isinstance(i, str) else i for i in ids]
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(i.cast("string"), F.lit("")) for i in names))
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("double") / F.lit(float(1 << 40))


def uniform_sql(seed: int, *ids: str) -> str:
    """uniform() for DuckDB."""
    text = ", ".join(f"coalesce(({i})::varchar, '')" for i in ids)
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {text})), 1, 10))::bigint / {float(1 << 40)})"


def normal(seed: int, *ids: Column) -> Column:
    """A standard normal by Box and Muller from two such numbers."""
    u = 1.0 - uniform(seed, *ids)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * uniform(seed + 7919, *ids))
