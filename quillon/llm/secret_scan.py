"""Secret scan: fixed patterns and sliding-window entropy, as SQL functions only.

Base kinds, leftmost and non-overlapping each: ``assign`` (a named value of 6
or more characters), ``access`` (an access key id), ``hex`` (24 or more
lower-case hexadecimal digits).

Beyond them, candidate strings of 20 or more key characters are classed by
their characters (hexadecimal, or base64 with a digit and letters of both
cases) and read with a sliding window.  Counts of the characters in the window
are kept up as one leaves and one enters, and with them
``S = sum(c * log2(c))``, so that the window's Shannon entropy is
``log2(w) - S / w``.  Windows at or above the class's threshold merge into a
span of kind ``entropy``, unless the candidate is on the allow list or the span
lies inside a base span.  Base spans are never suppressed.

Positions are code points, ends exclusive.  The gaps between matches (split)
and the matches themselves have the same order, so their lengths give the
positions.  Null texts are empty and have no spans.  Null doc_ids, repeated
rows and other columns are kept as they are.  An empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import unused

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs, so that a least length in the pattern drops the same matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Matches whose positions run up together.
BLOCK = 500

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Character class -> its pattern, window and least entropy in bits.
CLASSES = {
    "hex": (r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 20, 3.0),
    "base64": (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 20, 3.9),
}
#: Candidates that look random and are not secret: UUIDs, counting runs, padding, documentation.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)0123456789|abcdefghij|example|dummy|placeholder|xxxxxx",
)


def _gaps(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind, end, value>> of the matches, in order; a match
    whose group is shorter than ``least`` is dropped after it took its place.

    Positions run up within blocks of ``BLOCK`` matches and then over the blocks,
    so that a text of very many matches isn't copied once for each.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(F.arrays_zip(hits.alias("hit"), values.alias("value")), F.slice(_gaps(text, pattern), 1, F.greatest(F.lit(1), F.size(hits))), lambda m, gap: F.struct(F.length(gap).alias("gap"), m["hit"].alias("hit"), m["value"].alias("value")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc, m):
        start = acc["at"] + m["gap"]
        end = start + F.length(m["hit"])
        own = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(m["value"]) >= least, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def blocks(found):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(found, b * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))

    def placed(local):
        begins = F.aggregate(local, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(local, begins, lambda x, at: F.transform(x["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"), s["value"].alias("value")))))

    # one-element arrays bind what is used more than once
    found = F.transform(F.array(parts), lambda p: F.transform(F.array(blocks(p)), placed)[0])[0]
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _hot_windows(candidate: Column, window: int, least: float) -> Column:
    """array<struct<a, b>>: merged windows of a candidate with enough entropy."""
    chars = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    start = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("s"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def f(count):
        return F.element_at(weight, count + 1)

    def step(chars, acc, i):
        enters = F.element_at(chars, i)
        leaves = F.when(i > window, F.element_at(chars, F.greatest(F.lit(1), i - window))).otherwise(F.lit(-1))
        had_in = F.element_at(acc["n"], enters + 1)
        had_out = F.element_at(acc["n"], F.greatest(F.lit(0), leaves) + 1)
        change = F.when(leaves == enters, F.lit(0.0)).otherwise(f(F.least(F.lit(window), had_in + 1)) - f(had_in) + F.when(leaves >= 0, f(F.greatest(F.lit(0), had_out - 1)) - f(had_out)).otherwise(F.lit(0.0)))
        n = F.transform(acc["n"], lambda v, k: v + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
        s = acc["s"] + change
        hot = (i >= window) & (F.lit(math.log2(window)) - s / F.lit(float(window)) >= F.lit(least - 1e-9))
        last = F.element_at(acc["out"], -1)
        joined = F.concat(F.slice(acc["out"], 1, F.greatest(F.lit(0), F.size(acc["out"]) - 1)), F.array(F.struct(last["a"].alias("a"), i.alias("b"))))
        new = F.concat(acc["out"], F.array(F.struct((i - window).alias("a"), i.alias("b"))))
        out = F.when(~hot, acc["out"]).when((F.size(acc["out"]) > 0) & (F.try_element_at(acc["out"], F.lit(-1))["b"] >= i - window), joined).otherwise(new)
        return F.struct(n.alias("n"), s.alias("s"), out.alias("out"))

    # the characters are split once, through a one-element array
    return F.flatten(F.transform(F.array(chars), lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c)), start, lambda acc, i: step(c, acc, i), lambda acc: acc["out"])))


def _entropy_spans(text: Column) -> Column:
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def windows(m):
        value = m["value"]
        found = F.array().cast("array<struct<a:int,b:int>>")
        for pattern, window, least in reversed(CLASSES.values()):
            found = F.when(value.rlike(pattern), _hot_windows(value, window, least)).otherwise(found)
        for allowed in ALLOWED:
            found = F.when(value.rlike(allowed), F.array().cast("array<struct<a:int,b:int>>")).otherwise(found)
        return F.transform(found, lambda w: F.struct((m["start"] + w["a"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + w["b"]).alias("end"), F.lit("").alias("value")))

    classed = "|".join(p for p, _, _ in CLASSES.values())
    some = F.filter(_spans(text, CANDIDATE, 3), lambda m: m["value"].rlike(classed))
    return F.coalesce(F.flatten(F.transform(some, windows)), empty)


def scan(docs: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """docs with the column ``out``: array<struct<start, kind, end>> by start, then
    kind (its place in KINDS).  A column of docs with that name is replaced."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base, more = unused([*docs.columns, out], "base", "more")
    found = docs.withColumn(base, F.concat(_spans(t, ASSIGN, 0, 2, 6), _spans(t, ACCESS, 1), _spans(t, HEX, 2))).withColumn(more, _entropy_spans(t))
    covered = F.expr(f"filter(`{more}`, e -> not exists(`{base}`, b -> b.start <= e.start and e.end <= b.end))")
    every = F.transform(F.concat(base, covered), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.withColumn(out, F.array_sort(every)).drop(base, more)


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.end)), ',')"


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs."""
    found = scan(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "secret_spans")
    base = "filter(secret_spans, s -> s.kind < 3)"
    counts = [F.expr(f"cast(size(filter(secret_spans, s -> s.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.expr(f"sha2({_joined(base)}, 256)").alias("base_sha256"), F.expr(_joined("secret_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by the mark; overlapping spans
    by one.  Null texts stay null; all other columns are as they were."""
    (spans,) = unused(docs.columns, "spans")
    mark = mark.replace("\\", "\\\\").replace("'", "\\'")
    parts = f"""aggregate(`{spans}`, struct(0 as at, cast(array() as array<string>) as out), (acc, s) -> case when s.end <= acc.at then acc when s.start < acc.at then struct(s.end as at, acc.out as out) else struct(s.end as at, concat(acc.out, array(substring(`{text}`, acc.at + 1, s.start - acc.at))) as out) end, acc -> concat(acc.out, array(substring(`{text}`, acc.at + 1))))"""
    return scan(docs, text, spans).withColumn(text, F.expr(f"case when size(`{spans}`) > 0 then array_join({parts}, '{mark}') else `{text}` end")).select([f"`{c}`" for c in docs.columns])
