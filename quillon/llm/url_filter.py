"""URL filters: captures judged by the list entries in force when they were fetched.

List entries (key, action, since) are dated; the next entry of the same key
ends the one before, so entries become intervals [since, until).  A key is a
host or one of its parent domains, or a host with leading path segments.  A
capture is judged by every key of its URL; of the entries in force at its fetch
time the most specific wins (path prefixes before hosts, longer before
shorter).

The as-of join is an equi-join on a key and a cell of time: an interval is listed
under the whole years inside it and the months at its ends, a capture under its
month and its year, so they meet in one cell at most.  A host with very many
captures or entries is spread over cells and, as a plain join, can be split by
adaptive execution.

URLs without a host (null, empty, no ``//``) and captures without a fetch time
have no keys and get the verdict ``none``.  Entries with a null key, action or
date are ignored; of entries of one key and instant the alphabetically last
action holds.  Rows are judged each on its own, repeated or not.  Other columns
of the captures are kept, but for those named verdict, matched_key or
active_since, which the result replaces.  Without captures the result is empty,
without entries all verdicts are ``none``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Workspace

FAR = "9999-01-01"


def host(url: Column) -> Column:
    """The host in lower case, without user, port and a final dot; '' if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1), F.lit(""))


def keys(url: Column) -> Column:
    """array<struct<rank, key>>: parent domains (of two labels or more) with
    their number of labels, path prefixes with 1000 and their segments."""
    h = host(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.struct((n - i + 1).alias("rank"), F.array_join(F.slice(labels, i, n), ".").alias("key")))
    path = F.regexp_extract(url, r"^[^?#]*?//[^/?#]*(/[^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda i: F.struct((i + 1000).alias("rank"), F.concat(h, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key"))))
    none = F.array().cast("array<struct<rank:int,key:string>>")
    return F.when(h == "", none).otherwise(F.concat(hosts, F.coalesce(paths, none)))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of dated entries (key, action, since)."""
    entries = entries.where("key is not null and action is not null and since is not null").groupBy("key", "since").agg(F.max("action").alias("action"))
    after = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    return entries.select("key", "action", "since", F.coalesce(after, F.to_timestamp(F.lit(FAR))).alias("until"))


def _month(time: Column) -> Column:
    return F.year(time) * 12 + F.month(time) - 1


def _cells(first: Column, last: Column) -> Column:
    """Cells of the months first..last: whole years y as -1 - y, other months as they are."""
    year, end = F.ceil(first / 12).cast("int"), F.floor((last + 1) / 12).cast("int")
    months = lambda a, b: F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))
    years = F.transform(months(year, end - 1), lambda y: -1 - y)
    return F.when(year < end, F.concat(months(first, year * 12 - 1), years, months(end * 12, last))).otherwise(months(first, last))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with verdict, matched_key and active_since."""
    work = Workspace(captures.sparkSession, "url-filter")
    asked = captures.select(F.col(f"`{url}`").alias("u"), F.col(f"`{fetched}`").alias("f"))
    last = asked.agg(F.max("f")).first()[0]
    asked = asked.select("u", "f", F.explode(keys(F.col("u"))).alias("k")).select("u", "f", "k.rank", "k.key", F.explode(F.array(_month(F.col("f")), -1 - F.year("f"))).alias("cell"))
    dated = intervals(entries)
    if last is not None:  # nothing is asked later
        dated = dated.where(F.col("since") <= F.lit(last)).withColumn("until", F.least("until", F.lit(last) + F.expr("interval 1 second")))
    dated = work.table(dated.withColumn("cell", F.explode(_cells(_month(F.col("since")), _month(F.col("until"))))), "intervals")
    found = asked.join(work.small(dated), ["key", "cell"]).where("since <= f and f < until")
    best = found.groupBy("u", "f").agg(F.max(F.struct("rank", "key", "action", "since")).alias("b"))
    best = work.table(best.select("u", "f", F.col("b.action").alias("verdict"), F.col("b.key").alias("matched_key"), F.col("b.since").alias("active_since")), "verdicts")
    made = ["verdict", "matched_key", "active_since"]
    kept = [F.col(f"c.`{x}`") for x in captures.columns if x.lower() not in made]
    out = captures.alias("c").join(work.small(best).alias("b"), (F.col(f"c.`{url}`") == F.col("b.u")) & (F.col(f"c.`{fetched}`") == F.col("b.f")), "left")
    return out.select(*kept, F.coalesce("b.verdict", F.lit("none")).alias("verdict"), F.col("b.matched_key").alias("matched_key"), F.col("b.active_since").alias("active_since"))
