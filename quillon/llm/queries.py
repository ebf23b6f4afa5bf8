"""One query an operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, minhash, ngram_join, packing, secret_scan, substring_dedup, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_ngram_jaccard_join")
def op5(spark, sf_dir):
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


@query("op3_minhash_fingerprints")
def op3(spark, sf_dir):
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_substring_dedup")
def op8(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op9_language_id")
def op9(spark, sf_dir):
    return language_id.predict(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_secret_scan")
def op4(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))


@query("op2_warc_round_trip")
def op2(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op1_license_scan")
def op1(spark, sf_dir):
    return license_scan.report(table(spark, sf_dir, "documents"))


@query("op10_benchmark_decontamination")
def op10(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Captures are dated from their page_id; the list names every host three times,
# its parent domains and some of its paths.
_URL_ORACLE = """
with p as (
  select page_id, regexp_extract(lower(url), '://([^/?#]+)', 1) as h, regexp_extract(url, '//[^/?#]*(/[^?#]*)', 1) as path,
         1704067200 + ((page_id * 2099) % 525600) * 60 as f from pages),
hosts as (select h, min(page_id) as m from p where h <> '' group by h),
entries as (
  select h as key, case k when 1 then 'allow' else 'block' end as action, 1704067200 + ((m * 13 + k * 97) % 300) * 86400 as since
  from hosts, (values (0), (1), (2)) t(k)
  union all select h || '/en', 'allow', 1704067200 + (m % 100) * 86400 from hosts where m % 5 = 0
  union all select 'example.com', 'review', 1704067200 + 50 * 86400
  union all select 'example.org', 'review', 1704067200 + 200 * 86400),
e as (select key, since, max(action) as action from entries group by key, since),
iv as (select key, action, since, coalesce(lead(since) over (partition by key order by since), 99999999999) as until from e),
l as (select page_id, f, h, string_split(h, '.') as x, list_filter(string_split(path, '/'), lambda s: s <> '') as s from p where h <> ''),
keys as (
  select page_id, f, len(x) - i + 1 as rank, array_to_string(x[i:], '.') as key from l, unnest(range(1, greatest(2, len(x)))) u(i)
  union all
  select page_id, f, 1000 + i, h || '/' || array_to_string(s[:i], '/') from l, unnest(range(1, len(s) + 1)) u(i)),
best as (
  select page_id, arg_max(struct_pack(a := action, k := iv.key, s := since), rank) as b
  from keys join iv on keys.key = iv.key and since <= f and f < until group by page_id)
select p.page_id, p.h as host, p.f as fetched_s, coalesce(b.a, 'none') as verdict, b.k as matched_key, b.s as active_since_s
from p left join best using (page_id)"""


@query("op7_url_filter", _URL_ORACLE)
def op7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", url_filter.host(F.col("url")).alias("host"), F.expr("1704067200 + pmod(page_id * 2099, 525600) * 60").alias("fetched_s"))
    hosts = pages.where("host <> ''").groupBy("host").agg(F.min("page_id").alias("m"))
    named = hosts.select("host", "m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).selectExpr("host as key", "case k when 1 then 'allow' else 'block' end as action", "1704067200 + pmod(m * 13 + k * 97, 300) * 86400 as s")
    paths = hosts.where("m % 5 = 0").selectExpr("concat(host, '/en') as key", "'allow' as action", "1704067200 + (m % 100) * 86400 as s")
    fixed = spark.createDataFrame([("example.com", "review", 1704067200 + 50 * 86400), ("example.org", "review", 1704067200 + 200 * 86400)], "key string, action string, s long")
    entries = named.unionByName(paths).unionByName(fixed).select("key", "action", F.timestamp_seconds("s").alias("since"))
    out = url_filter.judge(pages.withColumn("fetched", F.timestamp_seconds("fetched_s")), entries)
    return out.select("page_id", "host", "fetched_s", "verdict", "matched_key", F.unix_seconds("active_since").alias("active_since_s"))
