"""URL filters: a sort-merge range join of reversed-host keys with nested rules.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.common import bare, cut, lower_ascii, table

TARGET = 100_000     # keys that one sweep runs over; a larger group is dealt out over several sweeps
ALLOW, BLOCK = "allow", "block"
RULES = [("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW)]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or if null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or if null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.net`` as ``net.example.www.``: a host's subdomains have keys that begin with the host's own."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def sweep(keys: DataFrame, rules: DataFrame, group: str, key: str) -> DataFrame:
    """``keys`` (group, key, ...) with ``stack``: the rules (group, key, info) of the group whose key is a prefix, shortest first.

    A rule's key stands for the interval of all keys that begin with it; such intervals nest or are apart.  Each
    rule first gets its own stack, the rules around it, by joining its prefixes with the rules.  Then rules
    and keys are sorted together: the last rule before a key, or one around that rule, is the innermost
    one around the key, so the stack that runs along is filtered by prefix and nothing is searched.

    A group with many keys is dealt out over several sweeps by the key's hash, each with all rules of the group.
    """
    own = rules.select(group, key, "info").distinct()
    prefixes = own.select(group, F.col(key).alias("of"), F.explode(F.sequence(F.lit(0), F.length(key))).alias("n"))
    prefixes = prefixes.select(group, "of", F.expr("substring(of, 1, n)").alias(key))
    stacks = (
        prefixes.join(own, [group, key])
        .groupBy(group, F.col("of").alias(key))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), "info"))).alias("stack"))
    )
    sizes = keys.groupBy(group).agg(F.count("*").alias("__n")).select(group, F.ceil(F.col("__n") / TARGET).cast("int").alias("__deals"))
    dealt = stacks.join(sizes, group).withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__deals") - 1))).drop("__deals")
    rows = keys.join(sizes, group).withColumn("__deal", F.pmod(F.xxhash64(key), F.col("__deals")).cast("int")).drop("__deals")
    both = dealt.withColumn("__rule", F.lit(0)).unionByName(rows.withColumn("__rule", F.lit(1)), allowMissingColumns=True)
    # by both columns: rows that came hashed by the group alone would satisfy the window, and all deals meet in one task
    both = both.repartition(group, "__deal")
    order = W.partitionBy(group, "__deal").orderBy(key, "__rule").rowsBetween(W.unboundedPreceding, 0)
    swept = both.withColumn("__last", F.last("stack", ignorenulls=True).over(order)).filter("__rule = 1")
    around = F.filter("__last", lambda r: F.startswith(F.col(key), r["key"]))
    return swept.select(*keys.columns, around.alias("stack")).filter(F.size("stack") > 0)


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    ``rules`` (host, path, verdict) is a table of any size.  A rule fits its host and all subdomains if the
    url's path starts with its path; the longest rule (host and path together, then host) that fits decides, and
    ``block`` where equal rules differ; without one the verdict is ``default`` and the rule null.

    First the distinct hosts are swept over the rules' hosts; then each distinct url is swept, once per rule
    host around it, over that host's paths.  A host or url that many pages share is swept once.  A null
    url, or one without ``://``, has an empty host and path and no rule.  Rules with a null or empty host are ignored; a
    null path stands for all paths.
    """
    parsed = bare(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = bare(rules, "host", "path", "verdict").filter("host <> ''").select(
        lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    urls = cut(parsed.filter("host <> ''").select("host", "path").distinct())
    top = F.element_at(F.split("host", r"\."), -1).alias("top")
    hosts = urls.select("host").distinct().select(top, reversed_host(F.col("host")).alias("key"), "host")
    rule_hosts = rules.select(top, reversed_host(F.col("host")).alias("key"), F.col("host").alias("info")).distinct()
    levels = sweep(hosts, rule_hosts, "top", "key").select("host", F.explode("stack.info").alias("level"))
    keys = urls.join(levels, "host").select("level", F.col("path").alias("key"), "host", "path")
    paths = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(F.col("host").alias("level"), F.col("path").alias("key"), F.col("verdict").alias("info"))
    fits = sweep(keys, paths, "level", "key").select("host", "path", "level", F.element_at("stack", -1).alias("r"))
    rule = F.concat("level", "r.key")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("n"), F.length("level").alias("m"), rule.alias("rule"), F.col("r.info").alias("verdict"))).alias("best"))
    best = best.select("host", "path", "best.rule", "best.verdict")
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page by the four rules."""
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
