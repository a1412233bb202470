"""URL rules as a sort-merge range join.

A rule (host, path) becomes the key ``reversed host labels / path``; the keys that start with it form one interval. A URL probes with its
own host and every parent host that can have a rule. Rules and probes are sorted together over range partitions; the last rule at or
before a probe is the top of the sweep's stack, and the rules nested around that one (its stack) are stored with it. The longest of
them that is a prefix of the probe is the rule of that host; the longest host wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelab.llm.common import stable
from routelab.scale import ordered_running

# The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substr(url, at + 3))


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    # a host has no slash, so the first one ends the host part
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule's key with the rules nested around it, itself included: key, stack array<struct<len, key, rule, verdict>>.

    Two rules of the same host and path: ``block`` beats ``allow``.
    """
    r = (rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
         .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
         .select(_key(F.reverse(F.split("host", r"\.")), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict"))
    outer = r.select(F.col("key").alias("_start"), F.struct(F.length("key").alias("len"), "key", "rule", "verdict").alias("_outer"))
    starts = r.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("_n")).select("key", F.expr("left(key, _n)").alias("_start"))
    return starts.join(outer, "_start").groupBy("key").agg(F.sort_array(F.collect_list("_outer")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule, else null), verdict (the rule's, else ``default``).

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest host wins, then the longest path. A null
    url or one without ``://`` has an empty host and path. Repeated pages each get their row; without rules every page gets the default; an empty table
    gives an empty result; a very long url is one key; other columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    stacks = stable(rule_stacks(rules))
    # no rule has more labels than this, so parents with more cannot match
    depth = stacks.select(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\.")))).first()[0] or 0
    labels = F.reverse(F.split("host", r"\."))
    places = urls.select("host", "path").distinct()
    probes = (places.withColumn("_labels", labels)
              .select("host", "path", "_labels", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(depth), F.size("_labels"))))).alias("_j"))
              .select("host", "path", "_j", _key(F.slice("_labels", F.lit(1), F.col("_j")), F.col("path")).alias("key")))
    starts = stacks.select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("_j"), "key", F.col("key").alias("_rule"))
    events = starts.unionByName(probes.withColumn("_rule", F.lit(None).cast("string")))
    # a rule (depth 0) sorts before the probes of the same key
    swept = ordered_running(events, [], ["key", "_j", "host"], {"_top": ("max", "_rule")}).where("_j > 0")
    fits = F.filter("stack", lambda s: F.col("key").startswith(s["key"]))
    # a table of its own, so that Spark can split a hot (host, path) in the join below
    found = stable(swept.join(stacks.select(F.col("key").alias("_top"), "stack"), "_top")
             .withColumn("_fit", F.element_at(F.when(F.size(fits) > 0, fits), -1)).where("_fit is not null")
             .groupBy("host", "path").agg(F.max(F.struct("_j", "_fit.len", "_fit.rule", "_fit.verdict")).alias("_best"))
             .select("host", "path", "_best.rule", "_best.verdict"))
    return urls.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
