"""URL filters: longest matching (host, path-prefix) rule for each URL.

A rule fits a URL if its host is the URL's host or a parent domain of it, and the URL's path starts with the rule's path.
Each URL is keyed once per parent domain that has as many labels as a rule's host, as reversed host + "/" + path, so that every rule is a plain prefix and covers one
interval of the sorted keys. Rules and distinct keys are swept together in key order: the last rule that began carries the stack of
the rules it is nested in, and those that still cover the key are the ones that fit.

Spark's range partitioning cuts the order into as many ranges as the session has shuffle partitions (or fewer, where adaptive execution
joins small ones); the ranges are written out with their numbers. A rule stands in the range it begins in. Of those that began in an earlier
range, exactly the rules that are prefixes of a range's first key reach into it, so each range gets these by an equi-join and needs no other range's rows.
Keys are distinct before the sweep: a host with very many URLs spreads over many ranges, and a parent key that very many hosts share
is one row; what fits it is joined back, which Spark can split.

Defined results: a null URL, or one without "://", has an empty host and path and meets no rule; rules with a null or empty host
are ignored, a null path is the empty prefix; of equal rules the blocking one counts; of rules of one length the blocking one,
then the smaller string. Repeated rows of pages give repeated rows, null ids stay. Columns beside the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanings.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts below every character of a host or path, so that a host's keys come before those of longer host labels.
SEP = "\x01"
#: Characters of a key by which ranges are cut, so that what Spark samples for it stays small; keys with the same ones stand in one range.
ORDERED = 512


def url_host(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _prefixes(keys: DataFrame, rules: DataFrame, *keep: str) -> DataFrame:
    """keep and key: the prefixes of keys' column ``of`` at those lengths that a key of rules has, however long a key is."""
    lengths = rules.agg(F.collect_set(F.length("key")).alias("lengths"))  # one row
    return keys.crossJoin(lengths).select(*keep, F.explode(F.expr("transform(filter(lengths, n -> n <= length(of)), n -> substring(of, 1, n))")).alias("key"))


def rule_keys(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) -> key, rule, verdict and the stack of rules that each is nested in, itself included."""
    plain = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .filter("host <> '' and host is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block > allow
        .select(
            F.concat(_reversed_host(F.split("host", r"\.")), F.lit(SEP), "path").alias("key"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        )
    )
    # the rules that a rule is nested in are the rules among its own prefixes
    prefixes = _prefixes(plain.select(F.col("key").alias("inner"), F.col("key").alias("of")), plain, "inner")
    stacks = (
        prefixes.join(plain, "key")
        .groupBy(F.col("inner").alias("key"))
        .agg(F.array_sort(F.collect_list(F.struct(F.length("key").alias("depth"), "key", "rule", "verdict"))).alias("stack"))
    )
    return stacks


def match_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict of every row of pages."""
    urls = pages.select(F.col(id_column).alias("_id"), url_host(F.col(url_column)).alias("_host"), url_path(F.col(url_column)).alias("_path"))
    # one row for each distinct address: copies and popular addresses collapse before the sweep
    distinct = urls.filter("_host <> ''").groupBy("_host", "_path").count().select("_host", "_path")
    ruled = rule_keys(rules)
    # parent domains with as many labels as a rule's host has: a host of very many labels has no more keys than others
    depths = ruled.select((F.size(F.split(F.split("key", SEP)[0], r"\.")).alias("d"))).agg(F.collect_set("d").alias("depths"))  # one row
    labels = F.split("_host", r"\.")
    parents = F.transform(F.filter("depths", lambda i: i <= F.size(labels)), lambda i: F.concat(_reversed_host(F.slice(labels, -i, i)), F.lit(SEP), F.col("_path")))
    keys = distinct.crossJoin(depths).select("_host", "_path", F.explode(parents).alias("key"))

    no_stack = F.lit(None).cast(ruled.schema["stack"].dataType).alias("stack")
    starts = ruled.select(F.col("key").alias("at"), F.lit(0).alias("kind"), F.length("key").alias("depth"), "stack")
    stops = keys.select(F.col("key").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("depth")).distinct().select("*", no_stack)
    ranged = staged(starts.unionByName(stops).repartitionByRange(F.substring("at", 1, ORDERED)).withColumn("range", F.spark_partition_id()))
    firsts = ranged.groupBy("range").agg(F.min("at").alias("low"))
    prefixes = _prefixes(firsts.select("range", F.col("low").alias("of")), ruled, "range")
    carried = prefixes.join(ruled, "key").select(F.lit("").alias("at"), F.lit(0).alias("kind"), F.length("key").alias("depth"), "stack", "range")
    sweep = W.partitionBy("range").orderBy("at", "kind", "depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = ranged.unionByName(carried).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    fits = swept.select(F.col("at").alias("key"), F.filter("open", lambda r: F.startswith(F.col("at"), r["key"])).alias("fits")).filter("size(fits) > 0")
    fitting = keys.join(fits, "key").select("_host", "_path", F.explode("fits").alias("r")).select("_host", "_path", F.struct((-F.length("r.rule")).alias("n"), (F.col("r.verdict") != "block").alias("v"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")).alias("r"))
    # the longest rule, of those the blocking one, of those the smaller string
    best = fitting.groupBy("_host", "_path").agg(F.min("r").alias("r"))
    return urls.join(best, ["_host", "_path"], "left").select(
        F.col("_id").alias(id_column), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict")
    )
