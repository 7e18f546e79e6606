"""Filters and gates. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.functions import text as T
from gleanings.session import written


def age_verdict(at: Column, now: Column, days: int | None) -> Column:
    """kept, no_date or too_old; without days everything is kept."""
    if not days:
        return F.lit("kept")
    return F.when(at.isNull(), "no_date").when(at >= now - F.expr(f"interval {int(days)} days"), "kept").otherwise("too_old")


def filter_by_age(df: DataFrame, at: str, now: Column, days: int | None) -> DataFrame:
    return df.filter(age_verdict(F.col(at), now, days) == "kept")


def filter_by_age_relaxed(df: DataFrame, key: str, at: str, now: Column, days: int, min_keep: int = 2) -> DataFrame:
    """Within each key the fresh rows, or all rows, flagged, where fewer than min_keep are fresh."""
    fresh = age_verdict(F.col(at), now, days) == "kept"
    n = F.sum(fresh.cast("int")).over(W.partitionBy(key))
    return df.withColumn("time_range_relaxed", n < min_keep).filter(fresh | F.col("time_range_relaxed"))


def cap_per_source(df: DataFrame, source: str, order: str, n: int | None) -> DataFrame:
    """The first n rows of each source; null: all."""
    if n is None:
        return df
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(source).orderBy(order))).filter(F.col("_rn") <= n).drop("_rn")


def cap_run(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    return df.orderBy(order).limit(n)


def hits_for_query(hits: DataFrame, queries: DataFrame, strict: bool = False) -> DataFrame:
    """hits (query_id, hit_id, title, snippet) that match their query (query_id, query).

    A query's Latin terms and pairs of CJK characters are looked for in the hit. One Latin term is enough, or two pairs (one if there is
    but one). A query without either keeps everything, and so does one without pairs, unless strict.
    """
    low = F.lower("query")
    latin = F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-z0-9]{2,})"), F.lit(1)))
    runs = F.regexp_extract_all(low, F.lit(r"([㐀-鿿]{2,})"), F.lit(1))
    bigrams = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    terms = queries.select("query_id", latin.alias("latin"), bigrams.alias("pairs"))
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    joined = hits.join(terms, "query_id").withColumn("_hay", hay)
    found = lambda c: F.size(F.filter(c, lambda t: F.contains(F.col("_hay"), t)))
    need = F.least(F.lit(2), F.size("pairs"))
    by_pairs = (found("pairs") >= need) & ((F.size("pairs") > 0) if strict else F.lit(True))
    return joined.filter((found("latin") >= 1) | by_pairs | ((F.size("latin") == 0) & (F.size("pairs") == 0))).drop("_hay", "latin", "pairs")


def chunked(df: DataFrame, order: str, n: int, partitions_by: list[str] | None = None) -> DataFrame:
    """Fixed chunks in order: chunk (from 0) and slot within it. With keys, each key is chunked for itself."""
    keys = partitions_by or []
    if keys:
        rn = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
        return df.withColumn("chunk", F.floor(rn / n).cast("long")).withColumn("slot", (rn % n).cast("int"))
    placed = numbered(df, order)
    return placed.withColumn("chunk", F.floor(F.col("_no") / n).cast("long")).withColumn("slot", (F.col("_no") % n).cast("int")).drop("_no")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """_no from 0 in the order of a column without ties, without gathering all rows: Spark cuts the order into ranges of like size, whose totals
    are summed first; then come places within a range."""
    ranged = written(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # one row a range
    begins = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("_in", within).join(begins, "_range").withColumn("_no", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def numbered_within(df: DataFrame, group: str, order: str) -> DataFrame:
    """_no from 0 in the order of a column within each value of ``group`` (null is one), however many rows it has: numbered(), for groups that ranges may cut."""
    ranged = written(df.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_g").orderBy("_r").rowsBetween(W.unboundedPreceding, -1))  # one row a range
    begins = parts.select("_g", "_r", F.coalesce(before, F.lit(0)).alias("_before"))
    within = ranged.withColumn("_in", F.row_number().over(W.partitionBy("_range", group).orderBy(order)) - 1)
    joined = within.join(begins, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("_no", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before", "_g", "_r")


def relevance_gate(articles: DataFrame, replies: DataFrame, order: str, chunk: int = 8) -> DataFrame:
    """Articles that the replies (chunk, reply) keep: a reply lists slots of its chunk; without a readable reply the whole chunk stays."""
    numbered = chunked(articles, order, chunk)
    read = replies.select("chunk", T.parse_indexes(F.col("reply")).alias("_kept"))
    return numbered.join(read, "chunk", "left").filter(F.col("_kept").isNull() | F.array_contains("_kept", F.col("slot"))).drop("_kept")


def required_length(source_chars: Column) -> Column:
    """Least length of a rewritten body."""
    fifth = F.floor(source_chars * 0.2)
    return F.when(source_chars < 300, 0).when(source_chars < 1500, source_chars).otherwise(F.least(F.greatest(fifth, F.lit(1500)), F.lit(3000))).cast("long")


# Least lengths of a synthesis by the depth that was asked for.
SYNTHESIS_FLOORS = {"beginner": 500, "intermediate": 600, "advanced": 800}


def synthesis_floor(depth: Column) -> Column:
    """Least length of a synthesised body; 0 where no depth was asked for."""
    return F.coalesce(*[F.when(depth == name, n) for name, n in SYNTHESIS_FLOORS.items()], F.lit(0))


def list_filter(df: DataFrame, **equal) -> DataFrame:
    """Equality predicates joined by AND; those that are None are left out."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def preflight(chapters: DataFrame, hits: DataFrame, retried: DataFrame, min_hits: int = 4) -> DataFrame:
    """chapters (chapter_id, title) with the hits of their query set, or of the retried one where it found strictly more, and thin."""
    first = hits.groupBy("chapter_id").agg(F.count("*").alias("n1"))
    again = retried.groupBy("chapter_id").agg(F.count("*").alias("n2"))
    joined = chapters.join(first, "chapter_id", "left").join(again, "chapter_id", "left").fillna(0, ["n1", "n2"])
    n = F.when((F.col("n1") < min_hits) & (F.col("n2") > F.col("n1")), F.col("n2")).otherwise(F.col("n1"))
    return joined.select("chapter_id", "title", n.alias("n_hits"), (n < min_hits).alias("thin"))


def first_nonempty_wave(hits: DataFrame) -> DataFrame:
    """hits (query_id, wave, relevant): those of each query's lowest wave that has a relevant one."""
    lowest = F.min(F.when(F.col("relevant"), F.col("wave"))).over(W.partitionBy("query_id"))
    return hits.withColumn("_w", lowest).filter("wave = _w and relevant").drop("_w")


def source_search(sources: DataFrame, needle: str | None = None, topic: str | None = None, mode: str | None = None, **equal) -> DataFrame:
    """Sources (name, url, type, topics, mode): keyword_search over name and url, those that have the topic, and those to be scraped in the
    mode (other types have none and stay), by name."""
    found = keyword_search(sources, needle, ["name", "url"], **equal)
    if topic is not None:
        found = found.filter(F.array_contains("topics", topic))
    if mode is not None:
        found = found.filter((F.col("type") != "scrape") | (F.col("mode") == mode))
    return found.orderBy("name")


def keyword_search(df: DataFrame, needle: str | None, columns: list[str], **equal) -> DataFrame:
    """Case-insensitive substring over any of the columns; a blank needle keeps all."""
    n = (needle or "").strip().lower()
    if n:
        any_of = F.lit(False)
        for c in columns:
            any_of = any_of | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(n))
        df = df.filter(any_of)
    return list_filter(df, **equal)
