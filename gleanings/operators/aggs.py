"""Aggregations: dashboards, hotness, statuses and funnels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.operators.filters import numbered_within


def dashboard_stats(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def count_filtered(df: DataFrame, **equal) -> DataFrame:
    from gleanings.operators.filters import list_filter

    return list_filter(df, **equal).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def topic_stats(articles: DataFrame, drafts: DataFrame, today: Column) -> DataFrame:
    """articles (article_id, topic, at), drafts (article_id) -> topic, total, recent (dated today or later) and drafts."""
    topic = F.coalesce(F.nullif(F.trim("topic"), F.lit("")), F.lit("unclassified"))
    n = drafts.groupBy("article_id").agg(F.count("*").alias("n"))
    return articles.join(n, "article_id", "left").groupBy(topic.alias("topic")).agg(F.count("*").alias("total"), F.count_if(F.to_date("at") >= today).alias("recent"), F.coalesce(F.sum("n"), F.lit(0)).alias("drafts"))


def source_stats(articles: DataFrame, today: Column) -> DataFrame:
    return articles.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.to_date("at") >= today).alias("recent"))


def hotness(stats: DataFrame, scores: DataFrame | None = None, web_hits: DataFrame | None = None, absent: float = 30.0, names: DataFrame | None = None) -> DataFrame:
    """stats (name, total), of all names or of those that a configuration lists -> name, total, score: an outside score (``absent`` where it has none) or twice the total up to 50, plus 3 a web hit up to 15 hits."""
    rows = stats if names is None else names.select("name").distinct().join(stats, "name", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    if scores is not None:
        rows = rows.join(scores.select("name", F.col("score").alias("_s")), "name", "left")
        base = F.when(F.col("_s").isNull(), F.lit(absent)).otherwise(F.least(F.greatest(F.col("_s"), F.lit(0.0)), F.lit(100.0)))
    else:
        base = F.least(F.col("total") * 2.0, F.lit(50.0))
    if web_hits is not None:
        rows = rows.join(web_hits.select("name", F.col("hits").alias("_h")), "name", "left")
        base = base + 3.0 * F.least(F.coalesce("_h", F.lit(0)), F.lit(15))
    return rows.select("name", "total", F.least(base, F.lit(100.0)).alias("score"))


def by_hotness(rows: DataFrame) -> DataFrame:
    """hotness() in order: score, then total, then name."""
    return rows.orderBy(F.col("score").desc(), F.col("total").desc(), "name")


def archive_by_day(articles: DataFrame, at: str, source: str, id_column: str, page: int = 500) -> DataFrame:
    """day, n (articles of the day), page (from 0) and items: all articles of the day by source, then id, ``page`` of them a row."""
    day, name = F.to_date(at), F.coalesce(F.col(source), F.lit(""))
    rows = articles.select(day.alias("day"), F.struct(name.alias("source"), F.col(id_column).alias("id")).alias("item"))
    placed = numbered_within(rows, "day", "item").withColumn("page", F.floor(F.col("_no") / page))
    items = placed.groupBy("day", "page").agg(F.array_sort(F.collect_list("item")).alias("items"))
    total = rows.groupBy(F.col("day").alias("_d")).agg(F.count("*").alias("n"))
    return items.join(total, F.col("day").eqNullSafe(F.col("_d"))).select("day", "n", "page", "items")


def sensitive_counts(hits: DataFrame) -> DataFrame:
    """hits (draft_id, word, n) of several fields -> draft_id and "word×n" in alphabetical order."""
    total = hits.groupBy("draft_id", "word").agg(F.sum("n").alias("n")).filter("n > 0")
    return total.groupBy("draft_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("word", F.lit("×"), "n"))), ", ").alias("hits"))


def series_status(series: DataFrame, chapters: DataFrame) -> DataFrame:
    """series (series_id), chapters (series_id, status) -> status, done and failed counts."""
    c = chapters.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.bool_or(F.col("status").isin("researching", "writing")).alias("busy")
    )
    status = F.when(F.col("n").isNull(), "failed").when(F.col("busy"), "running").when(F.col("done") == 0, "failed").when(F.col("done") == F.col("n"), "done").otherwise("partial")
    return series.join(c, "series_id", "left").select("series_id", status.alias("status"), F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("failed", F.lit(0)).alias("failed"))


def run_funnel(rows: DataFrame, key: str, stages: dict[str, Column]) -> DataFrame:
    """Number of rows of each run that reach each stage."""
    return rows.groupBy(key).agg(*[F.count_if(test).alias(name) for name, test in stages.items()])


def reachability(checks: DataFrame, retries: int = 3) -> DataFrame:
    """checks (source, candidate, candidate_ord, attempt, ok) -> reachable in the first attempts, and the first reachable candidate."""
    tried = checks.filter(F.col("attempt") <= retries)
    return tried.groupBy("source").agg(F.bool_or("ok").alias("reachable"), F.min_by("candidate", F.when(F.col("ok"), F.col("candidate_ord"))).alias("repaired_to"))


def reachability_totals(summary: DataFrame) -> DataFrame:
    """One row: sources checked, reachable, not reachable, and of these repaired by a candidate."""
    return summary.agg(F.count("*").alias("sources"), F.count_if("reachable").alias("reachable"), F.count_if(~F.col("reachable")).alias("unreachable"), F.count_if(F.col("repaired_to").isNotNull()).alias("repaired"))


# Texts by which failure messages are told apart, in order.
REASONS = (
    ("403 forbidden", ("403", "forbidden")),
    ("404 not found", ("404", "not found")),
    ("429 rate limited", ("429", "too many requests")),
    ("dns", ("getaddrinfo", "nameresolution", "failed to resolve", "name or service not known")),
    ("redirects", ("redirect",)),
    ("timeout", ("timed out", "timeout")),
    ("reset", ("forcibly closed", "connection reset", "10054", "closed connection", "incompleteread", "connection broken", "connection aborted")),
    ("tls", ("ssl", "certificate")),
)


def skip_reason(message: Column) -> Column:
    """Bucket of a failure message, by ordered rules."""
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("other")
    for test, reason in [(m.rlike(r"\b5[0-9][0-9]\b|server error"), "5xx"), *[(reduce(lambda a, b: a | b, [F.contains(m, F.lit(x)) for x in texts]), name) for name, texts in reversed(REASONS)]]:
        out = F.when(test, reason).otherwise(out)
    return out


def skip_reasons(failures: DataFrame) -> DataFrame:
    """failures (source, message) -> source, reason, n."""
    return failures.groupBy("source", skip_reason(F.col("message")).alias("reason")).agg(F.count("*").alias("n"))
