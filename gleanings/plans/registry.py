"""Registered queries of the curation operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with its DuckDB twin if there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top diverse article candidates: crawled pages, one for each address, that hold an article, scored, and no host more than twice in front."""
    from pyspark.sql import functions as F

    from gleanings.functions import urls
    from gleanings.operators import dedup, quality, windows
    from gleanings.session import table
    from gleanings.sources import io

    pages = table(spark, sf_dir, "pages")
    articles = io.extract_articles(dedup.dedup_exact(pages, "page_id").select("page_id", "url", "html"))
    score = quality.heuristic_score(F.col("title"), F.lit(None).cast("string"), F.col("content_md"), F.lit(None).cast("timestamp"), F.lit("2024-01-01").cast("timestamp"), ["licensed"])
    rows = articles.select("page_id", "url", "title", urls.host(F.col("url")).alias("source"), score.alias("score"), F.length("content_md").alias("n_chars"))
    ranked = rows.withColumn("rank", F.struct((-F.col("score")).alias("s"), (-F.col("n_chars")).alias("n"), "page_id"))
    return windows.source_diverse_topk(ranked, 100).select("page_id", "url", "title", "source", "score", "n_chars")
