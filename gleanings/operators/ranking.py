"""Ranking, paging and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recent_page(df: DataFrame, at: Column, tie: str, limit: int = 60, offset: int = 0) -> DataFrame:
    """One page, newest first; limit between 1 and 200."""
    limit, offset = min(max(limit, 1), 200), max(offset, 0)
    return df.orderBy(at.desc(), F.col(tie).desc()).offset(offset).limit(limit)


def page_with_more(df: DataFrame, at: Column, tie: str, limit: int = 60, offset: int = 0) -> DataFrame:
    """recent_page() and has_more: whether rows follow the page."""
    limit, offset = min(max(limit, 1), 200), max(offset, 0)
    order = [at.desc(), F.col(tie).desc()]
    some = df.orderBy(*order).offset(offset).limit(limit + 1)  # a page and one row
    placed = some.withColumn("_n", F.row_number().over(W.orderBy(*order))).withColumn("has_more", F.count("*").over(W.partitionBy()) > limit)
    return placed.filter(F.col("_n") <= limit).drop("_n")


def recent(df: DataFrame, at: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(n)


def topic_terms_of(topic: str) -> list[str]:
    """Latin terms of two characters or more, pairs of CJK characters and single CJK characters of a topic."""
    import re

    low = topic.lower()
    runs = re.findall("[一-鿿]+", low)
    found = re.findall("[a-z0-9]{2,}", low) + [r[i : i + 2] for r in runs for i in range(len(r) - 1)] + [c for r in runs for c in r]
    return list(dict.fromkeys(found))


def occurrences(text: Column, term: Column | str) -> Column:
    """How often a term stands in a text, without overlaps."""
    t = F.lit(term) if isinstance(term, str) else term
    return ((F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t)).cast("int")


def lexical_score(title: Column, body: Column, terms: list[str]) -> Column:
    """8 for each term in the title, 1 in the first 4,000 characters of the body, and up to 4 for length."""
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 4000))
    out = F.least(F.length(b) / F.lit(1000.0), F.lit(4.0))
    for term in terms:
        out = out + 8 * occurrences(t, term) + occurrences(b, term)
    return out


def rank_by_topic(articles: DataFrame, title: Column, body: Column, topic: str, order: str, scores: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Articles with outside score (0 where none) and lexical score, and their order by both, then by the input order."""
    rows = articles.withColumn("lexical", lexical_score(title, body, topic_terms_of(topic)))
    rows = rows.join(scores.select(key, F.col("score").alias("outside")), key, "left") if scores is not None else rows.withColumn("outside", F.lit(0.0))
    return rows.withColumn("outside", F.coalesce("outside", F.lit(0.0))).withColumn("rank", F.struct((-F.col("outside")).alias("o"), (-F.col("lexical")).alias("l"), F.col(order).alias("i")))


def draft_listing(drafts: DataFrame, status: str | None = None, limit: int = 60, offset: int = 0) -> DataFrame:
    """drafts (draft_id, title_cn, title_candidates, status, origin, updated_at) -> one page with display title, time in UTC+8 and
    the total of all pages."""
    kept = drafts if status is None else drafts.filter(F.col("status") == status)
    total = kept.agg(F.count("*").alias("total"))  # one row
    page = recent_page(kept, F.col("updated_at"), "draft_id", limit, offset).join(F.broadcast(total), F.col("total") > 0)
    title = F.coalesce(F.nullif(F.trim("title_cn"), F.lit("")), F.get("title_candidates", F.lit(0)), F.lit(""))
    shown = F.date_format(F.from_utc_timestamp("updated_at", "Asia/Shanghai"), "yyyy-MM-dd HH:mm")
    return page.select("draft_id", title.alias("title"), "status", F.coalesce("origin", F.lit("rewrite")).alias("origin"), shown.alias("shown_at"), "total")
