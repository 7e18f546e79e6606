"""Operators that look at rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.functions import urls
from gleanings.operators.filters import numbered_within


def source_diverse_topk(ranked: DataFrame, k: int, source: str = "source", rank: str = "rank", per_source: int = 2, keys: list[str] | None = None) -> DataFrame:
    """The first k rows where third and later rows of a source wait until all others are served. With keys, k for each key.

    Rows must have distinct ranks. Nobody needs a late row's place in its source. The first rows of each source are a filter on the row
    number, which Spark applies before the shuffle too. The late rows that are served are among the first k rows of all, and so are all
    rows of their sources in front of them; so a source with very many rows is never sorted.
    """
    keys = keys or []
    own = F.row_number().over(W.partitionBy(*keys, F.lower(F.col(source))).orderBy(rank))

    def first(df: DataFrame, *order: str) -> DataFrame:
        if not keys:
            return df.orderBy(*order).limit(k)
        return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")

    early = first(ranked.withColumn("_n", own).filter(F.col("_n") <= per_source).drop("_n"), rank)
    late = first(ranked, rank).withColumn("_n", own).filter(F.col("_n") > per_source).drop("_n")
    return first(early.withColumn("_late", F.lit(False)).unionByName(late.withColumn("_late", F.lit(True))), "_late", rank).drop("_late")


def rank_titles(candidates: DataFrame, n: int = 5, longest: int = 30) -> DataFrame:
    """candidates (draft_id, ord, title, score, reason) -> the n best distinct titles: not too long, by score, in order."""
    t = candidates.withColumn("title", F.trim("title")).filter("title <> ''")
    t = t.withColumn("_d", F.row_number().over(W.partitionBy("draft_id", "title").orderBy("ord"))).filter("_d = 1").drop("_d")
    t = t.withColumn("score", F.bround(F.coalesce("score", F.lit(0.0)), 2)).withColumn("reason", F.substring("reason", 1, 120))
    order = W.partitionBy("draft_id").orderBy(F.length("title") > longest, F.col("score").desc(), "ord")
    return t.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def grounding_sample(hits: DataFrame, per_domain: int = 2, budget: int = 6000) -> DataFrame:
    """hits (query_id, rank, title, snippet, url) -> lines of at most per_domain hits of a domain, up to the first that overflows the budget."""
    domain = F.regexp_replace(F.lower(urls.netloc(F.col("url"))), r"^www\.", "")
    line = F.concat(F.lit("- "), "title", F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("："), F.substring("snippet", 1, 180))).otherwise(""))
    some = hits.withColumn("_d", domain).withColumn("_n", F.row_number().over(W.partitionBy("query_id", "_d").orderBy("rank"))).filter(F.col("_n") <= per_domain)
    used = F.sum(F.length("line")).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return some.withColumn("line", line).withColumn("used", used).filter(F.col("used") <= budget).select("query_id", "rank", "line", "used")


def source_budget(articles: DataFrame, key: str, order: str, chars, per: int = 2500, total: int = 18000) -> DataFrame:
    """given: characters each source may use; each takes its length up to per until the total is used up."""
    want = F.least(chars, F.lit(per))
    before = F.coalesce(F.sum("_want").over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return articles.withColumn("_want", want).withColumn("given", F.greatest(F.lit(0), F.least("_want", F.lit(total) - before)).cast("long")).drop("_want")


def image_manifest(articles: DataFrame, most: int = 12) -> DataFrame:
    """articles (draft_id, source_no, images) -> draft_id, n, source_no, url: usable pictures numbered through the draft."""
    each = articles.select("draft_id", "source_no", F.posexplode("images").alias("pos", "url")).filter(F.col("url").rlike("(?i)^https?://") & ~urls.is_furniture(F.col("url")))
    some = each.withColumn("_i", F.row_number().over(W.partitionBy("draft_id", "source_no").orderBy("pos"))).filter(F.col("_i") <= most)
    return some.select("draft_id", (F.row_number().over(W.partitionBy("draft_id").orderBy("source_no", "pos")) - 1).alias("n"), "source_no", "url")


def series_nav(chapters: DataFrame) -> DataFrame:
    """chapters (series_id, chapter_order, title) -> part, parts, previous and next title; series of one chapter have none."""
    s = W.partitionBy("series_id")
    o = s.orderBy("chapter_order")
    rows = chapters.select(
        "series_id", "chapter_order", "title", F.row_number().over(o).cast("long").alias("part"), F.count("*").over(s).alias("parts"), F.lag("title").over(o).alias("previous_title"), F.lead("title").over(o).alias("next_title")
    )
    return rows.filter("parts >= 2")


def series_context(chapters: DataFrame) -> DataFrame:
    """chapters (series_id, chapter_order, title, summary, status) -> the earlier done chapters in order, next title, opener and closer."""
    o = W.partitionBy("series_id").orderBy("chapter_order")
    done = F.when(F.col("status") == "done", F.concat_ws(": ", "title", "summary"))
    whole = F.collect_list(done).over(o.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # one array for all rows of a series
    before = F.coalesce(F.count(done).over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return chapters.select(
        "series_id", "chapter_order", F.array_join(F.slice(whole, F.lit(1), before), "\n").alias("context"), F.lead("title").over(o).alias("next_title"),
        F.lag("title").over(o).isNull().alias("opener"), F.lead("title").over(o).isNull().alias("closer"),
    )


def latest_op(ops: DataFrame, key: str = "op_type", at: str = "ts", tie: str = "op_id") -> DataFrame:
    """Newest row of each type."""
    return ops.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc()))).filter("_rn = 1").drop("_rn")


def running_ops(ops: DataFrame, at: str = "started_at", tie: str = "op_id") -> DataFrame:
    """Operations that still run, in the order in which they began."""
    return ops.filter("status = 'running'").orderBy(at, tie)


def log_tail(lines: DataFrame, key: str, order: str, n: int = 500) -> DataFrame:
    """Last n lines of each key."""
    return lines.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).filter(F.col("_rn") <= n).drop("_rn")


def unique_ids(names: DataFrame, name: str, order: str, existing: DataFrame) -> DataFrame:
    """new_id: the slug of each name; names that share one get -2, -3, ... after those that exist (slug)."""
    slugged = names.withColumn("slug", urls.slugify(F.col(name)))
    suffix = F.coalesce(F.regexp_extract("slug", r"-(\d+)$", 1).try_cast("int"), F.lit(1))
    held = existing.select("slug").unionByName(existing.filter(F.col("slug").rlike(r"-\d+$")).select(F.regexp_replace("slug", r"-\d+$", "").alias("slug"))).distinct()
    taken = existing.select(F.regexp_replace("slug", r"-\d+$", "").alias("slug"), suffix.alias("k")).groupBy("slug").agg(F.max("k").alias("k"))
    taken = taken.join(held, "slug", "left_semi")
    k = F.col("_no") + 1 + F.coalesce("k", F.lit(0))  # very many names may share a slug
    return numbered_within(slugged, "slug", order).join(taken, "slug", "left").withColumn("_k", k).withColumn("new_id", F.when(F.col("_k") > 1, F.concat("slug", F.lit("-"), "_k")).otherwise(F.col("slug"))).drop("k", "_k", "_no")
