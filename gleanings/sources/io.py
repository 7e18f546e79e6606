"""Sources and sinks: feeds, archives, failure logs, configuration and series documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanings.functions import html as H
from gleanings.functions import urls
from gleanings.functions.dates import parse_date
from gleanings.functions.text import demote_headings, strip_nav

_TEXT = T.StringType()
_LINK = T.ArrayType(T.StructType([T.StructField("_VALUE", _TEXT), T.StructField("_href", _TEXT), T.StructField("_rel", _TEXT)]))
_RICH = T.StructType([T.StructField("_VALUE", _TEXT), T.StructField("_type", _TEXT)])
#: Entries of RSS ("item") and Atom ("entry"): bodies as content:encoded, content, description or summary, links as text or as href.
_ITEM = T.StructType(
    [
        T.StructField("title", _RICH),
        T.StructField("link", _LINK),
        T.StructField("content:encoded", _TEXT),
        T.StructField("content", _RICH),
        T.StructField("description", _TEXT),
        T.StructField("summary", _RICH),
        T.StructField("pubDate", _TEXT),
        T.StructField("published", _TEXT),
        T.StructField("updated", _TEXT),
        T.StructField("dc:date", _TEXT),
    ]
)


def read_feed_items(spark: SparkSession, path: str, source_name: str, pages: DataFrame | None = None, row_tag: str = "item") -> DataFrame:
    """One article for each entry of RSS (row_tag "item") or Atom ("entry") files.

    The body is the content, else the summary; a page body (link, body) replaces it if it is more than 1.5 times as long. Of an Atom entry's
    links the one to the article counts, that without a relation or with "alternate". Media of the body are resolved against the link.
    """
    raw = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").option("valueTag", "_VALUE").schema(_ITEM).load(path)
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    summary = F.coalesce(some(F.col("description")), some(F.col("summary._VALUE")))
    body = F.coalesce(some(F.col("content:encoded")), some(F.col("content._VALUE")), summary, F.lit(""))
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(*[some(F.get(own, F.lit(0))[f]) for f in ("_href", "_VALUE")], some(F.get("link", F.lit(0))["_href"]), F.lit(""))
    at = F.coalesce(parse_date(F.coalesce("pubDate", "published", "dc:date")), parse_date(F.col("updated")))
    items = raw.select(F.coalesce(F.trim("title._VALUE"), F.lit("")).alias("title"), link.alias("url"), body.alias("content_md"), summary.alias("raw_summary"), at.alias("published_at"), F.lit(source_name).alias("source_name"), F.lit("rss").alias("source_type"))
    if pages is not None:
        joined = items.join(pages.select(F.col("link").alias("url"), F.col("body").alias("_page")), "url", "left")
        items = joined.withColumn("content_md", F.when(F.length("_page") > 1.5 * F.length("content_md"), F.col("_page")).otherwise(F.col("content_md"))).drop("_page")
    return items.withColumns({"images": H.images(F.col("content_md"), F.col("url")), "videos": H.videos(F.col("content_md"), F.col("url"))})


def extract_articles(pages: DataFrame, now: Column | None = None) -> DataFrame:
    """pages (page_id, url, html) -> article rows; those that look like no article are dropped."""
    html = F.col("html")
    title = F.coalesce(F.nullif(H.page_title(html), F.lit("")), F.col("url"))
    rows = pages.select("page_id", "url", title.alias("title"), H.paragraph_text(html).alias("content_md"), H.images(html, F.col("url")).alias("images"), H.videos(html, F.col("url")).alias("videos"), (H.published_at(html, now) if now is not None else F.lit(None).cast("timestamp")).alias("published_at"), F.lit("scrape").alias("source_type"))
    return rows.filter(H.is_article(F.col("title"), F.col("content_md")))


def archive_path(topic: Column, at: Column, title: Column, fingerprint: Column) -> Column:
    """topic folder / yyyymmdd-slug; an untitled one carries 8 characters of its fingerprint."""
    slug = F.substring(urls.slugify(title), 1, 60)
    name = F.when(slug == "untitled", F.concat(slug, F.lit("-"), F.substring(fingerprint, 1, 8))).otherwise(slug)
    return F.concat(urls.safe_dir_name(topic), F.lit("/"), F.date_format(at, "yyyyMMdd"), F.lit("-"), name)


def with_archive_path(articles: DataFrame) -> DataFrame:
    at = F.coalesce("published_at", "fetched_at")
    return articles.withColumn("topic_dir", urls.safe_dir_name(F.col("topic"))).withColumn("archive_path", archive_path(F.col("topic"), at, F.col("title"), urls.fingerprint(F.col("url"))))


def write_archive(articles: DataFrame, path: str) -> None:
    """Parquet by topic folder, bodies inline."""
    with_archive_path(articles).write.mode("append").partitionBy("topic_dir").parquet(path)


def read_archive(spark: SparkSession, path: str, topic: str | None = None, source: str | None = None) -> DataFrame:
    """Archived rows; the topic prunes partitions, the source is pushed to the scan."""
    df = spark.read.parquet(path)
    if topic is not None:
        df = df.filter(F.col("topic_dir") == urls.safe_dir_name(F.lit(topic)))
    return df if source is None else df.filter(F.col("source_name") == source)


def failure_records(df: DataFrame) -> DataFrame:
    """timestamp, source_name, source_type, url, error_type, status_code, error_message, response_snippet (up to 200 characters)."""
    return df.withColumn("response_snippet", F.substring("response_snippet", 1, 200))


def media_failure_records(df: DataFrame) -> DataFrame:
    """The second log, of media: timestamp, url, source_url, media_type, error, downloader and skipped (failures that are none: not tried on purpose)."""
    return df.select("timestamp", "url", "source_url", "media_type", F.substring("error", 1, 500).alias("error"), "downloader", F.coalesce("skipped", F.lit(False)).alias("skipped"))


def compact_failures(spark: SparkSession, path: str, into: str, n: int = 10_000) -> None:
    """The newest n records of a log written to another folder, from where they replace the log."""
    failure_tail(spark.read.json(path), n).write.mode("overwrite").json(into)


def append_failures(df: DataFrame, path: str) -> None:
    failure_records(df).write.mode("append").json(path)


def failure_tail(df: DataFrame, n: int = 10_000, at: str = "timestamp", tie: str = "url") -> DataFrame:
    """The newest n records."""
    return df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(n)


_CONFIG = "version int, topics array<struct<name: string, keywords: array<string>>>, sources array<struct<name: string, type: string, url: string, topics: array<string>, mode: string, include_pattern: string, exclude_pattern: string, max_pages: int, render_js: boolean, enabled: boolean>>, settings map<string, string>"


def read_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics, sources and settings of a configuration file; nameless topics, incomplete sources, null settings and API keys are dropped."""
    raw = spark.read.option("multiLine", "true").schema(_CONFIG).json(path)
    topics = raw.select(F.posexplode("topics").alias("ord", "t")).select("ord", "t.*").filter("trim(name) <> ''")
    sources = raw.select(F.explode("sources").alias("s")).select("s.*").filter("trim(name) <> '' and trim(url) <> ''")
    sources = sources.withColumn("type", F.coalesce("type", F.lit("rss"))).withColumn("mode", F.coalesce("mode", F.lit("single"))).withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    settings = raw.select(F.explode("settings").alias("key", "value")).filter("value is not null and not endswith(key, '_api_key')")
    return topics, sources, settings


def export_config(topics: DataFrame, sources: DataFrame, settings: DataFrame, version: int = 1) -> DataFrame:
    """One JSON document of all three."""
    t = topics.agg(F.array_sort(F.collect_list(F.struct("ord", "name", "keywords"))).alias("topics"))
    s = sources.agg(F.array_sort(F.collect_list(F.struct(*sources.columns))).alias("sources"))
    k = settings.filter("not endswith(key, '_api_key')").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))
    return t.crossJoin(s).crossJoin(k).select(F.to_json(F.struct(F.lit(version).alias("version"), F.transform("topics", lambda x: F.struct(x["name"].alias("name"), x["keywords"].alias("keywords"))).alias("topics"), "sources", "settings")).alias("json"))


def compile_series(series: DataFrame, chapters: DataFrame, nav_opening: str = "This is part", sources: DataFrame | None = None, outlines: DataFrame | None = None) -> DataFrame:
    """series (series_id, topic), chapters (series_id, chapter_order, title, body) -> one document: contents, then chapters in order,
    with headings one level down and navigation quotes removed; behind the contents the series' outline (series_id, outline), and behind
    a chapter its numbered sources (series_id, chapter_order, no, title, url), where these are given."""
    body = demote_headings(strip_nav(F.coalesce("body", F.lit("")), nav_opening))
    parts = chapters.select("series_id", "chapter_order", "title", body.alias("body"))
    if sources is not None:
        line = F.concat(F.col("no").cast("string"), F.lit(". ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"))
        cited = sources.groupBy("series_id", "chapter_order").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"]), "\n").alias("_s"))
        parts = parts.join(cited, ["series_id", "chapter_order"], "left").withColumn("body", F.concat("body", F.coalesce(F.concat(F.lit("\n\n### Sources\n\n"), "_s"), F.lit("")))).drop("_s")
    ordered = F.array_sort(F.collect_list(F.struct("chapter_order", "title", "body")))
    docs = parts.groupBy("series_id").agg(ordered.alias("c"))
    contents = F.array_join(F.transform("c", lambda x: F.concat(F.lit("- "), x["title"])), "\n")
    bodies = F.array_join(F.transform("c", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["body"])), "\n\n")
    joined = series.join(docs, "series_id")
    joined = joined.join(outlines, "series_id", "left") if outlines is not None else joined.withColumn("outline", F.lit(None).cast("string"))
    outline = F.coalesce(F.concat(F.col("outline"), F.lit("\n\n")), F.lit(""))
    return joined.select("series_id", F.concat(F.lit("# "), "topic", F.lit("\n\n"), contents, F.lit("\n\n"), outline, bodies).alias("document"))
