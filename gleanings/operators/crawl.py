"""Crawling over a table of fetched pages: accepted links, frontiers, sitemaps and image lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.functions import html as H
from gleanings.functions import urls
from gleanings.session import written


def accept_links(links: DataFrame) -> DataFrame:
    """links (link, base_host, include_pattern, exclude_pattern): same host, include text present, exclude text absent, an article."""
    return links.filter(
        (urls.netloc(F.col("link")) == F.col("base_host"))
        & (F.coalesce("include_pattern", F.lit("")).eqNullSafe("") | F.contains("link", F.col("include_pattern")))
        & (F.coalesce("exclude_pattern", F.lit("")).eqNullSafe("") | ~F.contains("link", F.col("exclude_pattern")))
        & (urls.classify_url(F.col("link")) == "article")
    )


def frontier(edges: DataFrame, seeds: DataFrame, levels: int, budget: int | None = None) -> DataFrame:
    """edges (site, src, dst), seeds (site, url) -> site, url, level of all that is reachable within the levels.

    Each level joins the last one's pages with the link table and drops what is known; its rows are written out, so plans stay short.
    With a budget each site takes at most so many new pages a level, in order of address.
    """
    level = seeds.select("site", "url", F.lit(0).alias("level"))
    known = written(level)
    last = known
    for n in range(1, levels + 1):
        found = last.join(edges, (last["url"] == edges["src"]) & (last["site"] == edges["site"])).select(edges["site"], F.col("dst").alias("url")).distinct()
        fresh = found.join(known, ["site", "url"], "left_anti").withColumn("level", F.lit(n))
        if budget is not None:
            fresh = fresh.withColumn("_rn", F.row_number().over(W.partitionBy("site").orderBy("url"))).filter(F.col("_rn") <= budget).drop("_rn")
        last = written(fresh)
        known = known.unionByName(last)
    return known


# Where sites keep sitemaps that their robots file does not name, in the order in which they are tried.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")


def sitemap_urls(docs: DataFrame, include: str | None = None, limit: int = 300, most_maps: int = 12) -> DataFrame:
    """docs (site, address, text: fetched robots files and sitemaps) -> site, loc: the first pages that a site's maps list.

    Maps are those that the robots file names, then the common paths, then what an index lists (one level); at most ``most_maps`` are
    read a site, indexes included, in this order, and at most ``limit`` addresses returned. Both limits are the feature.
    """
    # a site has few maps to start with and an index a bounded number of entries, so the windows are small
    path = urls.path(F.col("address"))
    robots = docs.filter(path == "/robots.txt").select("site", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("pos", "address"))
    common = docs.filter(path.isin(*SITEMAP_PATHS)).select("site", (F.array_position(F.array(*map(F.lit, SITEMAP_PATHS)), path) + 1_000_000).cast("int").alias("pos"), "address")
    start = robots.unionByName(common).groupBy("site", "address").agg(F.struct(F.min("pos").alias("first"), F.lit(0).alias("second")).alias("place"))
    held = docs.select("site", "address", "text")
    top = start.join(held, ["site", "address"]).withColumn("index", F.col("text").rlike("(?i)<sitemapindex"))
    listed = top.filter("index").select("site", "place", F.posexplode(H.sitemap_locs(F.col("text"))).alias("second", "address"))
    inner = listed.groupBy("site", "address").agg(F.min(F.struct((F.col("place.first") + 2_000_000).alias("first"), F.col("second"))).alias("place"))
    inner = inner.join(start.select("site", "address"), ["site", "address"], "left_anti").join(held, ["site", "address"]).withColumn("index", F.col("text").rlike("(?i)<sitemapindex"))
    read = top.unionByName(inner).withColumn("_m", F.row_number().over(W.partitionBy("site").orderBy("place", "address"))).filter(F.col("_m") <= most_maps)
    found = read.filter("not index").select("site", "_m", F.posexplode(H.sitemap_locs(F.col("text"))).alias("pos", "loc"))
    if include:
        found = found.filter(F.contains("loc", F.lit(include)))
    once = found.groupBy("site", "loc").agg(F.min(F.struct("_m", "pos")).alias("place"))
    return once.withColumn("_rn", F.row_number().over(W.partitionBy("site").orderBy("place", "loc"))).filter(F.col("_rn") <= limit).select("site", "loc")


def feed_of_site(docs: DataFrame) -> DataFrame:
    """docs (site, path_ord, url, text: what well-known paths returned) -> site and url of the first path whose document is a feed."""
    feeds = docs.filter(H.is_feed_document(F.col("text")))
    return feeds.groupBy("site").agg(F.min(F.struct("path_ord", "url")).alias("x")).select("site", "x.url")


def crawl_site(links: DataFrame, seeds: DataFrame, fallbacks: list[DataFrame] = (), max_pages: int = 3, levels: int | None = None) -> DataFrame:
    """Article addresses (site, url, way) of every site.

    links (site, src, dst) are the links of fetched pages, seeds (site, url, include_pattern, exclude_pattern) the sites. A site's pages are read
    level by level from the seed until max(10 * max_pages, 30) are read or nothing new is found; at most max(50 * budget, 2000) addresses are
    known. Of those the links that accept_links() takes count, without the seed itself (way 0). A site without any takes the first of
    the fall-backs (site, url) that has something for it: its links on one level and further pages, feeds, sitemaps (ways 1, 2, ...).
    """
    budget = max(10 * max_pages, 30)
    cap = max(50 * budget, 2000)
    known = last = written(seeds.select("site", "url", F.lit(True).alias("read")))
    level = 0
    while levels is None or level < levels:
        level += 1
        found = last.join(links.select("site", F.col("src").alias("url"), "dst"), ["site", "url"]).select("site", F.col("dst").alias("url")).distinct()
        fresh = found.join(known.select("site", "url"), ["site", "url"], "left_anti")
        held = known.groupBy("site").agg(F.count("*").alias("_held"), F.count_if("read").alias("_read"))
        numbered = fresh.withColumn("_n", F.row_number().over(W.partitionBy("site").orderBy("url"))).join(held, "site").filter(F.col("_n") + F.col("_held") <= cap)
        fresh = written(numbered.select("site", "url", (F.col("_n") + F.col("_read") <= budget).alias("read")))
        known, last = known.unionByName(fresh), fresh.filter("read")
        if last.limit(1).count() == 0:
            break
    rules = seeds.select("site", F.col("url").alias("seed"), urls.netloc(F.col("url")).alias("base_host"), "include_pattern", "exclude_pattern")
    taken = accept_links(known.select("site", F.regexp_replace("url", "/+$", "").alias("link")).distinct().join(rules, "site")).filter("link <> seed").select("site", F.col("link").alias("url"), F.lit(0).alias("way"))
    for way, more in enumerate(fallbacks, 1):
        lacking = more.select("site", "url").distinct().join(taken.select("site").distinct(), "site", "left_anti").withColumn("way", F.lit(way))
        taken = written(taken.unionByName(lacking))
    return taken


def clean_image_list(articles: DataFrame, most: int = 12, id_column: str = "page_id") -> DataFrame:
    """articles (id, images, body): furniture dropped, at most ``most`` pictures; tokens [[IMG:n]] renumbered, those of dropped pictures
    removed, and tokens of pictures that the body lacks put in front."""
    numbered = F.transform("images", lambda u, i: F.struct(i.alias("i"), u.alias("u")))
    rows = articles.withColumn("_k", F.slice(F.filter(numbered, lambda x: ~urls.is_furniture(x["u"])), 1, most))
    tokens = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\[IMG:(\d+)\]\]"), F.lit(1)))
    # old numbers get a mark first, so that a new number is never taken for an old one
    place = lambda n: F.array_position(F.transform("_k", lambda x: x["i"].cast("string")), n)
    body = F.aggregate(tokens, F.col("body"), lambda t, n: F.replace(t, F.concat(F.lit("[[IMG:"), n, F.lit("]]")), F.when(place(n) > 0, F.concat(F.lit("[[IMG=>"), (place(n) - 1).cast("string"), F.lit("]]"))).otherwise("")))
    rows = rows.withColumn("_b", F.replace(body, F.lit("[[IMG=>"), F.lit("[[IMG:")))
    missing = F.filter(F.transform("_k", lambda x, j: F.concat(F.lit("[[IMG:"), j.cast("string"), F.lit("]]"))), lambda t: ~F.contains(F.col("_b"), t))
    front = F.when(F.size(missing) > 0, F.concat(F.array_join(missing, "\n\n"), F.lit("\n\n"))).otherwise("")
    return rows.select(id_column, F.array_join(F.transform("_k", lambda x: x["u"]), "\n").alias("images"), F.concat(front, "_b").alias("body"))
