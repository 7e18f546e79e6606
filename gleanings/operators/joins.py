"""Joins between articles, drafts, series and their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.functions import html as H
from gleanings.functions import urls
from gleanings.operators.dedup import first_per
from gleanings.session import written


def drafts_with_articles(drafts: DataFrame, articles: DataFrame, status: str | None = None) -> DataFrame:
    """Drafts with the columns of their article, if it exists."""
    kept = drafts if status is None else drafts.filter(F.col("status") == status)
    return kept.join(articles, "article_id", "left")


def series_source_urls(bridge: DataFrame, drafts: DataFrame, articles: DataFrame, exclude_draft: int | None = None) -> DataFrame:
    """Distinct (series_id, url) of the articles behind a series' drafts."""
    d = drafts if exclude_draft is None else drafts.filter(F.col("draft_id") != exclude_draft)
    return bridge.join(d.select("draft_id", "series_id"), "draft_id").join(articles.select("article_id", "url"), "article_id").select("series_id", "url").distinct()


def build_bridge(drafts: DataFrame) -> DataFrame:
    """drafts (draft_id, sources: article_id, rank, role) -> one row for each (draft, article)."""
    each = drafts.select("draft_id", F.posexplode("sources").alias("pos", "s")).filter("s.article_id is not null")
    role = F.coalesce(F.nullif(F.col("s.role"), F.lit("")), F.when(F.col("pos") == 0, "primary").otherwise("source"))
    rows = each.select("draft_id", F.col("s.article_id").alias("article_id"), F.coalesce(F.col("s.rank"), F.col("pos") + 1).alias("rank"), role.alias("role"), "pos")
    return first_per(rows, ["draft_id", "article_id"], "pos").drop("pos")


def draft_of_article(drafts: DataFrame) -> DataFrame:
    """First and current draft of each article that has one."""
    return drafts.groupBy("article_id").agg(F.min("draft_id").alias("first_draft"), F.max("draft_id").alias("current_draft"))


def keyword_pattern(word: str, boundary_up_to: int = 4) -> str:
    """A keyword as a pattern: short ones stand alone between non-word characters, longer ones match anywhere."""
    quoted = "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in word.lower())
    edge = r"[\p{L}\p{N}_]"
    return rf"(?<!{edge}){quoted}(?!{edge})" if len(word) <= boundary_up_to else quoted


def classify_topics(articles: DataFrame, topics: list[tuple[str, list[str]]], body: Column, replies: DataFrame | None = None, id_column: str = "doc_id") -> DataFrame:
    """id and topic: the first topic, in order, of which a keyword is in the lower-cased text; else what the reply names; else uncategorized.

    The topics are a short configuration, so each is one alternation that is compiled once a task.
    """
    low = F.lower(body)
    hit = F.coalesce(*[F.when(low.rlike("|".join(keyword_pattern(k) for k in words)), name) for name, words in topics if words], F.lit(None).cast("string"))
    found = articles.select(id_column, hit.alias("hit"))
    if replies is not None:
        said = F.trim(F.regexp_replace(F.col("reply"), "[\"'`。.]", ""))
        exact = F.coalesce(*[F.when((F.col("reply") == n) | (said == n), n) for n, _ in topics], F.lit(None).cast("string"))
        part = F.coalesce(*[F.when(F.contains(said, F.lit(n)), n) for n in sorted((n for n, _ in topics), key=lambda n: (-len(n), n))], F.lit(None).cast("string"))
        found = found.join(replies.select(id_column, F.coalesce(exact, part).alias("said")), id_column, "left")
    else:
        found = found.withColumn("said", F.lit(None).cast("string"))
    return found.select(id_column, F.coalesce("hit", "said", F.lit("uncategorized")).alias("topic"))


def localize_urls(articles: DataFrame, url_map: DataFrame, id_column: str = "id", body_prefix: str = "") -> DataFrame:
    """Remote addresses in body, images and videos that the map (remote, local) has, replaced; others stay. Longer addresses go first in the
    body, where local ones may get a prefix (a relative path)."""
    lists = [c for c in ("images", "videos") if c in articles.columns]
    named = F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists], H.body_media(F.coalesce("body", F.lit("")))))
    wanted = articles.select(id_column, F.explode(named).alias("remote")).join(url_map, "remote")
    maps = wanted.groupBy(id_column).agg(F.array_sort(F.collect_set(F.struct((-F.length("remote")).alias("n"), "remote", "local"))).alias("_m"))
    joined = articles.join(maps, id_column, "left")
    none = F.expr("cast(array() as array<struct<n:int,remote:string,local:string>>)")
    # addresses get a mark first, so that none is looked for inside the local name of another
    marked = F.aggregate(F.coalesce("_m", none), F.col("body"), lambda t, m: F.replace(t, m["remote"], F.concat(F.lit("\x02"), F.md5(m["remote"].cast("binary")), F.lit("\x02"))))
    swapped = F.aggregate(F.coalesce("_m", none), marked, lambda t, m: F.replace(t, F.concat(F.lit("\x02"), F.md5(m["remote"].cast("binary")), F.lit("\x02")), F.concat(F.lit(body_prefix), m["local"])))
    found = lambda u: F.get(F.filter(F.col("_m"), lambda m: m["remote"] == u), F.lit(0))["local"]
    return joined.withColumns({"body": swapped, **{c: F.transform(c, lambda u: F.coalesce(found(u), u)) for c in lists}}).drop("_m")


def resolve_image_refs(drafts: DataFrame, manifest: DataFrame) -> DataFrame:
    """drafts (draft_id, body): [[IMG:n]] replaced by the manifest's (draft_id, n, url) picture, or removed; resolved and dropped numbers."""
    entries = manifest.groupBy("draft_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("string"), "url"))).alias("_m"))
    joined = drafts.join(entries, "draft_id", "left")
    numbers = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\[IMG:(\d+)\]\]"), F.lit(1)))
    known = F.coalesce(F.map_keys("_m"), F.array().cast("array<string>"))
    body = F.aggregate(numbers, F.col("body"), lambda t, n: F.replace(t, F.concat(F.lit("[[IMG:"), n, F.lit("]]")), F.coalesce(F.concat(F.lit("![]("), F.try_element_at(F.col("_m"), n), F.lit(")")), F.lit(""))))
    return joined.select("draft_id", F.regexp_replace(body, r"\n{3,}", "\n\n").alias("body"), F.array_intersect(numbers, known).alias("resolved"), F.array_except(numbers, known).alias("dropped"))


def citation_links(drafts: DataFrame) -> DataFrame:
    """drafts (draft_id, sources, citations) -> draft_id, claim, source_no and url of every valid, distinct citation."""
    claims = drafts.select("draft_id", "sources", F.posexplode("citations").alias("claim_no", "c")).filter("trim(c.claim) <> ''")
    each = claims.select("draft_id", "claim_no", F.col("c.claim").alias("claim"), F.explode(F.array_distinct("c.source_indexes")).alias("source_no"), "sources")
    return each.filter("source_no between 1 and size(sources)").select("draft_id", "claim_no", "claim", "source_no", F.element_at("sources", F.col("source_no"))["url"].alias("url"))


def prerequisite_links(chapters: DataFrame) -> DataFrame:
    """chapters (series_id, chapter_order, title, prerequisites) -> each prerequisite with the earlier chapter of that title, if any."""
    wants = chapters.select("series_id", "chapter_order", F.explode("prerequisites").alias("wanted"))
    has = chapters.select(F.col("series_id").alias("s"), F.col("chapter_order").alias("earlier"), F.col("title").alias("t"))
    joined = wants.join(has, (F.col("series_id") == F.col("s")) & (F.col("wanted") == F.col("t")) & (F.col("earlier") < F.col("chapter_order")), "left")
    return joined.groupBy("series_id", "chapter_order", "wanted").agg(F.min("earlier").alias("linked_order"))


def delete_cascade(parents: DataFrame, children: DataFrame, ids: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of the given ids."""
    gone = ids.select(parent_key).distinct()
    return parents.join(gone, parent_key, "left_anti"), children.join(gone.withColumnRenamed(parent_key, child_key), child_key, "left_anti")


def delete_series(series: DataFrame, drafts: DataFrame, chapters: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Series, drafts and chapters without those of the given series ids, and one row with the number of rows gone of each."""
    gone = ids.select("series_id").distinct()
    kept = [df.join(gone, "series_id", "left_anti") for df in (series, drafts, chapters)]
    counts = [df.join(gone, "series_id", "left_semi").agg(F.count("*").alias("n")).withColumn("of", F.lit(of)) for df, of in ((series, "series"), (drafts, "drafts"), (chapters, "chapters"))]
    return *kept, counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy().pivot("of", ["series", "drafts", "chapters"]).agg(F.first("n"))


def delete_stored_series(tables: list, ids: DataFrame, key: str = "series_id") -> None:
    """delete_series() on tables stored by the series (sources.stored.KeyedTable): only the buckets of the given ids are read and written.

    The first table has the series themselves and goes last, so a deletion that fails halfway can be run again.
    """
    gone = written(ids.select(key).distinct())
    for stored in reversed(tables):
        stored.delete(gone)


def widen_references(primary: DataFrame, widened: DataFrame, k: int, least: int = 2) -> DataFrame:
    """refs (group, ord, url): groups with fewer than ``least`` get the widened ones with a new URL key after their own, then the first k."""
    p = primary.withColumn("url_key", urls.url_key(F.col("url"))).withColumn("widened", F.lit(False))
    n = p.groupBy("group").agg(F.count("*").alias("_n"))
    w = first_per(widened.withColumn("url_key", urls.url_key(F.col("url"))), ["group", "url_key"], "ord").join(n, "group", "left").filter(F.coalesce("_n", F.lit(0)) < least).drop("_n")
    w = w.join(p.select("group", "url_key"), ["group", "url_key"], "left_anti").withColumn("widened", F.lit(True))
    both = p.unionByName(w)
    return both.withColumn("place", F.row_number().over(W.partitionBy("group").orderBy("widened", "ord"))).filter(F.col("place") <= k)


def sync_title_scores(drafts: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """drafts (draft_id, title_candidates, title_scores): scores renamed with their titles, and only those of candidates kept."""
    rows = drafts
    if renames is not None:
        maps = renames.groupBy("draft_id").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_m"))
        rows = rows.join(maps, "draft_id", "left")
        new = lambda t: F.coalesce(F.try_element_at("_m", t), t)
        rows = rows.withColumn("title_candidates", F.transform("title_candidates", new)).withColumn("title_scores", F.transform("title_scores", lambda s: s.withField("title", new(s["title"])))).drop("_m")
    return rows.withColumn("title_scores", F.filter("title_scores", lambda s: F.array_contains("title_candidates", s["title"])))
