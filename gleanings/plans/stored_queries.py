"""Queries over tables that are written first and then changed, paged or read in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanings.functions import urls as U
from gleanings.operators import joins
from gleanings.plans.record_queries import _PAGE_TITLE, _pages
from gleanings.plans.registry import ORACLES, query
from gleanings.plans.web_queries import _NORM, _P
from gleanings.session import scratch, table
from gleanings.sources import io
from gleanings.sources.stored import KeyedTable, KnownArticles, OrderedTable


@query("keyed_upsert", """select o_orderkey, case when o_orderkey % 40 = 0 then 'new' else o_orderpriority end as note from orders where o_orderkey % 7 <> 0
 union all select o_orderkey, 'new' from orders where o_orderkey % 280 = 0""")
def keyed_upsert(spark, d):
    """Orders without each seventh; then some replaced, and of the missing ones some put in."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("note"))
    stored = KeyedTable(scratch(spark), ("o_orderkey",))
    stored.create(o.filter("o_orderkey % 7 <> 0"))
    stored.upsert(o.filter("o_orderkey % 40 = 0").withColumn("note", F.lit("new")))
    return stored.read(spark)


query("keyed_replace_group", ORACLES["replace_group"])(lambda spark, d: _regrouped(spark, d))


def _regrouped(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("conv_id") % 5 == 0, F.col("turn")).alias("draft_id"))
    stored = KeyedTable(scratch(spark), ("conv_id",))
    stored.create(c)
    stored.replace_group(c.filter("conv_id % 2 = 0 and role = 'user'").withColumn("role", F.lit("new")).withColumn("draft_id", F.lit(None).cast("bigint")), "turn")
    return stored.read(spark).select("conv_id", "turn", "role")


@query("keyed_delete_series", """select 'series' as of, c_custkey as id from customer where c_nationkey <> 3
 union all select 'drafts', o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3)""")
def keyed_delete_series(spark, d):
    """Customers as series and their orders as drafts, both stored by the series; those of one nation go."""
    series = table(spark, d, "customer").select(F.col("c_custkey").alias("series_id"), "c_nationkey")
    drafts = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("series_id"))
    held = [KeyedTable(scratch(spark), ("series_id",)) for _ in range(2)]
    for stored, rows in zip(held, (series, drafts), strict=True):
        stored.create(rows)
    joins.delete_stored_series(held, series.filter("c_nationkey = 3"))
    left = held[0].read(spark).select(F.lit("series").alias("of"), F.col("series_id").alias("id"))
    return left.unionByName(held[1].read(spark).select(F.lit("drafts").alias("of"), F.col("o_orderkey").alias("id")))


_PLACED = "with p as (select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey desc) as n from orders)"


@query("keyset_pages", f"""{_PLACED} select 1 as page, o_orderkey from p where n <= 60 union all select 2, o_orderkey from p where n between 61 and 120
 union all select 3, o_orderkey from p where n between 701 and 760""")
def keyset_pages(spark, d):
    """The first page, the one behind it by its last row, and one from a place far back."""
    stored = OrderedTable(scratch(spark), "o_orderdate", "o_orderkey")
    stored.create(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), 500)
    first = stored.page(spark)
    cursor = tuple(first.agg(F.min(F.struct("o_orderdate", "o_orderkey"))).first()[0])  # the last row of a page
    pages = [first, stored.page(spark, cursor), stored.page_at(spark, 700)]
    one, two, three = (p.select(F.lit(i).alias("page"), "o_orderkey") for i, p in enumerate(pages, 1))
    return one.unionByName(two).unionByName(three)


@query("known_articles", f"""with {_P}, n as (select page_id, {_NORM} as u, {_PAGE_TITLE} as title, net as source_name from parts),
 old as (select * from n where page_id % 3 <> 2)
 select page_id from n where page_id % 3 = 2 and u not in (select u from old) and (title, source_name) not in (select (title, source_name) from old)""")
def known_articles(spark, d):
    """Two thirds of the pages remembered in two batches, of the others those that are new; the index is packed in between."""
    p = _pages(spark, d).withColumn("fingerprint", U.fingerprint(F.col("url")))
    known = KnownArticles(scratch(spark), 16)
    for i in range(2):
        known.add(p.filter(F.col("page_id") % 3 == i), f"run-{i}")
    return known.compacted(spark, scratch(spark)).new_only(p.filter("page_id % 3 = 2"), "run-2").select("page_id")


@query("read_archive", f"with {_P} select page_id, net as source_name from parts where page_id % 4 = 1 and net = (select min(net) from parts where page_id % 4 = 1)")
def read_archive(spark, d):
    """Pages archived under four topics; those of one topic and one source read back."""
    p = _pages(spark, d).withColumns({"topic": F.concat(F.lit("topic/"), F.col("page_id") % 4), "published_at": F.lit(None).cast("timestamp"), "fetched_at": F.lit("2024-01-01").cast("timestamp")})
    path = scratch(spark)
    io.write_archive(p, path)
    least = p.filter("page_id % 4 = 1").agg(F.min("source_name")).first()[0]
    return io.read_archive(spark, path, "topic/1", least).select("page_id", "source_name")


@query("read_config", """select 'source' as kind, n_name as name, 'https://' || n_nationkey || '.example/' as value from nation where n_nationkey % 5 <> 0
 union all select 'topic', r_name, 'about ' || r_regionkey from region union all select 'setting', 's' || r_regionkey, 'v' || r_regionkey from region""")
def read_config(spark, d):
    """A configuration exported from nations (some without an address), regions and settings (with a key that stays out), and read again."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    topics = region.select(F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name"), F.array(F.concat(F.lit("about "), "r_regionkey")).alias("keywords"))
    address = F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.concat(F.lit("https://"), "n_nationkey", F.lit(".example/")))
    sources = nation.select(F.col("n_name").alias("name"), address.alias("url"))
    settings = region.select(F.explode(F.array(F.struct(F.concat(F.lit("s"), "r_regionkey").alias("key"), F.concat(F.lit("v"), "r_regionkey").alias("value")), F.struct(F.concat(F.lit("s"), "r_regionkey", F.lit("_api_key")).alias("key"), F.lit("x").alias("value")))).alias("s")).select("s.*")
    path = scratch(spark)
    io.export_config(topics, sources, settings).write.text(path)
    t, s, k = io.read_config(spark, path)
    of = lambda df, kind, value: df.select(F.lit(kind).alias("kind"), "name", value.alias("value"))
    return of(s, "source", F.col("url")).unionByName(of(t, "topic", F.element_at("keywords", 1))).unionByName(of(k.withColumnRenamed("key", "name"), "setting", F.col("value")))


@query("read_feed_items", """select 'Title ' || doc_id as title, 'https://feed.example/' || doc_id as url, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as body, '2024-01-02 03:04:05' as at
 from documents where trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def read_feed_items(spark, d):
    """Feeds of up to a thousand documents, each whole in an item, read as articles."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    parts = [tag("title", F.concat(F.lit(" Title "), "doc_id")), tag("link", F.concat(F.lit("https://feed.example/"), "doc_id")), tag("description", escaped), tag("pubDate", F.lit("Tue, 02 Jan 2024 03:04:05 GMT"))]
    docs = table(spark, d, "documents").filter("trim(both ' \\t\\n\\r' from coalesce(text, '')) <> ''").withColumn("feed", F.floor(F.col("doc_id") / 1000))
    entries = docs.select("feed", F.lit(1).alias("part"), tag("item", F.concat(*parts)).alias("value"))
    frame = docs.select("feed").distinct().select("feed", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("<rss><channel>").alias("value")), F.struct(F.lit(2).alias("part"), F.lit("</channel></rss>").alias("value")))).alias("x")).select("feed", "x.*")
    path = scratch(spark)
    entries.unionByName(frame).repartition("feed").sortWithinPartitions("feed", "part").select("feed", "value").write.partitionBy("feed").text(path)
    items = io.read_feed_items(spark, path, "feed")
    body = F.expr("trim(both ' \\t\\n\\r' from content_md)")
    return items.select("title", "url", F.md5(body).alias("body"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("failure_stream", "select event_id, substr(props, 1, 200) as snippet from events where event_type = 'error'")
def failure_stream(spark, d):
    """Failed events as a stream into the failure log, and the log read."""
    from gleanings.streaming import streams

    events = table(spark, d, "events").filter("event_type = 'error'").select("event_id", F.col("props").alias("response_snippet"))
    came, path = scratch(spark), scratch(spark)  # a file stream reads a folder
    events.write.parquet(came)
    streams.failure_stream(spark.readStream.schema(events.schema).parquet(came), path, scratch(spark)).awaitTermination()
    return spark.read.schema("event_id long, response_snippet string").json(path).select("event_id", F.col("response_snippet").alias("snippet"))
