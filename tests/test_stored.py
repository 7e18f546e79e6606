"""Stored tables change, page and answer in part, with the results of their whole-table twins."""

import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from gleanings.functions import html, urls
from gleanings.operators import aggs, ranking, sets, windows
from gleanings.sources.stored import KeyedTable, KnownArticles, OrderedTable
from gleanings.streaming import streams

SF = "/root/testdata/sf0.001"


def files(path):
    return {str(f) for f in Path(path).rglob("*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keyed_table_writes_only_touched_buckets(spark, tmp_path):
    stored = KeyedTable(str(tmp_path / "t"), ("k",), 8)
    start = spark.createDataFrame([(i, "old") for i in range(40)] + [(None, "none")], "k long, v string")
    stored.create(start)
    assert rows(stored.read(spark)) == rows(start)
    before = files(stored.path)
    news = spark.createDataFrame([(3, "new")], "k int, v string")  # of another integer type than the stored key
    stored.upsert(news)
    after = files(stored.path)
    assert len(before - after) == len(after - before) == 1
    wanted = sets.upsert(start, news.select(F.col("k").cast("long").alias("k"), "v"), ["k"])
    assert rows(stored.read(spark)) == rows(wanted)
    stored.upsert(news)  # again: the same
    assert rows(stored.read(spark)) == rows(wanted)
    stored.upsert(news.limit(0))
    assert rows(stored.read(spark)) == rows(wanted)


def test_keyed_table_empties_buckets(spark, tmp_path):
    stored = KeyedTable(str(tmp_path / "t"), ("k",), 4)
    start = spark.createDataFrame([(i, "old") for i in range(10)], "k long, v string")
    stored.create(start)
    stored.delete(start.select("k", F.lit(1).alias("other")))
    assert stored.read(spark).count() == 0
    stored.upsert(start)
    assert rows(stored.read(spark)) == rows(start)


def test_empty_keyed_table(spark, tmp_path):
    stored = KeyedTable(str(tmp_path / "t"), ("k",), 4)
    start = spark.createDataFrame([], "k long, v string")
    stored.create(start)
    assert stored.read(spark).columns == ["k", "v"] and stored.read(spark).count() == 0
    stored.delete(start)
    stored.upsert(spark.createDataFrame([(1, "x")], "k long, v string"))
    assert rows(stored.read(spark)) == [(1, "x")]


def test_pages_by_cursor_are_pages_by_offset(spark, tmp_path):
    rng = random.Random(3)
    table = spark.createDataFrame([(rng.choice([None, 1, 2, 3, 5, 8]), i) for i in range(95)], "at int, id int")
    stored = OrderedTable(str(tmp_path / "t"), "at", "id")
    stored.create(table, 10)
    want = [tuple(r) for r in table.orderBy(F.col("at").desc_nulls_last(), F.col("id").desc()).collect()]
    assert len(list((tmp_path / "t" / "rows").glob("_range=*"))) > 5
    got, cursor = [], None
    while True:
        page = [tuple(r) for r in stored.page(spark, cursor, 7).collect()]
        if not page:
            break
        got += page
        cursor = page[-1]
    assert got == want
    for offset in (0, 1, 29, 30, 88, 94, 95, 200):
        assert [tuple(r) for r in stored.page_at(spark, offset, 9).collect()] == want[offset : offset + 9]
    for offset in (0, 40, 80):  # few of the ranges, however far back the page is
        plan = stored.page_at(spark, offset, 3)._jdf.queryExecution().toString()
        (filters,) = {m for m in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)}
        named = re.search(r"_range#\d+ (?:IN \(([\d, ]+)\)|= (\d+))", filters)
        assert len((named[1] or named[2]).split(",")) <= 3
    same = ranking.recent_page(table.filter("at is not null"), F.col("at"), "id", 9, 20).collect()
    assert [tuple(r) for r in same] == want[20:29]


def test_small_ranges_make_no_tasks(spark, tmp_path):
    """Tasks report to the driver; a table of many small ranges has few of them, and a page lists the folders it reads only."""
    stored = OrderedTable(str(tmp_path / "t"), "at", "id")
    table = spark.range(200).select((F.col("id") % 7).alias("at"), "id")
    spark.sparkContext.setJobGroup("small ranges", "")
    try:
        stored.create(table, 2)
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("small ranges") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(list((tmp_path / "t" / "rows").glob("_range=*"))) == 100
    assert max(s.numTasks for s in stages if s) < 20
    page = stored.page_at(spark, 101, 5)
    assert [r.id for r in page.collect()] == [r.id for r in table.orderBy(F.desc("at"), F.desc("id")).collect()][101:106]
    assert len(page.inputFiles()) <= 4


def test_pages_of_an_empty_table(spark, tmp_path):
    stored = OrderedTable(str(tmp_path / "t"), "at", "id")
    stored.create(spark.createDataFrame([], "at int, id int"))
    assert stored.page(spark).count() == stored.page_at(spark, 5).count() == 0


def test_known_articles_read_the_buckets_of_their_keys(spark, tmp_path):
    known = KnownArticles(str(tmp_path / "k"), 32)
    old = spark.range(500).select(F.concat(F.lit("f"), "id").alias("fingerprint"), F.concat(F.lit("t"), "id").alias("title"), F.lit("s").alias("source_name"))
    known.add(old, "a-0")
    batch = spark.createDataFrame([("f7", "x", "s"), ("g", "t9", "s"), ("h", "t9", "other"), ("i", None, "s"), (None, "y", "s")], "fingerprint string, title string, source_name string")
    new = known.new_only(batch, "a-1")
    assert rows(new.select("fingerprint")) == sorted([("h",), ("i",), (None,)], key=repr)
    assert rows(known.new_only(batch, "a-0").select("fingerprint")) == rows(batch.select("fingerprint"))  # a replay does not see itself
    packed = known.compacted(spark, str(tmp_path / "p"))
    assert len(files(packed.path)) <= 32
    assert rows(packed.new_only(batch, "a-1")) == rows(new)
    held = packed._rows(spark).filter(F.col("bucket").isin([1, 2]) & (F.col("key") == "af7"))
    plan = held._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "EqualTo(key,af7)" in plan


def test_ingest_by_index_is_ingest_by_archive(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for i in range(3):
        pages.filter(F.col("page_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    known = KnownArticles(str(tmp_path / "known"), 16)
    now = F.lit("2100-01-01").cast("timestamp")
    for checkpoint in ("c1", "c2"):  # a second run over everything adds nothing
        streams.ingest_known(stream(), str(tmp_path / "archive"), known, str(tmp_path / checkpoint), now).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "archive"))
    titled = pages.select(urls.fingerprint(F.col("url")).alias("f"), html.page_title(F.col("html")).alias("t"), urls.netloc(F.col("url")).alias("s"))
    assert got.count() == got.select("fingerprint").distinct().count() == got.select("title", "source_name").distinct().count()
    assert got.count() == titled.groupBy("f").agg(F.first("t").alias("t"), F.first("s").alias("s")).select("t", "s").distinct().count()
    assert got.select("batch").distinct().count() > 1


def test_a_replayed_batch_replaces_its_own_rows(spark, tmp_path, monkeypatch):
    page = spark.createDataFrame([(1, "https://a/1", "<h1>One</h1><p>x</p>"), (2, "https://a/2", "<h1>Two</h1><p>y</p>")], "page_id long, url string, html string")
    page.coalesce(1).write.parquet(str(tmp_path / "in"))
    known, now = KnownArticles(str(tmp_path / "known"), 4), F.lit("2024-01-10").cast("timestamp")
    start = lambda: streams.ingest_known(spark.readStream.schema(page.schema).parquet(str(tmp_path / "in")), str(tmp_path / "archive"), known, str(tmp_path / "c"), now)

    def lost(*_):
        raise RuntimeError("lost between archive and index")

    monkeypatch.setattr(KnownArticles, "add", lost)
    try:
        start().awaitTermination()
    except Exception as e:  # the query fails after the archive is written
        assert "lost between" in str(e)
    monkeypatch.undo()
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 2
    start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 2
    assert known.new_only(streams.as_articles(page, now).withColumn("fingerprint", urls.fingerprint(F.col("url"))), "other").count() == 0


def test_days_of_any_size_come_in_pages(spark):
    items = spark.range(2500).select(F.when(F.col("id") % 5 > 0, F.lit("2024-01-01").cast("date")).alias("at"), F.lit(None).cast("string").alias("s"), "id")
    got = aggs.archive_by_day(items, "at", "s", "id", 300).collect()
    for day in (None, "2024-01-01"):
        pages = sorted((r for r in got if (None if r.day is None else str(r.day)) == day), key=lambda r: r.page)
        flat = [x.id for r in pages for x in r["items"]]
        assert flat == [i for i in range(2500) if (i % 5 == 0) == (day is None)]
        assert {r.n for r in pages} == {len(flat)} and [r.page for r in pages] == list(range(len(pages)))


def test_ids_of_a_name_that_nearly_all_share(spark):
    names = spark.range(1000).select("id", F.when(F.col("id") % 100 == 0, F.concat(F.lit("N"), "id")).otherwise("Untitled").alias("name"))
    got = {r.id: r.new_id for r in windows.unique_ids(names, "name", "id", spark.createDataFrame([("untitled",)], "slug string")).collect()}
    hot = [i for i in range(1000) if i % 100]
    assert [got[i] for i in hot] == [f"untitled-{k + 2}" for k in range(len(hot))]
    assert got[100] == "n100"
