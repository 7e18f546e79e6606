"""Streams end where their batch twins do."""

from pyspark.sql import functions as F

from gleanings.functions import html, urls
from gleanings.streaming import batch_twins, streams

SF = "/root/testdata/sf0.001"


def test_ingest_adds_each_article_once(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for i in range(3):
        pages.filter(F.col("page_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # a second run over everything adds nothing
        streams.ingest_stream(stream(), str(tmp_path / "archive"), str(tmp_path / checkpoint)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "archive"))
    titled = pages.select(urls.fingerprint(F.col("url")).alias("f"), html.page_title(F.col("html")).alias("t"), urls.netloc(F.col("url")).alias("s"))
    assert got.count() == got.select("fingerprint").distinct().count() == got.select("title", "source_name").distinct().count()
    assert got.count() == titled.groupBy("f").agg(F.first("t").alias("t"), F.first("s").alias("s")).select("t", "s").distinct().count()


def test_ingest_rejects_old_and_names_topics(spark, tmp_path):
    page = lambda i, host, title, day: (i, f"https://{host}/{i}", f'<meta property="og:published_time" content="{day}"><h1>{title}</h1><p>about whales</p>')
    rows = [page(1, "a", "One", "2024-01-09"), page(2, "a", "One", "2024-01-09"), page(3, "b", "One", "2024-01-09"), page(4, "a", "Old", "2023-01-01"), (5, "https://a/5", "<h1>No date</h1>"), page(6, "a", "Two", "2024-01-08")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("page_id long, url string, html string").parquet(str(tmp_path / "in"))
    now = F.lit("2024-01-10").cast("timestamp")
    streams.ingest_stream(stream, str(tmp_path / "archive"), str(tmp_path / "c"), now, 7, [("sea", ["whales"])]).awaitTermination()
    assert sorted((r.page_id, r.topic) for r in spark.read.parquet(str(tmp_path / "archive")).collect()) == [(1, "sea"), (3, "sea"), (6, "sea")]


def test_failures_are_appended(spark, tmp_path):
    log = spark.range(5).select(F.timestamp_seconds(F.col("id")).alias("timestamp"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("y"), 300).alias("response_snippet"))
    log.write.parquet(str(tmp_path / "in"))
    streams.failure_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.json(str(tmp_path / "log"))
    assert got.count() == 5 and {len(r.response_snippet) for r in got.collect()} == {200}


def test_backfill_touches_nulls_only(spark):
    rows = spark.createDataFrame([(1, None, "see https://youtu.be/x", []), (2, False, "https://youtu.be/x", []), (3, None, "plain", [])], "id long, has_video boolean, body string, videos array<string>")
    assert [r.has_video for r in streams.backfill_flags(rows).orderBy("id").collect()] == [True, False, False]


def test_op_states(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "start", "a"), (1, 2, "finish", "b"), (2, 3, "start", "c"), (2, 4, "fail", "bad")], "op_id long, seq long, event string, line string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    # processing-time timeouts would otherwise ask for empty batches for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = streams.op_state_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("op_states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {r.op_id: (r.status, r.n_lines, r.error) for r in spark.table("op_states").collect()}
    assert got == {1: ("done", 2, None), 2: ("error", 2, "bad")}


def test_late_rows_end_in_the_twins_states(spark, tmp_path):
    """Events dealt to batches at random, each in any order: the last rows of the stream are the batch twin's."""
    import random

    r = random.Random(3)
    rows = [(i % 17, i, r.choice(["start", "log", "log", "update", "finish", "fail", "cancel"]), r.choice([None, f"line {i}"]), r.choice([None, f'{{"n": {i}}}'])) for i in range(400)]
    schema = "op_id long, seq long, event string, line string, stats string"
    shuffled = r.sample(rows, len(rows))
    for k in range(4):
        spark.createDataFrame(shuffled[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    keep = lambda df, batch: out.extend((batch, x) for x in df.collect())
    q = streams.op_state_stream(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    names = ["op_id", "status", "lines", "last_line", "error", "stats"]
    final = {x.op_id: tuple(x[c] for c in names) for _, x in sorted(out, key=lambda t: t[0])}
    twin = batch_twins.op_state(spark.createDataFrame(rows, schema))
    assert len({b for b, _ in out}) == 4 and final == {x.op_id: tuple(x[c] for c in names) for x in twin.collect()}


def test_silent_operations_end_in_error(spark, tmp_path):
    import time

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    rows = spark.createDataFrame([(1, 1, "start", "a", '{"n": 1}'), (1, 2, "log", None, '{"n": 2}'), (2, 3, "finish", "b", None)], "op_id long, seq long, event string, line string, stats string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    states = streams.op_state_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), stale_seconds=1)
    q = states.writeStream.format("memory").queryName("silent_ops").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            got = {(r.op_id, r.status, r.error, r.stats) for r in spark.table("silent_ops").collect()}
            if any(status == "error" for _, status, _, _ in got):
                break
    finally:
        q.stop()
    assert got == {(1, "running", None, '{"n": 2}'), (1, "error", "stale", '{"n": 2}'), (2, "done", None, None)}
