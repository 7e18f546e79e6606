"""Structured Streaming: ingest into an archive, operation states, failures; and the lazy backfill of a column."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanings.functions import html as H
from gleanings.functions import urls
from gleanings.operators import dedup, filters, joins
from gleanings.session import written
from gleanings.sources import io
from gleanings.sources.stored import KnownArticles, overwrite_parts


ARCHIVE = "page_id long, url string, title string, source_name string, fingerprint string, published_at timestamp, topic string, body string"


def as_articles(pages: DataFrame, now: Column) -> DataFrame:
    """pages (page_id, url, html) -> what the archive has of them, but for the topic."""
    html = F.col("html")
    return pages.select("page_id", "url", H.page_title(html).alias("title"), urls.netloc(F.col("url")).alias("source_name"), H.published_at(html, now).alias("published_at"), H.paragraph_text(html).alias("body"))


def new_articles(batch: DataFrame, archive: DataFrame, now: Column, days: int | None = None, topics: list[tuple[str, list[str]]] = (), order: str = "page_id") -> DataFrame:
    """Rows of a batch (from as_articles) that go into the archive: young enough, the first of their address and of their title and source in the
    batch, neither archived yet, with their topic."""
    return _admitted(batch, lambda young: dedup.new_only(young, archive), now, days, topics, order)


def _admitted(batch: DataFrame, new_only: Callable[[DataFrame], DataFrame], now: Column, days: int | None, topics: list[tuple[str, list[str]]], order: str) -> DataFrame:
    young = filters.filter_by_age(batch, "published_at", now, days)
    fresh = new_only(dedup.dedup_exact(young, order))
    first = dedup.first_per(fresh, ["title", "source_name"], order)
    named = joins.classify_topics(first, list(topics), F.concat_ws("\n", "title", "body"), id_column="fingerprint")
    return first.join(named, "fingerprint").select(*[c.split()[0] for c in ARCHIVE.split(", ")])


def ingest_stream(pages: DataFrame, archive: str, checkpoint: str, now: Column | None = None, days: int | None = None, topics: list[tuple[str, list[str]]] = (), order: str = "page_id"):
    """Start a query that archives new articles of a stream of pages (page_id, url, html), each once over all batches.

    A batch that is replayed after a failure finds its articles archived and adds nothing.
    """
    at = F.current_timestamp() if now is None else now
    pages.sparkSession.createDataFrame([], ARCHIVE).write.mode("ignore").parquet(archive)  # does nothing where there is one

    def add(batch: DataFrame, _: int) -> None:
        known = batch.sparkSession.read.schema(ARCHIVE).parquet(archive)
        new_articles(as_articles(batch, at), known, at, days, topics, order).write.mode("append").parquet(archive)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_known(pages: DataFrame, archive: str, known: KnownArticles, checkpoint: str, now: Column | None = None, days: int | None = None, topics: list[tuple[str, list[str]]] = (), order: str = "page_id"):
    """ingest_stream() for a large archive: a batch asks the index of known articles, by the buckets of its own keys, and the archive itself is never read.

    The archive is in folders by batch, and the index is written behind it. A batch that failed anywhere in between and is run again writes the
    same rows to the same folders. Streams with different checkpoints may share an archive, one at a time.
    """
    at = F.current_timestamp() if now is None else now
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        name = f"{run}-{number}"
        rows = written(_admitted(as_articles(batch, at), lambda young: known.new_only(young, name), at, days, topics, order))
        overwrite_parts(rows.withColumn("batch", F.lit(name)), archive, "batch")
        known.add(rows, name)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(pages: DataFrame, at: str, delay: str) -> DataFrame:
    """The variant with bounded state: an address counts as new again once the watermark has passed it."""
    return pages.withColumn("fingerprint", urls.fingerprint(F.col("url"))).withWatermark(at, delay).dropDuplicatesWithinWatermark(["fingerprint"])


_HEAD = "last string, last_seq long, error string, error_seq long, stats string, stats_seq long, lines long, timer long"
_OUT = "op_id long, status string, lines long, n_lines int, last_line string, error string, stats string"
_STATUS = {"finish": "done", "fail": "error", "cancel": "cancelled"}


class OpStates(StatefulProcessor):
    """State of one operation: a value for what decides its status, a list of its last lines, and a timer while it runs.

    What is kept of each part is that of the largest seq so far, so rows that come late, or in another order, lead to the same state.
    """

    def __init__(self, most_lines: int, stale_seconds: int):
        self.most_lines, self.stale_ms = most_lines, stale_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.lines = handle.getListState("lines", "seq long, line string")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.head.get()
        last, last_seq, error, error_seq, stats, stats_seq, n, timer = held if held is not None else (None, -1, None, -1, None, -1, 0, 0)
        lines = [tuple(x) for x in self.lines.get()]
        for batch in rows:
            for r in batch.itertuples():
                seq, own = int(r.seq), getattr(r, "stats", None)
                if r.event in _STATUS and seq > last_seq:
                    last, last_seq = r.event, seq
                if r.event in ("fail", "cancel") and seq > error_seq:
                    error, error_seq = (r.line if r.event == "fail" else "cancelled"), seq
                if own is not None and seq > stats_seq:
                    stats, stats_seq = own, seq
                if r.line is not None:
                    lines.append((seq, r.line))
                    n += 1
            lines = sorted(lines)[-self.most_lines :]
        if timer:
            self.handle.deleteTimer(timer)
        timer = 0 if last else timerValues.getCurrentProcessingTimeInMs() + self.stale_ms
        if timer:
            self.handle.registerTimer(timer)
        self.head.update((last, last_seq, error, error_seq, stats, stats_seq, n, timer))
        self.lines.put(lines) if lines else self.lines.clear()
        yield self._row(key, _STATUS.get(last, "running"), n, lines, error, stats)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, _, _, _, stats, _, n, _ = self.head.get()
        lines = [tuple(x) for x in self.lines.get()]
        self.head.clear()
        self.lines.clear()
        yield self._row(key, "error", n, lines, "stale", stats)

    @staticmethod
    def _row(key: tuple[Any, ...], status: str, n: int, lines: list[tuple], error: str | None, stats: str | None) -> pd.DataFrame:
        return pd.DataFrame({"op_id": [key[0]], "status": [status], "lines": [n], "n_lines": [len(lines)], "last_line": [lines[-1][1] if lines else None], "error": [error], "stats": [stats]})

    def close(self) -> None:
        pass


def op_state_stream(events: DataFrame, most_lines: int = 500, stale_seconds: int = 3600) -> DataFrame:
    """events (op_id, seq, event, line and maybe stats, a JSON text) folded for each operation: status and error by the last of finish, fail and cancel, the
    number of lines, the last of them and the latest stats; one that stays silent while it runs ends in error, and its state is dropped.

    The state store must be RocksDB's, which this sets for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy("op_id").transformWithStateInPandas(OpStates(most_lines, stale_seconds), _OUT, "update", "processingTime")


def failure_stream(failures: DataFrame, path: str, checkpoint: str):
    """Append failures as JSON as they come."""
    return io.failure_records(failures).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backfill_flags(articles: DataFrame) -> DataFrame:
    """has_video computed where it is null; other rows untouched."""
    return articles.withColumn("has_video", F.coalesce("has_video", H.has_video(F.col("body"), F.col("videos"))))
