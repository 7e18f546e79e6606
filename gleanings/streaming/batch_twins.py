"""What the streams compute, as batch queries over all input at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanings.plans.web_queries import _NORM, _P, _PARAS, _TITLE
from gleanings.session import table


def op_state(events: DataFrame) -> DataFrame:
    """events (op_id, seq, event, line, stats) -> status and error by the last of finish, fail and cancel, which are final for what else comes, the number of
    lines, the last one and the latest stats."""
    final = F.when(F.col("event").isin("finish", "fail", "cancel"), F.col("seq"))
    last = F.max_by("event", final)
    status = F.when(last == "finish", "done").when(last == "fail", "error").when(last == "cancel", "cancelled").otherwise("running")
    error = F.max_by(F.when(F.col("event") == "fail", F.col("line")).when(F.col("event") == "cancel", "cancelled"), F.when(F.col("event").isin("fail", "cancel"), F.col("seq")))
    return events.groupBy("op_id").agg(
        status.alias("status"), F.count("line").alias("lines"), F.max_by("line", F.when(F.col("line").isNotNull(), F.col("seq"))).alias("last_line"), error.alias("error"),
        F.max_by("stats", F.when(F.col("stats").isNotNull(), F.col("seq"))).alias("stats"),
    )


TOPICS = [("spanish", ["ciónqu", "mente"]), ("english", ["tions"])]
INGEST_SQL = f"""with {_P}, n as (select page_id, {_NORM} as u, net from parts), f as (select min(page_id) as page_id, u, min(net) as net from n group by u),
 a as (select f.page_id, u, net, {_TITLE} as title, {_PARAS} as body from f join pages using (page_id)), t as (select *, row_number() over (partition by title, net order by page_id) as rn, lower(title || chr(10) || body) as x from a)
 select page_id, sha256(u) as fingerprint, case when contains(x, 'ciónqu') or contains(x, 'mente') then 'spanish' when contains(x, 'tions') then 'english' else 'uncategorized' end as topic from t where rn = 1"""


def ingest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive that the ingest stream ends with, if all pages come in one batch."""
    from gleanings.streaming import streams

    now = F.lit("2100-01-01").cast("timestamp")
    found = streams.new_articles(streams.as_articles(table(spark, sf_dir, "pages"), now), spark.createDataFrame([], streams.ARCHIVE), now, topics=TOPICS)
    return found.select("page_id", "fingerprint", "topic")
