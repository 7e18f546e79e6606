"""Tables in folders that are read and changed in part: keyed tables, tables in an order, and an index of known keys.

All three are plain Parquet under partition folders, so a partition filter prunes what is read, and Spark's dynamic partition overwrite replaces only the
folders that are written. What goes through the driver is bounded by the number of buckets, or by the rows of a page.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanings.operators import sets
from gleanings.session import written


def overwrite_parts(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partition folders that rows has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _bucket(key: list[Column], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path``, in buckets by a hash of its key columns; a change reads and writes only the buckets of the keys that it names.

    Every bucket has one row more, which is not live, so that a bucket that loses all its rows is still written. A change is staged before it replaces
    anything; one that fails halfway is completed by running it again. Null is a key like any other for placing rows, but equal to none in a change.
    """

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def create(self, rows: DataFrame) -> None:
        held = rows.withColumns({"_live": F.lit(True), "_bucket": _bucket([F.col(k) for k in self.keys], self.buckets)})
        all_ = rows.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias("_bucket"))
        self._write(held, all_)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows."""
        return self._stored(spark).filter("_live").drop("_live", "_bucket")

    def upsert(self, updates: DataFrame) -> None:
        """Insert rows, or replace those with the same key."""
        self._change(updates, lambda held, new: sets.upsert(held, new, list(self.keys)))

    def delete(self, ids: DataFrame) -> None:
        """Remove the rows whose keys stand in ids."""
        self._change(ids.select(*self.keys).distinct(), lambda held, new: held.join(new, list(self.keys), "left_anti"))

    def replace_group(self, rows: DataFrame, order: str, written_in: str = "draft_id") -> None:
        """sets.replace_group() of the groups in rows; the group is the only key."""
        (group,) = self.keys
        self._change(rows, lambda held, new: sets.replace_group(held, new, group, order, written_in))

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def _change(self, new: DataFrame, how) -> None:
        stored = self._stored(new.sparkSession)
        types = {f.name: f.dataType for f in stored.schema}
        new = written(new.select(*[F.col(c).cast(types[c]).alias(c) for c in new.columns]))  # read more than once below
        touched = new.select(_bucket([F.col(k) for k in self.keys], self.buckets).alias("_bucket")).distinct()
        numbers = [r[0] for r in touched.collect()]  # at most ``buckets``
        if not numbers:
            return
        held = stored.filter("_live").filter(F.col("_bucket").isin(numbers)).drop("_live", "_bucket")
        changed = how(held, new).select(*held.columns)
        self._write(changed.withColumns({"_live": F.lit(True), "_bucket": _bucket([F.col(k) for k in self.keys], self.buckets)}), touched)

    def _write(self, rows: DataFrame, touched: DataFrame) -> None:
        marks = touched.withColumn("_live", F.lit(False))
        staged = written(rows.unionByName(marks, allowMissingColumns=True))
        overwrite_parts(staged.repartition("_bucket").sortWithinPartitions("_bucket", *self.keys), self.path, "_bucket")


#: Rows that a task orders when an OrderedTable is made, where its ranges have fewer: tasks report to the driver, ranges do not.
ROWS_A_TASK = 100_000


@dataclass(frozen=True)
class OrderedTable:
    """A table at ``path`` in ranges of its order, newest first: by ``at`` descending (null last), then ``tie`` descending; ``tie`` has no repeated values.

    A page reads the ranges it lies in, so its cost does not depend on how far back it is. The ranges' ends and sizes are a table of their own, one row a range.
    """

    path: str
    at: str
    tie: str

    def create(self, rows: DataFrame, each: int = 100_000) -> None:
        """Write the table, some ``each`` rows a range."""
        total = rows.count()
        order = self._order()
        cut = rows.repartitionByRange(max(1, -(-total // max(each, ROWS_A_TASK))), *order).sortWithinPartitions(*order)
        placed = cut.withColumn("_at", F.monotonically_increasing_id())  # the partition, and in the lower 33 bits the place in it
        at = F.col("_at").bitwiseAND((1 << 33) - 1)
        ranged = written(placed.withColumn("_range", F.col("_at") - at + F.floor(at / each)).drop("_at"))
        by = ["_range"] if total else []  # without rows there are no folders, and a file keeps the columns
        ranged.write.partitionBy(*by).parquet(f"{self.path}/rows")
        last = F.min(F.struct(self.at, self.tie)).alias("last")
        ends = ranged.groupBy("_range").agg(F.count("*").alias("n"), last)
        before = F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a range
        ends.withColumn("before", before).coalesce(1).write.parquet(f"{self.path}/ranges")

    def page(self, spark: SparkSession, after: tuple[Any, Any] | None = None, limit: int = 60) -> DataFrame:
        """The rows that follow the cursor ``after``, the (at, tie) of the last row seen; of the first page without one. limit between 1 and 200."""
        limit = min(max(limit, 1), 200)
        ends = self._ranges(spark).select("_range", "n", F.col(f"last.{self.at}").alias(self.at), F.col(f"last.{self.tie}").alias(self.tie))
        rows = self._of(spark, ends.filter(self._after(after)), limit + 1)  # the first of them may have one row only that follows
        return rows.filter(self._after(after)).orderBy(*self._order()).limit(limit)

    def page_at(self, spark: SparkSession, offset: int, limit: int = 60) -> DataFrame:
        """The rows from a place on, as ranking.recent_page() counts places."""
        limit, offset = min(max(limit, 1), 200), max(offset, 0)
        ends = self._ranges(spark).filter(F.col("before") + F.col("n") > offset)
        first = ends.agg(F.min("before")).first()[0]
        return self._of(spark, ends, limit + 1).orderBy(*self._order()).offset(offset - (first or 0)).limit(limit)

    def _of(self, spark: SparkSession, ends: DataFrame, most: int) -> DataFrame:
        """Rows of the first ranges in ends; as every range has a row, ``most`` of them are enough for as many rows."""
        taken, held = [], 0
        for number, n in ends.orderBy("_range").limit(most).select("_range", "n").collect():
            taken.append(number)
            held += n if taken[1:] else 1
            if held >= most:
                break
        if not taken:
            return self._rows(spark).filter(F.lit(False)).drop("_range")
        # only these folders are listed, however many there are
        return self._rows(spark, [f"/_range={number}" for number in taken]).filter(F.col("_range").isin(taken)).drop("_range")

    def _order(self) -> list[Column]:
        return [F.col(self.at).desc_nulls_last(), F.col(self.tie).desc()]

    def _after(self, cursor: tuple[Any, Any] | None) -> Column:
        if cursor is None:
            return F.lit(True)
        at, tie = cursor
        if at is None:
            return F.col(self.at).isNull() & (F.col(self.tie) < F.lit(tie))
        return F.col(self.at).isNull() | (F.col(self.at) < F.lit(at)) | ((F.col(self.at) == F.lit(at)) & (F.col(self.tie) < F.lit(tie)))

    def _rows(self, spark: SparkSession, folders: list[str] | None = None) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows{f}" for f in folders or [""]])

    def _ranges(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/ranges")


@dataclass(frozen=True)
class KnownArticles:
    """The addresses, and the titles of sources, that an archive has: a narrow table of keys by bucket and batch.

    A batch reads the buckets of its own keys, and for few keys Spark also asks the Parquet bloom filters; bodies are never read. A batch that is replayed
    sees only what other batches added, and replaces what it added itself.
    """

    path: str
    buckets: int = 256

    def new_only(self, batch: DataFrame, name: str) -> DataFrame:
        """dedup.new_only() of a batch (fingerprint, title, source_name) against all batches but the one of this name."""
        keyed = written(batch.withColumns(_known_by()))
        keys = keyed.select(F.explode(F.array(*_known_by())).alias("key")).filter("key is not null").distinct()
        found = self._known(keys, name)
        left = keyed.join(found.withColumnRenamed("key", "_address"), "_address", "left_anti")
        return left.join(found.withColumnRenamed("key", "_title"), "_title", "left_anti").drop(*_known_by()).select(*batch.columns)

    def add(self, articles: DataFrame, name: str) -> None:
        """Remember the articles of a batch."""
        keys = articles.withColumns(_known_by()).select(F.explode(F.array(*_known_by())).alias("key")).filter("key is not null").distinct()
        rows = keys.withColumn("bucket", _bucket([F.col("key")], self.buckets)).repartition("bucket").sortWithinPartitions("bucket", "key")
        rows = rows.withColumn("batch", F.lit(name))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#key", "true")
        writer.partitionBy("bucket", "batch").parquet(self.path)

    def compacted(self, spark: SparkSession, into: str) -> KnownArticles:
        """The same keys at another path, one file a bucket; taken while no batch is open."""
        whole = KnownArticles(into, self.buckets)
        rows = self._rows(spark).select("key", "bucket").distinct().withColumn("batch", F.lit("all"))
        packed = rows.repartition("bucket").sortWithinPartitions("bucket", "key")
        packed.write.option("parquet.bloom.filter.enabled#key", "true").partitionBy("bucket", "batch").parquet(into)
        return whole

    def _known(self, keys: DataFrame, name: str) -> DataFrame:
        numbers = [r[0] for r in keys.select(_bucket([F.col("key")], self.buckets).alias("b")).distinct().collect()]  # at most ``buckets``
        held = self._rows(keys.sparkSession).filter(F.col("bucket").isin(numbers) & (F.col("batch") != name))
        some = keys.limit(FEW_KEYS + 1).collect()
        if len(some) <= FEW_KEYS:
            held = held.filter(F.col("key").isin([r[0] for r in some]))
        return written(keys.join(held.select("key"), "key", "left_semi"))

    def _rows(self, spark: SparkSession) -> DataFrame:
        schema = "key string, bucket int, batch string"
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket", "batch").parquet(self.path)  # does nothing where there is one
        return spark.read.schema(schema).parquet(self.path)


#: Up to so many keys of a batch are named in the filter, as many as Spark pushes one by one.
FEW_KEYS = 10


def _known_by() -> dict[str, Column]:
    """Keys of an article: its address, and its title with its source; null where a part is, as null is equal to nothing."""
    title = F.sha2(F.concat(F.length("title").cast("string"), F.lit(":"), "title", F.lit(":"), "source_name"), 256)
    return {"_address": F.concat(F.lit("a"), "fingerprint"), "_title": F.concat(F.lit("t"), title)}
