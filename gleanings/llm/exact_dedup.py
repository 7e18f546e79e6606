"""Exact dedup by sorting contents.

Normalised bytes are range-partitioned by splitters that Spark samples, sorted externally within each partition so that equal
texts are neighbours, and neighbours are compared in full. The sort key leads with a 64-byte prefix and a hash, so the sampled
splitters stay small however long the texts are; the bytes themselves break ties. The row id is the last part of the key: a group
of copies of any size is cut over partitions. Runs that touch a partition's edge are merged afterwards, by their full text, from
two rows a partition.

Defined results: null counts as empty, and empty texts are equal to each other; the smallest id of a group stays, null ids last;
of rows with the same text and the same id one stays (kept is true once); other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanings.llm.common import KEYS, SPACE, one_row_each, small_batches, staged, with_keys

_RUNS = "doc_id long, k1 long, k2 long, part int, run long, first_in_run boolean, keep_id long, group_size long, edge boolean, edge_text binary, text_sha256 string"
_NAMES = [c.split()[0] for c in _RUNS.split(", ")]


def _runs(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition -> the same rows with the run of equal texts they are in.

    Only the ids of the open run are held, and they are written in pieces where a run is long: then the run counts as an edge, whose
    size is summed later like that of one cut by a partition's end.
    """
    out: list[tuple] = []
    ids: list[tuple] = []  # doc_id and what tells its row from others with that id
    run, text, digest, piece = 0, None, "", 0

    def close(edge: bool) -> None:
        nonlocal ids, piece
        edge = edge or run == 1 or piece > 0
        keep, size = ids[0][0] if ids else None, len(ids)
        for i, row in enumerate(ids):
            out.append((*row, part, run, i == 0 and piece == 0, keep, size if i == 0 or not edge else 0, edge, text if edge and i == 0 else None, digest))
        ids = []

    def batch() -> pa.RecordBatch:
        nonlocal out
        columns = list(zip(*out, strict=True))
        out = []
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string()), strict=True)], names=_NAMES)

    for b in batches:
        for *row, norm in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if norm != text or run == 0:
                if run:
                    close(edge=False)
                run, text, piece = run + 1, norm, 0
                digest = hashlib.sha256(norm).hexdigest()
            ids.append(row)
            if len(ids) >= 50_000:
                close(edge=True)
                piece += 1
        if out:
            yield batch()
    if run:
        close(edge=True)
    if out:
        yield batch()


def exact_groups(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text)."""
    return _groups(docs.withColumns({"_key_1": F.lit(0).cast("long"), "_key_2": F.lit(0).cast("long")}), partitions).drop("k1", "k2")


def _groups(docs: DataFrame, partitions: int | None) -> DataFrame:
    """The same of docs with the hashes of KEYS, and these as k1 and k2."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ").cast("binary")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_key_1").alias("k1"), F.col("_key_2").alias("k2"), norm.alias("norm")).withColumn("head", F.substring("norm", 1, 64)).withColumn("hash", F.xxhash64("norm"))
    last = F.col("doc_id").asc_nulls_last()
    placed = keyed.repartitionByRange(n, "head", "hash", last).sortWithinPartitions("head", "hash", "norm", last, "k1", "k2").select("doc_id", "k1", "k2", "norm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _runs(TaskContext.get().partitionId(), batches)

    small_batches(spark)
    rows = staged(placed.mapInArrow(run, _RUNS))
    # at most the first and last run of each partition, and one row more for each 50,000 copies
    edges = rows.filter("edge_text is not null").select("part", "run", "edge_text", "keep_id", "group_size")
    whole = edges.groupBy("edge_text").agg(F.min("keep_id").alias("k"), F.sum("group_size").alias("g"))
    merged = edges.select("part", "run", "edge_text").distinct().join(whole, "edge_text").select(F.col("part").alias("p"), F.col("run").alias("r"), "k", "g")
    plain = rows.filter("not edge").select("doc_id", "k1", "k2", "keep_id", "group_size", "text_sha256", "first_in_run")
    cut = rows.filter("edge").join(merged, (F.col("part") == F.col("p")) & (F.col("run") == F.col("r")))
    # a run that goes on in the next partition has its first row in the earliest of them
    firsts = edges.join(merged, (F.col("part") == F.col("p")) & (F.col("run") == F.col("r"))).groupBy("edge_text").agg(F.min("part").alias("fp")).join(edges.select("edge_text", "part", "run").distinct(), "edge_text").filter("part = fp").select(F.col("part").alias("fp"), F.col("run").alias("fr"))
    cut = cut.join(firsts, (F.col("part") == F.col("fp")) & (F.col("run") == F.col("fr")), "left")
    cut = cut.select("doc_id", "k1", "k2", F.col("k").alias("keep_id"), F.col("g").alias("group_size"), "text_sha256", (F.col("first_in_run") & F.col("fp").isNotNull()).alias("first_in_run"))
    return plain.unionByName(cut).select("doc_id", "k1", "k2", "keep_id", "group_size", F.col("first_in_run").alias("kept"), "text_sha256")


def dedup(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group, null and repeated ids included."""
    kept = _groups(with_keys(docs), partitions).filter("kept")
    keys = kept.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias(KEYS[0]), F.col("k1").alias(KEYS[1]), F.col("k2").alias(KEYS[2]))
    return one_row_each(docs, keys)
