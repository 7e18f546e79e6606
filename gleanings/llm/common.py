"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than the six ASCII white-space characters (also the split of Python's bytes.split()).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: what the session names in spark.checkpoint.dir, or what SparkContext.setCheckpointDir() was given.

    Where neither is set, a session in local mode, whose driver and executors are one process, gets a temporary folder of its own;
    on a cluster that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: operators write their intermediate tables there")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
        found = context.getCheckpointDir()
    return found


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage is cut, and a lost executor costs no recomputation.

    The files stay until the folder is cleared, as those of checkpoint() do.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tell rows apart where ids are null or repeated: the id, and 128 bits of the text. They follow from the row alone, so nothing has to be
#: written out for them, and rows that agree in all three hold the same document.
KEYS = ["_key_id", "_key_1", "_key_2"]


def with_keys(docs: DataFrame) -> DataFrame:
    """docs and KEYS, none of which is null."""
    doc_id = F.col("doc_id").cast("long")
    return docs.withColumns({"_key_id": F.coalesce(doc_id, F.lit(0).cast("long")), "_key_1": F.xxhash64(doc_id.isNull(), "text"), "_key_2": F.xxhash64(F.lit("again"), "text")})


def _has_order(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_has_order(f.dataType) for f in kind.fields)
    return _has_order(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def one_row_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """For each of keys (KEYS, distinct) one row of docs with all its columns: of several the one that is first in their order.

    The join deals the rows out by KEYS, as the aggregation needs them, so they are shuffled once; and Spark can send a small set of keys along.
    """
    found = with_keys(docs).join(keys.select(*KEYS), KEYS)
    ordered = [f.name for f in docs.schema.fields if _has_order(f.dataType)]
    row = F.struct(*[found[c] for c in docs.columns])
    first = F.min(row) if ordered == docs.columns else F.min_by(row, F.struct(*[found[c] for c in ordered]))
    return found.groupBy(*KEYS).agg(first.alias("_row")).select("_row.*")


#: Bytes of text that a function of batches sees at once (more only where one row is larger).
GROUP_BYTES = 6 << 20


def small_batches(spark: SparkSession, most_bytes: int = GROUP_BYTES) -> None:
    """Rows travel to Python in batches of few bytes, so that a batch of long texts stays within a worker's memory.

    Plans read the limit when they run, so it is a setting of the session; a lower one of the caller's stays.
    """
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if not (now and now.isdigit() and 0 < int(now) <= most_bytes):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def grouped_batches(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most_bytes:
            yield pa.concat_batches(held)
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """Apply a function of Arrow batches within the tasks that read df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x.encode("utf-8", "surrogatepass") if x else b"" for x in column.to_pylist()]


def n_words(text: str | Column) -> Column:
    """Number of words of a text column as a long; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id as decimal text, modulo a number: the folds by which rows are held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(0).cast("long"))
