"""WARC archives as a PySpark Python data source, for reading and for writing.

Reading plans one partition for each range of whole records of a file; ranges come from the manifest that the writer left (a foreign
archive has one range a file). A task parses a record's named fields first. Predicates on them (record type, address, date, digest and
the like) are pushed down, and the block of a record that fails them is passed over: by a seek in a plain file, by inflating to nowhere in
a compressed one. A schema without ``payload`` passes over all payloads. Only one record's payload is held at a time, besides those of the
Arrow batch that is being filled.

Predicates come in two ways. read(where=...) hands them over with the path, and each DataFrame keeps its own. With catalyst=True those that
Catalyst finds in a query are taken too; Spark 4.1 keeps one set of these for all scans of one DataFrame, so each query must read() anew.

Writing makes one file a task, each record a gzip member of its own, under a name that no other attempt has. The driver's commit
writes a manifest of the files of successful tasks, so what lost or repeated attempts leave behind is never read.

Paths are URIs that pyarrow's file systems open (file, s3, gs, hdfs); all executors must share them.

Defined results: null payloads are written as empty; control characters in header values are percent-encoded and outer blanks are not
kept; payloads are bytes as stored (no transfer or content encoding is undone); a revisit has no payload (null), and its payload_length is
what its HTTP header says; names of fields are told apart without regard to case, of repeated ones the last counts; a truncated record
and one without a length raise an error. Columns beside the known ones are not written.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from gleanings.llm.common import small_batches

SCHEMA = "record_id string, record_type string, date string, target_uri string, content_type string, content_length long, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
#: Columns of SCHEMA that are a named field as it stands.
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "content_type": "content-type", "refers_to": "warc-refers-to"}
#: Least bytes of a planned range; rows and bytes of an Arrow batch; bytes passed over at once.
RANGE_BYTES, BATCH_ROWS, BATCH_BYTES, CHUNK = 32 << 20, 512, 4 << 20, 1 << 20
_SOFTWARE = b"software: gleanings\r\nformat: WARC File Format 1.1\r\n"


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# ---- records -------------------------------------------------------------------------------------------------------------------


def hex_digest(value: str | None) -> str | None:
    """A labelled digest ("sha1:" and 32 characters of base32, or hex) as bare lowercase hex."""
    bare = (value or "").rpartition(":")[2].strip()
    if re.fullmatch(r"[A-Za-z2-7]{32}", bare):
        return base64.b32decode(bare.upper()).hex()
    return bare.lower() or None


class Pieces(io.RawIOBase):
    """A range of a file as a stream of its own."""

    def __init__(self, source, begin: int, end: int):
        self.source, self.begin, self.end = source, begin, end
        source.seek(begin)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.source.read(max(0, min(len(into), self.end - self.source.tell())))
        into[: len(got)] = got
        return len(got)

    def seek(self, to: int, whence: int = 0) -> int:
        at = {0: self.begin, 1: self.source.tell(), 2: self.end}[whence] + to
        self.source.seek(min(max(at, self.begin), self.end))
        return self.source.tell() - self.begin

    def tell(self) -> int:
        return self.source.tell() - self.begin


def _fields(stream, most: int | None = None) -> tuple[dict[str, str], int]:
    """Named fields up to the empty line (or ``most`` bytes), and the number of bytes read."""
    found: dict[str, str] = {}
    last, used = None, 0
    while most is None or used < most:
        line = stream.readline() if most is None else stream.readline(most - used)
        used += len(line)
        if not line.strip(b"\r\n"):
            break
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and last:  # a folded line
            found[last] = f"{found[last]} {text.strip()}"
        elif ":" in text:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found, used


def _pass_over(stream, n: int, compressed: bool) -> None:
    if not compressed:
        stream.seek(n, 1)
        return
    while n > 0:
        got = len(stream.read(min(n, CHUNK)))
        if not got:
            raise EOFError("a WARC record is cut off")
        n -= got


def records(stream, compressed: bool, wanted: Callable[[dict], bool] = lambda row: True, payloads: bool = True) -> Iterator[dict]:
    """Records of a stream as rows of SCHEMA, in order. Payloads of rows that are not wanted are never read."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the beginning of a WARC record: {line[:60]!r}")
        named, _ = _fields(stream)
        if not named.get("content-length", "").isdigit():
            raise ValueError(f"a WARC record without a length: {named.get('warc-record-id')}")
        left = int(named["content-length"])
        row = {column: named.get(name) for column, name in FIELDS.items()}
        row |= {"content_length": left, "payload_digest": hex_digest(named.get("warc-payload-digest")), "headers": named, "payload": None, "payload_length": left}
        if wanted(row):
            if (row["content_type"] or "").startswith("application/http"):
                http, used = _fields(stream, left)
                left -= used
                length = http.get("content-length", "")
                row["payload_length"] = int(length) if row["record_type"] == "revisit" and length.isdigit() else left
            if payloads and row["record_type"] != "revisit":
                row["payload"] = stream.read(left)
                if len(row["payload"]) < left:
                    raise EOFError("a WARC record is cut off")
                left = 0
            yield row
        _pass_over(stream, left, compressed)


def _value(text) -> bytes:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(text)).strip().encode("utf-8", "replace")


def record(kind: str, record_id: str, date: str, fields: list[tuple[str, object]], content_type: str, block: bytes) -> bytes:
    """One record; fields that are None are left out."""
    named = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields, ("Content-Type", content_type), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + b"".join(name.encode() + b": " + _value(v) + b"\r\n" for name, v in named if v is not None) + b"\r\n" + block + b"\r\n\r\n"


def page_record(row: dict) -> bytes:
    """The record of a row of SCHEMA: response and revisit get an HTTP header in front, others their payload alone."""
    payload, kind = row.get("payload") or b"", row.get("record_type") or "resource"
    length = len(payload) if kind != "revisit" or row.get("payload_length") is None else row["payload_length"]
    digest = row.get("payload_digest")
    fields = [("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", digest and "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    fields += [(k, v) for k, v in (row.get("headers") or {}).items()]
    content_type, block = row.get("content_type") or "text/html; charset=utf-8", payload
    if kind in ("response", "revisit"):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: " + _value(content_type) + b"\r\nContent-Length: " + str(length).encode() + b"\r\n\r\n"
        content_type, block = "application/http; msgtype=response", http + (payload if kind == "response" else b"")
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", row.get("refers_to"))]
    return record(kind, row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>", row.get("date") or "1970-01-01T00:00:00Z", fields, content_type, block)


# ---- the data source -----------------------------------------------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    """Whole records of a file: bytes from begin to end (its size where None)."""

    uri: str
    begin: int = 0
    end: int | None = None


_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}
_KNOWN = {*FIELDS, "content_length", "payload_digest"}
_SIGNS = {"=": EqualTo, ">": GreaterThan, ">=": GreaterThanOrEqual, "<": LessThan, "<=": LessThanOrEqual, "in": In, "startswith": StringStartsWith, "endswith": StringEndsWith, "contains": StringContains}


def _known(f: Filter) -> bool:
    """Whether a predicate reads named fields only."""
    if isinstance(f, Not):
        return _known(f.child)
    return type(f) in {*_TESTS, EqualNullSafe, IsNull, IsNotNull} and len(f.attribute) == 1 and f.attribute[0] in _KNOWN


def holds(f: Filter, row: dict) -> bool | None:
    """Whether a predicate holds for a row; None as in SQL, where a value is null."""
    if isinstance(f, Not):
        found = holds(f.child, row)
        return None if found is None else not found
    x = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return x is None
    if isinstance(f, IsNotNull):
        return x is not None
    if isinstance(f, EqualNullSafe):
        return x == f.value
    value = f.value
    if x is None or value is None or isinstance(f, In) and None in value and x not in value:
        return None
    return _TESTS[type(f)](x, value)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        unknown = set(self.names) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"a WARC record has no {', '.join(sorted(unknown))}")
        self.schema, self.path = schema, options["path"]
        self.filters: list[Filter] = [_SIGNS[sign]((column,), value) for column, sign, value in json.loads(options.get("where", "[]"))]
        if not all(map(_known, self.filters)):
            raise ValueError(f"predicates can be on {', '.join(sorted(_KNOWN))}")

    def partitions(self) -> list[Range]:
        fs, path = _opened(self.path)
        scheme = self.path[: -len(path)] if self.path.endswith(path) else ""
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [Range(self.path)]
        held = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        made = [i.path for i in held if re.search(r"/_manifest-[^/]*\.json$", i.path)]
        if not made:
            return [Range(scheme + i.path) for i in held if re.search(r"\.warc(\.gz)?$", i.path) and i.type == pafs.FileType.File]
        out = []
        for name in sorted(made):
            for x in json.loads(fs.open_input_stream(name).read()):
                out += [Range(f"{scheme}{name.rpartition('/')[0]}/{x['file']}", a, b) for a, b in zip(x["ends"][:-1], x["ends"][1:], strict=True)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, size = to_arrow_schema(self.schema), [], 0
        fs, path = _opened(partition.uri)
        compressed = path.endswith(".gz")
        with fs.open_input_file(path) as source:
            stream = io.BufferedReader(Pieces(source, partition.begin, source.size() if partition.end is None else partition.end), CHUNK)
            if compressed:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=stream, mode="rb"), CHUNK)
            batch = lambda: pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r[n] for r in held], arrow.field(n).type) for n in self.names], schema=arrow)
            for row in records(stream, compressed, lambda row: all(holds(f, row) for f in self.filters), "payload" in self.names):
                held.append(row)
                size += len(row["payload"] or b"")
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
            if held:
                yield batch()


class PushedReader(WarcReader):
    """A reader that also takes the predicates that Catalyst finds in a query."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _known(f):
                self.filters.append(f)
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    """A finished file: its name and the ends of its ranges."""

    file: str
    ends: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.compressed = options.get("compression", "gzip") != "none"
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _opened(self.path)
        name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.compressed else ''}"
        fs.create_dir(path, recursive=True)
        shut = (lambda b: (c := zlib.compressobj(4, zlib.DEFLATED, 31)).compress(b) + c.flush()) if self.compressed else bytes
        ends, at = [0], 0
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            at += out.write(shut(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", "1970-01-01T00:00:00Z", [("WARC-Filename", name)], "application/warc-fields", _SOFTWARE)))
            for batch in batches:
                for i in range(batch.num_rows):  # one row's values at a time
                    row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                    row["headers"] = dict(row.get("headers") or {})
                    at += out.write(shut(page_record(row)))
                    if at - ends[-1] >= self.range_bytes:
                        ends.append(at)
        return Written(name, ends if ends[-1] == at else [*ends, at])

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _opened(self.path)
        fs.create_dir(path, recursive=True)
        before = [i.path for i in fs.get_file_info(pafs.FileSelector(path)) if "/_manifest-" in i.path] if self.overwrite else []
        with fs.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([{"file": m.file, "ends": m.ends} for m in messages if m]).encode())
        for name in before:  # files without a manifest are not read
            fs.delete_file(name)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = _opened(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{path}/{m.file}")


class WarcDataSource(DataSource):
    """format("warc"): options are path and, for writing, compression (gzip or none) and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return (PushedReader if self.options.get("catalyst") == "true" else WarcReader)(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, schema: str = SCHEMA, where: list[tuple[str, str, object]] = (), catalyst: bool = False) -> DataFrame:
    """Records of a file or folder. A schema with fewer columns of SCHEMA reads less; without payload none is decoded.

    where: predicates (column, sign, value) that all must hold, as in ("record_type", "in", ["response"]); a null holds for none.
    catalyst: take those of the query's filters, too; the setting that this needs is turned on for the session.
    """
    if catalyst:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").schema(schema).option("where", json.dumps(list(where))).option("catalyst", str(catalyst).lower()).load(path)


def write(rows: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """rows (columns of SCHEMA; payload_length of revisits that of the full payload) as archives in a folder."""
    rows.sparkSession.dataSource.register(WarcDataSource)
    small_batches(rows.sparkSession)
    rows.write.format("warc").mode(mode).options(**options).save(path)


def page_records(pages: DataFrame, date: str, id_column: str = "page_id", url_column: str = "url", text_column: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Records of pages: of equal payloads of ``least_bytes`` and more the page with the largest id is a response and the others revisit it.

    Equal are payloads of equal SHA-1. A null id is less than any other; rows that repeat the kept one's id and payload are responses too.
    Payloads travel once, by id and digest, which spreads copies; what is grouped by digest alone are ids.
    """
    payload = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("target_uri"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    light = rows.filter(F.col("n") >= least_bytes).select("id", "digest")
    kept = light.groupBy("digest").agg(F.max("id").alias("to"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "to")
    again = light.join(kept, "digest").filter("not (id <=> to)").select(F.col("id").alias("i"), F.col("digest").alias("d"), "to").distinct()
    joined = rows.join(again, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    name = lambda i: F.concat(F.lit("<urn:pages:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
    revisit = F.col("d").isNotNull()
    return joined.select(
        name(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.lit(date).alias("date"), "target_uri",
        F.col("digest").alias("payload_digest"), F.col("n").alias("payload_length"), F.when(revisit, name(F.col("to"))).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(record_id) -> F.Column:
    """The page's id in the name of a record that page_records() made."""
    return F.regexp_extract(record_id, r"^<urn:pages:(-?\d+|null):", 1).try_cast("long")
