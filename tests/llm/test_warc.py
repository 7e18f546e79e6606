"""Archives: what is written is read back, and what is not wanted is not read."""

import glob
import gzip
import hashlib
import io
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleanings.llm import warc
from gleanings.llm.registry import op12_warc

SCHEMA = "page_id long, url string, html string, digest string, id long, n long, record_type string, payload string"
BIG = "<p>ä\r\n\r\nWARC/1.1\r\n" * 100


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2, "y", "z") for i, u, h in rows], SCHEMA)


ROWS = [(i, f"https://h/{i}", BIG) for i in range(40)] + [
    (50, "https://h/a\r\nX: y", "small"), (51, "https://h/ü", "small"), (52, None, None), (53, "", ""), (None, "https://h/n", BIG), (None, None, None), (7, "https://h/7", "other"), (60, "u", "long " * 300_000),
    (61, "u", "x" * 1000), (62, "u", "x" * 1000), (63, "u", "x" * 999), (64, "u", "x" * 999), (65, "u", "twice" * 300), (65, "u", "twice" * 300), (-3, "u", "HTTP/1.1 200\r\n\r\n"),
]


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        kept = max(ids, key=lambda i: (i is not None, i))
        for i in ids:
            again = len(payload) >= 1000 and i != kept
            out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [ROWS, [], [(1, None, None)]])
def test_query_against_plain_groups(spark, tmp_path, rows):
    table(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = op12_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_payloads_come_back_and_ranges_hold_whole_records(spark, tmp_path, compression):
    path = str(tmp_path / "w")
    warc.write(warc.page_records(table(spark, ROWS).repartition(3), "2024-01-01T00:00:00Z"), path, compression=compression, rangeBytes="2000")
    back = warc.read(spark, path)
    assert back.rdd.getNumPartitions() > 5
    rows = back.collect()
    responses = [r for r in rows if r.record_type == "response"]
    assert sorted((r.target_uri or "", bytes(r.payload)) for r in responses if r.payload_length < 1000) == sorted(((u or "").replace("\r\n", "%0D%0A"), (h or "").encode()) for _, u, h in ROWS if len((h or "").encode()) < 1000)
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest and len(r.payload) == r.payload_length for r in responses)
    assert all(r.payload is None and r.headers["warc-profile"].endswith("identical-payload-digest") for r in rows if r.record_type == "revisit")
    assert sum(r.record_type == "warcinfo" for r in rows) == len(glob.glob(f"{path}/*.warc*"))


def test_predicates_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.page_records(table(spark, ROWS), "2024-01-01T00:00:00Z"), path)
    plain = warc.read(spark, path).drop("payload", "headers").collect()
    columns = "record_type string, target_uri string, refers_to string, content_length long"
    for test, keep in [
        ("record_type = 'revisit'", lambda r: r.record_type == "revisit"),
        ("record_type in ('response', 'revisit') and startswith(target_uri, 'https://h/1')", lambda r: r.record_type != "warcinfo" and (r.target_uri or "").startswith("https://h/1")),
        ("refers_to is not null and content_length > 10", lambda r: r.refers_to is not None and r.content_length > 10),
        ("not record_type = 'response' and target_uri is null", lambda r: r.record_type != "response" and r.target_uri is None),
        ("target_uri <=> null", lambda r: r.target_uri is None),
        ("length(target_uri) > 12 or record_type = 'warcinfo'", lambda r: len(r.target_uri or "") > 12 or r.record_type == "warcinfo"),
    ]:
        assert warc.read(spark, path, columns, catalyst=True).filter(test).count() == sum(map(keep, plain)), test
    text = warc.read(spark, path, columns, catalyst=True).filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in text


def test_predicates_of_a_frame_are_its_own(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.page_records(table(spark, ROWS), "2024-01-01T00:00:00Z"), path)
    plain = warc.read(spark, path).drop("payload", "headers").collect()
    of = lambda *where: warc.read(spark, path, "record_type string, target_uri string", list(where))
    revisits, early = of(("record_type", "=", "revisit")), of(("target_uri", "startswith", "https://h/1"), ("record_type", "in", ["response", "warcinfo"]))
    assert revisits.unionByName(early).count() == sum(r.record_type == "revisit" for r in plain) + sum((r.target_uri or "").startswith("https://h/1") and r.record_type == "response" for r in plain)
    with pytest.raises(Exception, match="predicates can be on"):
        of(("payload", "=", "x")).count()


def test_payloads_that_are_not_wanted_are_passed_over():
    class Seen(io.BytesIO):
        longest = 0

        def read(self, n=-1):
            got = super().read(n)
            Seen.longest = max(Seen.longest, len(got))
            return got

    body = b"".join(warc.page_record({"record_type": k, "record_id": f"<{i}>", "payload": b"x" * 1_000_000}) for i, k in enumerate(["response", "resource", "response", "metadata"]))
    rows = list(warc.records(Seen(body), False, lambda r: r["record_type"] == "response", payloads=False))
    assert [r["payload_length"] for r in rows] == [1_000_000] * 2 and Seen.longest == 0
    rows = list(warc.records(Seen(body), False, lambda r: r["record_id"] == "<1>"))
    assert [len(r["payload"]) for r in rows] == [1_000_000]


def test_foreign_archives(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhey\n\nWARC/1.0"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nwarc-target-uri: http://a/\r\nX-Long: a\r\n  b\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.warc").write_bytes(one + two)
    (tmp_path / "f/b.warc.gz").write_bytes(gzip.compress(one + two) + gzip.compress(two))
    rows = warc.read(spark, str(tmp_path / "f")).collect()
    assert [bytes(r.payload) for r in rows if r.record_type == "response"] == [b"hey\n\nWARC/1.0"] * 2 and sum(r.payload_digest == "0" * 40 for r in rows) == 3
    assert {r.headers["x-long"] for r in rows if r.record_type == "response"} == {"a b"}
    (tmp_path / "c.warc").write_bytes(one[:-10])
    with pytest.raises(Exception, match="cut off"):
        warc.read(spark, str(tmp_path / "c.warc")).collect()


def test_overwriting_and_files_of_lost_attempts(spark, tmp_path):
    path = str(tmp_path / "w")
    records = lambda n: warc.page_records(table(spark, ROWS[:n]), "2024-01-01T00:00:00Z")
    warc.write(records(40), path)
    (tmp_path / "w/part-lost.warc.gz").write_bytes(b"half a record")
    warc.write(records(40), path)
    count = lambda: warc.read(spark, path).filter(F.col("record_type") != "warcinfo").count()
    assert count() == 80
    warc.write(records(10), path, mode="overwrite")
    assert count() == 10
