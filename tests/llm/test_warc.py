import gzip
import hashlib
import io

import pytest

from locusforge.llm import warc as A
from locusforge.session import scratch_path

DDL = "page_id long, url string, html string, payload string, digest int"
LONG = "<p>same page, Ünïcode</p>" * 20


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}?a=b c\r\nd", h, "clash", 1) for i, h in enumerate(
        [None, "", "short", "short", LONG, LONG, "other" * 40, "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n" * 9,
         "é" * 50, "é" * 50, "z" * 300_000])]
    rows += [(None, None, LONG, "clash", 1), (4, None, LONG, "clash", 1), (None, None, "only null" * 20, "c", 1),
             (None, None, "only null" * 20, "c", 1)]
    return spark.createDataFrame(rows, DDL).repartition(2)


def round_trip(spark, pages):
    return A.read_archives(A.normalise(A.write_archives(A.plan_records(pages), scratch_path(spark, "warc"))))


def test_round_trip(spark, pages):
    got = sorted(map(str, round_trip(spark, pages).collect()))
    rows, least = pages.collect(), {}
    for r in rows:
        raw = (r["html"] or "").encode()
        if len(raw) >= 100 and r["page_id"] is not None:
            least[raw] = min(least.get(raw, r["page_id"]), r["page_id"])
    want = []
    for r in rows:
        raw = (r["html"] or "").encode()
        first = least.get(raw)
        again = first is not None and first != r["page_id"]
        text = lambda x: None if x is None else str(x)
        want.append((text(r["page_id"]), len(raw), hashlib.sha256(raw).hexdigest(),
                    "revisit" if again else "response", text(first) if again else None))
    from pyspark.sql import Row
    assert got == sorted(str(Row(page_id=a, payload_bytes=b, payload_digest=c, record_type=d, refers_to=e))
                         for a, b, c, d, e in want)


def test_members_and_sidecar(spark, pages):
    blocks = A.normalise(A.write_archives(A.plan_records(pages), scratch_path(spark, "warc"))).collect()
    total = 0
    for path, index in {(b["path"], b["index"]) for b in blocks}:
        raw = open(path.removeprefix("file:"), "rb").read()
        entries = A.read_index(index)
        assert [e["offset"] for e in entries][0] == 0
        assert entries[-1]["offset"] + entries[-1]["length"] == len(raw)
        whole = gzip.decompress(raw)
        for e in entries:
            fields, block = A.read_record(path, e["offset"], e["length"])
            assert fields["WARC-Record-ID"] == e["id"] and fields["WARC-Type"] == e["type"]
            assert block in whole
        total += len(entries)
    assert total == pages.count()


def test_normaliser_reads_whole_streams_and_members():
    raw = b"".join(A.record_bytes(str(i), "u", b"x" * i, i, "d", None) for i in range(50))
    for packed in (A.member(raw), b"".join(A.member(raw[i:i + 777]) for i in range(0, len(raw), 777))):
        reader = A.RecordReader()
        found = [f["WARC-Record-ID"] for data in A.inflated(io.BytesIO(packed)) for f, _, _ in reader.feed(data)]
        reader.close()
        assert found == [f"<urn:page:id:{i}>" for i in range(50)]
    reader = A.RecordReader()
    list(reader.feed(raw[:-3]))
    with pytest.raises(ValueError):
        reader.close()


def test_empty_table(spark):
    assert round_trip(spark, spark.createDataFrame([], DDL)).count() == 0
