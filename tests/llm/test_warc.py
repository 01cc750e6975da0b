import base64
import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from stratigraph.llm import warc
from stratigraph.llm.storage import Scratch

from ..conftest import SF

PAGES = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c", None), (4, "", ""), (5, "u\r\nv", "é" * 400_000), (6, "http://f", "x"), (7, "http://g", "one\r\n\r\ntwo"), (8, "http://h", "y" * 300_000)]


def want(pages, least=0):
    groups = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= least:
            groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        last = max(groups.get(h or "", [i]))
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if last == i else "revisit", None if last == i else last))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    got = warc.archive_and_read(pages, least).collect()
    assert sorted(tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got) == want(PAGES, least)
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None}[7] == "one\r\n\r\ntwo"


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = warc.archive_and_read(pages).collect()
    assert sorted(tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got) == want([tuple(r) for r in pages.collect()])


def test_repeated_ids_nulls_and_empty(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", "z"), (None, "n", "x"), (None, "n", "q")]
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_and_read(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, "response", None, 1), (1, "revisit", 1, 1), (1, "response", None, 1), (None, "revisit", 1, 1), (None, "response", None, 1)], key=str)
    assert warc.archive_and_read(spark.createDataFrame([], schema)).count() == 0
    alone = spark.createDataFrame([(None, "a", "long"), (None, "a", "long"), (1, "a", "s"), (1, "a", "s"), (2, "a", "s")], schema)
    assert all(r.record_type == "response" and r.payload is not None for r in warc.archive_and_read(alone, 2).collect())
    scratch = Scratch(spark, "warc-ids")
    many = spark.createDataFrame([(7, "u", "same")] * 40 + [(7, "v", "same")] * 3 + [(5, "u", "same")], schema).repartition(4)
    index = scratch.keep(warc.write_bundles(many, f"{scratch.folder}/b"), "index")
    assert index.select("record_id").distinct().count() == 44
    got = [(r.page_id, r.url, r.record_type, r.refers_to) for r in warc.read_bundles(index).collect()]
    assert got.count((7, "u", "response", None)) == 1 and got.count((7, "u", "revisit", 7)) == 39 and got.count((7, "v", "revisit", 7)) == 3 and got.count((5, "u", "revisit", 7)) == 1


def test_bundles_are_ordinary_zstandard_files(spark):
    scratch = Scratch(spark, "warc-test")
    pages = spark.createDataFrame([(k, f"http://{k}", f"page {k} " * 9000) for k in range(30)], "page_id long, url string, html string").repartition(2)
    index = scratch.keep(warc.write_bundles(pages, f"{scratch.folder}/b"), "index").collect()
    assert max(r.frame for r in index) > 0
    for path in {r.bundle for r in index}:
        raw = open(path.removeprefix("file://"), "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert plain.count(b"WARC/1.1\r\n") == sum(r.bundle == path for r in index)
    one = index[-1]
    with open(one.bundle.removeprefix("file://"), "rb") as f:
        reader = warc.BundleReader(f, len(open(one.bundle.removeprefix("file://"), "rb").read()))
        assert reader.frames[one.frame][:2] == (one.frame_start, one.frame_bytes)
        headers, payload = warc.read_record(reader.frame(one.frame)[one.offset_in_frame :][: one.record_bytes])
    assert headers["WARC-Record-ID"] == one.record_id and payload.decode() == f"page {one.page_id} " * 9000
