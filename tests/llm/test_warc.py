import base64
import hashlib
import io
import random

import zstandard

from turnstone.llm import warc
from turnstone.llm.common import new_path


def brute(rows, least):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        ref = first.get(p, i) if i is not None else i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if ref == i else "revisit", None if ref == i else ref))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def test_archives_read_back_whole(spark):
    rng = random.Random(1)
    bodies = ["", None, "<p>é</p>", "x" * 400_000, "a\r\n\r\nWARC/1.1\r\n\r\n", "same"]
    rows = [(i, rng.choice(["http://a/é b", None, "u\r\nX: y"]), rng.choice(bodies)) for i in range(120)] + [(500 + i, "u", "hot") for i in range(80)]
    rows += [(None, "u", "same"), (7, "u", "own")]
    df = pages(spark, rows).repartition(3)
    for least in (0, 5):
        index = warc.write_warc(df, new_path(spark, "warc"), least_bytes=least, bundle_records=25, frame_bytes=2000)
        got = [(None if r.id is None else int(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in warc.read_warc(index).collect()]
        assert sorted(got, key=str) == brute(rows, least)
    for r in index.limit(40).collect():
        headers, payload = warc.read_record(r.bundle, r.frame, r.offset)
        assert warc._from_urn(headers["WARC-Record-ID"]) == r.id
        if headers["WARC-Type"] == "response":
            assert payload.decode() in {x[2] or "" for x in rows if (x[0] is None) == (r.id is None) and (r.id is None or x[0] == int(r.id))}
    assert warc.write_warc(df.limit(0), new_path(spark, "warc")).count() == 0


def test_any_zstandard_reader_takes_a_bundle():
    out = io.BytesIO()
    w = warc.BundleWriter(out, frame_bytes=100)
    records = [warc.record(str(i), "u", b"p" * i) for i in range(9)]
    places = [w.add(r) for r in records]
    w.close()
    data = out.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records)
    table = warc.seek_table(io.BytesIO(data), len(data))
    for (frame, at, offset, size), r in zip(places, records):
        assert table[frame][0] == at
        frame_data = zstandard.ZstdDecompressor().decompress(data[at : at + table[frame][1]])
        assert frame_data[offset : offset + size] == r


def test_bundles_are_read_back_by_many_tasks(spark):
    index = spark.createDataFrame([(f"bundle-{k % 100}",) for k in range(400)], "bundle string")
    assert warc.read_warc(index).rdd.getNumPartitions() == 25
    assert warc.read_warc(index.limit(0)).count() == 0
