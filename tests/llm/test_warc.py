import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hostvigil.llm import warc
from hostvigil.session import new_path


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "x") for k, u, h in rows], "page_id LONG, url STRING, html STRING, payload STRING").repartition(3)


def cases():
    rng = random.Random(8)
    big = "é<p>" * 5000
    rows = [(i, f"http://x/{i}", "".join(rng.choice("ab é\r\n") for _ in range(rng.choice([0, 5, 999, 1000, 3000, 20_000])))) for i in range(40)]
    rows += [(100, None, None), (101, "u\r\nWARC/1.1\r\n", "WARC/1.1\r\n" * 300), (102, "a b", "WARC/1.1\r\n"), (103, "", big), (104, "x", big), (105, "y", big), (106, "z", "s" * 999), (107, "z", "s" * 999), (108, "z", "0\r\n\r\n" * 400)]
    rows += [(120 + i, "m", "x" * n + "WARC/1.1" + tail) for i, (n, tail) in enumerate([(5, ""), (4088, "y" * 9), (4088, ""), (92, "y"), (8192 - 8, "\r\n"), (8101, "y" * 200), (6992, "")])]
    return rows + [(None, "n", "no id"), (110, "n", "t" * 1000), (110, "m", "t" * 1000)]


def plain(rows):
    out, best = [], {}
    for k, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 1000:
            best[data] = max(best.get(data, k), k)
    for k, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and k != best[data]
        out.append((-1 if k is None else k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best[data] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment,chunk", [(8192, 4096), (100, 7), (10**9, 10**9)])
def test_round_trip(spark, segment, chunk):
    rows = [r for r in cases() if r[0] != 110]
    path = new_path(spark, "warc-test")
    warc.write_archive(pages(spark, rows), path, segment=segment, chunk=chunk)
    read = warc.read_archive(spark, path).collect()
    assert all(r.problem is None for r in read)
    found = sorted(((int(r.page_id) if r.page_id else -1, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in read), key=str)
    assert found == plain(rows)
    payloads = {int(r.page_id): bytes(r.payload) for r in read if r.payload is not None and r.page_id}
    assert all(payloads[k] == (h or "").encode() for k, _, h in rows if k in payloads)


def test_rows_that_share_an_id_and_empty_tables(spark):
    read = warc.round_trip(pages(spark, [r for r in cases() if r[0] == 110])).collect()
    assert sorted((r.record_type, r.refers_to or "") for r in read) == [("response", ""), ("revisit", "110")]
    twice = [(1, "u", "é" * 9000)] * 2
    assert [(r.record_type, r.payload_bytes, r.problem) for r in warc.round_trip(pages(spark, twice)).collect()] == [("response", 18_000, None)] * 2
    assert warc.round_trip(pages(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("data", [b"", b"a", b"WARC/1.1\r\n" * 3, b"WARC/1.1", b"abWARC/1.1", b"WARC/1.1" * 5, bytes(range(256)) * 20])
def test_chunked_framing(data):
    for size in (1, 5, 1000):
        framed = warc.chunked(data, size)
        assert warc.dechunked(framed) == data and warc.MARK not in framed
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"


def test_no_cut_makes_a_mark(spark):
    """The version name at the end of the payload, of a chunk and of a segment, at all offsets."""
    rows = [(i, "u", "x" * n + "WARC/1.1") for i, n in enumerate(range(0, 60))] + [(100 + i, "u", "x" * n + "WARC/1.1" + "y" * 50) for i, n in enumerate(range(0, 60))]
    path = new_path(spark, "warc-cuts")
    warc.write_archive(pages(spark, rows), path, segment=40, chunk=13)
    read = warc.read_archive(spark, path).collect()
    assert all(r.problem is None for r in read)
    assert {int(r.page_id): bytes(r.payload).decode() for r in read} == {k: h for k, _, h in rows}


@pytest.mark.parametrize("body", [b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"1\r\nab\r\n"])
def test_broken_framing_is_refused(body):
    with pytest.raises(ValueError):
        warc.dechunked(body)


def test_missing_and_altered_segments_are_reported(spark):
    path, broken = new_path(spark, "warc-test"), new_path(spark, "warc-broken")
    warc.write_archive(pages(spark, [(i, "u", f"{i}" * 3000) for i in range(1, 5)]), path, segment=1000)
    lines = spark.read.option("lineSep", "WARC/1.1\r\n").text(path).where("value <> ''")
    lines = lines.where(~(F.contains("value", F.lit("urn:page:1:")) & F.contains("value", F.lit("Segment-Number: 2"))))
    lines = lines.where(~(F.contains("value", F.lit("urn:page:2:")) & F.contains("value", F.lit("Total-Length"))))
    lines = lines.withColumn("value", F.regexp_replace("value", "333333", "334333"))
    lines.select(F.concat(F.lit("WARC/1.1\r\n"), F.rtrim("value", F.lit("\n"))).alias("value")).write.text(broken)
    found = {r.page_id: r.problem for r in warc.read_archive(spark, broken).collect()}
    assert found == {"1": "segments missing", "2": "total length differs", "3": "digest differs", "4": None}
