import base64
import gzip
import hashlib
import random
import re
from collections import defaultdict

import pytest

from chronocell.llm import warc
from chronocell.llm.warc import BadWarc, archive_round_trip, page_record, read_archives, read_records, record, sha1_label, with_revisits, write_archives

from chronocell.sources.scratch import Scratch

SCHEMA = "page_id long, url string, html string, record_type string"


def brute(rows, least=1000):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        last = max((x for x in groups[p] if x is not None), default=None)
        ref = last if len(p) >= least and len(groups[p]) > 1 and last is not None and i != last else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    big, edge = "é<p>" * 400, "x" * 1000
    rows = [(1, "http://a", big), (2, None, big), (5, "", big), (3, "http://b\n c", None), (4, "u", ""), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", edge), (9, "u", edge), (9, "u", edge), (None, "u", edge), (-3, "u", "\r\n\r\nWARC/1.1" * 90)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = archive_round_trip(df, archive_bytes=3000).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert all(r["digests_ok"] for r in got)
    assert archive_round_trip(df.limit(0)).count() == 0


def test_members_are_gzip_and_faults_are_seen(spark):
    one, two = page_record(1, "http://x/é", b"abc" * 50_000, None), page_record(2, None, b"", 1)
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\nWARC-Type: response")
    found = list(read_records(one + two))
    assert [o for o, _, _ in found] == [0, len(one)] and found[0][2].endswith(b"abc") and found[0][1]["warc-target-uri"] == "http://x/é"
    for bad in (one[:-9], one[:40], b"junk" + one, gzip.compress(b"HTTP/1.1\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n")):
        with pytest.raises(BadWarc):
            list(read_records(bad))
    wrong = record({"WARC-Type": "resource", "WARC-Record-ID": "<x>", "WARC-Block-Digest": sha1_label(b"other"), "WARC-Payload-Digest": "md5:00"}, b"this")
    rows = [("a", one + two + one[:100]), ("b", None), ("c", b""), ("d", wrong)]
    got = read_archives(spark.createDataFrame(rows, "archive string, content binary")).collect()
    assert sorted(((r["archive"], r["error"] is None, r["block_ok"], r["payload_ok"]) for r in got if r["error"] is None), key=str) == [("a", True, True, None), ("a", True, True, True), ("d", True, False, None)]
    assert sorted((r["archive"], r["offset"]) for r in got if r["error"]) == [("a", len(one)), ("b", 0)]


def test_archives_split_by_size(spark):
    df = spark.createDataFrame([(i, "u", "".join(hashlib.sha1(f"{i}/{k}".encode()).hexdigest() for k in range(50)), "") for i in range(1, 60)], SCHEMA).coalesce(1)
    assert write_archives(with_revisits(df, Scratch(spark, "test")), 5000).count() > 5


def test_copies_of_one_page_and_short_pages(spark):
    # A third of the rows is one page, most others are short; an empty filter and a full one give the same.
    rows = [(i, f"http://h/{i}", ("copy " * 250 if i % 3 == 0 else f"short {i % 5}" if i % 3 == 1 else f"own {i} " * 200)) for i in range(600)]
    got = archive_round_trip(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert {r["refers_to"] for r in got} == {None, 597}


def test_a_long_url_loses_no_page(spark):
    url = "data:text/html;base64," + base64.b64encode(random.Random(5).randbytes(1_500_000)).decode()
    rows = [(1, "u", "one"), (2, url, "two"), (3, "u", "three")]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA).coalesce(1)
    got = archive_round_trip(df).collect()
    assert sorted((r["page_id"], r["uri"], r["payload_bytes"], r["digests_ok"]) for r in got) == [(i, u, len(h), True) for i, u, h in rows]


def test_an_archive_that_breaks_off_fails(spark, monkeypatch):
    broken = spark.createDataFrame([("a", page_record(1, "u", b"x", None)[:-9])], "archive string, content binary")
    monkeypatch.setattr(warc, "write_archives", lambda pages, archive_bytes: broken)
    df = spark.createDataFrame([(1, "u", "x", "")], SCHEMA)
    with pytest.raises(Exception, match="archive a: the member ends early"):
        archive_round_trip(df).select("page_id").collect()


def test_a_record_that_was_tampered_with_fails(spark, monkeypatch):
    def archives(change):
        record = gzip.decompress(page_record(1, "u", b"a page of its own", None))
        return spark.createDataFrame([("a", gzip.compress(change(record)))], "archive string, content binary")

    df = spark.createDataFrame([(1, "u", "x", "")], SCHEMA)
    other = base64.b32encode(hashlib.sha1(b"other").digest())
    cases = {
        "a block does not fit": lambda r: r.replace(b"a page of its own", b"a page of his own"),
        "a payload does not fit": lambda r: re.sub(rb"(?i)(warc-payload-digest: sha1:)\w+", lambda m: m[1] + other, r),
    }
    for fault, change in cases.items():
        monkeypatch.setattr(warc, "write_archives", lambda pages, archive_bytes, change=change: archives(change))
        with pytest.raises(Exception, match=f"archive a: {fault} its digest"):
            archive_round_trip(df).select("payload_digest").collect()
    monkeypatch.setattr(warc, "write_archives", lambda pages, archive_bytes: archives(lambda r: r))
    assert archive_round_trip(df).first()["payload_digest"] == hashlib.sha1(b"a page of its own").hexdigest()
