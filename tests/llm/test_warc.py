"""WARC: exact round trip, revisit choice, a reader that checks what it reads."""

import gzip
import hashlib
import io

import pytest

from shelfmark.llm import warc

LONG = "é" * 80


def spec(rows):
    first = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and p is not None:
            first[raw] = min(p, first.get(raw, p))
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        f = first.get(raw)
        again = f is not None and f != p
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", f if again else None))
    return out


def test_round_trip(spark):
    rows = [(5, "http://a/", LONG), (3, "http://b/ c\n", LONG), (9, None, LONG), (3, "http://b/", LONG), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", None), (8, "u", ""), (10, "u", "y" * 400_000), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9), (None, "u", LONG), (12, "u", "z" * 100), (13, "u", "z" * 100)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    out = warc.round_trip(pages).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out], key=key) == sorted(spec(rows), key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back_and_archives_rotate(spark):
    from shelfmark.llm.common import workspace

    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.planned(pages), workspace(spark, "t"), archive_bytes=500)
    assert manifest.count() > 4 and sum(r.records for r in manifest.collect()) == 40
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read_archives(manifest, keep_payload=True).collect()}
    assert got == {i: (f"http://x/{i}", f"page {i} " * 50) for i in range(40)}


def test_members_stand_alone_and_damage_is_found():
    raws = [warc.format_record(1, "http://a/", b"one" * 100, None, False), warc.format_record(2, "http://a/", b"one" * 100, 1, True)]
    archive = b"".join(warc.gzip_member(r) for r in raws)
    assert gzip.decompress(archive) == b"".join(raws)

    class Drip(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    got = list(warc.read_records(Drip(archive), keep_payload=True))
    assert [r.payload for r in got] == [b"one" * 100, None] and got[1].payload_bytes == 300 and got[1].payload_digest == got[0].payload_digest
    for bad in (archive[:-9], warc.gzip_member(raws[0].replace(b"oneone", b"twoone")), warc.gzip_member(raws[0][:-30]), warc.gzip_member(b"junk\r\n\r\n"), b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def test_urls_of_any_length_come_back(spark):
    url = "http://a/" + "long" * (600 << 10)
    rows = [(1, url, LONG), (2, url, LONG), (3, "http://b/", "x")]
    folder_rows = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.url) for r in folder_rows) == [(p, u) for p, u, _ in rows]


def test_a_header_without_end_is_refused():
    members = warc._Members(io.BytesIO(gzip.compress(b"WARC/1.1\r\n" + b"x" * 300_000)))
    assert members.next_member()
    with pytest.raises(warc.WarcError, match="too long"):
        members.until(b"\r\n\r\n", most=100_000)
