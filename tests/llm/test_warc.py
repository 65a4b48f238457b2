import base64
import gzip
import hashlib

import pytest

from dossierlake.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


ROWS = [
    (5, "http://a/x y", "same"), (3, "http://a/1", "same"), (9, None, "same"), (1, "http://b", None), (2, "http://c", ""), (4, "u", "é🙂\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "u", "x" * 300_000), (7, "u", "x" * 300_000), (None, "n", "same"), (None, "n", "alone"), (None, "n", "alone"), (3, "http://a/1", "same"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_id int")


def test_round_trip(spark):
    got = warc.warc_digest(frame(spark, ROWS)).collect()
    body = lambda t: (t or "").encode()
    want = []
    for i, _, t in ROWS:
        first = min((p for p, _, x in ROWS if body(x) == body(t) and p is not None), default=None)
        again = first is not None and i != first
        want.append((i, len(body(t)), digest(body(t)), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_minimum_size_and_empty_table(spark, tmp_path):
    warc.convert(warc.pages_to_arc(frame(spark, ROWS)), str(tmp_path / "w"), min_bytes=10)
    types = {(r.page_id, r.payload_bytes): r.record_type for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert types[5, 4] == "response" and types[7, 300_000] == "revisit"
    assert warc.warc_digest(frame(spark, ROWS).limit(0)).count() == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_versions_and_lengths(version):
    fields = {"URL": "http://x", "IP-address": "1.2.3.4", "Archive-date": "19970101120000", "Content-type": "text/html", "Result-code": "200"}
    blocks = [b"", b"a\nb\n", b"http://fake 1.2.3.4 1997 text/html 3\nabc", bytes(range(256))]
    data = warc.arc_head("f.arc", version) + b"".join(warc.arc_record(fields, b, version) for b in blocks)
    for content in (data, gzip.compress(data)):
        got = list(warc.parse_arc(content))
        assert [b for _, b in got] == blocks and all(f["Archive-date"] == "19970101120000" for f, _ in got)
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-40]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://x 1.2.3.4 1997 text/html 3\nabc\n"))


def test_url_with_spaces():
    head = warc.arc_head("f", "1")
    (fields, block), = warc.parse_arc(head + b"http://x/a b 1.2.3.4 19970101120000 text/html 2\nok\n")
    assert fields["URL"] == "http://x/a b" and block == b"ok"


def test_files_are_whole_records(spark, tmp_path):
    warc.convert(warc.pages_to_arc(frame(spark, ROWS)), str(tmp_path / "w"))
    for f in (tmp_path / "w").glob("part-*"):
        raw = gzip.decompress(f.read_bytes())
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


def test_very_long_pages_take_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3_000_000)
    rows = [(i, "u", f"{i} " * 700_000) for i in range(4)] + [(9, "u", "short")]
    warc.convert(warc.pages_to_arc(frame(spark, rows).coalesce(1)), str(tmp_path / "w"), largest=2_000_000)
    assert len(list((tmp_path / "w").glob("part-*"))) == 5
    assert {r.page_id: r.payload_bytes for r in warc.read_warc(spark, str(tmp_path / "w")).collect()} == {i: len(t) for i, _, t in rows}
