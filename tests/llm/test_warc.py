"""WARC: archives parse on their own, the index points at whole records, reads fetch what was asked."""

import gzip
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest

from slatework.llm import warc
from slatework.llm.warc import coalesced, open_index, parsed, read_records, record, with_full_payload, write_archives

BODY = "<html>" + "é漢\r\n\r\nWARC/1.1\r\n" * 20 + "</html>"
VALUES = {"bytes": "CAST(octet_length(payload) AS LONG)", "digest": "sha2(payload, 256)"}


def rows():
    made = [(i, f"http://h{i % 7}/p?q={i}&ä b", BODY + str(i), 1, "x") for i in range(300)]
    made += [(1000 + i, "http://copy/", BODY, 1, "x") for i in range(150)]
    made += [(2000 + i, "http://short/", "short", 1, "x") for i in range(4)]
    made += [(3000, None, None, 1, "x"), (3001, "u\r\nX: y", "", 1, "x"), (None, "http://none", BODY, 1, "x"), (1000, "http://copy/", BODY, 1, "x")]
    return made + [(3002, "http://long", "z\n" * 3_000_000, 1, "x"), (None, "a", "n" * 200, 1, "x"), (None, "b", "n" * 200, 1, "x"), (3003, "c", "c" * 100, 1, "x"), (3004, "d", "c" * 100, 1, "x"), (3005, "d", "c" * 99, 1, "x"), (3006, "d", "c" * 99, 1, "x")]


def expected(data):
    first = {}
    for page, _, html, *_ in data:
        if html and len(html.encode()) >= 100 and page is not None:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, _, html, *_ in data:
        revisit = html in first and page != first[html]
        body = (html or "").encode()
        out.append((None if page is None else str(page), "revisit" if revisit else "response", str(first[html]) if revisit else None, len(body), hashlib.sha256(body).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, digest int, archive string")


def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def test_pages_come_back(spark, tmp_path):
    at = folder(tmp_path)
    index = write_archives(frame(spark, rows()), at, archive_bytes=20_000)
    full = with_full_payload(read_records(index, at), VALUES).collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"], r["bytes"], r["digest"]) for r in full), key=repr) == expected(rows())
    assert all(r["digest"] == r["payload_digest"] for r in full)
    assert index.select("archive").distinct().count() > 3
    assert open_index(spark, at).count() == len(rows())


def test_archives_parse_without_the_index_and_revisits_hold_no_payload(spark, tmp_path):
    at = folder(tmp_path)
    index = write_archives(frame(spark, rows()), at).collect()
    files = pa.fs.LocalFileSystem()
    kinds = {"warcinfo": 0, "response": 0, "revisit": 0}
    for archive in {r["archive"] for r in index}:
        raw = files.open_input_file(f"{at}/archives/{archive}").read()
        text = gzip.decompress(raw)
        while text:
            head, _, rest = text.partition(b"\r\n\r\n")
            size = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
            fields, block = parsed(text[: len(head) + 4 + size + 4])
            kinds[fields["warc-type"]] += 1
            text = rest[size + 4 :]
            if fields["warc-type"] == "revisit":
                assert block.endswith(b"\r\n\r\n") and fields["warc-profile"] == warc.REVISIT_PROFILE
        for r in index:
            if r["archive"] == archive:
                fields, _ = parsed(gzip.decompress(raw[r["offset"] : r["offset"] + r["length"]]))
                assert fields["warc-payload-digest"] == f"sha256:{r['payload_digest']}" and fields["warc-type"] == r["record_type"]
    assert kinds["warcinfo"] == len({r["archive"] for r in index}) and kinds["response"] + kinds["revisit"] == len(rows())
    assert kinds["revisit"] == sum(r[1] == "revisit" for r in expected(rows()))


def test_selected_records_only(spark, tmp_path):
    at = folder(tmp_path)
    index = write_archives(frame(spark, rows()), at)
    some = index.where("CAST(page_id AS INT) % 50 = 0 AND url LIKE 'http://h%'")
    for options in ({}, {"gap": 0, "range_bytes": 300}):
        got = read_records(some, at, **options).collect()
        assert sorted(r["page_id"] for r in got) == sorted(str(i) for i in range(0, 300, 50))
        assert all(bytes(r["payload"]).decode() == BODY + r["page_id"] for r in got)


def test_neighbours_share_a_read():
    places = np.array([(0, 10), (10, 5), (20, 10), (500, 4), (504, 4)])
    assert coalesced(places, 0) == [(0, 2), (2, 3), (3, 5)]
    assert coalesced(places, 5) == [(0, 3), (3, 5)]
    assert coalesced(places, 1000) == [(0, 5)]
    assert coalesced(places[:1], 0) == [(0, 1)]


def test_empty_table_and_headers(spark, tmp_path):
    at = folder(tmp_path)
    index = write_archives(frame(spark, []), at)
    assert index.count() == 0 and with_full_payload(read_records(index, at), VALUES).count() == 0
    fields, block = parsed(record("a b/ü", "http://x/\r\nEvil: 1", b"p", "00", 1, None, "2000-01-01T00:00:00Z"))
    assert "evil" not in fields and fields["warc-target-uri"] == "http://x/%0D%0AEvil:%201" and block.endswith(b"\r\n\r\np")
    assert warc._page_of(fields["warc-record-id"]) == "a b/ü"
    for wrong in (b"HTTP/1.1\r\n\r\n", record("1", "u", b"p", "00", 1, None, "d")[:-1]):
        with pytest.raises(ValueError):
            parsed(wrong)


def test_index_names_only_what_was_committed(spark, tmp_path):
    """A second attempt writes other archives; rows of the first are not in the index."""
    at = folder(tmp_path)
    index = write_archives(frame(spark, rows()[:20]), at)
    (tmp_path / at.rsplit("/", 1)[1] / "archives" / "lost-attempt.warc.gz").write_bytes(b"half a reco")
    assert read_records(index, at).count() == 20
