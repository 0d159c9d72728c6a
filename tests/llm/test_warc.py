import base64
import gzip
import hashlib
import io
import random

import pytest
from pyarrow import fs

from readsieve.llm import warc
from readsieve.session import fresh_path
from tests.llm.fixtures import rows_of

SCHEMA = "page_id long, url string, html string, digest string, file string"
ROWS = [
    (1, "http://a/1", "<html>same</html>"),
    (2, "http://a/2", "<html>same</html>"),
    (9, "http://a/9", "<html>same</html>"),
    (9, "http://a/9", "<html>same</html>"),
    (3, "http://a/3", ""),
    (4, None, None),
    (5, "http://é/\r\nx", "é😀\r\n\r\nWARC/1.1\r\n"),
    (6, "", "x" * 300_000),
    (None, "http://a/n", "<html>same</html>"),
    (None, "http://a/m", "alone"),
    (None, "http://a/m", "alone"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "d", "f") for r in rows], SCHEMA)


def brute(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        revisit = bool(ids) and page_id != max(ids)
        out.append(
            (
                page_id,
                len(payload),
                base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                "revisit" if revisit else "response",
                max(ids) if revisit else None,
            )
        )
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    found = warc.write_and_read(pages(spark).repartition(3))
    assert rows_of(found) == brute(ROWS)
    assert warc.write_and_read(pages(spark, [])).count() == 0


def test_small_files_and_a_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rng = random.Random(1)
    rows = [(i, f"u{i}", "hot" if i % 3 else f"page {rng.random()}" * 20) for i in range(300)]
    written, folder = warc.archive(pages(spark, rows).repartition(4))
    assert written.count() > 8
    assert rows_of(warc.read_archives(written, folder)) == brute(rows)


def records():
    return [warc.page_record(i, f"http://x/{i}", f"payload {i} " * (i * 50)) for i in range(20)]


def test_records_of_a_stream_in_small_pieces(monkeypatch):
    data = b"".join(r.to_bytes() for r in records())
    cut_at = len(data) // 3
    for stream in (gzip.compress(data), gzip.compress(data[:cut_at]) + gzip.compress(data[cut_at:])):
        for chunk in (3, 100, 1 << 20):
            monkeypatch.setattr(warc, "CHUNK", chunk)
            found = list(warc.read_records(io.BytesIO(stream), "s"))
            assert [f.block for f in found] == [r.block for r in records()]
            assert [f.headers["WARC-Target-URI"] for f in found] == [r.headers["WARC-Target-URI"] for r in records()]


@pytest.mark.parametrize("damage", [lambda d: d[:-20], lambda d: b"plain text", lambda d: gzip.compress(gzip.decompress(d)[:-7])])
def test_damaged_streams_are_named(damage):
    data = gzip.compress(b"".join(r.to_bytes() for r in records()))
    with pytest.raises(ValueError, match="file-x"):
        list(warc.read_records(io.BytesIO(damage(data)), "file-x"))


def test_normalise_a_monolithic_file(spark):
    source, target = fresh_path(spark, "in"), fresh_path(spark, "out")
    local = fs.LocalFileSystem()
    local.create_dir(source)
    with local.open_output_stream(f"{source}/whole.warc.gz", compression=None) as out:
        out.write(gzip.compress(b"".join(r.to_bytes() for r in records())))
    changes = "array<struct<seq: long, refers_to: long>>"
    files = spark.createDataFrame([("whole.warc.gz", [(3, 17)])], f"file string, changes {changes}")
    [row] = warc.normalise(files, source, target).collect()
    assert row["n_records"] == 20
    entries = list(warc.read_index(local, f"{target}/{row['index']}"))
    with local.open_input_file(f"{target}/{row['archive']}") as file:
        whole = file.read()
        assert len(whole) == sum(e["length"] for e in entries)
        for i in (19, 0, 3, 7):  # any order
            found = warc.read_member(file, entries[i]["offset"], entries[i]["length"], "x")
            assert found.headers["WARC-Record-ID"] == f"<urn:page:{i}>" == entries[i]["id"]
            if i == 3:
                assert found.headers["WARC-Type"] == "revisit" and found.payload == b""
                assert found.headers["WARC-Refers-To"] == "<urn:page:17>"
            else:
                assert found.block == records()[i].block
            member = whole[entries[i]["offset"] :][: entries[i]["length"]]
            assert gzip.decompress(member) == found.to_bytes()
    # The members make up a readable stream too.
    assert len(list(warc.read_records(io.BytesIO(whole), "x"))) == 20


def test_line_ends_in_urls_stay_out_of_the_head():
    record = warc.page_record(1, "a\r\nWARC-Type: revisit b", "x")
    [found] = warc.read_records(io.BytesIO(gzip.compress(record.to_bytes())), "x")
    assert found.headers["WARC-Type"] == "response"
    assert found.headers["WARC-Target-URI"] == "a%0D%0AWARC-Type:%20revisit%20b"
