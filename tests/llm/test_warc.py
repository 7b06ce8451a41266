"""The WARC operator against plain Python, gzip itself and DuckDB."""

import gzip
import hashlib
import io
import zlib

import duckdb
import pytest

from typeflow.llm import warc
from typeflow.llm.common import new_folder, table

LONG = "ü" * 600 + "<p>text</p>"
ROWS = [
    (1, "http://a/1", "short"),
    (2, "http://a/2", "short"),
    (3, "http://a/3", LONG),
    (9, "http://a/9 x\r\nX-Key: 7", LONG),
    (4, None, LONG),
    (9, "http://a/again", LONG),
    (None, "http://a/null", LONG),
    (5, "", None),
    (6, "u", ""),
    (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100),
    (8, "u", "x" * 3_000_000),
    (10, "u", "y" * 999),
    (11, "u", "y" * 999),
    (12, "u", "z" * 1000),
    (13, "u", "z" * 1000),
    (None, "u", "n" * 2000),
    (None, "u", "n" * 2000),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u, h, "x", 1, "d") for k, u, h in ROWS]
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string, bytes int, digest string").repartition(3)


def expected(rows):
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        keys = [k for k, _, h in rows if (h or "").encode() == data and k is not None]
        refers = max(keys) if len(data) >= 1000 and keys and key != max(keys) else None
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def query(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "table", lambda *_: pages)
    return sorted((tuple(r) for r in warc.op11_warc(spark, "").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_rows_against_plain_python(spark, pages, monkeypatch):
    assert query(spark, pages, monkeypatch) == expected(ROWS)
    assert query(spark, pages.where("false"), monkeypatch) == []


def test_rows_against_sql(spark, pages, monkeypatch):
    con = duckdb.connect()
    frame = pages.select("page_id", "html").toPandas().astype({"page_id": "Int64"})
    con.register("pages", frame)
    want = sorted((tuple(r) for r in con.sql(warc.ORACLE_SQL).select("page_id, payload_bytes, payload_digest, record_type, refers_to").fetchall()), key=repr)
    assert query(spark, pages, monkeypatch) == want


def test_every_record_is_a_member_of_its_own(spark, pages):
    whole, single = new_folder(spark, "t"), new_folder(spark, "t")
    warc.write_archives(pages, whole)
    files = warc.archive_files(spark, whole)
    assert 1 <= files.count() <= 3
    warc.normalise(files, single)
    index = warc.read_index(spark, single)
    rows = index.orderBy("file", "offset").collect()
    assert len(rows) == len(ROWS)
    read = lambda path: warc.opened(path)[0].open_input_stream(warc.opened(path)[1], compression=None).read()
    streams = sorted(gzip.decompress(read(r.path)) for r in files.collect())
    for r in files.collect():  # one member as they are written
        z = zlib.decompressobj(31)
        z.decompress(read(r.path))
        assert z.eof and not z.unused_data
    again = []
    for name in {r.file for r in rows}:
        data, at = read(f"{single}/{name}"), 0
        for r in (r for r in rows if r.file == name):
            assert r.offset == at
            member = gzip.decompress(data[at : at + r.length])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
            at += r.length
        assert at == len(data)
        again.append(gzip.decompress(data))
    assert sorted(again) == streams
    back = warc.read_archives(single, index).collect()
    held = {(k, h) for k, _, h in ROWS}
    for r in back:
        assert r.payload is None if r.record_type == "revisit" else (r.key, bytes(r.payload).decode()) in held | {(5, "")}
    # records by key open only their members
    few = warc.read_archives(single, index.where("key IN (7, 8)")).collect()
    assert {r.key: bytes(r.payload).decode() for r in few} == {k: h for k, _, h in ROWS if k in (7, 8)}
    assert next(r.url for r in back if r.key == 9 and "%0D%0A" in r.url) == "http://a/9%20x%0D%0AX-Key:%207"


def stream_of(data):
    s = warc.Inflated(io.BytesIO(data), "f")
    out = []
    while (h := s.header()) is not None:
        out.append((h, b"".join(s.pieces(int(warc.fields(h)["content-length"])))))
    return out


def made(body, kind="response"):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_streams_of_any_members(monkeypatch):
    bodies = [b"", b"\r\n", b"a" * 5000, b"\r\n\r\nWARC/1.0\r\n" * 50]
    raw = b"".join(map(made, bodies))
    for piece in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(warc, "PIECE", piece)
        half = len(raw) // 2
        for data in (gzip.compress(raw), gzip.compress(raw[:half]) + gzip.compress(raw[half:]) + b"\0" * 9, b"".join(gzip.compress(made(b)) for b in bodies)):
            assert [b for _, b in stream_of(data)] == bodies
    assert stream_of(b"") == []
    packed = gzip.compress(raw)
    for cut in (5, len(packed) - 3, len(packed) // 2):
        with pytest.raises(ValueError, match="f: the file ends"):
            stream_of(packed[:cut])
    with pytest.raises(ValueError, match="inside a record"):
        stream_of(gzip.compress(raw[:-60]))
    with pytest.raises(ValueError, match="inside a record's header"):
        stream_of(gzip.compress(made(b"x") + b"WARC/1.0\r\nA: b"))
    with pytest.raises(ValueError, match="no WARC record"):
        stream_of(gzip.compress(b"HTTP/1.1 200\r\n\r\n"))
    with pytest.raises(ValueError, match="f: "):
        stream_of(b"no gzip at all")


def test_changed_payload_is_an_error(spark):
    head = b"HTTP/1.1 200 OK\r\n\r\n"
    good = hashlib.sha1(b"body").hexdigest()
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:%s\r\nX-Payload-Length: 4\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%sBODY\r\n\r\n"
    folder = new_folder(spark, "t")
    place, path = warc.opened(folder)
    place.create_dir(path)
    with place.open_output_stream(f"{path}/a.warc.gz", compression=None) as out:
        out.write(gzip.compress(record % (good.encode(), len(head) + 4, head)))
    with pytest.raises(Exception, match="misses its digest"):
        warc.normalise(warc.archive_files(spark, folder), new_folder(spark, "t"))


def test_given_table(spark, sf_dir):
    got = warc.op11_warc(spark, sf_dir)
    assert got.count() == table(spark, sf_dir, "pages").count()
    want = sorted(map(repr, duckdb.sql(warc.ORACLE_SQL.replace("FROM pages", f"FROM '{sf_dir}/pages.parquet'")).fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want
