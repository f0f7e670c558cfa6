import base64
import gzip
import hashlib
import io
import zlib

from folio.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"
ROWS = [
    (1, "http://a.org/x#f", "abc"),
    (2, "http://c.org/", None),
    (3, None, "abc"),
    (4, "a b\r\nc", "x\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1"),
    (5, "u", "WARC/1.1\r\nWARC/1.1\r\n"),
    (None, "u", "abc"),
    (7, "u", "é" * 5000 + "\n"),
    (8, "u", ""),
    (9, "u", "twice"),
    (9, "u", "twice"),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)
    for n, (compression, scattered) in enumerate((("gzip", False), ("none", True))):
        path = f"{tmp_path}/w{n}"
        warc.write_archives(pages, path, chunk_bytes=999, compression=compression)
        got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(spark, path, scattered).collect()), key=str)
        want = []
        for page_id, _, html in ROWS:
            payload = (html or "").encode()
            best = max(r[0] or 0 for r in ROWS if (r[2] or "") == (html or ""))
            same = (page_id or 0) == best
            want.append((page_id or 0, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if same else "revisit", None if same else best))
        assert got == sorted(want, key=str)


def test_chunks_hold_no_separator_and_carry_digests(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA), path, chunk_bytes=1000)
    by = {}
    for r in warc.read_chunks(spark, path).orderBy("record_id", "chunk_no").collect():
        by.setdefault((r["page_id"], r["record_id"]), []).append(r)
    long = next(v for (page, _), v in by.items() if page == 7)
    assert [r["chunk_no"] for r in long] == list(range(11)) and [r["is_last"] for r in long] == [False] * 10 + [True]
    done = hashlib.sha1()
    for r in long:
        assert len(r["data"]) <= 1000
        done.update(bytes(r["data"]))
        assert r["running_digest"] == base64.b32encode(done.digest()).decode()
    for data in (b"", b"WARC/1.1\r\n", b"a\r\n\r\nWARC/1.1\r\nb\r\n\r\nWARC/1.1\r\n", b"\r\n\r\nWARC/1.1", b"\r\n\r\nWARC"):
        pieces = warc.cut(data)
        assert b"".join(pieces) == data and all((warc.END + p + warc.END).find(warc.BETWEEN) < 0 for p in pieces)


def test_small_payloads_are_responses_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/a", least_bytes=4)
    assert {r["record_type"] for r in warc.read_records(spark, f"{tmp_path}/a").collect()} == {"response"}
    warc.write_archives(pages.limit(0), f"{tmp_path}/b")
    assert warc.read_records(spark, f"{tmp_path}/b").count() == 0


def test_revisits_resolve_and_joins_agree(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA).repartition(3)
    pages.write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    warc.write_archives(pages, f"{tmp_path}/w", chunk_bytes=999)
    heads = {}
    for file in (tmp_path / "w").glob("*.warc.gz"):
        # What a record-wise reader sees: members, each a whole record or nothing.
        rest = file.read_bytes()
        while rest:
            member = zlib.decompressobj(31)
            record, rest = member.decompress(rest), member.unused_data
            if not record:
                continue
            assert record.startswith(warc.VERSION) and record.endswith(warc.END)
            fields, _ = warc.parse_record(record)
            assert fields["warc-record-id"] not in heads
            heads[fields["warc-record-id"]] = fields
    revisits = [h for h in heads.values() if h["warc-type"] == "revisit"]
    assert len(revisits) == 3
    for h in revisits:
        target = heads[h["warc-refers-to"]]
        assert target["warc-type"] == "response" and target["warc-payload-digest"] == h["warc-payload-digest"]
    both = []
    for most_sent in (0, 100):
        rows, shared = warc.classify(pages, most_sent=most_sent)
        assert shared.count() == 3
        both.append(sorted(map(str, rows.select("page_id", "row", "digest", "winner", "winner_row").collect())))
    assert both[0] == both[1]


def test_files_are_plain_gzip_and_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "\r\n\r\nWARC/1.1\r\n" * 20_000)], "page_id long, url string, html string").coalesce(1)
    plain = []
    for compression in ("gzip", "none"):
        path = tmp_path / compression
        warc.write_archives(pages, str(path), compression=compression)
        (file,) = path.glob("part-*")
        plain.append(gzip.GzipFile(fileobj=io.BytesIO(file.read_bytes())).read() if compression == "gzip" else file.read_bytes())
        assert {(r["page_id"], r["payload_bytes"]) for r in warc.read_records(spark, str(path), compression == "none").collect()} == {(1, 3), (2, 280_000)}
    assert plain[0] == plain[1]
