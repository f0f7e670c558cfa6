"""WARC archives through a chunked record table: rows of a record and a chunk number, with running digests.

A payload longer than a chunk is written as WARC segments (a response and its continuations), so neither side ever
holds a whole archive, and Python never holds a whole long record. Archives are written by Spark's text sink and read
by its text source with a separator that no segment contains: the writer cuts a segment wherever its bytes would hold
one. Compressed archives have a gzip member for each record, so a reader can begin at any of them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, paths_of, release, rename

VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: What the reader splits at: the end of one record and the version line of the next.
BETWEEN = END + VERSION
SEPARATORS = re.compile(b"(?=" + re.escape(BETWEEN) + b")")
#: The sink ends every row with bytes of its own; those of compressed archives are a member without content.
NO_CONTENT = gzip.compress(b"", mtime=0)
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = "record_id string, chunk_no int, record_type string, refers_to string, uri string, page_id long, payload_bytes long, payload_digest string, is_last boolean, data binary, running_digest string"
RECORD_SCHEMA = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, chunks int"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def cut(data: bytes) -> list[bytes]:
    """``data`` in pieces none of which, once framed by blank lines, holds the reader's separator; in linear time."""
    at = [0, *(m.start() + 4 for m in SEPARATORS.finditer(END + data + END)), len(data)]
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def classify(pages: DataFrame, least_bytes: int = 0, most_sent: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """page_id, url and html with row, payload, payload_bytes, digest (hex), winner and winner_row; and a table to release.

    ``winner`` is the largest page_id among rows with equal payloads (null sorts lowest) and ``winner_row`` the
    largest row with it, or the row's own for payloads that stand alone or are under ``least_bytes``. Only digests
    and ids are grouped, combined before the shuffle. Digests that several rows share are written and counted: up to
    ``most_sent`` are broadcast, so payloads stay where the scan puts them; beyond it the join spreads rows by digest
    and an adaptive join splits one that many rows share.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row")).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    best = F.max(F.struct("page_id", "row")).alias("best")
    shared = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))
    shared = materialize(shared.where("n > 1").select("digest", "best"), "digests")
    found = rows.join(F.broadcast(shared) if shared.count() <= most_sent else shared.hint("merge"), "digest", "left")
    alone = F.col("best").isNull()
    winner = F.when(alone, F.col("page_id")).otherwise(F.col("best.page_id"))
    return found.withColumn("winner", winner).withColumn("winner_row", F.when(alone, F.col("row")).otherwise(F.col("best.row"))).drop("best"), shared


def _frame(fields: list[tuple[str, str]], content: bytes) -> bytes:
    """A record without its version line's predecessor and without the blank lines that end it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(content)))])
    return VERSION + head.encode("utf-8") + b"\r\n" + content


def _clean(uri: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri)


def _name(page_id: int | None, row: int) -> str:
    """A record's id: rows may repeat a page_id, so it ends in the row's number in the table."""
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def _write_records(date: str, members: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, segment, at = None, 0, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                name = _name(row["page_id"], row["row"])
                same = row["page_id"] == row["winner"]
                kind = "response" if same else "revisit"
                digest = "sha1:" + base32(bytes.fromhex(row["digest"]))
                fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date)]
                if row["url"] is not None:
                    fields.append(("WARC-Target-URI", _clean(row["url"])))
                shared = [("WARC-Payload-Digest", digest), ("Payload-Length", str(row["payload_bytes"]))]
                if not same:
                    refers = _name(row["winner"], row["winner_row"])
                    out.append(_frame([*fields, *shared, ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", refers), ("Content-Type", "application/http; msgtype=response")], HTTP_HEAD))
                    continue
                if at != row["row"]:
                    at, segment, running = row["row"], 0, hashlib.sha1()
                pieces = cut(row["chunk"])
                for i, piece in enumerate(pieces):
                    running.update(piece)
                    segment += 1
                    last = row["last"] and i == len(pieces) - 1
                    more = [("Running-Digest", "sha1:" + base32(running.copy().digest()))]
                    if segment == 1:
                        # A record of one segment is an ordinary one and needs no segment number.
                        number = [] if last else [("WARC-Segment-Number", "1")]
                        out.append(_frame([*fields, *shared, *number, *more, ("Content-Type", "application/http; msgtype=response")], HTTP_HEAD + piece))
                    else:
                        total = [("WARC-Segment-Total-Length", str(row["payload_bytes"] + len(HTTP_HEAD)))] if last else []
                        out.append(_frame([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{segment}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(segment)), *total, *more], piece))
            if members:
                out = [gzip.compress(x + END, 6, mtime=0) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = 1 << 20, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write a WARC record for each row of ``pages`` (page_id, url, html) below ``path``.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least ``least_bytes``, that
    with the largest page_id becomes a response and the others revisits without payload, which refer to its record
    by id; rows that repeat the largest id are all responses, and the last of them is referred to. A payload over
    ``chunk_bytes`` is dealt into chunks by the JVM, row by row, and framed as segments that stand together in one
    file. An empty table gives no records. ``compression`` is gzip, with a member for each record and one without
    content behind it (the sink's row end), or none. ``pages`` is read twice and numbers its rows by partition, so it
    must come in the same partitions again, as a table does.
    """
    if compression not in ("gzip", "none"):
        raise ValueError(f"archives are compressed by gzip or none, not {compression}")
    members, spark = compression == "gzip", pages.sparkSession
    rows, shared = classify(pages, least_bytes)
    revisit = ~F.col("page_id").eqNullSafe(F.col("winner"))
    count = F.when(revisit, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk_bytes))).cast("int")
    part = F.when(revisit, F.lit(b"")).otherwise(F.substring(F.col("payload"), F.col("n") * chunk_bytes + 1, F.lit(chunk_bytes)))
    chunks = rows.withColumn("count", count).withColumn("n", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    chunks = chunks.select("page_id", "row", "url", "digest", "payload_bytes", "winner", "winner_row", (F.col("n") == F.col("count") - 1).alias("last"), part.alias("chunk"))
    framed = chunks.mapInArrow(_write_records(date, members), "value binary").select(F.col("value").cast("string").alias("value"))
    # As Latin-1 the option gives the sink these bytes as they are.
    end = NO_CONTENT if members else END
    framed.write.options(lineSep=end.decode("latin-1"), encoding="ISO-8859-1", compression="none").text(path)
    for made in paths_of(spark, path):
        if made.endswith(".txt"):
            rename(spark, made, made.removesuffix("txt") + ("warc.gz" if members else "warc"))
    release(shared)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-cased name, and the content, of a record as the text source splits it."""
    raw = raw.removeprefix(VERSION)
    at = raw.find(END)
    if at < 0:
        raise ValueError("a WARC record has no end of header")
    fields = dict(line.split(": ", 1) for line in raw[:at].decode("utf-8").split("\r\n"))
    fields = {k.lower(): v for k, v in fields.items()}
    size = int(fields["content-length"])
    content = raw[at + 4 : at + 4 + size]
    if len(content) != size:
        raise ValueError(f"a WARC record holds {len(content)} of {size} bytes")
    return fields, content


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.string()]
    number = lambda name: int(x) if (x := name.strip("<>").split(":")[2]) else None
    for batch in batches:
        columns = [[] for _ in names]
        for raw in batch.column(0).to_pylist():
            fields, content = parse_record(raw)
            kind, segment = fields["warc-type"], int(fields.get("warc-segment-number", "1"))
            origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
            data = content if kind == "continuation" else content[content.index(END) + 4 :]
            last = "warc-segment-total-length" in fields or "warc-segment-number" not in fields
            size = fields.get("payload-length")
            row = (origin, segment - 1, kind, fields.get("warc-refers-to"), fields.get("warc-target-uri"), number(origin), int(size) if size else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, last, data, fields.get("running-digest", "").removeprefix("sha1:") or None)
            for c, x in zip(columns, row, strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives below ``path``: a row for each record and chunk number, ordered within a file."""
    return spark.read.option("lineSep", BETWEEN.decode()).text(path).select(F.col("value").cast("binary").alias("value")).mapInArrow(_read_chunks, CHUNK_SCHEMA)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from chunk rows in order; holds one digest and never more than a batch of chunks."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]
    number = lambda name: int(x) if name and (x := name.strip("<>").split(":")[2]) else None
    at, first, running, size, seen = None, None, None, 0, 0
    for batch in batches:
        columns = [[] for _ in names]
        for row in batch.to_pylist():
            if row["chunk_no"] == 0:
                if at is not None:
                    raise ValueError(f"record {at} has no last chunk")
                at, first, running, size, seen = row["record_id"], row, hashlib.sha1(), 0, 0
            if row["record_id"] != at or row["chunk_no"] != seen:
                raise ValueError(f"chunk {row['chunk_no']} of record {row['record_id']} is out of order")
            running.update(row["data"])
            size, seen = size + len(row["data"]), seen + 1
            if first["record_type"] == "response" and base32(running.copy().digest()) != row["running_digest"]:
                raise ValueError(f"chunk {row['chunk_no']} of record {at} doesn't match its running digest")
            if not row["is_last"]:
                continue
            if first["record_type"] == "response":
                if (base32(running.digest()), size) != (first["payload_digest"], first["payload_bytes"]):
                    raise ValueError(f"record {at} doesn't match its payload digest")
            else:
                size = first["payload_bytes"]
            made = (first["page_id"], first["uri"], size, first["payload_digest"], first["record_type"], number(first["refers_to"]), seen)
            for c, x in zip(columns, made, strict=True):
                c.append(x)
            at = None
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    if at is not None:
        raise ValueError(f"record {at} has no last chunk")


def read_records(spark: SparkSession, path: str, scattered: bool = False) -> DataFrame:
    """A verified row for each record of the archives below ``path``: page_id, uri, payload_bytes, payload_digest, record_type, refers_to, chunks.

    Chunks are folded in order; digests that don't match raise an error. ``write_archives`` leaves the segments of
    a record together in a file that one task reads, so nothing is shuffled; ``scattered`` first brings together
    and sorts the chunks of each record, for archives of uncompressed files that a scan may split. A revisit's
    bytes and digest are those of the full payload it refers to, from its header.
    """
    chunks = read_chunks(spark, path)
    if scattered:
        chunks = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return chunks.mapInArrow(_fold, RECORD_SCHEMA)
