"""Legacy ARC archives, converted to WARC.

An ARC file starts with a version block, whose first line ends in the length of the
rest, whose second names the version and whose third names the fields of a record line:
five in version 1, ten in version 2. The last field is the declared length of the block
that follows, the first the URL, and blank lines may stand between records. A line is
split from its end, as old crawlers left spaces in URLs. The converter reads blocks by
their declared length alone, and synthesises what WARC needs: a warcinfo record for each
file, identifiers, ISO dates, record types and content types (HTTP messages are
responses, other blocks, such as those of dns: URLs, are resources of the type that ARC
gives), addresses, payload and block digests, and for payloads that came before a
revisit record that refers to the first of them.

Archives are written by Spark's text writer, one record a row with the record's end as
line separator, and read as whole binary files, so both work in any store that Spark
knows. Gzip members are inflated as a stream: memory holds the compressed file and one
record. An archive file is as large as the partition it came from; one of more than 2 GB
can't be read, as it is one binary value (ARC files have some 100 MB by custom).

Identifiers carry the record's key (the ``X-Archive-Key`` header of the block) as a
custom (version 8) UUID, or a hash of file and offset where there is none. So what a
revisit refers to is known without a join.

Defined results: a null html is an empty payload; empty payloads equal one another; a
null url is ``-``; rows with a null page_id come last among equals, in the order of
their place, and keep a null page_id; of repeated rows one is the response; an empty
table gives an empty result; other columns are not read. In an archive, lines that are
no record line are passed over up to the next that is one, and a record that the end of
the file cuts off is left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import scratch

#: The two forms of an ARC record line, and a WARC profile.
ARC1 = "URL IP-address Archive-date Content-type Archive-length"
ARC2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
NO_ADDRESS = (None, "", "-", "0.0.0.0")
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FIELDS, HTTP = {1: 5, 2: 10}, "application/http; msgtype=response"
KEY = b"x-archive-key:"
EPOCH = 820_454_400  # 1996-01-01
BATCH_BYTES = 4 << 20
RECORDS = "file string, offset long, url string, ip string, date string, mime string, key long, block binary, body int, payload_bytes long, payload_digest string"
READ = "record_type string, record_id string, key long, refers_to_key long, url string, date string, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Stream:
    """Lines and counted bytes of a file's content, inflated piece by piece if it is gzip (of one member or many)."""

    def __init__(self, content: bytes, piece: int = 1 << 20):
        self.rest, self.piece, self.buffer, self.at, self.offset = memoryview(content), piece, b"", 0, 0
        self.inflate = zlib.decompressobj(31) if bytes(self.rest[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        while len(self.rest):
            if self.inflate is None:
                new, self.rest = bytes(self.rest[: self.piece]), self.rest[self.piece :]
            else:
                taken = self.rest[: self.piece]
                new = self.inflate.decompress(taken)
                self.rest = self.rest[len(taken) - len(self.inflate.unused_data) :]
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
            if new:
                self.buffer, self.at = self.buffer[self.at :] + new, 0
                return True
        return False

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                last, self.at = self.buffer[self.at :], len(self.buffer)
                self.offset += len(last)
                return last or None
        out = self.buffer[self.at : end]
        self.offset += end + 1 - self.at
        self.at = end + 1
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            got = self.buffer[self.at : self.at + left]
            if not got and not self._more():
                raise EOFError(f"a record declares {n} bytes; {left} are missing")
            self.at += len(got)
            left -= len(got)
            parts.append(got)
        self.offset += n
        return b"".join(parts)


def body_of(block: bytes) -> int:
    """Where the payload of an HTTP message starts; 0 if the block is none."""
    if not block.startswith(b"HTTP/"):
        return 0
    ends = [i + len(x) for x in (b"\r\n\r\n", b"\n\n") if (i := block.find(x)) >= 0]
    return min(ends, default=len(block))


def header_value(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\n"):
        if line.lower().startswith(name):
            return line[len(name) :].strip().decode("utf-8", "replace")
    return None


def record_line(line: bytes, fields: int) -> list[str] | None:
    """The fields of a record line, split from its end; None if it is none."""
    parts = line.decode("utf-8", "replace").rsplit(" ", fields - 1)
    if len(parts) != fields or ":" not in parts[0] and parts[0] != "-" and fields != len(line.split(b" ")):
        return None
    return parts if parts[-1].isdigit() else None


def arc_records(content: bytes) -> Iterator[tuple[int, list[str], bytes]]:
    """Offset, fields and block of each record of an ARC file, version block excepted."""
    stream, fields = Stream(content), FIELDS[1]
    try:
        while (line := stream.line()) is not None:
            offset = stream.offset
            if line.startswith(b"filedesc:") and (size := line.rsplit(b" ", 1)[-1]).isdigit():
                lines = stream.take(int(size)).split(b"\n")
                version = lines[0].split(b" ", 1)[0]
                named = len(lines[1].split()) if len(lines) > 1 else 0
                fields = named if named >= 3 else FIELDS.get(int(version) if version.isdigit() else 1, FIELDS[1])
            elif line.strip() and (parts := record_line(line, fields)):
                yield offset, parts, stream.take(int(parts[-1]))
    except EOFError:
        return


def record_id(key: int | None, file: str, offset: int) -> str:
    name = hashlib.sha256(b"quarry" if key is not None else f"{file}:{offset}".encode()).hexdigest()
    if key is None:
        return f"<urn:uuid:{name[:8]}-{name[8:12]}-5{name[12:15]}-8{name[15:18]}-{name[18:30]}>"
    h = f"{key & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{name[:3]}-8{name[3:6]}-{name[6:14]}{h[12:]}>"


def key_of(identifier: str | None) -> int | None:
    if not identifier or identifier[24] != "8":
        return None
    h = identifier[10:].rstrip(">").split("-")
    x = int(h[0] + h[1] + h[4][8:], 16)
    return x - (1 << 64) if x >> 63 else x


def iso(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1(block: bytes) -> str:
    return f"sha1:{digest(block)}"


def warc_record(kind: str, url: str, date: str, identifier: str, payload_digest: str, block: bytes, refers_to: str | None = None, content_type: str = HTTP, ip: str | None = None) -> bytes:
    """A record without the two line ends that close it."""
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Target-URI: {url}", f"WARC-Date: {iso(date)}", f"WARC-Record-ID: {identifier}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: {sha1(block)}"]
    if ip not in NO_ADDRESS:
        head.append(f"WARC-IP-Address: {ip}")
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT}"]
    head += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block


def warcinfo(date: str, first: str) -> bytes:
    """The record that opens a file whose first record's identifier is ``first``."""
    block = b"software: quarry\r\nformat: WARC File Format 1.0\r\n"
    name = hashlib.sha256(first.encode()).hexdigest()
    head = ["WARC/1.0", "WARC-Type: warcinfo", f"WARC-Date: {iso(date)}", f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-5{name[12:15]}-9{name[15:18]}-{name[18:30]}>", f"WARC-Block-Digest: {sha1(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    stream = Stream(content)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {stream.offset}")
        head = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.take(int(head["content-length"]))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


ARC_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("key", pa.int64()), ("block", pa.binary()), ("body", pa.int32()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
READ_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("key", pa.int64()), ("refers_to_key", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of a folder of ARC files; ``blocks`` False leaves the block empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column("path")[i].as_py().rpartition("/")[2]
                for offset, f, block in arc_records(batch.column("content")[i].as_py()):
                    body = body_of(block)
                    key = header_value(block[:body], KEY)
                    rows.append((file, offset, f[0], f[1], f[2], f[3], int(key) if key else None, block if blocks else None, body, len(block) - body, digest(block[body:])))
                    size += len(block) if blocks else 200
                    if size > BATCH_BYTES:
                        yield _columns(rows, ARC_ARROW)
                        rows, size = [], 0
        yield _columns(rows, ARC_ARROW)

    return _files(spark, path).mapInArrow(run, RECORDS)


def _write(df: DataFrame, path: str, end: str) -> None:
    """One text column to gzip files at the fastest level."""
    df.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", end).text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    """The pages as ARC files, version 1 from even and version 2 from odd partitions."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    html, url = F.coalesce("html", F.lit("")), F.coalesce(F.regexp_replace("url", r"\s", "%20"), F.lit("-"))
    url = F.when(url == "", "-").otherwise(url)
    key = F.coalesce(F.concat(F.lit("X-Archive-Key: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"), key, F.lit("\r\n"), html)
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))), "yyyyMMddHHmmss")
    rows = pages.select(url.alias("url"), date.alias("date"), block.alias("block"), F.pmod(F.spark_partition_id(), F.lit(2)).alias("odd"), first.alias("first"))

    def opening(version: int, fields: str) -> str:
        rest = f"{version} 0 quarry\n{fields}\n"
        return f"filedesc://pages.arc 0.0.0.0 19960101000000 text/plain {len(rest)}\n{rest}\n" if version == 1 else f"filedesc://pages.arc 0.0.0.0 19960101000000 text/plain 200 - - 0 pages.arc {len(rest)}\n{rest}\n"

    middle = F.when(F.col("odd") == 1, F.lit(" text/html 200 - - 0 pages.arc ")).otherwise(F.lit(" text/html "))
    start = F.when(F.col("first"), F.when(F.col("odd") == 1, opening(2, ARC2)).otherwise(opening(1, ARC1))).otherwise("")
    _write(rows.select(F.concat(start, "url", F.lit(" 0.0.0.0 "), "date", middle, F.octet_length("block").cast("string"), F.lit("\n"), "block").alias("value")), path, "\n")


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """A folder of ARC files to a folder of WARC files.

    One pass takes keys and digests; payloads that occur more than once make a table of
    their first records. It is written, so that its size is known: Spark broadcasts it
    below its own limit and joins by sorting, with skewed digests split, beyond.
    """
    order = F.struct(F.col("key").isNull().alias("none"), "key", "file", "offset")
    seen = read_arc(spark, arc, blocks=False).groupBy("payload_digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    again, path = scratch.keep(seen.filter("n > 1").select("payload_digest", F.col("first.key").alias("first_key"), F.col("first.file").alias("first_file"), F.col("first.offset").alias("first_offset")), "arc-again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                identifier, block = record_id(r["key"], r["file"], r["offset"]), r["block"]
                if not opened:
                    out.append(warcinfo(r["date"], identifier))
                    opened = True
                revisit = r["first_file"] is not None and (r["first_file"], r["first_offset"]) != (r["file"], r["offset"])
                refers_to = record_id(r["first_key"], r["first_file"], r["first_offset"]) if revisit else None
                http = block.startswith(b"HTTP/")
                kind = "revisit" if revisit else "response" if http else "resource"
                if revisit:
                    block = block[: r["body"]]
                out.append(warc_record(kind, r["url"], r["date"], identifier, r["payload_digest"], block, refers_to, HTTP if http else r["mime"], r["ip"]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = read_arc(spark, arc).select("file", "offset", "url", "ip", "date", "mime", "key", "block", "body", "payload_digest").join(again, "payload_digest", "left")
    _write(records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")), warc, "\r\n\r\n")
    scratch.drop(spark, path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder of WARC files; payloads of responses and resources are held against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for head, block in warc_records(batch.column("content")[i].as_py()):
                    if head["warc-type"] == "warcinfo":
                        continue
                    body, said = body_of(block), head["warc-payload-digest"].removeprefix("sha1:")
                    size = len(block) - body
                    if head["warc-type"] != "revisit":
                        if digest(block[body:]) != said:
                            raise ValueError(f"the payload of {head['warc-record-id']} is not what its digest says")
                    else:
                        size = int(header_value(block, b"content-length:") or 0)
                    key = header_value(block[:body], KEY)
                    rows.append((head["warc-type"], head["warc-record-id"], int(key) if key else None, key_of(head.get("warc-refers-to")), head["warc-target-uri"], head["warc-date"], size, said))
                yield _columns(rows, READ_ARROW)

    return _files(spark, path).mapInArrow(run, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = scratch.place(spark, "arc"), scratch.place(spark, "warc")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), arc)
    convert(spark, arc, warc)
    scratch.drop(spark, arc)
    return read_warc(spark, warc).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))
