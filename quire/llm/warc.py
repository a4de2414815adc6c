"""WARC archives: writing, normalising monolithic gzip files, and reading by an offset index.

A WARC file compressed as one gzip stream cannot be entered in the middle.  The
normaliser inflates such a stream once, from start to end in blocks of bounded
size, writes every record as a gzip member of its own into a new file, and
beside it a sidecar index with each member's offset and length, so any record can be read alone.

Files live in a folder that all executors see.  A file is written under a
temporary name and renamed when whole, the index last; a task that runs again
writes its own temporary file and replaces the result by an equal one.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import work_path, written

BLOCK = 1 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, record_id string, warc_type string, offset long, length long"


def _sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plan_records(pages: DataFrame, record_id: str = "page_id", payload: str = "html", min_bytes: int = 0, url: str | None = None) -> DataFrame:
    """record_id, uri, payload, digest, size, refers_to and name of every row.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is the
    response and the others refer to it; null payloads are empty ones.  Rows repeated
    with the smallest id are all responses; rows without an id refer to the smallest id there is.
    ``uri`` is the address in column ``url``, signs that no address may hold as %20; without one it is made of the id.
    ``name`` identifies the record: rows repeated whole have names of their own.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    key = F.coalesce(F.col(record_id).cast("string"), F.lit(""))
    address = F.nullif(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x20\x7F]", "%20"), F.lit("")) if url else F.lit(None).cast("string")
    rows = pages.select(
        F.col(record_id).alias("record_id"), F.coalesce(address, F.concat(F.lit("urn:page:"), F.url_encode(key))).alias("uri"), body.alias("payload"),
        F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).cast("long").alias("size"), F.xxhash64(body).alias("x"), F.monotonically_increasing_id().alias("row"),
    )
    # Payloads are equal when length and two digests agree; only the digests move.
    same = rows.select("sha1", "size", "x", "record_id", "uri").groupBy("sha1", "size", "x").agg(
        F.min(F.struct(F.col("record_id").isNull().alias("none"), "record_id", "uri")).alias("first"), F.count(F.lit(1)).alias("n"))
    same = written(same.where((F.col("n") > 1) & (F.col("size") >= min_bytes)).select("sha1", "size", "x", "first.record_id", "first.uri").toDF("sha1", "size", "x", "first", "first_uri"), "payloads")
    again = rows.groupBy("record_id", "sha1", "size", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.struct("record_id", "sha1", "size", "x").alias("again"))
    again = written(again, "repeated")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("record_id")), F.col("first"))
    rows = rows.join(same, ["sha1", "size", "x"], "left").join(again, F.struct("record_id", "sha1", "size", "x") == F.col("again"), "left")
    return rows.select(
        "record_id", "uri", F.when(refers.isNull(), F.col("payload")).otherwise("").alias("payload"), F.unhex("sha1").alias("sha1"), "size", refers.alias("refers_to"),
        F.when(refers.isNotNull(), F.col("first_uri")).alias("refers_uri"), _uuid(F.col("record_id").cast("string"), F.col("sha1"), F.when(F.col("again").isNotNull(), F.col("row"))).alias("name"),
    )


def _uuid(*parts: Column) -> Column:
    """A name in the form of a UUID from the parts, nulls included."""
    h = F.md5(F.to_json(F.struct(*[c.alias(f"p{i}") for i, c in enumerate(parts)])).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _base32(sha1: Column) -> Column:
    """Upper-case base32 of a 20-byte digest: every five hex digits are four signs."""
    signs = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    part = [F.conv(F.substring(F.hex(sha1), 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*[F.substring(signs, (F.shiftright(p, s).bitwiseAND(31) + 1), F.lit(1)) for p in part for s in (15, 10, 5, 0)])


def write_monolithic(records: DataFrame, folder: str, date: str | None = None) -> None:
    """Writes ``records`` (of :func:`plan_records`) as WARC files, each one gzip stream, with Spark's text writer.

    Every block is an HTTP message: the head and the payload of a response, the head alone of a revisit.  Fields beyond the standard hold
    a record's id, that of the record it refers to, and the payload's size.  ``date`` is that of all records, now by default.
    """
    revisit = F.col("refers_to").isNotNull()
    crlf = "\r\n"
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    field = lambda name, value: F.concat(F.lit(f"{crlf}{name}: "), value)
    of = lambda c: F.url_encode(F.col(c).cast("string"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("size").cast("string"), F.lit(crlf * 2))
    header = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("name"), F.lit(">"))), field("WARC-Date", F.lit(date)), field("WARC-Target-URI", F.col("uri")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("sha1")))),
        F.when(revisit, F.concat(
            field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To-Target-URI", F.col("refers_uri")), field("WARC-Refers-To-Date", F.lit(date)), field("X-Refers-Key", of("refers_to")),
        )).otherwise(""),
        F.coalesce(field("X-Record-Key", of("record_id")), F.lit("")), field("X-Payload-Length", F.col("size").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", (F.octet_length(head) + F.octet_length("payload")).cast("string")), F.lit(crlf * 2),
    )
    # The writer ends every row with a line feed, the last sign of the record's end.
    records.select(F.concat(header, head, "payload", F.lit("\r\n\r")).alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(folder)


class _Reader:
    """Bytes of one gzip stream, inflated once; holds one block and what was not yet taken."""

    def __init__(self, source):
        self.source, self.held, self.inflater, self.packed = source, bytearray(), zlib.decompressobj(31), b""
        self.started = False

    def more(self) -> bool:
        data = self.packed or self.source.read(BLOCK)
        if not data:
            if self.started and not self.inflater.eof:
                raise ValueError("the gzip stream is cut off")
            return False
        self.started = True
        if self.inflater.eof:  # a further member, as in files that are normal already
            self.inflater = zlib.decompressobj(31)
        self.held += self.inflater.decompress(data, BLOCK)
        self.packed = self.inflater.unconsumed_tail or self.inflater.unused_data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything to the end of ``mark``; None at the end of the stream."""
        start = 0
        while (i := self.held.find(mark, start)) < 0:
            start = max(len(self.held) - len(mark) + 1, 0)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the stream ends inside a record")
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the stream ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse_header(block: bytes) -> dict[str, str]:
    """The fields of a header block, names in lower case."""
    lines = block.decode("utf-8").split("\r\n")
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:] if x)}


def records_of(source) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(header block, fields, payload) of every record in a gzip stream of WARC records."""
    reader = _Reader(source)
    while (block := reader.until(b"\r\n\r\n")) is not None:
        fields = parse_header(block.lstrip(b"\r\n"))
        payload = reader.take(int(fields["content-length"]))
        if reader.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield block.lstrip(b"\r\n"), fields, payload


def _key(fields: dict[str, str], name: str = "x-record-key") -> str | None:
    """The id that a record was written for; of records from elsewhere their own name."""
    if (key := fields.get(name)) is not None:
        return unquote_plus(key)
    return fields["warc-record-id"].removeprefix("<").removesuffix(">") if name == "x-record-key" and "x-payload-length" not in fields else None


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites the archives named in column ``path`` into ``folder``, and returns the rows of their sidecar indexes.

    Every archive becomes ``<name>.warc.gz`` with one gzip member a record and ``<name>.cdxj`` with one JSON line a member.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, at = _filesystem(path)
                out, base = _filesystem(folder)
                out.create_dir(base)
                name = f"{base}/{at.rsplit('/', 1)[-1].split('.')[0]}"
                trial = f"{name}.{uuid.uuid4().hex}"
                rows, uris, offset = [], [], 0
                with fs.open_input_stream(at, compression=None) as source, out.open_output_stream(f"{trial}.warc", compression=None) as sink:
                    for block, fields, payload in records_of(source):
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = packer.compress(block) + packer.compress(payload) + packer.compress(b"\r\n\r\n") + packer.flush()
                        sink.write(member)
                        rows.append((f"{name}.warc.gz", _key(fields), fields["warc-type"], offset, len(member)))
                        uris.append(fields.get("warc-target-uri"))
                        offset += len(member)
                with out.open_output_stream(f"{trial}.cdxj", compression=None) as sink:
                    for (_, rid, kind, start, length), uri in zip(rows, uris, strict=True):
                        sink.write((json.dumps({"url": uri, "record": rid, "type": kind, "offset": start, "length": length}) + "\n").encode())
                out.move(f"{trial}.warc", f"{name}.warc.gz")
                out.move(f"{trial}.cdxj", f"{name}.cdxj")
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")])

    return archives.select("path").mapInPandas(rewrite, INDEX)


RECORD = "record_id string, warc_type string, payload binary, payload_bytes long, payload_digest string, refers_to string"


def read_archives(indexes: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the normal archives whose sidecar indexes are named in column ``path``.

    Every member is read by its offset alone.  A response's digest and size are computed from its
    payload and must equal the header's; a revisit's are the header's.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, at = _filesystem(path)
                with fs.open_input_stream(at, compression=None) as lines, fs.open_input_file(at.removesuffix(".cdxj") + ".warc.gz") as archive:
                    rows, held = [], 0
                    for entry in map(json.loads, lines.read().splitlines()):
                        block, _, rest = zlib.decompress(archive.read_at(entry["length"], entry["offset"]), 31).partition(b"\r\n\r\n")
                        fields = parse_header(block)
                        payload = rest[:-4].partition(b"\r\n\r\n")[2]  # of the HTTP message
                        size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and (len(payload), _sha1_base32(payload)) != (size, digest):
                            raise ValueError(f"record {entry['record']} of {at} does not have the payload that its header names")
                        rows.append((entry["record"], fields["warc-type"], payload if with_payload else None, size, digest, _key(fields, "x-refers-key")))
                        held += len(payload)
                        if held >= 8 * BLOCK:
                            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])

    return indexes.select("path").mapInPandas(read, RECORD)


def _files(spark, folder: str, pattern: str) -> DataFrame:
    """Column path: the folder's files, one to a partition as far as possible; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return files.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")


def round_trip(pages: DataFrame, record_id: str = "page_id", payload: str = "html", min_bytes: int = 0, with_payload: bool = True, url: str | None = None) -> DataFrame:
    """Writes a record per row, normalises the archives and reads them back; see :data:`RECORD` for the columns.

    ``url`` names the column with the records' addresses.  Null ids come back as null; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    raw, normal = work_path(spark, "warc-raw"), work_path(spark, "warc")
    write_monolithic(plan_records(pages, record_id, payload, min_bytes, url), raw)
    index = written(normalise(_files(spark, raw, "*.gz"), normal), "warc-index")
    if index.isEmpty():
        return spark.createDataFrame([], RECORD)
    return read_archives(_files(spark, normal, "*.cdxj"), with_payload)
