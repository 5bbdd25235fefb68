"""Legacy archive converter: ARC files of either version become WARC files.

An ARC file begins with a filedesc record that names its version (the field list of all headers: five fields in version 1, ten in
version 2), and every record is a header line of those fields, the last its content's length, then the content. The converter reads the
line by the version's fields and the content by its declared length, and makes the WARC record: an identifier, the timestamp in ISO
form, the type (response for archived HTTP messages, revisit for payloads that another record holds, resource for anything else), block
and payload digests, and the headers that carry over.

Archives have one gzip member a record, so a record can be read by its place alone, and begin with the record that describes them (filedesc
in ARC, warcinfo in WARC). A file ends after RECORDS records or FILE_BYTES of content. Files are written by Spark's own text writer, a row
each, whose separator is the zero byte that ends such a member (the top byte of a length below 16 MiB; after a longer record stands an empty
member). So they live wherever the cluster's shared folder does, are committed task by task, and survive lost executors. They are read back
as binary files, one member at a time.

A record's identifier is made of where it stood (file, member, number), and of the page's id, which can be read back; so repeated rows have
identifiers of their own.

Revisits: equal payloads of LEAST bytes or more are one response, that with the largest page_id (of several, one of them), and the others
refer to it. It is found by a partial aggregate over digests. Digests that repeat are broadcast if they are few, counted; else they meet in
a join whose hot digests adaptive execution can split.

Defined cases: a null html is an empty payload; a null url becomes one of the .invalid domain; white space and control characters in a
url are percent-encoded; a null page_id is kept as null, and never the page that others refer to while there is another id; repeated
page_ids each have a record; an empty table gives no rows. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm.common import batches_of, new_path, remove, small, staged, table

LEAST = 1000
RECORDS = 4000  # of one archive file
FILE_BYTES = 32 << 20  # of its content, or one record
STEP = 1 << 16  # bytes unpacked at a time
#: fixed field names of the two versions' header lines
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
DATE = "20200101000000"
SOFTWARE = "blockmill"
RECORD = "url string, page_id long, date string, mime string, extra string, payload binary, digest string, head binary, kind string, place string"
NONE = ("-", "", "0.0.0.0")


def record_id(page_id: int | None, place: str) -> str:
    """A version 8 identifier made of 56 bits of the record's place (14 hex digits) and the page's id, which can be read back.

    In order: 48 bits of the place, the version, 8 more of the place, whether the id is null, its top 3 bits, the variant, a spare bit,
    its other 61 bits.
    """
    number = (page_id or 0) & ((1 << 64) - 1)
    flags = number >> 61 | (8 if page_id is None else 0)
    low = f"{number & ((1 << 61) - 1) | 1 << 63:016x}"
    return f"<urn:uuid:{place[:8]}-{place[8:12]}-8{place[12:14]}{flags:x}-{low[:4]}-{low[4:]}>"


def page_of(identifier: str) -> int | None:
    value = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    mid = value >> 64 & 15
    if mid >> 3:
        return None
    number = (mid & 7) << 61 | value & ((1 << 61) - 1)
    return number - (1 << 64) if number >> 63 else number


def member(record: bytes) -> bytes:
    """A record as gzip, ending in a zero byte."""
    out = b""
    for part in (record, b""):
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += c.compress(part) + c.flush()
        if out[-1] == 0:
            break
    return out


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The place and content of each gzip member."""
    at = 0
    while at < len(data):
        start, d, parts = at, zlib.decompressobj(31), []
        while not d.eof:
            piece = data[at : at + STEP]
            if not piece:
                raise ValueError(f"gzip member at {start} ends early")
            parts.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        yield start, b"".join(parts)


def archives(records: Iterable[tuple[bytes, str]], opening) -> Iterator[pa.RecordBatch]:
    """Files (column value, binary) of the given (record, identifier); each begins with what opening makes of its first identifier.

    A record may hold b"%FILE%" in place of the identifier of the file's own first record.
    """
    out, n, size, own = [], 0, 0, ""

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array([b"".join(out)[:-1]], pa.binary())], names=["value"])  # the writer adds the last byte

    for record, identifier in records:
        if n and (n >= RECORDS or size + len(record) > FILE_BYTES):
            yield batch()
            out, n, size = [], 0, 0
        if not n:
            own, head = opening(identifier)
            out.append(member(head))
        out.append(member(record.replace(b"%FILE%", own.encode(), 1) if own else record))
        n, size = n + 1, size + len(record)
    if n:
        yield batch()


def _write(rows: DataFrame, path: str) -> None:
    rows = rows.select(F.col("value").cast("string"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def filedesc(version: int = 1) -> str:
    """The record that begins an ARC file of this version, without its last line end."""
    body = f"{version} 0 {SOFTWARE}\n" + " ".join(FIELDS[version]) + "\n"
    own = f"filedesc://pages.arc 0.0.0.0 {DATE} text/plain "
    return (own + f"{len(body)}\n" if version == 1 else own + f"200 - - 0 pages.arc {len(body)}\n") + body


def arc_record(page_id: int | None, url: str, html: bytes, version: int = 1) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(html)}\r\n\r\n".encode()
    middle = f" 0.0.0.0 {DATE} text/html" if version == 1 else f" 0.0.0.0 {DATE} text/html 200 {hashlib.sha1(html).hexdigest()} - 0 pages.arc"
    return f"{url}{middle} {len(head) + len(html)}\n".encode() + head + html + b"\n"


def write_arc(pages: DataFrame, path: str, version: int = 1) -> None:
    """ARC files of page_id, url and html."""
    url = F.coalesce("url", F.concat(F.lit("http://unknown.invalid/"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = pages.select("page_id", F.regexp_replace(url, r"[\p{Cntrl}\s]", "%20").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = ((arc_record(p.as_py(), u.as_py(), h.as_py(), version), "") for b in batches for p, u, h in zip(b["page_id"], b["url"], b["html"], strict=True))
        yield from archives(records, lambda _: ("", filedesc(version).encode() + b"\n"))

    with batches_of(pages.sparkSession, 256):
        _write(rows.mapInArrow(run, "value binary"), path)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def fields_of(line: str) -> list[str]:
    """A filedesc line tells the version by its number of fields."""
    return FIELDS[2] if len(line.split(" ")) == len(FIELDS[2]) else FIELDS[1]


def parse_arc(data: bytes, fields: list[str] | None = None) -> Iterator[dict]:
    """The records of unpacked ARC content as dicts of the header's fields, and content. fields: those in force before it."""
    at, fields = 0, fields or FIELDS[1]
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8")
        if not line.strip():
            at = end + 1
            continue
        if line.startswith("filedesc://"):
            fields = fields_of(line)
        parts = line.split(" ")
        if len(parts) != len(fields):
            raise ValueError(f"ARC header of {len(parts)} fields: {line[:200]}")
        size = int(parts[-1])
        content = data[end + 1 : end + 1 + size]
        if len(content) != size:
            raise ValueError(f"ARC record of {len(content)} bytes, {size} declared: {line[:200]}")
        yield dict(zip(fields, parts, strict=True)) | {"content": content}
        at = end + 1 + size


def arc_records(path: str, data: bytes) -> Iterator[dict]:
    """What an ARC file's records (but its filedesc) say, as the converter needs it."""
    fields = FIELDS[1]
    for start, unpacked in members(data):
        for n, r in enumerate(parse_arc(unpacked, fields)):
            fields = list(r)[:-1]
            if r["URL"].startswith("filedesc://"):
                continue  # the converter's warcinfo stands for it
            row = {"url": r["URL"], "page_id": None, "date": r["Archive-date"], "mime": r["Content-type"], "place": hashlib.sha1(f"{path}:{start}:{n}".encode()).hexdigest()[:14]}
            if r["content"].startswith(b"HTTP/"):
                head, _, payload = r["content"].partition(b"\r\n\r\n")
                own = [h[11:] for h in head.split(b"\r\n") if h.lower().startswith(b"x-page-id: ")]
                row |= {"page_id": int(own[0]) if own else None, "payload": payload, "head": head + b"\r\n\r\n", "kind": "response"}
            else:
                row |= {"payload": r["content"], "head": b"", "kind": "resource"}
            kept = (("WARC-IP-Address", "IP-address"), ("ARC-Result-Code", "Result-code"), ("ARC-Checksum", "Checksum"), ("ARC-Location", "Location"))
            row["extra"] = "".join(f"{name}: {r[field]}\r\n" for name, field in kept if r.get(field, "-") not in NONE)
            yield row | {"digest": hashlib.sha1(row["payload"]).hexdigest()}


SCHEMA = pa.schema([("url", pa.string()), ("page_id", pa.int64()), ("date", pa.string()), ("mime", pa.string()), ("extra", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("head", pa.binary()), ("kind", pa.string()), ("place", pa.string())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    held = 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            for row in arc_records(path.as_py(), content.as_py()):
                rows.append(row)
                held += len(row["payload"])
                if held > 4 << 20 or len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, page_id and place of the responses of LEAST bytes or more."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = [(r["digest"], r["page_id"], r["place"]) for r in arc_records(path.as_py(), content.as_py()) if r["kind"] == "response" and len(r["payload"]) >= LEAST]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["digest", "page_id", "place"])


def warc_record(r: dict) -> tuple[bytes, str]:
    """The WARC record of one of _records, with keeper and keeper_place, and its identifier."""
    again = r["keeper_place"] is not None and r["keeper_place"] != r["place"]
    kind = "revisit" if again else r["kind"]
    block = r["head"] if again else r["head"] + r["payload"]
    d, identifier = r["date"], record_id(r["page_id"], r["place"])
    lines = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {identifier}\r\nWARC-Warcinfo-ID: %FILE%\r\n"
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z\r\nWARC-Target-URI: {r['url']}\r\n{r['extra']}"
        f"WARC-Payload-Digest: sha1:{r['digest'].upper()}\r\nWARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest().upper()}\r\n"
    )
    if again:
        lines += f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {record_id(r['keeper'], r['keeper_place'])}\r\n"
    mime = r["mime"] if kind == "resource" else "application/http; msgtype=response"
    return f"{lines}Content-Type: {mime}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", identifier


def warcinfo(identifier: str) -> tuple[str, bytes]:
    """The identifier and the record that begin a file, of its first record's identifier."""
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, identifier)}>"
    body = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC\r\n"
    stamp = f"{DATE[:4]}-{DATE[4:6]}-{DATE[6:8]}T00:00:00Z"
    return own, f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {own}\r\nWARC-Date: {stamp}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()


def _warcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from archives((warc_record(r) for b in batches for k in range(0, b.num_rows, 64) for r in b.slice(k, 64).to_pylist()), warcinfo)


def convert(arc_files: DataFrame, path: str) -> None:
    """Reads ARC files (columns path, content) and writes the WARC files of all their records to path."""
    spark = arc_files.sparkSession
    with batches_of(spark, 256):
        # read twice: once for the digests alone, which costs less than keeping the payloads
        slim = arc_files.mapInArrow(_digests, "digest string, page_id long, place string")
        best = F.max(F.struct("page_id", "place"))  # null ids are the least
        kept = slim.groupBy("digest").agg(best.alias("k"), F.count("*").alias("n")).where("n > 1 and k.page_id is not null")
        kept = staged(kept.select("digest", F.col("k.page_id").alias("keeper"), F.col("k.place").alias("keeper_place")), "warc-kept", 256)
        records = arc_files.mapInArrow(_records, RECORD)
        long = (F.octet_length("payload") >= LEAST) & (F.col("kind") == "response")
        own = small(kept.withColumnRenamed("digest", "kept_digest"), 1 << 17)
        joined = records.join(own, long & (F.col("digest") == F.col("kept_digest")), "left").drop("kept_digest")
        _write(joined.mapInArrow(_warcs, "value binary"), path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of unpacked WARC content: headers and block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:100]}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for h, block in (r for _, unpacked in members(content.as_py()) for r in parse_warc(unpacked)):
                if h["WARC-Type"] == "warcinfo":
                    continue
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:").lower()
                head, _, payload = block.partition(b"\r\n\r\n")
                if h["WARC-Type"] == "revisit":
                    size = next(int(x[16:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length: "))
                else:
                    payload = payload if h["WARC-Type"] == "response" else block
                    size = len(payload)
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {h['WARC-Record-ID']} does not match")
                to = h.get("WARC-Refers-To")
                rows.append((page_of(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], page_of(to) if to else None, h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=NAMES)


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"]


def read_warc(warc_files: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date."""
    return warc_files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(files(spark, arc), warc)
    remove(spark, arc)
    return read_warc(files(spark, warc)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
