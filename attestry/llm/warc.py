"""Legacy archive converter: ARC files of either version to WARC files, and readers of both.

Archives are whole files of bounded size, one text row each, written and read by Spark in the shared
folder. Records are converted one at a time from their header line and declared length.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import Scratch, salted

ARCHIVE_BYTES = 16 << 20  # of records in one file, unless a single record is larger
SPACE_UUID = uuid.UUID("6f1f3c1e-6f0e-5b0c-9d53-0c4f5d2b7a11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# The fields of a record's header line by the major version of its archive.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}
ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def digest_of(data: bytes) -> str:
    return b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def arc_head(name: str, version: int) -> bytes:
    """The version block that opens an archive; its body names the version and the fields."""
    body = f"{version} 0 attestry\n{ARC_NAMES[version]}\n".encode()
    date = b"19960101000000"
    more = b" 200 - - 0 %s" % name.encode() if version == 2 else b""
    return b"filedesc://%s 0.0.0.0 %s text/plain%s %d\n%s\n" % (name.encode(), date, more, len(body), body)


def arc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of each record; a version block at the file's start tells the fields.

    A version block is known by its place: its fields have the type ``warcinfo``, those of a later
    record of the same scheme do not. A length that leads past the end of the file gives the block
    up to there.
    """
    at, version, opened = 0, 1, False
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].rstrip(b"\r")
        at = end + 1
        if not line:
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        length = int(parts[-1]) if parts[-1].isdigit() else 0
        block = data[at : at + length]
        at += length
        is_head = not opened and line.startswith(b"filedesc://")
        opened = True
        if is_head:
            version = 2 if block[:1] == b"2" else 1
        fields = ARC_FIELDS[version]
        if len(parts) < len(fields):
            fields = ARC_FIELDS[1]
        # an unescaped space in the URL makes more parts; the other fields are counted from the right
        extra = len(parts) - len(fields)
        told = dict(zip(fields, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=False))
        yield (told | {"type": "warcinfo"}) if is_head else told, block


def warc_date(stamp: str) -> str:
    """ARC's 14 (or, earlier, 12 or 8) digits as a WARC timestamp."""
    s = (stamp if stamp.isdigit() else "19700101000000").ljust(14, "0")[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head, with its blank line, and the payload; no head if the block is not HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def converted(fields: dict, block: bytes) -> dict:
    """What a WARC record needs of an ARC record but for its identifier: timestamp, type, digests."""
    head, payload = split_http(block)
    name = fields.get("filename", "")
    page = name[5:-5] if name.startswith("page-") and name.endswith(".html") else ""
    return {
        "url": fields["url"], "date": warc_date(fields["date"]), "ip": fields["ip"], "mime": fields["mime"],
        "type": fields.get("type") or ("response" if head else "resource"), "digest": digest_of(payload),
        "page_id": int(page) if page.lstrip("-").isdigit() else None, "head": head, "payload": payload,
    }


def record_id(path: str, nth: int) -> str:
    """A record's identifier: the same for the same place in the same archive, so unique."""
    return f"urn:uuid:{uuid.uuid5(SPACE_UUID, f'{path}#{nth}')}"


def warc_record(r: dict) -> bytes:
    """A record; a revisit (``top`` set, the record that it repeats) carries the HTTP head alone."""
    top = r.get("top")
    block = r["head"] if top else r["head"] + r["payload"]
    kind = "revisit" if top else r["type"]
    mime = "application/http; msgtype=response" if r["head"] else r["mime"]
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"Content-Type: {mime}",
        f"WARC-Payload-Digest: sha1:{r['digest']}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
    ]
    if r["page_id"] is not None:
        lines.append(f"X-Source-Page: {r['page_id']}")
    if top:
        lines += [
            f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(top['path'], top['nth'])}>",
            f"WARC-Refers-To-Target-URI: {top['url']}", f"WARC-Refers-To-Date: {top['date']}",
        ]
        if top["page_id"] is not None:
            lines.append(f"X-Refers-To-Source-Page: {top['page_id']}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers with lower-case names, block) of each record, by declared lengths."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        lines = data[start:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def content_length(head: bytes) -> int | None:
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def write_files(rows: DataFrame, path: str) -> None:
    """One gzip file for each row of the single column, a whole archive."""
    out = rows.write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "FOUR")
    out.mode("overwrite").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def unzipped(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def archives(records: Iterator[bytes], head: bytes, most: int) -> Iterator[pa.RecordBatch]:
    held, size = [head], 0
    for record in records:
        if size and size + len(record) > most:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
            held, size = [head], 0
        held.append(record)
        size += len(record)
    if size:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])


def write_arc(pages: DataFrame, path: str, version: int = 2, most: int = ARCHIVE_BYTES) -> None:
    """Pages (page_id, url, html) as ARC files; version 2 carries the page_id in the file name field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for k, url, html in zip(*batch.columns, strict=True):
                    k, url, payload = k.as_py(), url.as_py() or "urn:none", (html.as_py() or "").encode("utf-8", "replace")
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    block += payload
                    stamp = b"2000%02d%02d%02d%02d%02d" % (
                        1 + (k or 0) % 12, 1 + (k or 0) % 28, (k or 0) % 24, (k or 0) % 60, (k or 0) % 60
                    )
                    url = "%20".join(url.split())
                    name = b"-" if k is None else b"page-%d.html" % k
                    more = b" 200 - - 0 " + name if version == 2 else b""
                    line = b"%s 0.0.0.0 %s text/html%s %d\n" % (url.encode("utf-8", "replace"), stamp, more, len(block))
                    yield line + block + b"\n"

        return archives(records(), arc_head("pages.arc", version), most)

    slim = pages.select(F.col("page_id").cast("long").alias("k"), F.col("url").cast("string"), F.col("html").cast("string"))
    write_files(slim.mapInArrow(run, "value binary").select(F.col("value").cast("string")), path)


KEYS = "path string, nth long, page_id long, digest string, bytes long, url string, date string"


def arc_keys(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives but their version blocks: its place, page, payload digest and size."""
    names = [part.split()[0] for part in KEYS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*batch.columns, strict=True):
                rows = []
                for nth, (fields, block) in enumerate(arc_records(unzipped(content.as_py()))):
                    r = converted(fields, block)
                    if r["type"] != "warcinfo":
                        rows.append((file.as_py(), nth, r["page_id"], r["digest"], len(r["payload"]), r["url"], r["date"]))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return read_files(spark, path).mapInArrow(run, KEYS)


def repeats(keys: DataFrame, least_bytes: int) -> DataFrame:
    """(path, again): for each archive, the places of its records that repeat another, and which.

    Of records with equal payloads of at least least_bytes the one with the largest page_id stays
    (null is less than any), of equal ones the last in place. Groups are aggregated to one row and
    met again in parts; an archive is bounded, so its list is.
    """
    place = F.struct("page_id", "path", "nth", "url", "date")
    large = keys.filter(F.col("bytes") >= least_bytes)
    chosen = large.groupBy("digest").agg(F.max(place).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = salted(large.select("digest", "path", "nth"), chosen.select("digest", "top"), ["digest"], F.xxhash64("path", "nth"))
    again = met.filter((F.col("path") != F.col("top.path")) | (F.col("nth") != F.col("top.nth")))
    return again.groupBy("path").agg(F.collect_list(F.struct("nth", "top")).alias("again"))


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, most: int = ARCHIVE_BYTES) -> None:
    """Converts archives, each with the list of its records that become revisits, a few archives a task."""
    archives_, again = read_files(spark, arc_path), repeats(arc_keys(spark, arc_path), least_bytes)
    parts = max(spark.sparkContext.defaultParallelism, archives_.select("path").count() // 4)
    files = archives_.repartition(parts, "path").join(again.repartition(parts, "path").hint("shuffle_hash"), "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[bytes]:
            for batch in batches:
                for path, content, again in zip(*batch.columns, strict=True):
                    path, tops = path.as_py(), {r["nth"]: r["top"] for r in again.as_py() or ()}
                    for nth, (fields, block) in enumerate(arc_records(unzipped(content.as_py()))):
                        r = converted(fields, block)
                        if r["type"] != "warcinfo":
                            yield warc_record(r | {"record_id": record_id(path, nth), "top": tops.get(nth)})

        info = b"software: attestry\r\nformat: WARC File Format 1.1\r\n"
        head = (
            b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\n"
            b"Content-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
        ) % (str(uuid.uuid5(SPACE_UUID, "warcinfo")).encode(), len(info), info)
        return archives(rows(), head, most)

    write_files(files.mapInArrow(run, "value binary").select(F.col("value").cast("string")), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response, resource and revisit records: page_id, type, record_id, refers_id, refers_page, payload bytes and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows = []
                for headers, block in warc_records(unzipped(file.as_py())):
                    kind = headers.get("warc-type")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    head, payload = split_http(block)
                    size, own = len(payload), digest_of(payload)
                    if kind == "revisit":
                        size = content_length(head)
                        own = headers["warc-payload-digest"].removeprefix("sha1:")
                    page, refers = headers.get("x-source-page"), headers.get("x-refers-to-source-page")
                    rows.append((
                        int(page) if page else None, kind, headers["warc-record-id"].strip("<>"),
                        headers.get("warc-refers-to", "").strip("<>") or None, int(refers) if refers else None, size, own,
                    ))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["page_id", "type", "record_id", "refers_id", "refers_page", "payload_bytes", "payload_digest"]
    schema = "page_id long, type string, record_id string, refers_id string, refers_page long, payload_bytes long, payload_digest string"
    return read_files(spark, path).select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, least_bytes: int = 0, version: int = 2) -> DataFrame:
    """Writes pages as ARC files, converts these to WARC files, reads those back; one row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to (the page_id of the
    response that a revisit refers to). Null html is an empty payload, and empty payloads equal each
    other. Of repeated rows one is the response and the others revisit it. A null page_id is less
    than any other, and a revisit of such a record refers to null. Any url is kept, one that looks
    like a version block's included; white space in it is escaped. An empty table gives no rows.
    Other columns are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    write_arc(pages, scratch.path("arc"), version)
    arc_to_warc(spark, scratch.path("arc"), scratch.path("warc"), least_bytes)
    scratch.drop("arc")
    return read_warc(spark, scratch.path("warc")).select(
        "page_id", "payload_bytes", "payload_digest",
        F.when(F.col("type") == "revisit", "revisit").otherwise("response").alias("record_type"),
        F.col("refers_page").alias("refers_to"),
    )
