"""Legacy archive conversion: ARC records in, equivalent WARC records out.

Pages are first written as ARC segments (version 1 or 2 header lines with
declared lengths); the converter parses those and synthesises WARC records:
ids, timestamps, types and digests. A payload of at least `least_bytes`
bytes that an earlier page (smaller id) also holds becomes a revisit record
without its payload. Archives are binary rows of a table, so that any store
Spark writes to can hold them; `archive_bytes` of a table's rows in order is a
valid .warc file.

Null html is an empty payload; null urls become "urn:page:<id>". Blanks in
urls are percent-encoded, since header lines are split at blanks. Null page
ids count as smaller than all others; their records bear no page id. Rows
that repeat a page id are records of their own, judged each by its payload:
with an equal payload all are the response or all revisit the same page. An
empty table gives an empty archive, a long payload one long record. Only id,
url and html are read, so clashing columns do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import columns_as_bytes, salt_of, scratch, stash, tidied

#: Field names of the ARC header lines by version (fixed values of the format).
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes of records gathered into one archive row.
SEGMENT_BYTES = 4 << 20


class ArchiveError(ValueError):
    """An archive whose lines or lengths do not hold."""


# -- ARC ---------------------------------------------------------------------


def arc_version_block(name: str, version: int, date: str = "20240101000000") -> bytes:
    body = f"{version} 0 lorekeep\n{' '.join(_TITLES[f] for f in ARC_FIELDS[version])}\n".encode()
    values = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(len(body))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


_TITLES = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}


def arc_record(version: int, values: dict[str, str], block: bytes) -> bytes:
    values = {"ip": "0.0.0.0", "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "-"} | values | {"length": str(len(block))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record behind the version block.

    The version block says by its number how the later header lines are
    read. A url may hold blanks in old archives: fields are counted from the
    right.
    """
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError("header line without an end")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        names = ARC_FIELDS[version or 1]
        if version is None:
            if not line.startswith("filedesc://"):
                raise ArchiveError("no version block")
            length = int(line.rsplit(" ", 1)[1])
            first = data[end + 1 : end + 1 + length].split(b"\n", 1)[0]
            version = int(first.split()[0])
            if version not in ARC_FIELDS:
                raise ArchiveError(f"unknown version {version}")
            at = end + 1 + length
            continue
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ArchiveError(f"header line of {len(parts)} fields: {line[:80]}")
        fields = dict(zip(names, parts, strict=True))
        block = data[end + 1 : end + 1 + int(fields["length"])]
        if len(block) != int(fields["length"]):
            raise ArchiveError("block shorter than declared")
        yield fields, block
        at = end + 1 + len(block)


# -- WARC --------------------------------------------------------------------


def record_id(*of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, ' '.join(of))}>"


def warc_date(arc_date: str) -> str:
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{sha1}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(fields: dict[str, str], block: bytes, refers_to: str | None, refers_url: str | None, revisit: bool | None = None) -> bytes:
    """The WARC record that stands for an ARC record.

    refers_to: the page whose response holds the same payload, or None.
    revisit: whether there is such a page; it may be one without an id.
    """
    revisit = refers_to is not None if revisit is None else revisit
    head, _, payload = block.partition(b"\r\n\r\n")
    page = (re.search(rb"(?im)^X-Page-Id: *(\S+)", head) or [b"", b""])[1].decode()
    url, date = fields["url"], warc_date(fields["date"])
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page, url)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", fields["ip"]),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if page:
        headers.append(("WARC-Page-Id", page))
    if not revisit:
        return warc_record(headers, block)
    headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(refers_to or "", refers_url or "")), ("WARC-Truncated", "length")]
    if refers_to is not None:
        headers.append(("WARC-Refers-To-Page-Id", refers_to))
    return warc_record(headers, head + b"\r\n\r\n")


def warcinfo(name: str) -> bytes:
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", name)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: lorekeep\r\nformat: WARC File Format 1.0\r\n")


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; checks lengths and digests."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ArchiveError(f"no record at {at}")
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ArchiveError("block shorter than declared")
        if headers["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ArchiveError("block digest differs")
        yield headers, block
        at = end + 8 + length


# -- on tables ---------------------------------------------------------------


def first_holders(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(id, digest, refers_to, refers_url) of the pages (id, url, digest, size) whose payload an earlier page holds.

    Digests are grouped with a salt first: a payload that a third of all pages
    share reaches its group as a bounded number of rows.
    """
    digests = stash(pages.select("id", "url", "digest").where(F.col("size") >= least_bytes).withColumn("salt", salt_of("id")), "payloads")
    parts = digests.groupBy("digest", "salt").agg(F.min(F.struct("id", "url")).alias("low"), F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("digest").agg(F.min("low").alias("low"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    dealt = stash(groups.select("digest", "low", F.explode("salts").alias("salt")), "holders")
    found = digests.join(dealt.hint("merge"), ["digest", "salt"]).where(~F.col("id").eqNullSafe(F.col("low.id")))
    return stash(found.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("low.id").alias("refers_to"), F.col("low.url").alias("refers_url")).distinct(), "twins")


def safe_url(url: str | None, page) -> str:
    return re.sub(r"\s", lambda m: "%%%02X" % ord(m[0]) if ord(m[0]) < 128 else "+", url) if url else f"urn:page:{page}"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, arc_version: int = 2) -> DataFrame:
    """Rows (archive string, segment long, archive_bytes binary): the converted archives."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"))
    keyed = rows.withColumns({"digest": F.unhex(F.sha2("html", 256)), "size": F.octet_length("html")})
    twins = first_holders(keyed, least_bytes)
    joined = keyed.join(twins, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    source = joined.select(F.col("id").cast("string").alias("page"), "url", F.col("__digest").isNotNull().alias("revisit"), F.col("refers_to").cast("string").alias("refers_to"), "refers_url", F.col("html").alias("__text"))

    def run(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        name, segment, out, size = f"part-{TaskContext.get().partitionId():06d}.warc", 0, [warcinfo(f"part-{TaskContext.get().partitionId():06d}.warc")], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([segment], pa.int64()), pa.array([b"".join(out)], pa.binary())], names=["archive", "segment", "archive_bytes"])

        for batch in batches:
            plain = [batch.column(i).to_pylist() for i in range(5)]
            for page, url, revisit, refers, refers_url, payload in zip(*plain, columns_as_bytes(batch, "__text"), strict=True):
                mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n".encode() + payload
                arc = arc_version_block(name, arc_version) + arc_record(arc_version, {"url": safe_url(url, page), "date": "20240101000000", "type": "text/html"}, http)
                for fields, block in read_arc(arc):
                    record = convert(fields, block, refers, safe_url(refers_url, refers) if revisit else None, revisit)
                    out.append(record)
                    size += len(record)
                if size >= SEGMENT_BYTES:
                    yield row()
                    segment, out, size = segment + 1, [], 0
        if out:
            yield row()

    return source.mapInArrow(tidied(run), "archive string, segment bigint, archive_bytes binary")


def read_archives(archives: DataFrame, column: str = "archive_bytes") -> DataFrame:
    """One row per response or revisit record, from its headers and block."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for h, block in read_warc(data):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    if h["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ArchiveError("payload digest differs")
                    size = len(payload) if h["warc-type"] == "response" else int(h["warc-payload-length"])
                    rows.append((h.get("warc-page-id"), h["warc-target-uri"], h["warc-record-id"], h["warc-date"], size, digest, h["warc-type"], h.get("warc-refers-to-page-id")))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 4 else pa.string()) for i, c in enumerate(columns)], names=names)

    schema = "page string, target_uri string, record_id string, warc_date string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    names = [x.split()[0] for x in schema.split(", ")]
    return archives.select(column).mapInArrow(tidied(run), schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Writes the archives into the shared folder and reads them back."""
    kind = pages.schema[id_col].dataType
    with scratch(pages.sparkSession) as keep:
        archives = keep(write_archives(pages, id_col, url_col, html_col, least_bytes), "archives")
    read = read_archives(archives)
    return read.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "record_id", "warc_date", "target_uri")
