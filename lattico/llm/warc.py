"""WARC archives: written with Spark's own text writer, read back record by record, and assembled into captures.

Each capture is three records: a request, a response (or a revisit of an equal payload) and a metadata record, tied together by
WARC-Concurrent-To. A record ends in CR LF CR LF, which is the line separator that the text writer puts after each row, so that
the files are plain WARC 1.1 and go through any file system that Spark can write. The reader takes whole files (of bounded size),
cuts records by Content-Length and so doesn't depend on what payloads hold; it also reads gzip archives, by member or as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, table

CRLF = "\r\n"
#: Bytes of payload that a file gets on average.
FILE_BYTES = 24 << 20
#: Bytes of records that the reader hands over at once.
BATCH_BYTES = 8 << 20
#: Parts that the rows of one digest are dealt into where they meet their newest.
SALTS = 16
#: Date of all records, so that reruns write the same archives.
DATE = "2024-01-01T00:00:00Z"

RECORD = "warc_type string, record_id string, concurrent_to array<string>, refers_to string, uri string, date string, payload_digest string, headers map<string,string>, block binary, read_bytes long, read_digest string"


def base32_of_hex(hex_: Column, digits: int = 40) -> Column:
    """RFC 4648 base32, upper case, of a digest in hex whose length is a multiple of 5 digits: each 5 digits are 20 bits, 4 characters."""
    fives = [F.lpad(F.conv(F.substring(hex_, i + 1, 5), 16, 32), 4, "0") for i in range(0, digits, 5)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    """A record id: a UUID's form made of a digest."""
    h = F.md5(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("\u0001")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str | Column, id_: Column, uri: Column, content_type: str, headers: list[Column], block: Column) -> Column:
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), id_),
        F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri), *headers, F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def captures(pages: DataFrame, least: int = 0, id_: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """A row for each row of pages: id, url, payload, hex (SHA-1), copy, kind, refers_to (an id) and refers_url.

    A null payload is empty. Of captures with equal payloads of at least `least` bytes, those with the largest id are responses
    and the others revisit it; a null id is smaller than any. copy numbers rows that are equal in id, url and payload, from 1, so
    that record ids are unique; such rows meet in the task that writes them. Other columns aren't read. An empty table gives an empty result.
    """
    rows = pages.select(F.col(f"`{id_}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("hex", F.sha1(F.col("payload").cast("binary")))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) // FILE_BYTES))
    # only ids and digests meet their equals, those of a hot digest in SALTS parts; payloads move once, dealt by id and digest, which no group shares
    narrow = rows.filter(F.octet_length("payload") >= least).select("id", "url", "hex")
    newest = narrow.groupBy("hex").agg(F.max(F.struct("id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hex", "first.*")
    newest = newest.select(F.col("hex").alias("kh"), F.col("id").alias("first"), F.col("url").alias("first_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = narrow.select("id", "hex").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    first = salted.join(newest, (salted.hex == newest.kh) & (salted.salt == newest.salt)).select(F.coalesce(F.col("id"), F.lit(-1)).alias("k"), F.col("id").isNull().alias("kn"), "kh", "first", "first_url")
    whole = (
        rows.withColumns({"k": F.coalesce(F.col("id"), F.lit(-1)), "kn": F.col("id").isNull()}).repartition(n, "k", "kn", "hex")
        .groupBy("k", "kn", "hex", "id", "url").agg(F.count("*").alias("copies"), F.first("payload").alias("payload"))
    )
    found = whole.join(first.repartition(n, "k", "kn", "kh"), (whole.k == first.k) & (whole.kn == first.kn) & (whole.hex == first.kh), "left").drop(first.k).drop(first.kn)
    is_response = F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first"))
    return found.select(
        "id", "url", "payload", "hex", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), F.when(is_response, "response").otherwise("revisit").alias("kind"),
        F.when(~is_response, F.col("first")).alias("refers_to"), F.when(~is_response, F.col("first_url")).alias("refers_url"))


def _capture_id(id_: Column, url: Column, hex_: Column, copy: Column) -> Column:
    return _urn(F.lit("capture"), id_, url, hex_, copy)


def write_archive(found: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes captures as WARC files under path: a request, a response or revisit, and a metadata record of each.

    A revisit has no payload but its digest, and names the response it refers to by that record's id; the metadata record holds the
    page's id, the payload's full length and the page that a revisit refers to.
    """
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:none")), r"[\x00-\x20]", "%20")
    me = _capture_id(*map(F.col, ("id", "url", "hex", "copy")))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("hex")))
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF))
    target = F.concat(F.lit("WARC-Refers-To: "), _capture_id(F.col("refers_to"), F.col("refers_url"), F.col("hex"), F.lit(1)))
    request = _record("request", _urn(F.lit("request"), me), uri, "application/http; msgtype=request", [F.concat(F.lit("WARC-Concurrent-To: "), me)],
                      F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    response = _record(F.col("kind"), me, uri, "application/http; msgtype=response", [digest, F.when(F.col("kind") == "revisit", F.concat_ws(CRLF, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), target))],
                       F.concat(http, F.when(F.col("kind") == "response", F.col("payload")).otherwise("")))
    fields = F.concat_ws(CRLF, F.concat(F.lit("page_id: "), F.col("id").cast("string")), F.concat(F.lit("payload_bytes: "), size), F.concat(F.lit("refers_to_page: "), F.col("refers_to").cast("string")))
    metadata = _record("metadata", _urn(F.lit("metadata"), me), uri, "application/warc-fields", [F.concat(F.lit("WARC-Concurrent-To: "), me)], fields)
    found.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """A file's bytes in pieces, gzip members one after another inflated."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        while not d.eof:
            piece = d.decompress(data, 1 << 20)
            data = d.unconsumed_tail
            if piece:
                yield piece
            elif not data and not d.eof:
                raise ValueError("a gzip member is cut off")
        data = d.unused_data


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive file. A file that ends within a record, or doesn't begin one with WARC/, raises."""
    pieces, buffer = _inflated(data), bytearray()

    def fill(n: int) -> bool:
        while len(buffer) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        while fill(1) and buffer[:1] in b"\r\n":
            del buffer[: max(1, len(buffer) - len(buffer.lstrip(b"\r\n")))]
        if not buffer:
            return
        at = buffer.find(b"\r\n\r\n")
        while at < 0:
            seen = max(0, len(buffer) - 3)
            if not fill(len(buffer) + 1):
                raise ValueError("an archive ends within a record's header")
            at = buffer.find(b"\r\n\r\n", seen)
        lines = bytes(buffer[:at]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        pairs = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        headers = dict(pairs)
        size = int(headers["content-length"])
        if not fill(at + 4 + size):
            raise ValueError("an archive ends within a record's block")
        block = bytes(buffer[at + 4 : at + 4 + size])
        del buffer[: at + 4 + size]
        yield {
            "warc_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "concurrent_to": [v for k, v in pairs if k == "warc-concurrent-to"],
            "refers_to": headers.get("warc-refers-to"), "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
            "payload_digest": headers.get("warc-payload-digest"), "headers": headers, "block": block, "read_bytes": None, "read_digest": None,
        } | (_measured(block) if headers.get("warc-type") in ("response", "resource") else {})


def _measured(block: bytes) -> dict:
    """Length and base32 SHA-1 of the payload that a response's or resource's block holds: what follows an HTTP header, or all."""
    at = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    payload = block[at:] if at != 3 else b""
    return {"read_bytes": len(payload), "read_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record (RECORD's columns) of the archives under path, in any order.

    Without payloads the blocks of responses and resources, whose lengths and digests are taken while reading, are null: what is
    left is small enough to be written down once where several joins read it.
    """
    types = {"concurrent_to": pa.list_(pa.string()), "headers": pa.map_(pa.string(), pa.string()), "block": pa.binary(), "read_bytes": pa.int64()}
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, types.get(n, pa.string())) for n in names])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], schema.field(n).type) for n in names], names=names)

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows, n = [], 0
                for r in parse(data.as_py()):
                    if not payloads and r["read_bytes"] is not None:
                        r["block"] = None
                    rows.append(r)
                    n += len(r["block"] or b"") + 500
                    if n >= BATCH_BYTES:
                        yield batch(rows)
                        rows, n = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, uri, date, record_type, payload_digest, refers_to, response, read_bytes, read_digest,
    requests, metadata). read_bytes and read_digest are those of the payload as read, null for a revisit.

    A capture is a response, revisit or resource record. Requests and metadata are joined to it where either names the other in
    WARC-Concurrent-To, metadata also by way of the capture's request; each is an array of (record_id, block) in order of id,
    empty where there is none. Records of other kinds, and those tied to no capture, are left out.
    """
    main = records.filter(F.col("warc_type").isin("response", "revisit", "resource"))
    side = records.filter(F.col("warc_type").isin("request", "metadata")).select("warc_type", "record_id", "concurrent_to", "block")
    forward = side.select(F.col("record_id").alias("side_id"), F.explode("concurrent_to").alias("to"))
    backward = main.select(F.explode("concurrent_to").alias("side_id"), F.col("record_id").alias("to"))
    ids = main.select(F.col("record_id").alias("to"))
    direct = forward.unionByName(backward).join(ids.distinct(), "to", "left_semi")
    by_request = forward.withColumnRenamed("to", "via").join(direct.select(F.col("side_id").alias("via"), "to"), "via").select("side_id", "to")
    ties = direct.unionByName(by_request).distinct()
    parts = side.join(ties, side.record_id == ties.side_id).groupBy("to").agg(
        F.sort_array(F.collect_list(F.when(F.col("warc_type") == "request", F.struct("record_id", "block")))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("warc_type") == "metadata", F.struct("record_id", "block")))).alias("metadata"))
    empty = F.array().cast("array<struct<record_id:string,block:binary>>")
    return main.join(parts, main.record_id == parts["to"], "left").select(
        "record_id", "uri", "date", F.col("warc_type").alias("record_type"), F.regexp_replace("payload_digest", "^[^:]*:", "").alias("payload_digest"), "refers_to",
        F.col("block").alias("response"), "read_bytes", "read_digest", F.coalesce("requests", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata"))


def _field(name: str) -> Column:
    text = F.element_at("metadata", 1)["block"].cast("string")
    return F.regexp_extract(text, rf"(?m)^{name}: (-?\d+)\r?$", 1).try_cast("long")


def page_digests(captured: DataFrame) -> DataFrame:
    """Per archived page row: page_id, payload_bytes, payload_digest, record_type, refers_to, from assembled captures.

    A response's length and digest are those of the payload that was read; a revisit's are what its records say of it.
    """
    rows = captured.withColumns({
        "page_id": _field("page_id"), "payload_bytes": F.coalesce("read_bytes", _field("payload_bytes")),
        "payload_digest": F.coalesce("read_digest", "payload_digest"), "refers_to": _field("refers_to_page"),
    })
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(captures(table(spark, sf_dir, "pages")), path)
    return page_digests(assemble(cut(read_archive(spark, path, payloads=False), "records")))


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (SELECT hex, max(page_id) AS first FROM p GROUP BY hex),
a AS (SELECT p.page_id, p.html, p.hex, f.first FROM p JOIN f ON p.hex = f.hex)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first OR page_id IS NULL THEN first END AS refers_to
FROM a
"""
