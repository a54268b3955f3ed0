"""Operator 6, WARC: a content-addressed archive.

Three steps, each a table in the shared folder:

    payloads  digest (SHA-256), bytes (zstandard), size   - every distinct payload once
    headers   page_id, digest, head                       - the exact bytes before each record's payload
    records   are rebuilt by joining the two on digest

A response's payload is checked on the way back: SHA-256 against its key, SHA-1 and length against its
record's head; a revisit takes its payload from the response that it names.  Payloads meet by digest only
after each task has dropped the copies it has seen itself, and page numbers meet through a minimum that is
combined before the shuffle, so a payload that a third of all pages share adds one row a task.  The joins
on digest are inner joins, whose large partitions Spark splits.

A null html is an empty payload, a null url an empty target.  Rows that repeat a page_id are archived one
by one; those that repeat the response's page_id and payload are responses too.  A row without a page_id is
a revisit that names no response, with the record id NONE; its payload is stored and checked like all others.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_bytes

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"
NONE = "none"
END = b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class Archive:
    payloads: DataFrame
    headers: DataFrame


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a digest in hexadecimal, five hexadecimal digits (four base32 digits) at a time."""
    digits = [F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _head(kind: str, refers: Column | None) -> Column:
    """Everything before the payload: the record's header, and the HTTP header that begins its block."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.length(http) + (F.col("size") if kind == "response" else F.lit(0))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", "")
    more = [] if kind == "response" else [F.lit(f"WARC-Profile: {PROFILE}\r\n")]
    more += [] if refers is None else [F.lit(f"WARC-Refers-To: <{RECORD_ID}"), refers.cast("string"), F.lit(">\r\n")]
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{RECORD_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit(NONE)),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), url, F.lit("\r\n"), *more,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        block.cast("string"), F.lit("\r\n\r\n"), http,
    )


def _payloads(batches):
    """digest, bytes and size of each payload that is new to this task."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    seen: set[bytes] = set()
    for b in batches:
        digests, squeezed, sizes = [], [], []
        for payload in text_bytes(b.column(0)):
            payload = payload or b""
            digest = hashlib.sha256(payload).digest()
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                squeezed.append(squeeze(payload))
                sizes.append(len(payload))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(squeezed, pa.binary()), pa.array(sizes, pa.int64())], names=["digest", "bytes", "size"])


def write_archive(pages: DataFrame, least_bytes: int = 0) -> Archive:
    """Archive pages(page_id, url, html).

    Of the records with equal payloads of at least `least_bytes`, the one with the smallest page_id is the
    response and the others revisit it; smaller payloads are stored once too, but all are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    known = known.select("page_id", "url", F.length("payload").cast("long").alias("size"), F.unhex(F.sha2("payload", 256)).alias("digest"), base32_of_hex(F.sha1("payload")).alias("sha1"))
    first = known.groupBy("digest").agg(F.min("page_id").alias("first"))
    revisit = (F.col("size") >= least_bytes) & (F.col("page_id") != F.col("first"))
    headers = known.join(first, "digest").select("page_id", "digest", F.when(F.col("page_id").isNull(), _head("revisit", None)).when(revisit, _head("revisit", F.col("first"))).otherwise(_head("response", None)).cast("binary").alias("head"))
    held = pages.select("html").mapInArrow(_payloads, "digest binary, bytes binary, size long").dropDuplicates(["digest"])
    return Archive(stored(held, "payloads"), stored(headers, "headers"))


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("head").cast("string"), f"(?m)^{name}: (.*)$", 1)


def _page(name: str) -> Column:
    return F.regexp_extract(_field(name), f"^<{RECORD_ID}(-?\\d+)>$", 1)


def _rebuild(batches):
    """Responses with their payloads, each checked against its digests and lengths."""
    import base64

    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for b in batches:
        columns = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        payloads, records = [], []
        for head, digest, sha1, length, data, size in zip(*(columns[n] for n in ("head", "digest", "sha1", "length", "bytes", "size")), strict=True):
            payload = expand(data, max_output_size=max(size, 1))
            inner = head.index(END) + len(END)
            if len(payload) != size or hashlib.sha256(payload).digest() != digest:
                raise ValueError(f"a stored payload doesn't match its digest {digest.hex()}")
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha1 or len(head) - inner + size != length:
                raise ValueError(f"a record doesn't match its payload {digest.hex()}")
            payloads.append(payload)
            records.append(b"".join((head, payload, END)))
        yield pa.RecordBatch.from_arrays(
            [b.column(b.schema.names.index("page_id")), b.column(b.schema.names.index("digest")), pa.array(payloads, pa.binary()), pa.array(records, pa.binary())], names=["page_id", "digest", "payload", "record"]
        )


def _read(archive: Archive, which: str) -> DataFrame:
    """Records with their payloads; those of revisits aren't part of their blocks."""
    heads = archive.headers.select("page_id", "digest", "head", _field("WARC-Type").alias("kind"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("sha1"), _field("Content-Length").cast("long").alias("length"))
    joined = heads.where(which).join(archive.payloads, "digest")
    joined = joined.withColumn("length", F.col("length") + F.when(F.col("kind") == "revisit", F.col("size")).otherwise(0)).drop("kind")
    return joined.mapInArrow(_rebuild, "page_id long, digest binary, payload binary, record binary")


def read_responses(archive: Archive) -> DataFrame:
    """page_id, digest, payload and record (the exact bytes of the original record) of each response."""
    return _read(archive, "kind = 'response'")


def read_revisits(archive: Archive) -> DataFrame:
    """page_id, digest, refers_to and record of each revisit."""
    heads = archive.headers.where(_field("WARC-Type") == "revisit")
    return heads.select("page_id", "digest", F.nullif(_page("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"), F.concat(F.col("head"), F.lit(END.decode()).cast("binary")).alias("record"))


def read_archive(archive: Archive) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes and payload_digest of every record.

    The payloads' figures are taken from the payloads that were rebuilt; revisits get them from their response,
    or, where they name none, from the payload of their digest.
    """
    figures = (F.length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"))
    whole = stored(_read(archive, "kind = 'response' or page_id is null").select("page_id", "digest", *figures), "responses")
    kind = F.when(F.col("page_id").isNull(), "revisit").otherwise("response")
    rebuilt = whole.select("page_id", kind.alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest")
    targets = whole.where("page_id is not null").select(F.col("page_id").alias("refers_to"), "digest", "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "digest"])
    revisits = read_revisits(archive).join(targets, ["refers_to", "digest"])
    return rebuilt.unionByName(revisits.select("page_id", F.lit("revisit").alias("record_type"), "refers_to", "payload_bytes", "payload_digest"))
