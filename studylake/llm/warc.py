"""WARC archives: one gzip member per record, written and read in parallel.

Writing: Spark's text writer puts the bytes of each row and a separator into a file. A gzip member ends
with the high byte of its uncompressed size, which is zero below 16 MiB, so the writer gets each member
without its last byte and a zero byte as separator: the files are plain sequences of gzip members, and
Spark's commit protocol covers lost executors. The members pass through Spark as strings that needn't be valid
UTF-8: the cast from binary and the writer leave the bytes alone, which the tests hold to. Larger blocks are segmented (continuation records).
The files are gzip data whatever their names end in.

Reading: each archive is decompressed member by member in small steps, framed by content length, and the
digests of block and payload are verified. Spark hands a task the compressed bytes of one archive at a time;
the writer bounds them by counting the bytes of payload as it goes, whatever the sizes of pages are.

Deduplication: of pages with equal payloads of at least min_bytes the smallest id is the response, others
are revisits without payload that refer to it.

Defined results: null html is an empty payload; repeated rows give a record each, all of the same type;
a page with a null id never is the response of others unless it has no copies; control characters in URLs
are percent-encoded; an empty table gives no records. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_on, new_path, written

MIN_BYTES = 100
SEGMENT = 8 << 20  # bytes of a block in one record; a member stays below 16 MiB
ARCHIVE_BYTES, RECORD_BYTES = 256 << 20, 1000  # payload of an archive at most, and what a record has besides
STEP_BYTES = 8 << 20  # members that a task holds at once
HOT = 100_000  # pages with one payload from which its key is taken out of the shuffled join
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(headers: dict[str, str], block: bytes) -> bytes:
    lines = headers | {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    return _gzip("WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n")


def _uri(page_id) -> str:
    return f"<urn:x-page:{'' if pd.isna(page_id) else page_id}>"


def members(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The gzip members of one page's record."""
    kind = "revisit" if refers_to is not None else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    headers = {"WARC-Type": kind, "WARC-Record-ID": _uri(page_id), "WARC-Date": DATE, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if url:
        headers["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    if kind == "revisit":
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _uri(refers_to)}
    if len(block) <= segment:
        return [_record(headers, block)]
    out = [_record(headers | {"WARC-Segment-Number": "1"}, block[:segment])]
    for i in range(segment, len(block), segment):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:x-page:{page_id}:{i // segment + 1}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": _uri(page_id), "WARC-Segment-Number": str(i // segment + 1)}
        if i + segment >= len(block):
            more["WARC-Segment-Total-Length"] = str(len(block))
        out.append(_record(more, block[i : i + segment]))
    return out


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, segment: int = SEGMENT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per row of pages (page_id, url, html). A task closes an archive before a page that would take it beyond archive_bytes; only a larger page stands alone."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    firsts = written(firsts, "firsts")
    # a digest with many pages goes by broadcast (there are pages / HOT of them at most), so no key of the shuffled join is hot
    sizes = firsts.agg(F.count_if(F.col("n") > HOT), F.count(F.lit(1))).first()
    hot, rest = firsts.filter(F.col("n") > HOT).drop("n"), firsts.filter(F.col("n") <= HOT).drop("n")
    few = sizes[1] - sizes[0] <= BROADCAST_ROWS
    others = large.join(F.broadcast(hot), "digest", "left_anti") if sizes[0] else large
    copies = others.join(F.broadcast(rest) if few else rest, "digest")
    copies = copies.unionByName(large.join(F.broadcast(hot), "digest")) if sizes[0] else copies
    copies = written(copies.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct(), "copies")
    rows = join_on(rows, F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, ["page_id", "digest"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, size = 0, 0  # of this task
        for batch in batches:
            out: list[tuple[int, bytes]] = []
            held = 0
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                if size and size + len(payload) + RECORD_BYTES > archive_bytes:
                    archive, size = archive + 1, 0
                size += len(payload) + RECORD_BYTES
                for m in members(page_id, url, payload, digest, refers_to, segment):
                    out.append((archive, m[:-1]))
                    held += len(m)
                if held > STEP_BYTES:
                    yield batch_of(out)
                    out, held = [], 0
            yield batch_of(out)

    def batch_of(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], type=pa.int32()), pa.array([m for _, m in out], type=pa.binary())], names=["archive", "member"])

    given = rows.select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))
    packed = given.mapInArrow(pack, "archive int, member binary").select("archive", F.col("member").cast("string").alias("member"))
    packed.write.option("lineSep", "\0").partitionBy("archive").text(path)


def read_members(data: bytes, step: int = 1 << 13) -> Iterator[bytes]:
    """The decompressed records of an archive, one at a time."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("the archive ends within a record")
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case and the block, framed by the content length and verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    if not version.startswith("WARC/1.") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record of the length it states")
    block = rest[:n]
    if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"the block of {headers.get('warc-record-id')} has another digest")
    return headers, block


def read_pages(data: bytes) -> Iterator[dict]:
    """The pages of an archive: id, url, payload (none for revisits), its length and digest, type and referred id."""
    headers: dict[str, str] = {}
    blocks: list[bytes] = []

    def page() -> dict:
        head, _, payload = b"".join(blocks).partition(b"\r\n\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
        number = lambda uri: int(uri[len("<urn:x-page:") : -1] or -1) if uri else None
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
        if headers["warc-type"] == "response" and (len(payload) != int(fields["content-length"]) or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {headers['warc-record-id']} has another length or digest")
        own = headers["warc-record-id"] != _uri(None)
        return {"page_id": number(headers["warc-record-id"]) if own else None, "url": headers.get("warc-target-uri"), "payload": payload, "payload_bytes": int(fields["content-length"]), "payload_digest": digest, "record_type": headers["warc-type"], "refers_to": number(headers.get("warc-refers-to"))}

    for record in read_members(data):
        found, block = parse_record(record)
        if found["warc-type"] == "continuation":
            if found["warc-segment-origin-id"] != headers["warc-record-id"] or int(found["warc-segment-number"]) != len(blocks) + 1:
                raise ValueError("a segment is out of order")
            blocks.append(block)
            continue
        if blocks:
            yield page()
        headers, blocks = found, [block]
    if blocks:
        yield page()


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """One row per page of all archives below path; payloads: with url and payload."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payloads else [])]
    kinds = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", url string, payload binary" * payloads

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows: list[dict] = []
                size = 0
                for p in read_pages(bytes(data)):
                    rows.append({n: p[n] for n in names})
                    size += len(p["payload"])
                    if len(rows) >= 2000 or payloads and size > 8 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, kinds)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
     f as (select d, min(page_id) as m from p where n >= 100 group by d)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
       case when p.page_id is distinct from f.m and f.m is not null and p.n >= 100 then 'revisit' else 'response' end as record_type,
       case when p.page_id is distinct from f.m and p.n >= 100 then f.m end as refers_to
from p left join f on p.d = f.d
"""
