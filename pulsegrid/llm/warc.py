"""Operator 8: WARC archives: writing captures, reading records, assembling transactions.

Files are written by Spark's text writer with the record end (two line breaks) as
line separator, so that any file system Spark knows works, and read back by its
binary-file reader; records are cut by their Content-Length, never by searching the
payload. A capture is a request, a response (or revisit) and a metadata record; the
first and last name the middle one in WARC-Concurrent-To, and the assembly joins
them through it and emits one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path

_CRLF = "\r\n"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pulsegrid:capture")
RECORDS_PER_FILE = 6000
DATE = "2024-01-01T00:00:00Z"

RECORD = "record_id string, warc_type string, target_uri string, concurrent_to string, refers_to string, page_id long, seq long, payload_bytes long, payload_digest string, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) -> plus payload_digest, refers_to, is_response.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the
    largest page_id is the response and the others refer to it; smaller payloads are
    all responses. Of rows with equal page_id and payload all are responses. The
    largest page_id of a digest is a partially aggregated maximum, written before it
    is joined back, so that a payload that a third of all pages share can be split.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html")).withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8")))
    light = materialise(rows.select("page_id", "payload_digest", F.octet_length("html").alias("n")), "warc-digests")
    last = materialise(light.groupBy("payload_digest").agg(F.max("page_id").alias("last")), "warc-last")
    joined = light.join(last, "payload_digest").where((F.col("n") >= least_bytes) & (F.col("page_id") != F.col("last")))
    revisits = materialise(joined.select("page_id", "payload_digest", F.col("last").alias("refers_to")).distinct(), "warc-revisits")
    # page_id is nearly unique, so this join is even; the digest tells rows of one page_id apart
    out = rows.join(revisits.withColumnRenamed("payload_digest", "__d"), (rows["page_id"] == revisits["page_id"]) & (rows["payload_digest"] == F.col("__d")), "left")
    return out.select(rows["page_id"], "url", "html", "payload_digest", "refers_to", F.col("refers_to").isNull().alias("is_response"))


def capture_id(page_id, seq: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{seq}/{kind}')}>"


def _record(kind: str, rid: str, uri: str, media: str, block: str, size: int, more: list[str]) -> str:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", *more, f"Content-Type: {media}", f"Content-Length: {size}"]
    return _CRLF.join(head) + _CRLF + _CRLF + block


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write one request, one response or revisit and one metadata record per row.

    Null html is an empty payload and a null url the target ``urn:none``; a null
    page_id is kept. Repeated rows are separate captures. Other columns are not
    read; an empty table writes an archive without records.
    """

    def build(batches):
        for batch in batches:
            out = []
            for page, seq, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "seq", "url", "html", "refers_to")), strict=True):
                uri = " ".join((url or "urn:none").split()) or "urn:none"
                payload = html.encode("utf-8", "surrogatepass")
                main, own = capture_id(page, seq, "response"), f"X-Page-ID: {'' if page is None else page}"
                digest = f"WARC-Payload-Digest: sha1:{digest32(payload)}"
                head = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: {len(payload)}{_CRLF}{_CRLF}"
                ask = f"GET {uri} HTTP/1.1{_CRLF}User-Agent: pulsegrid{_CRLF}{_CRLF}"
                out.append(_record("request", capture_id(page, seq, "request"), uri, "application/http; msgtype=request", ask, len(ask.encode("utf-8", "surrogatepass")), [f"WARC-Concurrent-To: {main}"]))
                if refers is None:
                    out.append(_record("response", main, uri, "application/http; msgtype=response", head + html, len(head) + len(payload), [digest, own]))
                else:
                    out.append(_record("revisit", main, uri, "application/http; msgtype=response", head, len(head), [digest, own, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers}"]))
                facts = f"pageId: {'' if page is None else page}{_CRLF}sequence: {seq}{_CRLF}"
                out.append(_record("metadata", capture_id(page, seq, "metadata"), uri, "application/warc-fields", facts, len(facts), [f"WARC-Concurrent-To: {main}"]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    planned = plan_revisits(pages, least_bytes).withColumn("seq", F.monotonically_increasing_id())
    lines = planned.select("page_id", "seq", "url", "html", "refers_to").mapInArrow(build, "value string")
    lines.write.option("lineSep", _CRLF + _CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(data: bytes):
    """(headers, block) of every record of one uncompressed archive."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        lines = data[at:end].decode("utf-8", "surrogatepass").split(_CRLF)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        size = int(headers["content-length"])
        yield headers, bytes(view[start : start + size])
        at = start + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives (plain or gzip) under ``path``.

    payload_bytes and payload_digest are of the full payload; a revisit's come from
    its HTTP head and its digest header. With ``payload`` false the bytes are dropped
    as soon as they are measured.
    """

    def parse(batches):
        import zlib

        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    plain = b""
                    while data:  # one member per record or per file
                        member = zlib.decompressobj(31)
                        plain += member.decompress(data)
                        data = member.unused_data
                    data = plain
                rows = []
                for headers, block in parse_records(data):
                    kind, n, digest, body = headers.get("warc-type"), None, None, None
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        digest = headers.get("warc-payload-digest", "").rpartition(":")[2]
                        if kind == "revisit":
                            n = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                            body = None
                        else:
                            n = len(body)
                            if digest32(body) != digest:
                                raise ValueError(f"payload digest of {headers.get('warc-record-id')} differs")
                    page, refers = headers.get("x-page-id") or None, headers.get("x-refers-to-page")
                    seq = None
                    if kind == "metadata":
                        facts = dict(x.split(": ", 1) for x in block.decode().split(_CRLF) if ": " in x)
                        seq = int(facts["sequence"]) if "sequence" in facts else None
                    rows.append((headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-concurrent-to"), refers, page and int(page), seq, n, digest, body if payload else None))
                for k in range(0, len(rows), 2000):
                    columns = zip(*rows[k : k + 2000], strict=True)
                    types = [pa.string()] * 5 + [pa.int64()] * 3 + [pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, page_id, response, request, metadata.

    The response or revisit record leads; request and metadata records join it by
    their concurrent-to identifier and are null where the archive has none.
    """
    main = records.where("warc_type in ('response', 'revisit')")
    fields = [F.col(c) for c in ("warc_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload")]
    main = main.select("record_id", "page_id", F.struct(*fields).alias("response"))
    # a capture has one of each, so a capped aggregate is not needed; partial aggregation keeps the keys even
    others = records.where("warc_type in ('request', 'metadata')").groupBy(F.col("concurrent_to").alias("__to"))
    one = lambda kind, *c: F.min(F.when(F.col("warc_type") == kind, F.struct(*c)))
    others = others.agg(one("request", "record_id", "target_uri").alias("request"), one("metadata", "record_id", "seq").alias("metadata"))
    return main.join(others, main["record_id"] == others["__to"], "left").select("record_id", "page_id", "response", "request", "metadata")


def round_trip(pages: DataFrame, least_bytes: int = 0, payload: bool = False) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back and assemble."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, least_bytes)
    return assemble(read_warc(spark, path, payload))
