"""WARC archives: segmented writing, reading and reassembly on Spark.

Writing: each page becomes an HTTP response whose body travels in chunked
transfer framing. A record block longer than ``segment_bytes`` is cut into a
first record and continuation records, which name the first one as their origin
and carry their segment number; the last carries the total length. Pages whose
payload was already written become revisit records of the first one. Files are
plain gzip WARC files, written by Spark's own text writer.

Reading: files are parsed record by record by their Content-Length.
Continuations are grouped by origin, ordered by segment number, checked for gaps
and total length, and joined; then the chunked framing is decoded and the payload
digest verified. Only cut records are shuffled.

Defined results: a null html is the empty payload; a null page_id sorts after all
others and takes part like them; among repeated rows of the smallest page_id one
is the response; an empty table gives no rows; other columns are ignored. A record
that cannot be restored is kept with a null payload and its ``status`` says why:
``missing segment``, ``length mismatch``, ``bad chunk`` or ``digest mismatch``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import text_bytes

#: Longest record block before it is cut into segments, and bytes of one chunk.
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
#: Records of one file, so that a file read as a whole stays small.
FILE_RECORDS = 500
DATE = "2024-01-01T00:00:00Z"
PARSED = ("record_id string, warc_type string, origin_id string, segment int, total_length long, page_id long, "
          "digest string, refers_to string, block binary")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes | None:
    """Payload of a chunked body, None if the framing is broken. Chunk extensions
    and trailer fields are allowed."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts) if body.endswith(b"\r\n\r\n") or body[at:] == b"\r\n" else None
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        parts.append(body[at:at + n])
        at += n + 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def page_records(rid: str, page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None,
                 segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit, a response, or a cut response."""
    common = {"WARC-Date": DATE, "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", "%20", url or "urn:none"),
              "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page_id}
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = "application/http; msgtype=response"
    if refers_to is not None:
        return [record({"WARC-Type": "revisit", "WARC-Record-ID": f"<urn:page:{rid}>", **common,
                        "WARC-Refers-To": f"<urn:page:{refers_to}>", "Content-Type": kind,
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, status)]
    block = status + chunked(payload)
    first = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{rid}>", **common, "Content-Type": kind}
    if len(block) <= segment_bytes:
        return [record(first, block)]
    cuts = [block[at:at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = [record({**first, "WARC-Segment-Number": 1}, cuts[0])]
    for k, cut in enumerate(cuts[1:], 2):
        out.append(record({
            "WARC-Type": "continuation", "WARC-Record-ID": f"<urn:page:{rid}:{k}>", "WARC-Date": DATE,
            "WARC-Target-URI": common["WARC-Target-URI"], "WARC-Segment-Origin-ID": f"<urn:page:{rid}>",
            "WARC-Segment-Number": k, "WARC-Segment-Total-Length": len(block) if k == len(cuts) else None}, cut))
    return out


def parse(data: bytes):
    """(fields with lower-case names, block) of each record of a WARC file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        yield fields, data[end + 4:end + 4 + n]
        at = end + 4 + n


def _write_rows(batches, segment_bytes: int):
    for batch in batches:
        cols = [batch.column(i) for i in range(batch.num_columns)]
        for at in range(0, batch.num_rows, 200):
            out = []
            for rid, page_id, url, html, refers in zip(*[c.slice(at, 200).to_pylist() for c in cols]):
                payload = text_bytes(html)
                out += page_records(rid, page_id, url, payload, digest_of(payload), refers, segment_bytes)
            # the writer ends each row with the line feed that ends the record
            yield pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in out], pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_revisit: int = 0,
                   url_col: str = "url") -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files below ``path``. Of equal
    payloads of at least ``min_revisit`` bytes the one with the smallest page_id is
    the response and the others revisit it. ``pages`` is read twice, so it must be
    a table, not something computed anew in another order."""
    text = F.coalesce(F.col("html"), F.lit(""))
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), text.alias("html"),
                         F.sha1(text.cast("binary")).alias("sha1"), F.monotonically_increasing_id().alias("n"))
    keyed = keyed.withColumn("rid", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "n"))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "n")
    first = (keyed.filter(F.octet_length("html") >= min_revisit).groupBy("sha1")
             .agg(F.min(F.struct(order.alias("o"), "rid")).alias("first"), F.count(F.lit(1)).alias("copies"))
             .filter("copies > 1").select(F.col("sha1").alias("of"), F.col("first.rid").alias("first")))
    dealt = keyed.join(first, (F.col("sha1") == F.col("of")) & (F.octet_length("html") >= min_revisit), "left")
    refers = F.when(F.col("first") != F.col("rid"), F.col("first"))
    lines = dealt.select("rid", "page_id", "url", "html", refers.alias("refers")).mapInArrow(
        lambda batches: _write_rows(batches, segment_bytes), "value binary")
    (lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n")
     .option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").text(path))


def _parse_rows(batches, schema: pa.Schema):
    def number(x):
        return int(x) if x is not None and re.fullmatch(r"-?[0-9]+", x) else None

    for batch in batches:
        for data in batch.column(0):
            out: list[list] = [[] for _ in schema]
            size = 0
            for f, block in parse(data.as_py()):
                row = (f.get("warc-record-id"), f.get("warc-type"), f.get("warc-segment-origin-id"),
                       number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")),
                       number(f.get("x-page-id")), (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                       f.get("warc-refers-to"), block)
                for column, x in zip(out, row):
                    column.append(x)
                size += len(block)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)
                    out, size = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below ``path``."""
    schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("origin_id", pa.string()),
                        ("segment", pa.int32()), ("total_length", pa.int64()), ("page_id", pa.int64()),
                        ("digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary())])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(lambda batches: _parse_rows(batches, schema), PARSED)


def _restored(block: bytes | None, digest: str | None) -> tuple[bytes | None, str]:
    if block is None:
        return None, "missing segment"
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, "bad chunk"
    if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", head, re.I):
        body = dechunk(body)
        if body is None:
            return None, "bad chunk"
    if digest is not None and digest_of(body) != digest:
        return None, "digest mismatch"
    return body, "ok"


DECODED = "struct<payload: binary, payload_bytes: bigint, payload_digest: string, status: string>"


def _decode(parts: pa.Array, digest: pa.Array, status: pa.Array, with_payload: bool = True) -> pa.Array:
    rows = []
    for p, d, s in zip(parts, digest, status):
        block = b"".join(x.as_py() for x in p.values) if p.is_valid and s.as_py() is None else None
        payload, found = _restored(block, d.as_py()) if s.as_py() is None else (None, s.as_py())
        rows.append({"payload": payload if with_payload else None, "payload_bytes": None if payload is None else len(payload),
                     "payload_digest": None if payload is None else digest_of(payload), "status": found})
    return pa.array(rows, pa.struct([("payload", pa.binary()), ("payload_bytes", pa.int64()),
                                     ("payload_digest", pa.string()), ("status", pa.string())]))


def reassemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Whole responses and revisits with their decoded payload (null unless
    ``with_payload``), its length and digest, and ``status``; a revisit has no
    payload of its own (see :func:`resolve_revisits`)."""
    whole = records.filter("segment is null and warc_type <> 'continuation'").withColumn(
        "status", F.lit(None).cast("string")).withColumn("parts", F.array("block"))
    cut = records.filter("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    # one group is one record's segments, in order of their numbers
    groups = (cut.groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("record_id", "warc_type", "page_id", "digest", "refers_to"))).alias("first"),
        F.max("total_length").alias("total_length"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts")))
    count = F.size("parts")
    gaps = ((F.col("parts")[0]["segment"] != 1) | (F.element_at("parts", -1)["segment"] != count)
            | F.col("total_length").isNull() | F.col("first").isNull())
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    built = groups.select(
        F.coalesce(F.col("first.record_id"), F.col("origin")).alias("record_id"),
        F.coalesce(F.col("first.warc_type"), F.lit("response")).alias("warc_type"), "first.page_id", "first.digest",
        "first.refers_to", F.when(gaps, "missing segment").when(length != F.col("total_length"), "length mismatch").alias("status"),
        F.transform("parts", lambda p: p["block"]).alias("parts"))
    cols = ["record_id", "warc_type", "page_id", "digest", "refers_to", "parts", "status"]

    def decode_parts(parts: pa.Array, digest: pa.Array, status: pa.Array) -> pa.Array:
        return _decode(parts, digest, status, with_payload)

    decode = F.arrow_udf(decode_parts, DECODED)
    both = whole.select(cols).unionByName(built.select(cols))
    both = both.withColumn("status", F.when(F.col("warc_type") == "revisit", "revisit").otherwise(F.col("status")))
    return both.withColumn("d", decode("parts", "digest", "status")).select(
        "record_id", "warc_type", "page_id", "digest", "refers_to", "d.payload", "d.payload_bytes", "d.payload_digest", "d.status")


def resolve_revisits(whole: DataFrame) -> DataFrame:
    """Per page the length and digest of its full payload; a revisit takes them
    from the response that it names."""
    slim = whole.select("record_id", "warc_type", "page_id", "refers_to", "payload_bytes", "payload_digest", "status")
    there = slim.filter("warc_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"),
        F.col("payload_digest").alias("to_digest"), F.col("status").alias("to_status"))
    again = slim.filter("warc_type = 'revisit'").join(there, "refers_to", "left").select(
        "page_id", F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.col("to_page").alias("refers_to"),
        F.coalesce("to_status", F.lit("missing response")).alias("status"))
    return slim.filter("warc_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), "status").unionByName(again)


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, min_revisit: int = 0) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, segment_bytes, min_revisit)
    whole = reassemble(read_records(spark, path), with_payload=False)
    return resolve_revisits(materialize(whole.drop("payload"), "warc-index"))
