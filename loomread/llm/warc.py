"""WARC archives: records with segments and chunked framing, written and read back through Spark's text source."""

from __future__ import annotations

import base64
import hashlib
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomread.storage import scratch, stored

NO_ID = -(1 << 63)  # stands for a null id: before all others
BREAK = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def record_id(page_id, digest: str, copy: int | str = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{copy}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cuts(data: bytes, size: int) -> list[int]:
    """0, then ends of pieces of at most ``size`` bytes that do not end inside a character."""
    out = [0]
    while len(data) - out[-1] > size:
        at = out[-1] + size
        while at - 1 > out[-1] and data[at] & 0xC0 == 0x80:
            at -= 1
        out.append(at)
    return [*out, len(data)] if data else out


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in HTTP/1.1 chunked transfer framing."""
    at = cuts(payload, size)
    return b"".join(b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(at, at[1:])) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at:at + n])
        at += n + 2


def record(fields: dict, block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n" for k, v in fields.items() if v is not None)
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block


def segments(fields: dict, block: bytes, most: int) -> list[bytes]:
    """The record, or where its block is longer than ``most`` bytes its first segment and its continuations."""
    if len(block) <= most:
        return [record(fields, block)]
    at = cuts(block, most)
    out = [record(fields | {"WARC-Segment-Number": 1}, block[:at[1]])]
    for k in range(1, len(at) - 1):
        own = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, fields['WARC-Record-ID'] + str(k))}>", "WARC-Date": fields["WARC-Date"],
               "WARC-Segment-Origin-ID": fields["WARC-Record-ID"], "WARC-Segment-Number": k + 1, "WARC-Segment-Total-Length": len(block) if k == len(at) - 2 else None}
        out.append(record(own, block[at[k]:at[k + 1]]))
    return out


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = 16_384, chunk_bytes: int = 4_096, min_revisit: int = 0) -> None:
    """A WARC record per row of ``pages`` into gzip files under ``path``.

    Of rows with equal payloads (UTF-8 of html; null: empty) of at least ``min_revisit`` bytes, the one with the largest
    page_id (of equal ids the least url) is the response and the others revisit it without a payload; a null id is never the
    largest unless all are null. Equal rows give records of their own; other columns are not read; an empty table gives
    no records. Blocks longer than segment_bytes go on in continuation records.
    Only (digest, page_id) is aggregated over equal payloads, so payloads of revisits are never shuffled; Spark's text
    writer ends records with the blank lines WARC asks for and commits files task by task.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html")).withColumn("hex", F.sha1(F.encode("html", "UTF-8")))
    rows = rows.withColumn("pid", F.coalesce("page_id", F.lit(NO_ID)))
    small = F.octet_length("html") < min_revisit
    winners = rows.where(~small).groupBy("hex").agg(F.max("pid").alias("pid"))
    kept = rows.where(~small).join(winners, ["hex", "pid"], "left_semi")
    # dealt as the join has dealt them, so payloads move once
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("hex", "pid").orderBy("url"))).withColumn("again", F.col("place") > 1)
    if min_revisit:
        kept = kept.unionByName(rows.where(small).withColumns({"place": F.lit(1), "again": F.lit(False)}))
    kept = kept.select("page_id", "url", F.when(F.col("again"), "").otherwise(F.col("html")).alias("html"), "hex", "again", F.when(F.col("again"), F.col("pid")).alias("best"))
    again = rows.where(~small).select("page_id", "pid", "url", "hex").join(winners.withColumnRenamed("pid", "best"), "hex").where("pid <> best").select(
        "page_id", "url", F.lit("").alias("html"), "hex", F.lit(True).alias("again"), "best")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["hex"])).decode()
                at += 1
                # a response is found by its page and payload; no two others have a name in common
                own = record_id(r["page_id"], digest, f"{task}.{at}") if r["again"] or len(r["html"].encode()) < min_revisit else record_id(r["page_id"], digest)
                fields = {"WARC-Type": "revisit" if r["again"] else "response", "WARC-Record-ID": own, "WARC-Date": "2024-01-01T00:00:00Z",
                          "WARC-Target-URI": r["url"], "Page-ID": r["page_id"], "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
                if r["again"]:
                    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(None if r["best"] == NO_ID else r["best"], digest)}
                    out.append(record(fields, HTTP_HEAD))
                else:
                    out += segments(fields, HTTP_HEAD + chunked(r["html"].encode(), chunk_bytes), segment_bytes)
            # every record is UTF-8 text, as chunks and segments end between characters
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], ["value"])

    kept.unionByName(again).mapInArrow(run, "value string").write.option("lineSep", BREAK.decode()).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def _finished(page_id, kind, rid, refers, said, block: bytes | None, with_payload: bool):
    """A row of read_warc() from a record's whole block."""
    if kind == "revisit" or block is None:
        return page_id, kind, rid, refers, said, None, None, block is not None
    head, _, body = block.partition(BREAK)
    try:
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return page_id, kind, rid, refers, said, None, None, False
    return page_id, kind, rid, refers, base32_sha1(payload), len(payload), payload if with_payload else None, said == f"sha1:{base32_sha1(payload)}"


RECORD = "page_id long, record_type string, record_id string, refers_to_record string, payload_digest string, payload_bytes long, payload binary, valid boolean"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """RECORD rows of the archives under ``path``, segmented records put together again.

    A gzip file is read by one task, in order, as the fragments between blank lines; Content-Length says where blocks
    end. Records without segments are decoded in place; only segments are shuffled, grouped by the identifier of
    their origin, ordered by number and checked: numbers from 1 without a gap and the total length as stated, else
    valid is false. A payload that doesn't fit its digest or framing is not valid either. Revisits have no payload.
    """
    raw = spark.read.option("lineSep", BREAK.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))

    def records(batches, segmented):
        import pyarrow as pa
        import zstandard

        packed = zstandard.ZstdCompressor(level=3).compress  # segments are shuffled

        kinds = [("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                 ("payload", pa.binary()), ("valid", pa.bool_()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
        file, fields, held, rows = None, None, bytearray(), []
        for b in batches:
            for v, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if f != file:
                    if fields or held.strip(b"\r\n"):
                        raise ValueError(f"{file} ends inside a record")
                    file, held = f, bytearray()
                held += v
                held += BREAK  # as the reader took it off
                if fields is None:
                    at = held.find(BREAK)
                    if held.strip(b"\r\n"):
                        fields = _fields(bytes(held[:at]))
                        del held[:at + 4]
                if fields is None or len(held) < (n := int(fields["content-length"])) + 4:
                    continue  # the blank line is part of the block
                if held[n:n + 4] != BREAK:
                    raise ValueError(f"no blank line after a record of {file}")
                block = bytes(held[:n])
                del held[:n + 4]
                page = int(fields["page-id"]) if "page-id" in fields else None
                kind, rid = fields["warc-type"], fields["warc-record-id"]
                if ("warc-segment-number" in fields) != segmented:
                    pass
                elif segmented:
                    rows.append((page, kind, rid, None, fields.get("warc-payload-digest"), None, None, None, fields.get("warc-segment-origin-id", rid), int(fields["warc-segment-number"]),
                                 int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None, packed(block)))
                else:
                    rows.append((*_finished(page, kind, rid, fields.get("warc-refers-to"), fields.get("warc-payload-digest"), block, with_payload), None, None, None, None))
                fields = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [k for k, _ in kinds])
                rows = []

    parsed = [raw.mapInArrow(partial(records, segmented=x), RECORD + ", origin string, number int, total long, block binary") for x in (False, True)]
    joined = parsed[1].groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.max("page_id").alias("page_id"),
        F.max(F.when(F.col("number") == 1, F.col("record_type"))).alias("record_type"), F.max(F.when(F.col("number") == 1, F.col("payload_digest"))).alias("said"))

    def together(batches):
        import pyarrow as pa
        import zstandard

        unpacked = zstandard.ZstdDecompressor().decompress

        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                block = b"".join(unpacked(p["block"]) for p in r["parts"])
                whole = [p["number"] for p in r["parts"]] == list(range(1, len(r["parts"]) + 1)) and len(block) == r["total"]
                rows.append(_finished(r["page_id"], r["record_type"], r["origin"], None, r["said"], block if whole else None, with_payload))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in RECORD.split(", ")])

    return parsed[0].drop("origin", "number", "total", "block").unionByName(joined.mapInArrow(together, RECORD))


def op2_warc_segments(spark, sf_dir):
    """Every page written as a record and read back; a revisit's payload is that of the record it refers to.

    A record that is not valid, or a revisit of a record that is not there, is an error.
    """
    path = scratch(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    got = read_warc(spark, path, with_payload=False)
    known = F.when(F.col("valid"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("not a valid record: "), F.coalesce("record_id", F.lit("")))))
    got = stored(got.withColumn("record_type", known), "warc-read")
    whole = got.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    origin = got.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", F.lit(True).alias("there"))
    again = got.where("record_type = 'revisit'").select("page_id", "refers_to_record").join(origin, "refers_to_record", "left")
    found = F.when(F.col("there"), F.lit("revisit")).otherwise(F.raise_error(F.concat(F.lit("no such record: "), F.coalesce("refers_to_record", F.lit("")))))
    return whole.unionByName(again.select("page_id", "payload_bytes", "payload_digest", found.alias("record_type"), "refers_to"))


SQL_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p),
bits AS (SELECT h, list_transform(range(20), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS o FROM (SELECT DISTINCT h FROM p)),
code AS (SELECT h, array_to_string(list_transform(range(32), lambda k:
   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((o[(5 * k) // 8 + 1] * 256 + coalesce(o[(5 * k) // 8 + 2], 0)) >> (11 - (5 * k) % 8)) & 31) + 1)::BIGINT, 1)), '') AS d FROM bits)
SELECT page_id, octet_length(b) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM m JOIN code USING (h)
"""
