"""WARC archives: segmented, chunked records out, and reassembly on the way back."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import shared_folder, small_batches, table, utf8

#: Blocks longer than this are cut into segments.
SEGMENT_BYTES = 16_384
#: Records in an archive at most; as each holds a segment at most, this bounds what is read back at once (128 MB).
ARCHIVE_RECORDS = 8_192
#: Size of the chunks of the chunked transfer coding.
TRANSFER_BYTES = 4_096
#: Equal payloads shorter than this are stored each time.
REVISIT_BYTES = 100
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = TRANSFER_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over. Broken framing raises ValueError."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += size + 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return utf8("\r\n".join(lines)) + END


def page_records(page_id: int | None, number: str, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page without the closing blank lines: a revisit, or a response with its continuations."""
    origin = f"<urn:page:{'' if page_id is None else page_id}:{number}>"
    uri = (url or "about:blank").replace("\r", "").replace("\n", "")
    digest = f"sha256:{hashlib.sha256(payload).hexdigest()}"
    base = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *base, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("Content-Length", 0)]
        return [_head(fields)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    several = len(parts) > 1
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *base, ("WARC-Segment-Number", 1 if several else None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(parts[0]))]
    out = [_head(fields) + parts[0]]
    for k, part in enumerate(parts[1:], 2):
        last = len(block) if k == len(parts) else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{origin[:-1]}:segment:{k}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri)]
        fields += [("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", last), ("Content-Length", len(part))]
        out.append(_head(fields) + part)
    return out


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        split = archive.index(END, at)
        lines = archive[at:split].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        begin = split + len(END)
        end = begin + int(fields["content-length"])
        if archive[end : end + len(END)] != END:
            raise ValueError(f"record at byte {at} isn't closed")
        yield fields, archive[begin:end]
        at = end + len(END)


def revisits(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(id, url, payload, refers_to): the smallest id of each payload of ``least`` bytes or more is stored, the others refer to it.

    A payload with null ids only is stored each time; with others, its null ids are revisits.
    """
    rows = pages.select(F.col(id_col).alias("id"), (F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("original"))
    joined = rows.join(firsts, "digest", "left")
    return joined.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Write (id, url, payload, refers_to) as WARC files, one for each task, by Spark's text writer.

    The blank lines that close a record are the writer's line separator, so the unpacked files are plain
    WARC, go to any file system that Spark knows, and are committed by task. A task begins a new archive
    after ``ARCHIVE_RECORDS`` records.
    """
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        for b in batches:
            out = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += page_records(page_id, f"{task}.{number}", url, utf8(payload), refers_to, segment)
                number += 1
            yield table({"record": pa.array(out, pa.binary())})

    raw = records.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    raw.write.option("maxRecordsPerFile", ARCHIVE_RECORDS).option("lineSep", END.decode()).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each archived page: id, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, intact.

    Whole records are decoded where they are parsed. Segments are grouped by their origin, put in order by
    number and checked against the total length of the last; then the transfer framing goes. ``intact``
    tells whether numbers, lengths and digest hold; damaged records stay, with it false. Archives are
    parsed twice, once for each kind, which saves writing their content again.
    """
    small_batches(spark)  # batches are bounded in bytes as well, and archives are unpacked one by one
    files = spark.read.format("binaryFile").load(path).select("content")
    head = [("id", pa.string()), ("declared", pa.string()), ("bytes", pa.int64()), ("type", pa.string()), ("refers_to", pa.string())]
    kinds = [("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), *head, ("block", pa.binary())]

    def records(archive: bytes) -> Iterator[dict]:
        for f, block in parse(archive if archive[:2] != b"\x1f\x8b" else gzip.decompress(archive)):
            origin = f.get("warc-segment-origin-id", f["warc-record-id"])
            total, length = f.get("warc-segment-total-length"), f.get("x-payload-length")
            yield {
                "origin": origin, "segment": int(f.get("warc-segment-number", 0)), "total": total and int(total), "id": origin[len("<urn:page:") : -1].split(":")[0] or None,
                "declared": f.get("warc-payload-digest", "")[7:], "bytes": length and int(length), "type": f["warc-type"],
                "refers_to": f.get("warc-refers-to", "")[len("<urn:page:") : -1] or None, "block": block,
            }

    def decoded(r: dict, numbers: list[int], block: bytes) -> dict:
        payload, good = None, True
        if r["type"] != "revisit":
            good = numbers == [0] or (numbers == list(range(1, len(numbers) + 1)) and len(block) == r["total"])
            try:
                payload = dechunked(block.partition(END)[2])
            except ValueError:
                good = False
        digest = r["declared"] if payload is None else hashlib.sha256(payload).hexdigest()
        good = good and digest == r["declared"]
        size = r["bytes"] if payload is None else len(payload)
        return {"id": r["id"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": r["type"], "refers_to": r["refers_to"], "intact": good}

    result = pa.schema([("id", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("intact", pa.bool_())])

    def in_parts(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row.get("block") or row.get("payload") or b"")
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                yield from in_parts((decoded(r, [0], r["block"]) for r in records(archive) if not r["segment"]), result)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                yield from in_parts((r for r in records(archive) if r["segment"]), pa.schema(kinds))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from in_parts((decoded(r, r["numbers"], b"".join(r["blocks"])) for r in b.to_pylist()), result)

    schema = "id string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean"
    pieces = files.mapInArrow(segments, "origin string, segment int, total long, id string, declared string, bytes long, type string, refers_to string, block binary")
    firsts = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c, _ in head]
    ordered = F.sort_array(F.collect_list(F.struct("segment", "block")))
    pieces = pieces.groupBy("origin").agg(*firsts, F.max("total").alias("total"), ordered.alias("ordered"))
    pieces = pieces.select(*[c for c, _ in head], "total", F.col("ordered.segment").alias("numbers"), F.col("ordered.block").alias("blocks"))
    return files.mapInArrow(whole, schema).unionByName(pieces.mapInArrow(join, schema))


def round_trip(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """Archive the pages in the shared folder and read them back; ids have their own type again.

    Null payloads are empty. Null ids and urls are archived without them. Repeated rows have a record each.
    Other columns are not archived. A record that comes back damaged raises an error.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(revisits(pages, id_col, text_col), path)
    kind = dict(pages.dtypes)[id_col]
    back = read_archives(spark, path)
    damaged = F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("id"), F.lit("without id"))))
    back = back.withColumn("payload_digest", F.when(F.col("intact"), F.col("payload_digest")).otherwise(damaged.cast("string")))
    return back.withColumn("id", F.col("id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
