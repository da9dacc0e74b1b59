"""Operator 11: WARC archives with segmented records, written and read back.

Writing: payloads that are equal are stored once, as the response of the smallest id, and revisited by the others. A message has
chunked transfer framing; one longer than a segment is cut into a first record and continuations that name its id. Records
are rows of Spark's text sink with the blank lines that end a WARC record as line separator, so files appear by Spark's commit
protocol in any file system, and a lost executor leaves no half of an archive. Only ids and hashes are compared and shuffled;
the payloads of responses go from the scan to the archive.

Reading: files are parsed as streams into records. Records without a segment number are whole; the others are grouped by the
identifier of their first record, put in order of their numbers, checked against the total length, and joined. Then the chunk
framing is decoded and the payload compared with its digest. What does not fit is returned with its problem, never dropped.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

END = b"\r\n"
#: Fixed by the format: the profile of revisits that repeat a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
ID_FIELD = "X-Page-Id"


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunks of `size` bytes, each after its length in hexadecimal, and the empty last chunk."""
    out = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        out += [b"%x" % len(part), END, part, END]
    return b"".join([*out, b"0", END, END])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. Raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        stop = body.find(END, at)
        if stop < 0:
            raise ValueError("a chunk has no length")
        word = body[at:stop].split(b";")[0].strip()
        if not word or word.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("a chunk's length is no number")
        size = int(word, 16)
        at = stop + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != END:
            raise ValueError("a chunk ends early")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(message: bytes) -> bytes:
    """The payload of an HTTP message, its transfer framing decoded."""
    head, blank, body = message.partition(END + END)
    if not blank:
        raise ValueError("the HTTP header has no end")
    fields = dict((k.strip().lower(), v.strip().lower()) for k, _, v in (line.partition(b":") for line in head.split(END)[1:]))
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def joined(blocks: list[tuple[int, bytes]], total: int | None) -> bytes:
    """The message of the segments (number, block), in order; a segment that is there twice counts once."""
    by_number: dict[int, bytes] = {}
    for number, block in blocks:
        if by_number.setdefault(number, block) != block:
            raise ValueError(f"segment {number} differs between records")
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        raise ValueError(f"segments {sorted(by_number)} do not follow each other from 1")
    message = b"".join(by_number[k] for k in sorted(by_number))
    if len(by_number) > 1 and total is None:
        raise ValueError("no segment has the total length")
    if total is not None and len(message) != total:
        raise ValueError(f"the total length is {total}, not {len(message)}")
    return message


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in [*fields, ("Content-Length", len(block))] if value is not None]
    return b"".join([b"WARC/1.1\r\n", "\r\n".join(lines).encode(), END + END, block])


def _address(url: str | None) -> str | None:
    """A url as the value of a field: control characters are percent-encoded."""
    return url if url is None else "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def captures(pages: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(the distinct captures, of groups of equal payloads their roles).

    A capture is (page_id, url, sha, sha1, n) with the number `c` of its rows; a null html is an empty payload. In a group of
    equal payloads of at least `least` bytes, one row of the smallest id (and url) is the response, `first`.
    """
    rows = hashed(pages).groupBy("page_id", "url", "sha", "sha1", "n").agg(F.count("*").alias("c"))
    found = written(rows, "captures")
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    firsts = found.where(F.col("n") >= least).groupBy("sha").agg(F.min(order).alias("first"), F.sum("c").alias("copies")).where("copies > 1")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    return found, found.join(firsts, "sha").select("page_id", "url", "sha", "sha1", "n", "c", "first", is_first.alias("is_first"))


def hashed(pages: DataFrame) -> DataFrame:
    """The rows of (page_id, url, html) as (page_id, url, payload, sha, sha1, n)."""
    d = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    return d.select("*", F.unhex(F.sha2("payload", 256)).alias("sha"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))


def write_archive(
    pages: DataFrame, path: str, least: int = 0, segment: int = 65_536, chunk: int = 16_384, per_file: int = 2048,
    compression: str = "gzip", date: datetime.datetime | None = None,
) -> None:
    """Write one record for each row of (page_id, url, html), besides continuations, to files in the new folder `path`.

    Of rows with equal payloads of at least `least` bytes, one of the smallest page_id is a response and the others revisit
    it; shorter ones are all responses. Null ids come after all others; repeated rows count as rows. A message longer than
    `segment` bytes is cut, so a file holds at most `per_file` times that. Control characters of a url are percent-encoded.
    An empty table gives an archive without records.
    """
    if segment < 1 or chunk < 1:
        raise ValueError("segments and chunks have one byte at least")
    spark = pages.sparkSession
    run = uuid.uuid4()
    when = (date or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    name = lambda *parts: uuid.uuid5(run, "\n".join(repr(p) for p in parts)).urn

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row_number = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                row_number += 1
                page, sha, payload = row["page_id"], row["sha"], row["payload"]
                shared = [("WARC-Date", when), ("WARC-Target-URI", _address(row["url"])), (ID_FIELD, page), ("WARC-Payload-Digest", f"sha1:{base32(row['sha1'])}")]
                kind = ("Content-Type", "application/http; msgtype=response")
                if payload is None:
                    own = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name(task, row_number)}>"), ("WARC-Profile", PROFILE)]
                    refers = [("WARC-Refers-To", f"<{name(row['first_page'], sha)}>"), ("WARC-Refers-To-Target-URI", _address(row["first_url"]))]
                    made = [_record([*own, *refers, *shared, kind], HTTP)]
                else:
                    record_id = name(page, sha) if row["n"] >= least else name(task, row_number)
                    message = HTTP + chunked(payload, chunk)
                    own = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *shared, kind]
                    parts = range(0, len(message), segment)
                    made = [_record([*own, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], message[:segment])]
                    for number, at in enumerate(parts[1:], 2):
                        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name(record_id, number)}>"), ("WARC-Date", when)]
                        fields += [("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", number)]
                        fields.append(("WARC-Segment-Total-Length", len(message) if number == len(parts) else None))
                        made.append(_record(fields, message[at : at + segment]))
                out += made
                size += sum(map(len, made))
                if size > 8_000_000:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    _, groups = captures(pages, least)
    groups = written(groups, "payload-groups")
    key = ["page_id", "url", "sha"]
    same = lambda a, b: a["page_id"].eqNullSafe(b["page_id"]) & a["url"].eqNullSafe(b["url"]) & (a["sha"] == b["sha"])
    rows = hashed(pages)
    elsewhere = groups.where("not is_first or c > 1").select(*key)
    responses = rows.join(elsewhere, same(rows, elsewhere), "left_anti")
    repeated = groups.where("is_first and c > 1").select(*key)
    if not repeated.isEmpty():
        responses = responses.union(rows.join(repeated, same(rows, repeated), "left_semi").dropDuplicates(key))
    times = F.col("c") - F.col("is_first").cast("long")
    revisits = groups.select("*", times.alias("times")).where("times > 0").withColumn("_k", F.explode(F.expr("sequence(1L, times)")))
    first = [F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url")]
    revisits = revisits.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "sha", "sha1", "n", *first)
    none = [F.lit(None).cast(revisits.schema[c].dataType).alias(c) for c in ("first_page", "first_url")]
    both = responses.select("*", *none).unionByName(revisits)
    out = both.mapInArrow(records, "value string").write.option("lineSep", "\r\n\r\n").option("compression", compression)
    out.option("maxRecordsPerFile", per_file).text(path)


def _rows(records: list[bytes]) -> pa.RecordBatch:
    """Bytes as a column of strings, not decoded: segments may begin and end inside a character."""
    return pa.RecordBatch.from_arrays([pa.array(records, pa.binary()).view(pa.string())], ["value"])


def parsed(stream: io.BufferedIOBase, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (fields, block) of each record of a file, plain or in gzip members; names of fields in lower case."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line == END:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record begins where one is due, but {line[:40]!r}")
        fields: dict[str, str] = {}
        last = None
        while (line := stream.readline()) != END:
            if not line:
                raise ValueError(f"{path}: the file ends in the fields of a record")
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.decode().strip()
                continue
            field, _, value = line.decode().partition(":")
            last = field.strip().lower()
            fields[last] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"{path}: the file ends in a block of {size} bytes")
        yield fields, block


FIELDS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "uri": "warc-target-uri", "page": ID_FIELD.lower(), "digest": "warc-payload-digest",
    "refers_id": "warc-refers-to", "origin": "warc-segment-origin-id", "segment": "warc-segment-number", "total": "warc-segment-total-length",
}


def read_records(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """(record_type, record_id, date, uri, page, digest, refers_id, origin, segment, total, block) of each record in the folder.

    `segmented` chooses records with or without a segment number. A file is held by one task, in its compressed form; the
    records are taken from it as from a stream.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = io.BytesIO(memoryview(content.as_buffer()))
                stream = gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                out, size = [], 0
                for fields, block in parsed(stream, file):
                    if segmented is not None and ("warc-segment-number" in fields) != segmented:
                        continue
                    out.append([fields.get(f) for f in FIELDS.values()] + [block])
                    size += len(block)
                    if size > 4_000_000:
                        yield _table(out)
                        out, size = [], 0
                if out:
                    yield _table(out)

    def _table(rows: list[list]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(FIELDS))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.binary())], [*FIELDS, "block"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(parse, ", ".join(f"{f} string" for f in FIELDS) + ", block binary")
    return found.withColumns({"segment": F.col("segment").cast("long"), "total": F.col("total").cast("long")})


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, date, uri, page, refers_id, digest, payload, problem), one row for each message of the folder.

    The segments of a message are put together; its payload is decoded, and `digest` (bare base32 SHA-1) is that of the
    payload as read. A revisit has no payload and the digest of its field. `problem` says what is wrong with a message: missing,
    differing or superfluous segments, another total length, broken chunks, another digest; its payload is then null.
    """
    one = F.struct(F.lit(1).cast("long").alias("segment"), "block")
    head = ["record_type", "record_id", "date", "uri", "page", "digest", "refers_id"]
    whole = read_records(spark, path, segmented=False).where("record_type in ('response', 'resource', 'revisit')")
    whole = whole.select(*head, F.lit(None).cast("long").alias("total"), F.array(one).alias("blocks"))
    cut = read_records(spark, path, segmented=True).withColumn("record_id", F.coalesce("origin", "record_id"))
    # the fields are those of the first record; a message without it keeps what its continuations have
    fields = [F.min_by(c, "segment").alias(c) for c in head if c != "record_id"]
    groups = cut.groupBy("record_id").agg(*fields, F.max("total").alias("total"), F.collect_list(F.struct("segment", "block")).alias("blocks"))
    found = whole.unionByName(groups)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, digests, problems = [], [], []
            for row in batch.select(["record_type", "digest", "total", "blocks"]).to_pylist():
                payload, digest, problem = None, (row["digest"] or "").removeprefix("sha1:") or None, None
                try:
                    message = joined([(b["segment"], b["block"]) for b in row["blocks"]], row["total"])
                    if row["record_type"] == "continuation":
                        raise ValueError("the first segment is missing")
                    if row["record_type"] != "revisit":
                        payload = payload_of(message)
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if digest not in (None, own):
                            payload, problem = None, f"the payload's digest is {own}, not {digest}"
                        digest = own
                except ValueError as error:
                    payload, problem = None, str(error)
                payloads.append(payload)
                digests.append(digest)
                problems.append(problem)
            same = ["record_type", "record_id", "date", "uri", "page", "refers_id"]
            columns = [*(batch.column(c) for c in same), pa.array(digests, pa.string()), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*same, "digest", "payload", "problem"])

    schema = "record_type string, record_id string, date string, uri string, page string, refers_id string, digest string, payload binary, problem string"
    return found.mapInArrow(decode, schema)


def resolved(found: DataFrame) -> DataFrame:
    """(page, record_type, digest, payload_bytes, refers_page, problem): revisits have the length and page of their response."""
    rows = found.select("page", "record_type", "record_id", "refers_id", "digest", F.octet_length("payload").cast("long").alias("n"), "problem")
    rows = written(rows, "records")
    own = rows.where("record_type != 'revisit'").select("page", "record_type", "digest", F.col("n").alias("payload_bytes"), F.lit(None).cast("string").alias("refers_page"), "problem")
    targets = rows.where("record_type != 'revisit'").select(F.col("record_id").alias("refers_id"), F.col("page").alias("refers_page"), "n", F.lit(True).alias("known"))
    again = rows.where("record_type = 'revisit'").drop("n").join(targets, "refers_id", "left")
    lost = F.when(F.col("known").isNull(), F.lit("the record it refers to is not in the archive"))
    again = again.select("page", "record_type", "digest", F.col("n").alias("payload_bytes"), "refers_page", F.coalesce("problem", lost).alias("problem"))
    return own.unionByName(again)
