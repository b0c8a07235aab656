"""Operator 3: WARC archives, written with revisit records and segmented responses, and read back whole.

Segments of a record may lie anywhere in an archive: continuation records are grouped by their origin's identifier,
ordered by segment number and checked against the total length that the last one states; then the chunked transfer
framing of the HTTP body is undone and the payload's digest is checked.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristream.llm.common import materialise, scope, tidy

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: Revisits that are broadcast to the writer; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def chunked(payload: bytes, size: int = 4096) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(part := payload[i : i + size]), part) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Undoes chunked transfer framing, with extensions and trailers; ValueError where it is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length than stated")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """An HTTP message's body, its transfer framing undone."""
    head, blank, body = block.partition(END)
    if not blank:
        raise ValueError("HTTP header without end")
    fields = dict(parse_fields(head.split(b"\r\n")[1:]))
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"").lower() else body


def parse_fields(lines: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    for line in lines:
        name, _, value = line.partition(b":")
        yield name.strip().lower(), value.strip()


def clean_field(value: str) -> str:
    """A header value stays on its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A").strip()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """Without the blank lines at its end."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def sha1(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_record(page: int, payload: bytes) -> str:
    return f"<urn:page:{page}:{hashlib.sha1(payload).hexdigest()}>"


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 1000, segment: int = 16_384, records_a_file: int = 2000) -> None:
    """One WARC record per row at `path`, gzip-compressed: a response, cut into segments of `segment` bytes, or a revisit.

    Of rows with equal payloads (UTF-8; null is empty) of at least `least_revisit` bytes those with the largest id are responses
    and the others revisits of it; smaller payloads are all responses. Null ids are smaller than any.

    Payloads are hashed first; only hashes and ids are shuffled. Files hold `records_a_file` records, which bounds what a
    reader's task holds. Spark's own writer commits them, so lost tasks leave nothing behind.
    """
    payload = F.coalesce(pages[payload_col], F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), payload.alias("payload"))
    hashed = rows.where(F.octet_length("payload") >= least_revisit).select("id", F.sha1("payload").alias("h"))
    with scope():
        # Combined before the shuffle: a payload of a million pages is as many rows as it has different ids.
        ids = materialise(hashed.groupBy("h", "id").agg(F.count("*").alias("times")), "ids")
        groups = ids.groupBy("h").agg(F.max(F.struct("id", "times")).alias("last"), F.sum("times").alias("n")).where("n > 1 AND last.id IS NOT NULL")
        marked = ids.join(groups, "h").withColumn("single", F.col("last.times") == 1).withColumn("own", F.col("id").eqNullSafe(F.col("last.id")))
        marked = marked.where(~F.col("own") | ~F.col("single"))
        known = marked.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"), "h", F.when(~F.col("own"), F.col("last.id")).alias("refers_to"), "single")
        known = materialise(known, "revisits")
        few = known.count() <= BROADCAST_ROWS
        # A null or repeated id may stand for several payloads, so the hash is part of the key.
        keyed = rows.withColumn("h", F.sha1("payload")).withColumn("k", F.coalesce(F.col("id").cast("string"), F.lit("")))
        joined = keyed.join(F.broadcast(known) if few else known, ["k", "h"], "left").select("id", "url", "payload", "refers_to", F.coalesce("single", F.lit(True)).alias("single"))
        _write(joined, path, least_revisit, segment, records_a_file)


def _write(joined: DataFrame, path: str, least_revisit: int, segment: int, records_a_file: int) -> None:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page, url, payload, refers_to, single in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                payload = payload.encode()
                n += 1
                # What revisits may refer to is named by page and payload; several rows that agree in both are named by place, like all others.
                name = page_record(page, payload) if single and refers_to is None and page is not None and len(payload) >= least_revisit else f"<urn:record:{part}-{n}>"
                common = [("WARC-Date", DATE), ("WARC-Target-URI", clean_field(url) or None), ("Page-ID", page)]
                header = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
                kind = ("Content-Type", "application/http; msgtype=response")
                if refers_to is not None:
                    out.append(record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", page_record(refers_to, payload) if single else None), ("Refers-To-Page-ID", refers_to), ("WARC-Payload-Digest", sha1(payload)), kind], header))
                    continue
                block = header + chunked(payload)
                pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
                first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", sha1(payload)), kind]
                out.append(record(first + [("WARC-Segment-Number", 1)] * (len(pieces) > 1), pieces[0]))
                for i, piece in enumerate(pieces[1:], 2):
                    last = len(block) if i == len(pieces) else None
                    out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:record:{part}-{n}-{i}>"), *common[:2], ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", last)], piece))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # A record is a line whose separator is the two blank lines that end a record.
    text = joined.mapInArrow(tidy(records), "value binary").select(F.col("value").cast("string"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def inflate(data: bytes) -> bytes:
    """Of all gzip members one after another; other data as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes | None]]:
    """Header fields (names in lower case) and block of each record.

    A block is None where the header states no length or the record is cut off; reading goes on at the next version line behind
    a blank one. Bytes that belong to no record are one without fields.
    """
    at = 0
    while at < len(data):
        end = data.find(END, at)
        starts = data.startswith(b"WARC/1.", at)
        fields = dict(parse_fields(data[at : end if end >= 0 else len(data)].split(b"\r\n")[1:])) if starts else {}
        size = fields.get(b"content-length", b"")
        if starts and end >= 0 and size.isdigit() and end + 4 + int(size) <= len(data):
            yield fields, data[end + 4 : end + 4 + int(size)]
            at = end + 8 + int(size)
            continue
        yield fields, None
        found = data.find(END + b"WARC/1.", at)
        at = len(data) if found < 0 else found + 4


OUT = "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, stated_digest string, origin string, segment int, total long, block binary"


def read_archive(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row per response and revisit record: page_id, record_type, refers_to, payload, payload_bytes, payload_digest (hexadecimal SHA-1 of what
    was read), verified (it equals the digest that the record states, and segments add up to their stated length).

    A task reads whole files, one at a time. Only segments are shuffled, by origin; a group is one record. A revisit has the
    payload figures of the response it refers to; where the archive has none, a null length and the digest it states. An archive without
    records gives no rows. Broken framing, missing segments, records without a length or cut off, and bytes between records give a row each,
    with null payload figures and verified false; record_type is then what is known of it: response, revisit, continuation (segments whose
    first is missing) or unknown. A digest that isn't base32 counts as none. Null and repeated page ids are passed on.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])

    def number(value: bytes | None) -> int | None:
        try:
            return None if value is None else int(value)
        except ValueError:
            return None

    def stated(fields: dict[bytes, bytes]) -> str | None:
        digest = fields.get(b"warc-payload-digest", b"")
        try:
            return base64.b32decode(digest[5:]).hex() if digest.startswith(b"sha1:") else None
        except binascii.Error:
            return None

    def body(row: dict, block: bytes) -> dict:
        try:
            payload = http_payload(block)
        except ValueError:
            return row
        return row | {"payload": payload if with_payload else None, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_records(inflate(content.as_py())):
                    kind, name = (fields.get(x, b"").decode("utf-8", "replace") for x in (b"warc-type", b"warc-record-id"))
                    if kind not in ("response", "revisit", "continuation"):
                        if kind and block is not None:
                            continue  # a kind of record that holds no page
                        kind = "unknown"
                    row = {"page_id": number(fields.get(b"page-id")), "record_type": kind, "refers_to": number(fields.get(b"refers-to-page-id")), "stated_digest": stated(fields)}
                    if block is not None and kind != "unknown" and (segment := number(fields.get(b"warc-segment-number"))) is not None:
                        row |= {"origin": fields.get(b"warc-segment-origin-id", name.encode()).decode("utf-8", "replace"), "segment": segment, "total": number(fields.get(b"warc-segment-total-length")), "block": block}
                    elif kind == "response" and block is not None:
                        row = body(row, block)
                    rows.append(row)
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "refers_to", "stated_digest", "total", "length", "numbers"]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                block = b"".join(row["blocks"])
                whole = row["numbers"] == list(range(1, len(row["numbers"]) + 1)) and row["total"] == len(block)
                one = {k: row[k] for k in names[:4]}
                rows.append(body(one, block) if whole else one)
            yield pa.RecordBatch.from_pylist(rows, schema)

    parts = materialise(files.mapInArrow(tidy(parse), OUT), "records")
    groups = parts.where("origin IS NOT NULL").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("page_id", "record_type", "refers_to", "stated_digest")],
    )
    whole = groups.select("page_id", "record_type", "refers_to", "stated_digest", "total", F.col("parts.segment").alias("numbers"), F.col("parts.block").alias("blocks")).mapInArrow(tidy(decode), OUT)
    out = ["page_id", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "stated_digest"]
    read = parts.where("origin IS NULL").select(*out).unionByName(whole.withColumn("record_type", F.coalesce("record_type", F.lit("continuation"))).select(*out))
    responses = read.where("record_type = 'response'")
    wanted = read.where("record_type = 'revisit'")
    # Rows that repeat an id, and so are each a response, may differ in payload: the digest is part of the key.
    sources = responses.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest")).agg(*[F.any_value(c).alias(c) for c in ("payload", "payload_bytes", "payload_digest")])
    revisits = wanted.drop("payload", "payload_bytes", "payload_digest").join(sources, ["refers_to", "stated_digest"], "left").withColumn("payload_digest", F.coalesce("payload_digest", "stated_digest"))
    rest = read.where("record_type NOT IN ('response', 'revisit')")
    done = responses.unionByName(revisits.select(responses.columns)).unionByName(rest).withColumn("verified", F.coalesce(F.col("payload_digest") == F.col("stated_digest"), F.lit(False)) & F.col("payload_bytes").isNotNull())
    return done.select("page_id", "record_type", "refers_to", *["payload"] * with_payload, "payload_bytes", "payload_digest", "verified")
