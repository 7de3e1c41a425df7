"""WARC writing and reading with segment reassembly.

Writing is declarative: each page becomes a response record (an HTTP message in chunked
transfer framing) or, where an equal payload is already stored by a page with a smaller
identifier, a revisit record, whose WARC-Refers-To is the WARC-Record-ID of that response.
Identifiers of records follow from page, URL, payload and the number of the copy. A block
longer than segment_chars is cut into a first segment
and continuation records with WARC-Segment-Number and WARC-Segment-Origin-ID; the last one
states WARC-Segment-Total-Length. Records are written by Spark's text writer, whose line
separator is the blank lines that end a record, so the part files are WARC files in any
store that Spark writes to; a file holds at most RECORDS_PER_FILE records of bounded length.
A compressed file is one gzip stream (Spark's writer has no members); the reader takes both.
All cuts are one scan each, so a page of any length costs in proportion to it.

Reading takes whole files (gzip or plain), follows Content-Length from record to record,
groups segments by origin identifier, orders them by number, verifies that none is missing
and that the total length agrees, undoes the chunked framing and verifies the digest.

Null html counts as empty. Empty payloads and those under min_revisit_bytes are always
responses. Rows that repeat a page_id give a record each (equal rows are counted, then written
as numbered copies); all rows with a response's page_id and payload are responses. A null
page_id is read back as null; such a row revisits an equal payload that has an identifier, and
is a response where no row of its payload has one.
Broken archives raise ValueError, naming the record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, sized, trimmed

END = "\r\n\r\n"
RECORDS_PER_FILE = 2_000
SEGMENT_CHARS = 1 << 15
CHUNK_CHARS = 1 << 13


def mark_revisits(pages: DataFrame, *, min_revisit_bytes: int = 100) -> DataFrame:
    """(page_id, url, html) with payload_bytes, digest, mark (of URL and payload), copy,
    refers_to and refers_mark (null for a response).

    Only (digest, page_id, mark) is grouped, with partial aggregation; the rows join the few
    digests that occur more than once."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    rows = rows.withColumn("mark", F.md5(F.concat("digest", "url")))
    keys = rows.select("digest", "page_id", "mark", "payload_bytes").groupBy("digest", "page_id", "mark", "payload_bytes").agg(F.count("*").alias("copies"))
    keys = materialise(keys, "warc-keys")
    known = keys.filter((F.col("payload_bytes") >= min_revisit_bytes))
    first = known.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "mark"))).alias("first"), F.sum("copies").alias("n")).filter("n > 1 AND first IS NOT NULL")
    first = materialise(first.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.mark").alias("first_mark")), "warc-first")
    repeated = materialise(keys.filter("copies > 1").select(F.col("page_id").alias("r_id"), F.col("mark").alias("r_mark"), "copies"), "warc-repeated")
    n_repeated = repeated.count()
    if n_repeated:  # each equal row once, then as often as it occurs
        same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("mark") == F.col("r_mark"))
        rows = rows.join(sized(repeated, n_repeated, 64), same, "left").drop("r_id", "r_mark")
        fields = [c for c in rows.columns if c not in ("html", "copies")]
        equal = rows.filter("copies IS NOT NULL").groupBy(*fields, "copies").agg(F.first("html").alias("html"))
        equal = equal.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
        rows = rows.filter("copies IS NULL").drop("copies").withColumn("copy", F.lit(1).cast("long")).unionByName(equal)
    else:
        rows = rows.withColumn("copy", F.lit(1).cast("long"))
    rows = rows.join(sized(first, first.count(), 120), "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.withColumn("refers_to", F.when(again, F.col("first_id"))).withColumn("refers_mark", F.when(again, F.col("first_mark"))).drop("first_id", "first_mark")


def cut(text: str, chars: int) -> str:
    """The text in pieces of so many characters, in one scan."""
    return f"regexp_extract_all({text}, '(?s).{{1,{chars}}}', 0)"


def _chunked(text: str, chars: int) -> str:
    framed = f"array_join(transform({cut(text, chars)}, c -> concat(lower(hex(octet_length(c))), '\r\n', c, '\r\n')), '')"
    return f"concat({framed}, '0\r\n\r\n')"


def record_id(page_id: Column, mark: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), mark, F.lit(":"), copy.cast("string"), F.lit(">"))


def records(marked: DataFrame, *, segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """One row (record) per WARC record, without the blank lines that end it."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(F.col("refers_to").isNull(), F.concat(F.lit("Transfer-Encoding: chunked\r\n\r\n"), F.expr(_chunked("html", chunk_chars)))).otherwise(
            F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
        ),
    )
    rows = marked.withColumn("block", http).drop("html").withColumn("record_id", record_id(F.col("page_id"), F.col("mark"), F.col("copy")))
    rows = rows.withColumn("total", F.octet_length("block")).withColumn("n_segments", F.expr(f"(length(block) - 1) div {segment_chars} + 1"))
    rows = rows.select("*", F.posexplode(F.expr(cut("block", segment_chars))).alias("at", "piece")).drop("block")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    first = F.col("at") == 0
    revisit = F.col("refers_to").isNotNull()
    header: Column = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(F.concat(F.expr("left(record_id, length(record_id) - 1)"), F.lit(":"), F.col("at").cast("string"), F.lit(">")))),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.when(first, F.concat(
            line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
            F.lit("Content-Type: application/http;msgtype=response\r\n"),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.when(revisit, F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("refers_mark"), F.lit(1))),
            )).otherwise(F.lit("")),
        )).otherwise(F.lit("")),
        F.when(F.col("n_segments") > 1, line("WARC-Segment-Number", (F.col("at") + 1).cast("string"))).otherwise(F.lit("")),
        F.when(~first, line("WARC-Segment-Origin-ID", F.col("record_id"))).otherwise(F.lit("")),
        F.when(~first & (F.col("at") + 1 == F.col("n_segments")), line("WARC-Segment-Total-Length", F.col("total").cast("string"))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length("piece").cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, F.col("piece")).alias("record"))


def write_archives(pages: DataFrame, folder: str, *, min_revisit_bytes: int = 100, compression: str = "gzip", segment_chars: int = SEGMENT_CHARS) -> None:
    """pages (page_id, url, html) as WARC files below folder."""
    rows = records(mark_revisits(pages, min_revisit_bytes=min_revisit_bytes), segment_chars=segment_chars)
    rows.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record."""
    if content[:2] == b"\x1f\x8b":
        members, rest = [], content
        while rest:
            unzip = zlib.decompressobj(31)
            members.append(unzip.decompress(rest))
            rest = unzip.unused_data
        content = b"".join(members)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or content[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        header = {}
        for line in content[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            header[name.strip().lower()] = value.strip()
        start = end + 4
        stop = start + int(header["content-length"])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record {header.get('warc-record-id')} has another length than it states")
        yield header, content[start:stop]
        at = stop + 4


def unchunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked body without its last chunk")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk shorter than it states")
        at = end + 4 + size


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and decoded body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, unchunk(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


RAW = "record_id string, type string, page_id long, url string, digest string, refers_to long, segment int, total long, block binary"


def _page(urn: str) -> int | None:
    page = urn.strip("<>").split(":")[2]
    return None if page == "null" else int(page)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """RAW rows: unsegmented records, first segments and continuations (record_id: their origin's)."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse_archive(content.as_py()):
                    origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                    refers = h.get("warc-refers-to")
                    segment, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    rows.append((origin, h["warc-type"], _page(origin), h.get("warc-target-uri"), (h.get("warc-payload-digest") or "").removeprefix("sha256:"), _page(refers) if refers else None, int(segment) if segment else None, int(total) if total else None, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(trimmed(parse), RAW)


def reassemble(raw: DataFrame) -> DataFrame:
    """One row per logical record. Only segmented records are shuffled, by origin; a group is
    one record's segments."""
    whole = raw.filter("segment IS NULL").drop("segment", "total")
    parts = raw.filter("segment IS NOT NULL")
    joined = parts.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("type", "page_id", "url", "digest", "refers_to")),
    )
    joined = joined.withColumn("block", F.expr("unhex(array_join(transform(parts, p -> hex(p.block)), ''))"))
    fine = F.expr("total IS NOT NULL AND octet_length(block) = total AND parts[size(parts) - 1].segment = size(parts) AND parts[0].segment = 1")
    joined = joined.withColumn("block", F.when(fine, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing or of another length: "), F.col("record_id"))).cast("binary")))
    return whole.unionByName(joined.select(whole.columns))


def decode(records: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """page_id, record_type, payload_bytes, payload_digest, refers_to (and url, payload) of logical
    records. A response's figures come from its decoded payload, verified against its
    digest; a revisit's from what its header states."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", url string, payload binary" if with_payload else ""

    def run(batches):
        for batch in batches:
            ids, types, stated, refers, urls, blocks = (batch.column(c).to_pylist() for c in ("page_id", "type", "digest", "refers_to", "url", "block"))
            sizes, digests, payloads = [], [], []
            for i, kind, said, block in zip(ids, types, stated, blocks, strict=True):
                fields, body = http_payload(block)
                if kind == "revisit":
                    size, digest = int(fields["content-length"]), said
                else:
                    size, digest = len(body), hashlib.sha256(body).hexdigest()
                    if digest != said:
                        raise ValueError(f"page {i}: payload has another digest than its record states")
                sizes.append(size)
                digests.append(digest)
                payloads.append(body if with_payload else None)
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(types, pa.string()), pa.array(refers, pa.int64())]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            if with_payload:
                columns += [pa.array(urls, pa.string()), pa.array(payloads, pa.binary())]
                names += ["url", "payload"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return records.select("page_id", "type", "digest", "refers_to", "url", "block").mapInArrow(trimmed(run), schema)


def read_archives(spark: SparkSession, folder: str, *, with_payload: bool = False) -> DataFrame:
    return decode(reassemble(read_records(spark, folder)), with_payload=with_payload)
