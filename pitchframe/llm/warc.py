"""WARC archives: writing pages with revisits and segments, reading them back whole.

Records are built from column expressions and written by Spark's own text writer, whose
line separator is the two line ends that close a WARC record; the writer's
commit protocol thus also covers lost tasks. Archives are gzip files of about
``ARCHIVE_BYTES``. A block longer than a segment is continued in records that name the
first one as their origin. The reader groups continuations by origin, orders them by
segment number, verifies the total length and takes the chunked framing off.
"""
from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import filled_id, restored_id
from pitchframe.plans.scratch import scratch_path, written

END = "\r\n"
ARCHIVE_BYTES = 16_000_000
SEGMENT_CHARS = 16_384
CHUNK_CHARS = 4_096
WARC_DATE = "1970-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_RECORD = "record_id string, page_id long, url string, record_type string, digest string, refers_to string, origin string, segment int, total long, block binary"
_WHOLE = "record_id string, page_id long, url string, record_type string, digest string, refers_to string, payload binary, fault string"


def base32_of_sha1(content: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column: 160 bits, 20 at a time."""
    hexed = F.sha1(content.cast("binary"))
    out = []
    for five in range(8):
        bits = F.conv(F.substring(hexed, 5 * five + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def roles(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, sha, payload_bytes and ``first``: the id that holds this payload, for each page and payload.

    Payloads are told apart by their SHA-256. Smaller ones than ``min_revisit_bytes`` are all held by themselves.
    """
    sizes = pages.select(filled_id("page_id"), _sha().alias("sha"), F.octet_length(_payload()).cast("long").alias("payload_bytes"))
    sizes = written(sizes, "payloads")
    firsts = sizes.groupBy("sha").agg(F.min("page_id").alias("first"))
    small = F.col("payload_bytes") < min_revisit_bytes
    return sizes.distinct().join(firsts, "sha").withColumn("first", F.when(small, F.col("page_id")).otherwise(F.col("first")))


def _payload() -> Column:
    return F.coalesce("html", F.lit(""))


def _sha() -> Column:
    return F.sha2(_payload().cast("binary"), 256)


def _record_id(page_id: Column, copy: Column, sha: Column) -> Column:
    h = F.md5(F.concat_ws(":", page_id.cast("string"), copy.cast("string"), sha).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _cut(text: Column, chars: int) -> Column:
    """``text`` in pieces of ``chars`` code points, cut in one pass; one empty piece for an empty text."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(pieces)


def _chunked(body: Column, chars: int) -> Column:
    framed = F.transform(_cut(body, chars), lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(END), c, F.lit(END)))
    return F.when(body == "", F.lit(f"0{END}{END}")).otherwise(F.concat(F.array_join(framed, ""), F.lit(f"0{END}{END}")))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def warc_records(pages: DataFrame, min_revisit_bytes: int = 0, segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``record``: one WARC record per row, segments of a page in order, dealt out to archives by page."""
    held = written(roles(pages, min_revisit_bytes), "roles")
    total = held.agg(F.sum("payload_bytes")).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    content = pages.select(filled_id("page_id"), "url", _payload().alias("html"), _sha().alias("sha"))
    content = content.repartition(archives, "page_id", "sha").join(held.repartition(archives, "page_id", "sha"), ["page_id", "sha"])
    copy = F.row_number().over(Window.partitionBy("page_id", "sha").orderBy("url"))
    content = content.withColumn("copy", copy)
    own = (F.col("page_id") == F.col("first")) & ((F.col("copy") == 1) | (F.col("payload_bytes") < min_revisit_bytes))
    own = own | (F.col("payload_bytes") < min_revisit_bytes)
    head = F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Transfer-Encoding: chunked{END}{END}")
    content = content.select(
        restored_id("page_id"),
        F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20").alias("url"),
        own.alias("own"),
        base32_of_sha1(F.col("html")).alias("digest"),
        _record_id(F.col("page_id"), F.col("copy"), F.col("sha")).alias("id"),
        _record_id(F.col("first"), F.lit(1), F.col("sha")).alias("first_id"),
        F.when(own, F.concat(head, _chunked(F.col("html"), chunk_chars))).otherwise(head).alias("block"),
    )
    content = content.withColumn("parts", _cut(F.col("block"), segment_chars)).withColumn("total", F.octet_length("block"))
    # A row per segment carries its own part of the block only.
    content = content.withColumn("many", F.size("parts")).drop("block")
    names = [c for c in content.columns if c != "parts"]
    content = content.select(*names, F.posexplode("parts").alias("at", "part"))
    first, last = F.col("at") == 0, F.col("at") == F.col("many") - 1
    several = F.col("many") > 1
    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _field("WARC-Type", F.when(~first, "continuation").when(F.col("own"), "response").otherwise("revisit")),
        _field("WARC-Record-ID", F.when(first, F.col("id")).otherwise(F.concat(F.regexp_replace("id", ">", ""), F.lit("#"), F.col("at"), F.lit(">")))),
        _field("WARC-Date", F.lit(WARC_DATE)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _field("WARC-Refers-To", F.when(first & ~F.col("own"), F.col("first_id"))),
        _field("WARC-Profile", F.when(first & ~F.col("own"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("WARC-Segment-Number", F.when(several, F.col("at") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(~first, F.col("id"))),
        _field("WARC-Segment-Total-Length", F.when(several & last, F.col("total"))),
        _field("X-Page-Id", F.when(first, F.col("page_id"))),
        _field("Content-Type", F.when(first, "application/http; msgtype=response")),
        _field("Content-Length", F.octet_length("part")),
        F.lit(END),
        F.col("part"),
    )
    return content.select(record.alias("record"))


def write_archives(pages: DataFrame, path: str, **options: int) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files under ``path``.

    A null html is an empty payload; a null url or page_id leaves its header line out. Of equal
    payloads the record of the smallest page_id holds the payload; of repeated rows one
    does, and the others revisit it. No pages give empty archives.
    """
    records = warc_records(pages, **options)
    records.write.mode("overwrite").option("lineSep", END + END).option("compression", "gzip").text(path)


def parse_archive(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of one archive: header fields by lower-case name, and the block."""
    while line := stream.readline():
        if not line.strip():
            continue
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields.get("content-length", 0))
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record {fields.get('warc-record-id')} ends early")
        yield fields | {"block": block}


def decode_chunked(body: bytes) -> bytes:
    """The content of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(chunk)
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(x.lower().startswith(b"transfer-encoding:") and b"chunked" in x.lower() for x in head.split(b"\r\n"))
    return decode_chunked(body) if chunked and body else body


def read_records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """Raw records of the archives under ``path``: those that come in segments, or the others."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _RECORD.split(", ")]
        for frame in batches:
            for content in frame["content"]:
                rows, size = [], 0
                for f in parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    if ("warc-segment-number" in f) != segmented:
                        continue
                    page, number, total = (f.get(k) for k in ("x-page-id", "warc-segment-number", "warc-segment-total-length"))
                    rows.append((f.get("warc-record-id"), page and int(page), f.get("warc-target-uri"), f.get("warc-type"), (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None, f.get("warc-refers-to"), f.get("warc-segment-origin-id"), number and int(number), total and int(total), f["block"]))
                    size += len(f["block"])
                    if size > 8_000_000:
                        yield _frame(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows, names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(parse, _RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "segment": "Int32", "total": "Int64"} if "segment" in names else {"page_id": "Int64"})


def reassemble(records: DataFrame) -> DataFrame:
    """One row per page of records that come in segments, blocks joined in segment order.

    ``fault`` says what is wrong with a page whose segments don't make a whole: a missing first
    or last segment, a gap, or a total length that isn't met. Its payload is null.
    """
    key = F.coalesce("origin", "record_id")
    head = F.struct("record_id", "page_id", "url", "record_type", "digest", "refers_to")
    grouped = records.groupBy(key.alias("key")).agg(
        F.first(F.when(F.col("origin").isNull(), head), ignorenulls=True).alias("head"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    fault = (
        F.when(F.col("head").isNull(), "no first segment")
        .when(F.col("total").isNull(), "no last segment")
        .when(numbers != F.sequence(F.lit(1), F.size("parts")), "segments missing or repeated")
        .when(length != F.col("total"), "total length not met")
    )
    return grouped.select("key", "head.*", fault.alias("fault"), F.transform("parts", lambda p: p["block"]).alias("blocks"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, url, record_type, digest, refers_to (a record id), payload, fault of every page.

    Of a revisit the payload is empty here; ``digest`` is that of the full payload.
    """

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _WHOLE.split(", ")]
        for frame in batches:
            payloads, faults = [], []
            for blocks, fault in zip(frame["blocks"], frame["fault"]):
                payload = None
                if fault is None:
                    try:
                        payload = http_payload(b"".join(blocks))
                    except ValueError as wrong:
                        fault = str(wrong)
                payloads.append(payload)
                faults.append(fault)
            yield frame.drop(columns="blocks").assign(payload=payloads, fault=faults)[names].astype({"page_id": "Int64"})

    names = ["record_id", "page_id", "url", "record_type", "digest", "refers_to", "fault", "blocks"]
    single = read_records(spark, path, False).withColumn("fault", F.lit(None).cast("string")).withColumn("blocks", F.array("block"))
    joined = reassemble(read_records(spark, path, True)).withColumn("record_id", F.coalesce("record_id", "key"))
    return single.select(names).unionByName(joined.select(names)).mapInPandas(whole, _WHOLE)


def round_trip(pages: DataFrame, **options: int) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and resolve the revisits."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    back = read_archives(spark, path)
    revisit = F.col("record_type") == "revisit"
    back = back.select(
        "page_id",
        "record_id",
        "record_type",
        "refers_to",
        "fault",
        F.when(revisit, F.col("digest")).otherwise(base32_of_sha1(F.col("payload"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        (revisit | (F.col("digest") == base32_of_sha1(F.col("payload")))).alias("digest_holds"),
    )
    back = written(back, "pages-read")
    held = back.where(~revisit).select(F.col("record_id").alias("held_id"), F.col("page_id").alias("held_page"), F.col("payload_bytes").alias("held_bytes"))
    out = back.join(held, back["refers_to"] == held["held_id"], "left")
    return out.select(
        "page_id",
        F.when(revisit, F.col("held_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(revisit, F.col("held_page")).alias("refers_to"),
        "digest_holds",
        "fault",
    )
