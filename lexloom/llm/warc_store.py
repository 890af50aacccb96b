"""Content-addressed WARC archive.

Two tables make an archive: `payloads` holds each distinct payload once, compressed, under its
SHA-256; `headers` holds every record's exact header bytes, with the digest that names its
payload. Joining the two gives back the original records. Digests are recomputed from the bytes
whenever they are read. Plain .warc files can be written and read as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import shared_dir, slices

#: Payloads from this many bytes on are deduplicated.
DEDUPLICATE = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record ids, before the page's id.
URN = "urn:page:"
_CRLF = "\r\n"


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        for batch in slices(whole, "html"):
            payloads = [(t or "").encode() for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([packer.compress(p) for p in payloads], pa.binary())], ["digest", "packed"])


def write_archive(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as an archive under path, one record a row.

    Null html: an empty payload. Null url: an empty one; CR and LF in urls become %0D and %0A.
    Rows with a null page_id are left out; rows with a repeated page_id are records of their own.
    Of equal payloads of DEDUPLICATE bytes or more the one of the smallest page_id is the
    response, and the others are revisits that refer to it; of several rows of that page_id all are
    responses. No rows: an archive without records."""
    shared_dir(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where("page_id is not null")
    packed = rows.select("html").mapInArrow(_compress, "digest string, packed binary")
    packed.groupBy("digest").agg(F.first("packed").alias("packed")).write.parquet(f"{path}/payloads")

    facts = rows.select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").cast("long").alias("n"))
    # a table of its own, so that the join can split the rows of a digest that many records share
    first = facts.where(F.col("n") >= DEDUPLICATE).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select("digest", "first").checkpoint()
    facts = facts.join(first, "digest", "left").withColumn("revisit", F.coalesce(F.col("first") < F.col("page_id"), F.lit(False)))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.format_string(f"<{URN}%d>", "page_id")),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.format_string(f"<{URN}%d>", "first")))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit(_CRLF),
    )
    facts.select("page_id", "digest", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, digest and packed payload of every record: headers joined with payloads.
    A digest that many records share is a skewed join key, which adaptive execution splits."""
    return spark.read.parquet(f"{path}/headers").join(spark.read.parquet(f"{path}/payloads"), "digest")


def parse_header(header: bytes) -> dict[str, str]:
    """Named fields of a record's header."""
    version, *lines = header.decode().removesuffix(_CRLF * 2).split(_CRLF)
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    return dict(x.split(": ", 1) for x in lines)


def _page(urn: str) -> int:
    return int(urn.strip("<>").removeprefix(URN))


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for header, packed in zip(batch.column("header"), batch.column("packed"), strict=True):
            fields, payload = parse_header(header.as_py()), packer.decompress(packed.as_py())
            digest = hashlib.sha256(payload).hexdigest()
            kind = fields["WARC-Type"]
            if fields["WARC-Payload-Digest"] != f"sha256:{digest}":
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
            if int(fields["Content-Length"]) != (len(payload) if kind == "response" else 0):
                raise ValueError(f"block of {fields['WARC-Record-ID']} does not have its length")
            refers = fields.get("WARC-Refers-To")
            rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload, len(payload), digest, kind, _page(refers) if refers else None))
        if rows:
            types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The original records, restored and verified: page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to. A damaged payload or header fails the read."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return records(spark, path).select("header", "packed").mapInArrow(_restore, schema)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for header, packed in zip(batch.column("header"), batch.column("packed"), strict=True):
            header = header.as_py()
            revisit = parse_header(header)["WARC-Type"] == "revisit"
            out.append((header + (b"" if revisit else packer.decompress(packed.as_py()))).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def export_warc(spark: SparkSession, path: str, to: str, per_file: int = 5000) -> None:
    """Write an archive's records as plain .warc text parts: a record, then CRLF CRLF."""
    rows = records(spark, path).select("header", "packed").mapInArrow(_block, "value string")
    rows.write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", per_file).text(to)


def _parse_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            data, at, rows = content.as_py(), 0, []
            while at < len(data):
                end = data.index(b"\r\n\r\n", at) + 4
                fields = parse_header(data[at:end])
                n = int(fields["Content-Length"])
                refers = fields.get("WARC-Refers-To")
                rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Type"], data[end : end + n], _page(refers) if refers else None))
                at = end + n + 4
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.int64()), strict=True)], ["page_id", "record_type", "block", "refers_to"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of plain .warc parts: page_id, record_type, block, refers_to. Records are cut by
    their Content-Length; a file is read by one task, so files should stay below memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parse_file, "page_id long, record_type string, block binary, refers_to long")


def archive_dir(spark: SparkSession) -> str:
    return shared_dir(spark)
