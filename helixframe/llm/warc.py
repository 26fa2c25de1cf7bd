"""A content-addressed WARC archive: payload bytes stored once by digest, exact record headers apart.

An archive is a folder with two tables.  `payloads` holds each distinct payload once under its
SHA-256, with its SHA-1, its length and how many records have it.  `headers` holds one row a
record: the exact bytes of its WARC header and the payload's SHA-256.  A record's original bytes
are its header, its payload if it is a response, and CR LF CR LF.

Payloads of at least `min_revisit` bytes that several records share are written as one response,
of the record with the largest id, and revisits to it; all shorter payloads are responses.

Edge cases: null html is an empty payload; a null url leaves the target line out; a null page_id
is written as such and sorts below every other; if several rows share the largest page_id each is
a response; CR and LF in a url are percent-encoded, since a header line cannot hold them; an empty
table makes an empty archive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, join_by_key

MIN_REVISIT = 1000
#: Written into every record; the pages carry no date of their own.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one exported .warc file, which is read back whole by one task.
RECORDS_PER_FILE = 2000

_CRLF = "\r\n"
_URN = "<urn:x-page:"


def _header(kind: Column, page_id: Column, url: Column, refers: Column, sha1: Column, sha256: Column, size: Column) -> Column:
    """The header block of a record, its closing empty line included."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    ident = lambda x: F.concat(F.lit(_URN), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">"))
    uri = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + _CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", ident(page_id)),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(revisit, F.sha2(F.lit(b""), 256)).otherwise(sha256))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", ident(refers)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
        F.lit(_CRLF),
    )


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit: int = MIN_REVISIT,
) -> str:
    """Write both tables of an archive under the path.

    Payload bytes move once, into the aggregation that keeps one of each digest; a digest that many
    rows share is folded before that shuffle.  The record rows move without payloads.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("long").alias("n_bytes"),
    )
    (
        rows.groupBy("sha256")
        .agg(
            F.max("page_id").alias("keeper"), F.count("*").alias("n_records"), F.min("n_bytes").alias("n_bytes"),
            F.max("n_bytes").alias("most_bytes"), F.min("sha1").alias("sha1"), F.max("sha1").alias("last_sha1"),
            F.first("payload").alias("payload"),
        )
        .write.parquet(f"{path}/payloads")
    )
    stored = spark.read.parquet(f"{path}/payloads")
    if bad := stored.filter("n_bytes <> most_bytes or sha1 <> last_sha1").select("sha256").limit(1).collect():
        raise ValueError(f"different payloads share SHA-256 {bad[0][0]}")
    keepers = stored.select("sha256", "keeper", "n_records")
    keyed = join_by_key(rows.drop("payload"), keepers, "sha256", "n_records", "inner")
    revisit = (F.col("n_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    kind = F.when(revisit, "revisit").otherwise("response")
    header = _header(kind, F.col("page_id"), F.col("url"), F.col("keeper"), F.col("sha1"), F.col("sha256"), F.col("n_bytes"))
    keyed.select("sha256", header.cast("binary").alias("header")).write.parquet(f"{path}/headers")
    return path


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, read back from the archive: what its header says, and what its verified payload is.

    Every stored payload is hashed anew; a row whose bytes do not give its key is an error.
    """
    checked = spark.read.parquet(f"{path}/payloads").select(
        F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256"))
        .otherwise(F.raise_error(F.concat(F.lit("stored payload differs from its digest "), F.col("sha256"))))
        .alias("sha256"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "n_records",
    )
    ident = lambda name: F.regexp_extract(_field(name), rf"^{_URN}(-?\d+)>$", 1)
    number = lambda x: F.when(x != "", x.cast("long"))
    headers = spark.read.parquet(f"{path}/headers").select(
        "sha256", number(ident("WARC-Record-ID")).alias("page_id"), F.nullif(_field("WARC-Target-URI"), F.lit("")).alias("url"),
        _field("WARC-Type").alias("record_type"), number(ident("WARC-Refers-To")).alias("refers_to"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("header_digest"),
    )
    return join_by_key(headers, checked, "sha256", "n_records", "inner").select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "sha256", "header_digest"
    )


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload and the exact record bytes of each record, rebuilt by joining headers with payloads."""
    stored = spark.read.parquet(f"{path}/payloads").select("sha256", "payload", "n_records")
    headers = spark.read.parquet(f"{path}/headers")
    joined = join_by_key(headers, stored, "sha256", "n_records", "inner")
    ident = F.regexp_extract(_field("WARC-Record-ID"), rf"^{_URN}(-?\d+)>$", 1)
    body = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("header"), body, F.lit(b"\r\n\r\n"))
    return joined.select(F.when(ident != "", ident.cast("long")).alias("page_id"), "payload", record.alias("record"))


def export_warc(spark: SparkSession, path: str, to: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Plain .warc files of the archive's records; the text writer's line end is the records' own."""
    records = original_records(spark, path).select(F.expr("decode(substring(record, 1, octet_length(record) - 4), 'UTF-8')"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(to)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a .warc file's bytes, by the stated lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end]
        if not header.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        length = next(int(x.split(b":", 1)[1]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if data[end + length : end + length + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield header, data[end : end + length]
        at = end + length + 4


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """header and block of each record of the .warc files in a folder."""
    schema = T.StructType([T.StructField("header", T.BinaryType()), T.StructField("block", T.BinaryType())])

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                found = list(parse_warc(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())],
                    names=schema.names,
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write the pages' archive into the shared folder and read its records back."""
    spark = pages.sparkSession
    path = write_archive(pages, fresh_path(spark, "warc"))
    return read_records(spark, path)
