"""Derived WARC records: linked metadata and plain-text conversions of response records."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gradeframe.llm.html_paths import plain_text

CRLF = "\r\n"
RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, content_length long, block_digest string, payload_digest string, "
    "source_digest string, source_headers string, block string"
)


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(text, F.lit("")), 256))


def record_id(*parts: Column) -> Column:
    """A UUID-shaped name from what a record says, so that a repeated run gives equal records."""
    name = F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(name, a, n) for a, n in cuts)), F.lit(">"))


def responses(
    pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """``key`` and a response record per page: HTTP header block, payload, and their digests.

    A null page has an empty payload and a null address an empty one.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    length = F.octet_length(payload).cast("string")
    header = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        length,
        F.lit(CRLF + CRLF),
    )
    target = F.coalesce(F.col(uri), F.lit(""))
    return pages.select(
        key,
        F.lit("response").alias("record_type"),
        record_id(F.lit("response"), F.col(key), target, payload).alias("record_id"),
        target.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        header.alias("http_header"),
        payload.alias("payload"),
        digest(F.concat(header, payload)).alias("block_digest"),
        digest(payload).alias("payload_digest"),
    )


@F.pandas_udf(StringType())
def _plain(pages: pd.Series) -> pd.Series:
    return pd.Series([plain_text(p) for p in pages], dtype=object)


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """A metadata and a conversion record for every response record; rows of other types are left out.

    Both refer to the response by its id and carry its address, date, HTTP header and payload digest. The
    block of a metadata record lists them as fields; that of a conversion record is the page's visible
    text. Lengths are in bytes of UTF-8. Empty payloads give empty conversions; repeated responses give
    equal records each; an empty table gives an empty table; other columns are not read.
    """
    base = records.where("record_type = 'response'").select(
        key,
        "record_id",
        "target_uri",
        "warc_date",
        "http_header",
        "payload_digest",
        "block_digest",
        F.octet_length("payload").cast("string").alias("_bytes"),
        _plain("payload").alias("_text"),
    )
    fields = F.concat(
        F.lit("responseId: "), F.col("record_id"),
        F.lit(f"{CRLF}targetUri: "), F.col("target_uri"),
        F.lit(f"{CRLF}payloadDigest: "), F.col("payload_digest"),
        F.lit(f"{CRLF}blockDigest: "), F.col("block_digest"),
        F.lit(f"{CRLF}payloadLength: "), F.col("_bytes"),
        F.lit(f"{CRLF}textLength: "), F.octet_length("_text").cast("string"),
        F.lit(f"{CRLF}httpHeader: "), F.regexp_replace(F.trim("http_header"), r"\s*\r\n\s*", " | "),
        F.lit(CRLF),
    )
    derived = base.withColumn(
        "_derived",
        F.explode(
            F.array(
                F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("mime"), fields.alias("block")),
                F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain").alias("mime"), F.col("_text").alias("block")),
            )
        ),
    )
    block, kind = F.col("_derived.block"), F.col("_derived.kind")
    return derived.select(
        key,
        kind.alias("record_type"),
        record_id(kind, F.col("record_id"), block).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("_derived.mime").alias("content_type"),
        F.octet_length(block).cast("long").alias("content_length"),
        digest(block).alias("block_digest"),
        F.col("payload_digest").alias("source_digest"),
        F.col("http_header").alias("source_headers"),
        block.alias("block"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """``record``: derived records as text in WARC format 1.1, without the two line ends that close them."""
    def line(name: str, value) -> Column:
        return F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")), F.lit(CRLF))

    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("source_digest")),
        line("WARC-Source-HTTP-Header", F.regexp_replace(F.trim("source_headers"), r"\s*\r\n\s*", " | ")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
        F.lit(CRLF),
    )
    return records.select(F.concat(head, F.coalesce("block", F.lit(""))).alias("record"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One file per partition, records one after the other."""
    text = serialised(records).write.option("lineSep", CRLF + CRLF).option("compression", compression)
    text.text(path)


def parse_records(data: str) -> Iterator[dict]:
    """Headers and block of each record of a file's text; lengths are bytes of UTF-8."""
    raw, at = data.encode("utf-8", "surrogatepass"), 0
    while (start := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", start)
        if end < 0:
            return
        lines = raw[start:end].decode("utf-8").split(CRLF)[1:]
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        size = int(headers.get("Content-Length") or 0)
        yield {"headers": headers, "block": raw[end + 4 : end + 4 + size].decode("utf-8", "replace")}
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``headers map, block`` of all records below ``path``; a task reads whole files."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                found = list(parse_records(text))
                if found:
                    yield pd.DataFrame(found)

    files = spark.read.text(path, wholetext=True)
    return files.mapInPandas(parse, "headers map<string,string>, block string")
