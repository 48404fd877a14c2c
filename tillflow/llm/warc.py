"""A content-addressed web archive: payloads once, record headers apart, records by joins.

``write`` stores two tables.  ``payloads`` has each distinct payload once under its
SHA-256.  ``headers`` has one row per record with the exact bytes of its WARC header
and of its HTTP header, and the SHA-256 of its payload.  ``records`` joins the two into
whole records and checks the digest of every stored payload again.  ``export`` writes
records as WARC files, ``read_files`` reads such files, and ``read_back`` says what is in
them: lengths and digests of the bytes that were read, and for a revisit those of the
record it refers to, found by a join.

Of records with equal payloads the one with the smallest identifier is the response;
the others revisit it and carry no payload in their WARC record.  Equality is that of
the SHA-256; where a group's lengths or SHA-1 differ, ``write`` stops with an error
instead of storing one payload for two.

A payload that a third of all records share is one row per task before the exchange,
and its records are joined to it by written tables on both sides, which Spark can
split.

Defined results.  A null payload is empty.  Payloads below ``min_bytes`` are always
responses.  Null identifiers come after all others; equal ones are told apart by
their place in the files, which is part of the record's own identifier.  Control and non-ASCII characters of an address are
percent-encoded in the header, all others stay; a null address leaves its line out.  An empty table
gives an empty archive.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.llm.tables import FILE, ROW, land, located

# Fixed values of the format.
EOL, END = "\r\n", "\r\n\r\n"
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in base 32: 40 hexadecimal digits, five at a time, are 32 letters."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), BASE32_HEX, BASE32)


def line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def address(url: Column) -> Column:
    """An address fit for a header line: what is not printable ASCII is percent-encoded."""
    runs = F.regexp_extract_all(url, F.lit(r"[\x21-\x7E]+|[^\x21-\x7E]+"), F.lit(0))
    encoded = lambda run: F.regexp_replace(F.url_encode(run), r"\+", "%20")
    return F.array_join(F.transform(runs, lambda run: F.when(run.rlike(r"^[\x21-\x7E]"), run).otherwise(encoded(run))), "")


def digests(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Identifier, address, digests and length of each located row."""
    payload = payload_of(payload_col)
    return pages.select(
        F.col(id_col).alias("record"), F.col(url_col).cast("string").alias("url"), F.sha2(payload, 256).alias("sha256"),
        sha1_base32(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes"), FILE, ROW)


def payload_of(column: str) -> Column:
    """The payload's bytes: UTF-8 for strings."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
) -> None:
    """Store all rows as records below ``folder``."""
    rows = located(pages)
    seen = land(digests(rows, id_col, url_col, payload_col), "digests")
    # Rows of one payload, told apart where they are too short to share.
    share = F.when(F.col("n_bytes") >= min_bytes, F.lit("")).otherwise(F.concat_ws("#", FILE, ROW))
    keyed = seen.withColumn("share", share)
    first = F.min(F.struct(F.col("record").isNull(), "record", FILE, ROW))
    groups = land(keyed.groupBy("sha256", "share").agg(
        first.alias("first"), F.min("n_bytes").alias("low"), F.max("n_bytes").alias("high"), F.min("sha1").alias("s1"), F.max("sha1").alias("s2")), "groups")
    if not groups.filter("low <> high or s1 <> s2").isEmpty():
        raise ValueError("payloads with equal SHA-256 differ in length or SHA-1")

    plan = land(keyed.join(groups.select("sha256", "share", "first"), ["sha256", "share"]).withColumn(
        "response", (F.col(FILE) == F.col(f"first.{FILE}")) & (F.col(ROW) == F.col(f"first.{ROW}"))), "records")
    # A digest is stored by one of its responses.
    owner = plan.filter("response").groupBy("sha256").agg(F.min(F.struct(FILE, ROW)).alias("o")).select(F.col(f"o.{FILE}").alias(FILE), F.col(f"o.{ROW}").alias(ROW))
    others = land(plan.select(FILE, ROW).join(owner, [FILE, ROW], "left_anti"), "copies")
    rows.join(others, [FILE, ROW], "left_anti").select(
        F.sha2(payload_of(payload_col), 256).alias("sha256"), payload_of(payload_col).alias("payload")
    ).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    kind = F.when(F.col("response"), "response").otherwise("revisit")
    body = F.when(F.col("response"), F.col("n_bytes")).otherwise(0)

    def record_id(of: str) -> Column:
        place = F.lower(F.hex(F.xxhash64(f"{of}{FILE}", f"{of}{ROW}")))
        return F.concat(F.lit("<urn:record:"), F.coalesce(F.col(f"{of}record").cast("string"), F.lit("")), F.lit("/"), place, F.lit(">"))

    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"), line("WARC-Type", kind), line("WARC-Record-ID", record_id("")), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", address(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        line("WARC-Refers-To", F.when(~F.col("response"), record_id("first."))),
        line("WARC-Profile", F.when(~F.col("response"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + body).cast("string")), F.lit(EOL))
    plan.select("record", kind.alias("kind"), "sha256", head.alias("warc_header"), http.alias("http_header")).write.option(
        "compression", "zstd").parquet(f"{folder}/headers")


def records(spark: SparkSession, folder: str, revisited: bool = True) -> DataFrame:
    """``record, kind, warc_header, http_header, payload`` of each record.

    The payload of a revisit is the one it refers to; without ``revisited`` it is null, as in the files.
    """
    headers, payloads = (spark.read.parquet(f"{folder}/{name}") for name in ("headers", "payloads"))
    bare = headers.filter("kind <> 'response'").drop("sha256").withColumn("payload", F.lit(None).cast("binary"))
    if not revisited:
        headers = headers.filter("kind = 'response'")
    whole = headers.join(payloads, "sha256").select("record", "kind", "warc_header", "http_header", "payload", "sha256")
    sound = F.sha2("payload", 256) == F.col("sha256")
    whole = whole.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not fit its digest")))).drop("sha256")
    return whole if revisited else whole.unionByName(bare)


def record_text(rows: DataFrame) -> Column:
    """The bytes of a WARC record without its closing blank lines."""
    return F.concat(
        F.col("warc_header").cast("binary"), F.col("http_header").cast("binary"), F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit(b"")))


def field(header: Column, name: str) -> Column:
    """The value of a header line, or null."""
    return F.nullif(F.regexp_extract(header, rf"(?i)(?:^|\n){name}: *([^\r\n]*)", 1), F.lit(""))


def read_back(files: DataFrame, id_type: str = "long") -> DataFrame:
    """What records read from files say: ``record, kind, payload_bytes, payload_digest, refers_to, url``.

    Length and digest are those of the bytes read; a revisit has those of the record it refers
    to.  Stops if a header says something else, or if that record is missing.
    """
    warc, http = F.col("warc_header"), F.col("http_header")
    said = land(files.select(
        field(warc, "WARC-Record-ID").alias("own"), field(warc, "WARC-Type").alias("kind"), field(warc, "WARC-Refers-To").alias("other"),
        field(warc, "WARC-Target-URI").alias("url"), field(http, "Content-Length").cast("long").alias("said_bytes"),
        F.substring_index(field(warc, "WARC-Payload-Digest"), ":", -1).alias("said_digest"),
        F.octet_length("body").cast("long").alias("n_bytes"), sha1_base32(F.col("body")).alias("digest"),
        (field(warc, "Content-Length").cast("long") == F.octet_length(http) + F.octet_length("body")).alias("fits")), "read-back")
    found = said.filter("kind = 'response'").select(F.col("own").alias("other"), F.col("n_bytes").alias("there_bytes"), F.col("digest").alias("there_digest"))
    whole = said.filter("kind = 'response'").withColumns({"there_bytes": F.col("n_bytes"), "there_digest": F.col("digest")}).unionByName(
        said.filter("kind <> 'response'").join(found, "other", "left"))
    sound = F.coalesce(F.col("fits") & (F.col("there_bytes") == F.col("said_bytes")) & (F.col("there_digest") == F.col("said_digest")), F.lit(False))
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:record:(.*)/[0-9a-f]+>$", 1), F.lit("")).cast(id_type)
    return whole.select(
        number("own").alias("record"), F.when(sound, F.col("kind")).otherwise(F.raise_error(F.lit("a record does not fit its header"))).alias("kind"),
        F.col("there_bytes").alias("payload_bytes"), F.col("there_digest").alias("payload_digest"), number("other").alias("refers_to"), "url")


def export(rows: DataFrame, path: str, per_file: int = 4_000) -> None:
    """Records as WARC files, ``per_file`` records at most in each.

    The text writer copies bytes as they are, and its line separator is what ends a
    record.
    """
    rows.select(record_text(rows).cast("string").alias("value")).write.options(
        lineSep=END, compression="gzip", maxRecordsPerFile=str(per_file)).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``warc_header, http_header, body`` of each record in the WARC files of a folder.

    One file at a time is in memory; ``export`` bounds their size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for content, name in zip(batch.column("content"), batch.column("path").to_pylist(), strict=True):
                data = content.as_py()
                data = gzip.decompress(data) if name.endswith(".gz") else data
                out: list[tuple[str, str, bytes]] = []
                at = 0
                while at < len(data):
                    split = data.index(b"\r\n\r\n", at) + 4
                    header = data[at:split].decode()
                    size = next(int(x.split(":")[1]) for x in header.split(EOL) if x.lower().startswith("content-length:"))
                    block = data[split:split + size]
                    http = block.index(b"\r\n\r\n") + 4
                    out.append((header, block[:http].decode(), block[http:]))
                    at = split + size + 4
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["warc_header", "http_header", "body"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["warc_header", "http_header", "body"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "warc_header string, http_header string, body binary")
