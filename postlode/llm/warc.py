"""WARC archives: write captures, read records back, assemble transactions.

A capture is a response (or a revisit of an equal payload), the request that asked for it and a metadata record; the last
two name the response in WARC-Concurrent-To.  Archives are written by Spark's text writer with the record separator of
the format, so any file system that Spark reaches will do, and read as binary files, record by record.  ``assemble`` joins
the records of a capture through those identifiers and returns one nested row for each.

Defined cases: a missing page is an empty one; a page repeated in full is written once, with its number of copies in
the metadata, and reported once per copy; of equal payloads the one with the largest page_id (a missing id is smaller
than any, ties are broken by a hash of the row) is the response.  On reading, a record repeated under one id counts once; one
without an id stands for itself; a damaged record is skipped up to the next version line and reported with ``broken`` set.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from postlode.session import cut, shared_dir

SEPARATOR = "\r\n\r\n"
RECORDS_PER_FILE = 2_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2026-01-01T00:00:00Z"
RECORD = (
    "record_id string, type string, uri string, date string, concurrent_to array<string>, refers_to string, payload_digest string, "
    "http array<struct<name:string,value:string>>, status int, content binary, n_content bigint, actual_digest string, broken boolean"
)
RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: forty hex digits are eight times twenty bits, or four base32 digits each."""
    return base32_hex(F.sha1(data))


def base32_hex(digits: Column) -> Column:
    """Upper-case base32 of forty hex digits."""
    out = []
    for i in range(8):
        bits = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.pmod(F.shiftright(bits, s), F.lit(32)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record_uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(" ", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def record(kind: str, fields: dict[str, Column], content: Column) -> Column:
    """The text of one record, without the separator that ends it."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}")]
    for name, value in (fields | {"Content-Length": F.octet_length(content).cast("string")}).items():
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise(F.lit("")))
    return F.concat(*lines, F.lit(SEPARATOR), content)


def header_safe(value: Column) -> Column:
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]+", " ")


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records of all captures as a column ``value``: response or revisit, request, metadata.

    Who is the response is decided on narrow rows; the markup is shuffled once.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), header_safe(F.coalesce("url", F.lit(""))).alias("uri"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select(F.xxhash64("page_id", F.isnull("page_id"), "uri", "html").alias("k1"), F.xxhash64("html", F.lit(1), "uri", "page_id").alias("k2"), "*")
    narrow = rows.groupBy("k1", "k2", "page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("bytes")).agg(F.count("*").alias("copies"))
    narrow = cut(narrow, "warc-payloads")
    lead = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), "k1", "k2")
    # Only payloads that occur again have a row here.  It is stored, so that a payload with a third of all rows is a
    # plain skewed join, which Spark splits.
    leads = narrow.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.max(lead).alias("lead"), F.count("*").alias("n")).where("n > 1")
    leads = cut(leads.select("sha", "bytes", F.col("lead.k1").alias("l1"), F.col("lead.k2").alias("l2")), "warc-leads")
    roles = narrow.join(leads, ["sha", "bytes"], "left").select("k1", "k2", "copies", "sha", F.when((F.col("l1") != F.col("k1")) | (F.col("l2") != F.col("k2")), F.struct("l1", "l2")).alias("of"))
    once = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
    full = rows.withColumn("_row", once).where("_row = 1").drop("_row").join(roles, ["k1", "k2"])

    def rid(kind: str, a: str = "k1", b: str = "k2") -> Column:
        return record_uuid(F.lit(kind), F.col(a).cast("string"), F.col(b).cast("string"))

    own = rid("capture")
    shared = {"WARC-Target-URI": F.col("uri"), "WARC-Date": F.lit(DATE)}
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(SEPARATOR))
    digest = F.concat(F.lit("sha1:"), base32_hex(F.col("sha")))
    capture = {"WARC-Record-ID": own, **shared, "WARC-Payload-Digest": digest}
    response = record("response", capture | {"Content-Type": F.lit("application/http; msgtype=response")}, F.concat(head, "html"))
    profile = {"WARC-Profile": F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), "WARC-Refers-To": rid("capture", "of.l1", "of.l2")}
    revisit = record("revisit", capture | profile | {"Content-Type": F.lit("application/http; msgtype=response")}, head)
    request = record("request", {"WARC-Record-ID": rid("request"), **shared, "WARC-Concurrent-To": own, "Content-Type": F.lit("application/http; msgtype=request")},
                     F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_replace("uri", r"^[a-zA-Z]+://[^/]*", ""), F.lit("")), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = record("metadata", {"WARC-Record-ID": rid("metadata"), **shared, "WARC-Concurrent-To": own, "Content-Type": F.lit("application/warc-fields")},
                      F.concat(F.when(F.col("page_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n"))), F.lit("copies: "), F.col("copies").cast("string"), F.lit("\r\n")))
    return full.select(F.explode_outer(F.array(F.when(F.col("of").isNull(), response).otherwise(revisit), request, metadata)).alias("value"))


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write records as gzipped archives; none holds more than ``records_per_file`` records.

    The fastest level of compression: the usual one takes more time than all other work on the records.
    """
    records.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


_LENGTH = re.compile(rb"\r?\ncontent-length:[ \t]*([0-9]+)", re.IGNORECASE)


def _fields(block: bytes) -> tuple[str, dict[str, list[str]]]:
    """First line and fields of a header block; a line that starts with white space continues the one before."""
    lines = re.sub(r"\r?\n[ \t]+", " ", block.decode("utf-8", "replace")).replace("\r\n", "\n").split("\n")
    fields: dict[str, list[str]] = {}
    for name, colon, value in (x.partition(":") for x in lines[1:]):
        if colon:
            fields.setdefault(name.strip().lower(), []).append(value.strip())
    return lines[0], fields


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        end = data.find(b"\r\n\r\n", at)
        length = _LENGTH.search(data, at, end) if end >= 0 else None
        if length is None or end + 4 + int(length[1]) > len(data):
            yield {"broken": True}
            follow = data.find(b"\r\nWARC/", at + 1)
            at = follow + 2 if follow >= 0 else -1
            continue
        _, fields = _fields(data[at:end])
        content = data[end + 4:end + 4 + int(length[1])]
        one = {k: v[0] for k, v in fields.items()}
        status, http = None, None
        if "application/http" in one.get("content-type", ""):
            head, _, body = content.partition(b"\r\n\r\n")
            line, found = _fields(head)
            http = [(k, v[0]) for k, v in found.items()]
            code = line.split()[1:2]
            status, content = (int(code[0]) if code and code[0].isdigit() else None), body
        yield {
            "record_id": one.get("warc-record-id"), "type": one.get("warc-type"), "uri": one.get("warc-target-uri"), "date": one.get("warc-date"),
            "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": one.get("warc-refers-to"), "payload_digest": one.get("warc-payload-digest"),
            "http": http, "status": status, "content": content, "n_content": len(content), "actual_digest": b32encode(hashlib.sha1(content).digest()).decode(), "broken": False,
        }
        at = data.find(b"WARC/", end + 4 + int(length[1]))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under ``path``.  A task holds one archive at a time, and a batch of its records.

    Without ``payloads`` the content of responses is read and digested but not returned.
    """
    names = RECORD_NAMES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows, held = [], 0
                for r in parse_archive(bytes(data)):
                    if not payloads and r.get("type") == "response":
                        r["content"] = None
                    rows.append([r.get(n) for n in names])
                    held += r.get("n_content") or 0
                    if len(rows) >= 1000 or held > 8_000_000:
                        yield pd.DataFrame(rows, columns=names).astype(object)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype(object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response (or revisit), requests and metadata, joined by concurrent-to identifiers.

    A request or metadata record may name the response, or a record that names it.  What names no response that is there
    makes a capture without one, under the identifier that it names, or its own.
    """
    records = cut(records, "warc-records")  # three steps read them
    nested = F.struct(*[c for c in records.columns if c not in ("broken", "concurrent_to")])
    good = records.where(~F.col("broken") & F.col("type").isin("response", "revisit", "request", "metadata"))
    good = good.withColumn("record_id", F.coalesce("record_id", F.concat(F.lit("none:"), F.xxhash64("type", "uri", "date", "actual_digest").cast("string"))))
    roots = good.where(F.col("type").isin("response", "revisit")).groupBy(F.col("record_id").alias("capture_id")).agg(F.min_by(nested, F.struct("type", "date", "actual_digest")).alias("response"))
    others = good.where(F.col("type").isin("request", "metadata")).withColumn("names", F.coalesce(F.element_at("concurrent_to", 1), F.col("record_id")))
    hop = others.select(F.col("record_id").alias("names"), F.col("names").alias("beyond")).where("names != beyond").distinct()
    hop = hop.groupBy("names").agg(F.min("beyond").alias("beyond"))
    sides = others.join(hop, "names", "left").withColumn("capture_id", F.coalesce("beyond", "names"))
    sides = sides.groupBy("capture_id", "record_id", "type").agg(F.min_by(nested, F.struct("date", "actual_digest")).alias("record"))
    sides = sides.groupBy("capture_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", F.struct("record_id", "record")))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", F.struct("record_id", "record")))).alias("metadata"))
    return roots.join(sides, "capture_id", "full").select("capture_id", "response", F.col("requests.record").alias("requests"), F.col("metadata.record").alias("metadata"))


def archive_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, read them back, assemble the captures and report one row per page."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages, min_bytes), path)
    captures = assemble(read_warc(spark, path, payloads=False))
    notes = F.decode(F.get("metadata", F.lit(0))["content"], "UTF-8")
    response = F.col("response")
    rows = captures.where("response is not null").select(
        "capture_id", F.regexp_extract(notes, r"page-id: (-?[0-9]+)", 1).try_cast("long").alias("page_id"), F.regexp_extract(notes, r"copies: ([0-9]+)", 1).cast("int").alias("copies"),
        F.when(response["type"] == "revisit", F.map_from_entries(response["http"])["content-length"].cast("long")).otherwise(response["n_content"]).alias("payload_bytes"),
        F.when(response["type"] == "revisit", F.regexp_replace(response["payload_digest"], "^sha1:", "")).otherwise(response["actual_digest"]).alias("payload_digest"),
        response["type"].alias("record_type"), response["refers_to"].alias("refers_id"), response["uri"].alias("uri"),
        (F.concat(F.lit("sha1:"), response["actual_digest"]) == response["payload_digest"]).alias("digest_ok"), F.size("requests").alias("n_requests"),
    )
    rows = cut(rows, "warc-captures")
    targets = rows.select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to")).join(rows.select("refers_id").where("refers_id is not null").distinct(), "refers_id", "left_semi")
    out = rows.join(cut(targets, "warc-targets"), "refers_id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "n_requests")
