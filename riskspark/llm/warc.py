"""WARC archives: writing captures as transactions, reading archives, assembling transactions.

Writing is DataFrame-only: each capture gives a response (or revisit), a request and a metadata
record that name the response in WARC-Concurrent-To. A record is one string whose lines end in CRLF;
the text sink puts the CRLF CRLF that ends a record behind it and compresses each file, so task
commits make the archive complete or absent. Reading takes whole archive files of bounded size,
decompresses them as a stream and frames records by Content-Length, so payloads may hold anything.
Assembly joins request, response and metadata records through the concurrent-to identifiers.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.common import chunked, stage, with_python

CRLF = "\r\n"
MIN_REVISIT_BYTES = 100
FILE_BYTES = 32 << 20
SALTS = 32
DATE = "2026-01-01T00:00:00Z"

RECORD = ("record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, "
          "payload_bytes long, payload_sha256 string, fields map<string,string>, payload binary")


def _uuid(kind: str, *columns):
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]))
    parts = [h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list, block, size):
    """One record as text. headers: (name, column); a NULL value leaves its line out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))) for k, v in headers]
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF), block)


def plan_roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(digest, refers_id, refers_url) of every payload of at least ``min_bytes`` bytes that several rows hold: its smallest
    page_id and that page's smallest url. No payload is shuffled."""
    html = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", "url", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    first = narrow.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
    return first.where("n > 1").select("digest", F.col("first.page_id").alias("refers_id"), F.col("first.url").alias("refers_url"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write one transaction (three records) per row of ``pages`` (page_id, url, html) under ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id (then url) is a
    response, the others are revisits without the payload; of rows equal in everything the first is
    that one, each has a record of its own. NULL html: an empty payload. NULL url: no target. Line breaks in a url are percent-encoded. A NULL page_id is never a revisit.
    """
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(1, math.ceil(total / file_bytes))
    clean = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    wide = pages.select(F.col("page_id").cast("long").alias("page_id"), clean.alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    # a payload that many rows share is dealt by page too, so its rows stand on many tasks
    roles = plan_roles(wide, min_bytes)
    keyed = wide.withColumn("digest", F.sha2("html", 256)).withColumn("u", F.coalesce(F.concat(F.lit("="), "url"), F.lit("")))
    same = ["page_id", "digest", "u"]
    own = keyed.repartition(files, *same).withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("u")))
    # found without payloads, so the wide rows stay on the partitioning that they have
    shared = keyed.select(*same).distinct().join(roles, "digest").repartition(files, *same)
    both = own.join(shared, same, "left")
    later = (F.col("page_id") > F.col("refers_id")) | ~(F.col("url").eqNullSafe(F.col("refers_url")) & (F.col("nth") == 1))
    both = both.withColumn("role", F.when(F.col("refers_id").isNotNull() & F.col("page_id").isNotNull() & later, "revisit").otherwise("response"))
    size = F.octet_length("html")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF))
    own_id = lambda kind: _uuid(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth"))
    response_id, digest = own_id("response"), F.concat(F.lit("sha256:"), F.col("digest"))
    revisit = F.col("role") == "revisit"
    first_id = _uuid("response", F.col("refers_id"), F.col("refers_url"), F.col("digest"), F.lit(1))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))]
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    response = _record([("WARC-Type", F.col("role")), ("WARC-Record-ID", response_id), *common, ("WARC-Payload-Digest", digest),
                        ("WARC-Refers-To", F.when(revisit, first_id)), ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
                        ("Content-Type", F.lit("application/http;msgtype=response"))], body, F.octet_length(http) + F.when(revisit, 0).otherwise(size))
    ask = F.concat(F.lit("GET "), F.coalesce(F.col("url"), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", own_id("request")), *common,
                       ("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/http;msgtype=request"))], ask, F.octet_length(ask))
    notes = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(""))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", own_id("metadata")), *common,
                        ("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/warc-fields"))], notes, F.octet_length(notes))
    (both.select(F.explode(F.array(request, response, metadata)).alias("value"))
     .write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path))


def parse_archive(stream, with_payload: bool = True):
    """Records of an (uncompressed) archive stream as tuples in the order of RECORD."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            head.setdefault(name.decode("utf-8", "replace").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
        size = int(head["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        one = lambda k: head.get(k, [None])[0]
        kind, digest = one("warc-type"), one("warc-payload-digest")
        fields: dict[str, str] = {}
        payload, declared, sha = block, len(block), None
        if (one("content-type") or "").startswith(("application/http", "application/warc-fields")):
            http = (one("content-type") or "").startswith("application/http")
            top, _, payload = block.partition(b"\r\n\r\n") if http else (block, b"", b"")
            for x in top.split(b"\r\n")[1 if http else 0:]:
                name, colon, value = x.partition(b":")
                if colon:
                    fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
            declared = len(payload)
        if kind == "revisit":  # the payload is the referred-to record's
            declared, sha = int(fields.get("content-length", 0)), (digest or "").partition(":")[2] or None
        elif kind == "response":
            sha = hashlib.sha256(payload).hexdigest()
            if digest and digest.startswith("sha256:") and digest[7:] != sha:
                raise ValueError(f"payload of {one('warc-record-id')} does not match its digest")
        yield (one("warc-record-id"), kind, head.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), digest,
               declared, sha, list(fields.items()), payload if with_payload else None)


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record under ``path`` (.gz or plain; members per record or per file), see RECORD."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()),
                        ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
                        ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                raw = io.BytesIO(b.column(0)[i].as_py())
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                yield from parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if zipped else raw, with_payload)

    files = spark.read.format("binaryFile").load(path).select("content")
    return with_python(files).mapInArrow(lambda bs: chunked(rows(bs), schema, weigh=lambda r: 200 + len(r[10] or b"")), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture (response or revisit): record_id, type, target_uri, date, refers_to, payload_digest,
    payload_bytes, payload_sha256, request and metadata (arrays of record structs), payload.

    Request and metadata records belong to a capture if either names the other in concurrent-to, or if
    a metadata record names the capture's request. Records that repeat a record id count once. A
    record without an id, or that reaches no capture, is left out; a capture without partners has empty arrays.
    """
    records = records.where("record_id IS NOT NULL")
    side = records.where("type IN ('request', 'metadata')").select("record_id", F.struct("type", "record_id", "fields").alias("r"), "concurrent_to").dropDuplicates(["record_id"])
    named = records.select("record_id", "type", F.explode("concurrent_to").alias("other")).distinct()
    pairs = named.select(F.col("record_id").alias("a"), F.col("other").alias("b")).union(named.select(F.col("other").alias("a"), F.col("record_id").alias("b"))).distinct()
    heads = records.where("type IN ('response', 'revisit')").select("record_id").distinct()
    direct = pairs.join(heads, pairs.b == heads.record_id).select("a", F.col("b").alias("capture"))
    through = pairs.join(direct.withColumnRenamed("a", "via"), F.col("b") == F.col("via")).select("a", "capture")
    members = direct.union(through).distinct().join(side, F.col("a") == F.col("record_id")).groupBy("capture").agg(F.collect_list("r").alias("rs"))
    own = records.where("type IN ('response', 'revisit')").drop("concurrent_to", "fields").dropDuplicates(["record_id"])
    of = lambda kind: F.filter(F.coalesce("rs", F.array().cast(members.schema["rs"].dataType)), lambda r: r["type"] == kind).alias(kind)
    return own.join(members, own.record_id == members.capture, "left").select(*[own[c] for c in own.columns if c != "payload"], of("request"), of("metadata"), own["payload"])


def captures(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` to ``path``, read the archives back and return per page: page_id, payload_bytes,
    payload_digest, record_type, refers_to (page_id of the response), target_uri.

    As many rows as ``pages`` has: rows equal in page_id, url and html are captures of their own. A revisit's length
    and digest are those of the response that it refers to, as read back. An empty table gives no rows.
    """
    spark = pages.sparkSession
    write_archive(pages, path, min_bytes)
    got = assemble(stage(read_archive(spark, path, with_payload=False), "records")).select(
        "record_id", F.get("metadata", F.lit(0))["fields"]["page-id"].cast("long").alias("page_id"), "payload_bytes", F.col("payload_sha256").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").alias("refers_record"), "target_uri")
    # many captures may refer to one response: its row is copied for each salt
    asked = got.where("refers_record IS NOT NULL").select("refers_record").distinct()
    named = (got.where("record_type = 'response'").select(F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")).join(asked, "refers_record")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = got.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    again = F.col("record_type") == "revisit"
    return salted.join(named, ["refers_record", "salt"], "left").select(
        "page_id", F.when(again, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to", "target_uri")
