"""WARC archives: pages to request, response and metadata records, and records back to captures.

``write`` makes three records of each page in one task; Spark's text writer puts the record separator between them, so the
files are WARC 1.1 on any file system that Spark writes to, compressed with gzip and closed after ``FILE_RECORDS`` records.
Of pages with equal payloads the one with the largest id is a response, the others are revisit records that refer to it.
The largest id per digest is pre-aggregated; pages find it by a join on the digest, which Spark broadcasts where the
duplicated digests are few bytes and splits where one digest is very frequent.

``records`` reads archives, its own or others, by Content-Length, file by file. ``captures`` assembles transactions:
requests and metadata are joined to the response or revisit that they name as concurrent, or that names them, and each
capture is one nested row. ``followed`` adds to each revisit the capture whose record it refers to.

NULL payloads are empty. Pages without an id come before all ids. Rows that repeat an id and a payload have the same
record identifiers and each give a capture of the same type. Several requests or metadata records of one capture: the one
with the smallest identifier is shown, with their number. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"
FILE_RECORDS = 12_288
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive that are expanded at a time.
CHUNK = 1 << 20

RECORD = (
    "record_id string, record_type string, concurrent_to array<string>, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, fields map<string,string>"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: four times 40 bits are eight digits each."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str, page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(kind), F.coalesce(page.cast("string"), F.lit("")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """The text of a record; headers that are NULL are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    size = F.octet_length(block).cast("string")
    lines = [("WARC-Type", kind), ("WARC-Date", F.lit(DATE)), *headers, ("Content-Type", F.lit(content_type)), ("Content-Length", size)]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{n}: "), v) for n, v in lines]), F.lit(END), block)


def typed(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(``page_id``, ``uri``, ``payload``, ``bytes``, ``digest``, ``winner``): winner is set on revisits."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), F.lit("urn:page")), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select("page_id", uri.alias("uri"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest"),
    )
    found = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    repeated = found.filter("n > 1").select(F.col("digest").alias("same"), "last")
    winner = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
    return rows.join(repeated, F.col("digest") == F.col("same"), "left").withColumn("winner", winner).drop("same", "last")


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one request, one response or revisit, and one metadata record per page."""
    rows = typed(pages, min_bytes)
    page, digest, winner, uri = (F.col(c) for c in ("page_id", "digest", "winner", "uri"))
    own = _record_id("capture", page, digest)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    host = F.regexp_extract(uri, r"^[a-z]+://([^/?#]*)", 1)
    request = _record(
        "request", [("WARC-Record-ID", _record_id("request", page, digest)), ("WARC-Concurrent-To", own), ("WARC-Target-URI", uri)],
        "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
    )
    revisit = winner.isNotNull()
    answer = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [("WARC-Record-ID", own), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
         ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)), ("WARC-Refers-To", F.when(revisit, _record_id("capture", winner, digest)))],
        "application/http; msgtype=response", F.when(revisit, head).otherwise(F.concat(head, F.col("payload"))),
    )
    fields = [("pageId", page)]
    metadata = _record(
        "metadata", [("WARC-Record-ID", _record_id("metadata", page, digest)), ("WARC-Concurrent-To", own), ("WARC-Target-URI", uri)],
        "application/warc-fields", F.concat(F.concat_ws("\r\n", *[F.concat(F.lit(f"{n}: "), v.cast("string")) for n, v in fields]), F.lit("\r\n")),
    )
    lines = rows.select(F.explode(F.array(request, answer, metadata)).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _expanded(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive in pieces: plain, one gzip member, or many."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        while not member.eof and content:
            yield member.decompress(content, CHUNK)
            content = member.unconsumed_tail
        content = member.unused_data


def parse(content: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record; names in lower case."""
    pieces, held, at = _expanded(content), bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        piece = next(pieces, None)
        if piece is None:
            return False
        if at > CHUNK:
            del held[:at]
            at = 0
        held += piece
        return True

    while True:
        while held[at: at + 2] == b"\r\n" or len(held) - at < 2:
            if len(held) - at >= 2:
                at += 2
            elif not more():
                return
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("an archive ends inside a record's headers")
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = [(n.strip().lower(), v.strip()) for n, _, v in (x.partition(":") for x in lines[1:])]
        size, at = int(dict(headers)["content-length"]), end + 4
        while len(held) - at < size:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield headers, bytes(held[at: at + size])
        at += size


def _row(headers: list[tuple[str, str]], block: bytes, with_payload: bool) -> dict:
    names = dict(headers)
    kind = names.get("warc-type")
    payload, fields = None, []
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2] if names.get("content-type", "").startswith("application/http") else block
    if kind == "metadata":
        pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
        fields = list({n.strip(): v.strip() for n, _, v in pairs}.items())
    digest = names.get("warc-payload-digest", "").rpartition(":")[2] or None
    if payload is not None:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "record_id": names.get("warc-record-id"), "record_type": kind, "concurrent_to": [v for n, v in headers if n == "warc-concurrent-to"],
        "target_uri": names.get("warc-target-uri"), "refers_to": names.get("warc-refers-to"), "payload_digest": digest,
        "payload_bytes": None if payload is None else len(payload), "payload": payload if with_payload else None, "fields": fields,
    }


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in a folder. Digests and lengths of responses are computed from what was read."""
    kind = pa.schema([
        *[(c, pa.string()) for c in ("record_id", "record_type")], ("concurrent_to", pa.list_(pa.string())),
        *[(c, pa.string()) for c in ("target_uri", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()),
        ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for headers, block in parse(content.as_py()):
                    held.append(_row(headers, block, with_payload))
                    size += len(block)
                    if size > 8 * CHUNK or len(held) >= 4096:
                        yield pa.RecordBatch.from_pylist(held, schema=kind)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One row per response or revisit, with its request and metadata nested in it."""
    answers = found.filter("record_type IN ('response', 'revisit')").select(
        "record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "concurrent_to",
    )
    named = answers.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("other"))

    def beside(kind: str, *columns: str) -> DataFrame:
        side = found.filter(F.col("record_type") == kind)
        shown = F.struct("record_id", *columns)
        ours = side.select(F.explode("concurrent_to").alias("capture"), shown.alias("r"))
        theirs = named.join(side.select(F.col("record_id").alias("other"), shown.alias("r")), "other").select("capture", "r")
        return ours.unionByName(theirs).groupBy(F.col("capture").alias(f"{kind}_of")).agg(
            F.min_by("r", "r.record_id").alias(kind), F.count_distinct("r.record_id").alias(f"n_{kind}"),
        )

    whole = answers
    for kind, columns in (("request", ("target_uri",)), ("metadata", ("fields",))):
        side = beside(kind, *columns)
        whole = whole.join(side, whole["record_id"] == side[f"{kind}_of"], "left")
    return whole.select(
        F.struct("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response"),
        "request", "metadata", F.coalesce("n_request", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
    )


def followed(whole: DataFrame) -> DataFrame:
    """Captures with ``original``: for a revisit, the length and digest of the response that it refers to and the metadata
    beside it; NULL for responses, and for revisits whose original is not among the archives."""
    kept = F.struct("response.payload_bytes", "response.payload_digest", "metadata")
    originals = whole.filter("response.record_type = 'response'").groupBy(F.col("response.record_id").alias("original_id"))
    originals = originals.agg(F.first(kept).alias("original"))  # repeated rows have one identifier
    return whole.join(originals, F.col("response.refers_to") == F.col("original_id"), "left").drop("original_id")
