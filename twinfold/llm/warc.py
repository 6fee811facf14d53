"""WARC archives: writing captures, reading records back, and assembling one row per capture.

A capture is a response or revisit with its request and metadata records; those name it in
WARC-Concurrent-To. Archives are gzip files written by Spark's text writer, whose line end
is the blank line that ends a record, so they go to any store that Spark writes to. They are read
back line by line in streams: a record at a time is in memory, never a file. Records of a
capture are joined by the identifiers they name, whatever files they stand in.

Defined cases: a null payload is empty; a payload may hold any bytes, blank lines and record heads
included, since the length in the head decides; of equal payloads of at least ``least`` bytes the
one with the largest key is a response and the others revisit it, smaller ones are all responses; a
null key is less than any other, and of rows with equal payloads and keys any one may be the response; an empty table writes no records. A
request or metadata record whose capture is missing is dropped, a capture without one has an empty list
there. Repeated keys and rows each give a capture of their own. Headers may repeat. Records may name each other
in either direction, and metadata may name the request instead. Extra columns are not written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from twinfold.common import cut, ship

END = "\r\n\r\n"
SOFTWARE = "twinfold"
FIELDS = "record_id string, warc_type string, target_uri string, warc_date string, concurrent_to array<string>, refers_to string, payload_digest string, headers map<string,array<string>>, http_head string, payload binary"
#: Rows handed on together when reading, in records and bytes.
ROWS, BYTES = 256, 8_000_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Digits in which 40 bits are written before they become base 32.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def digest(data: Column) -> Column:
    """SHA-1 in bare upper-case base 32: eight digits for each 40 bits."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def plan(pages: DataFrame, key: str = "page_id", payload: str = "html", uri: str = "url", least: int = 0) -> DataFrame:
    """(key, uri, payload, digest, bytes, id, refers_to, refers_id): each capture, its record's identifier, and the
    key and identifier of the response that it revisits; a response refers to nothing."""
    rows = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", digest(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    # Of each payload that repeats: the largest key, and how many rows have it. Counts by key come first, so no group is in one task.
    counts = rows.filter(F.col("bytes") >= least).groupBy("digest", "bytes", "key").agg(F.count("*").alias("n"))
    whole = counts.groupBy("digest", "bytes").agg(F.max(F.struct(F.col("key").isNotNull().alias("there"), "key", "n")).alias("first"), F.sum("n").alias("n")).filter("n > 1")
    kept = cut(whole.select("digest", "bytes", F.col("first.key").alias("first"), (F.col("first.n") > 1).alias("tied"), F.lit(True).alias("many")))  # small; and a join of two plain inputs is one whose hot keys Spark can split
    joined = rows.join(kept, ["digest", "bytes"], "left").withColumn("many", F.coalesce("many", F.lit(False)))
    best = F.col("many") & F.col("key").eqNullSafe(F.col("first"))
    if kept.filter("tied").isEmpty():
        told = joined.withColumn("response", ~F.col("many") | best)
    else:
        of_ties = best & F.col("tied")
        nth = F.row_number().over(Window.partitionBy("digest", "bytes").orderBy("uri"))
        told = joined.filter(~of_ties).withColumn("response", ~F.col("many") | best).unionByName(joined.filter(of_ties).withColumn("response", nth == 1))
    first = _urn(F.concat_ws(":", F.lit("response"), "digest", F.col("bytes").cast("string")))
    ident = F.when(F.col("many") & F.col("response"), first).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    return told.select("key", "uri", "payload", "digest", "bytes", ident.alias("id"), F.when(~F.col("response"), F.col("first")).alias("refers_to"), F.when(~F.col("response"), first).alias("refers_id"))


def _urn(name: Column) -> Column:
    h = F.sha1(name)
    return F.concat(F.lit("<urn:uuid:"), *(x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]), F.lit(">"))


def _record(kind: Column, ident: Column, uri: Column, date: str, type_: str, block: Column, more: list[tuple[str, Column]]) -> Column:
    """Bytes of a record; a header whose value is null is left out."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.regexp_replace(uri, r"[\r\n]", " ")), *more, ("Content-Type", F.lit(type_)), ("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat(F.lit("WARC/1.0\r\n"), *(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in lines), F.lit("\r\n"))
    return F.concat(head.cast("binary"), block)


def write(plan_: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes three records for each row of ``plan`` into gzip archives below ``path``."""
    key, uri = F.col("key"), F.coalesce("uri", F.lit(""))
    of = F.col("id")
    revisit = F.col("refers_id").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: "), F.coalesce(key.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)).cast("binary")
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    host = F.coalesce(F.nullif(F.regexp_extract(uri, "^[a-z]+://([^/?#]*)", 1), F.lit("")), F.lit("localhost"))
    ask = F.concat(F.lit("GET "), F.regexp_replace(uri, r"[\r\n ]", "%20"), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)).cast("binary")
    note = F.concat(F.lit("page: "), F.coalesce(key.cast("string"), F.lit("")), F.lit("\r\nfetchTimeMs: 0\r\n")).cast("binary")
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
    records = F.array(
        _record(F.lit("request"), _urn(F.concat(F.lit("request:"), of)), uri, date, "application/http; msgtype=request", ask, [("WARC-Concurrent-To", of)]),
        _record(F.when(revisit, "revisit").otherwise("response"), of, uri, date, "application/http; msgtype=response", body, [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", F.col("refers_id")), ("WARC-Profile", profile)]),
        _record(F.lit("metadata"), _urn(F.concat(F.lit("metadata:"), of)), uri, date, "application/warc-fields", note, [("WARC-Concurrent-To", of)]),
    )
    plan_.select(F.explode(records).alias("r")).select(F.col("r").cast("string").alias("value")).write.mode("overwrite").option("lineSep", END).option("compression", "gzip").text(path)


Head = dict[str, list[str]]


def _only(head: Head, name: str) -> str | None:
    """The first value of a header."""
    return head[name][0] if name in head else None


def _length(head: Head, file: str) -> int:
    value = _only(head, "content-length") or ""
    if not (value.isascii() and value.isdigit()):
        raise ValueError(f"{file}: a record without a valid Content-Length")
    return int(value)


def parse(lines: Iterator[tuple[str, bytes]]) -> Iterator[tuple[Head, bytes]]:
    """Headers (names in small letters, each with its values) and block of each record, from (file, line without its line feed)."""
    head: Head | None = None
    block, want, at, last = [], -1, 0, ""
    for name, line in lines:
        if name != last:
            if want > at:
                raise ValueError(f"{last} ends inside a record")
            head, want, last = None, -1, name
        if want >= 0:  # inside a block
            block.append(line)
            at += len(line) + 1
            if at >= want:
                data = b"\n".join(block) + b"\n"
                yield head, data[:want]
                head, want = None, -1
        elif head is None:
            if line.rstrip(b"\r"):
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{name}: no record begins with {line[:40]!r}")
                head = {}
        elif line.rstrip(b"\r"):
            k, _, v = line.rstrip(b"\r").decode("utf-8", "replace").partition(":")
            head.setdefault(k.strip().lower(), []).append(v.strip())
        else:
            want, at, block = _length(head, name), 0, []
            if not want:
                yield head, b""
                head, want = None, -1
    if want > at:
        raise ValueError(f"{last} ends inside a record")


def http(headers: Head, block: bytes) -> tuple[str | None, bytes]:
    """HTTP head and payload of a response's or revisit's block; other blocks are all payload."""
    if _only(headers, "warc-type") not in ("response", "revisit") or not (_only(headers, "content-type") or "").startswith("application/http"):
        return None, block
    head, _, body = block.partition(END.encode())
    return head.decode("utf-8", "replace"), body


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the gzip archives below ``path``. Such a file is never split, so its lines come in order."""
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[str, bytes]]:
            for b in batches:
                yield from zip(b.column("file").to_pylist(), b.column("line").to_pylist(), strict=True)

        def full(rows: list) -> pa.RecordBatch:
            types = [pa.string()] * 4 + [pa.list_(pa.string())] + [pa.string()] * 2 + [pa.map_(pa.string(), pa.list_(pa.string())), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows, size = [], 0
        for h, block in parse(each()):
            rows.append((*(_only(h, f"warc-{x}") for x in ("record-id", "type", "target-uri", "date")), h.get("warc-concurrent-to", []), _only(h, "warc-refers-to"), _only(h, "warc-payload-digest"), list(h.items()), *http(h, block)))
            size += len(block)
            if len(rows) >= ROWS or size >= BYTES:
                yield full(rows)
                rows, size = [], 0
        if rows:
            yield full(rows)

    return lines.mapInArrow(run, FIELDS)


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: its record id, type, size and digest of the payload, the payload itself if wanted,
    and lists of its request and metadata records.

    The records are parsed once: what is joined is written, without the captures' payloads unless they are wanted.
    """
    capture = F.col("warc_type").isin("response", "revisit")
    text = F.when(F.col("warc_type").isin("request", "metadata"), F.col("payload").cast("string")).alias("text")
    wanted = records.filter(F.col("record_id").isNotNull() & (capture | F.col("warc_type").isin("request", "metadata")))
    once = cut(wanted.select(
        "record_id", "warc_type", "target_uri", "warc_date", "concurrent_to", "refers_to", F.regexp_replace("payload_digest", "^sha1:", "").alias("named_digest"), "http_head",
        text, F.when(capture, F.octet_length("payload").cast("long")).alias("payload_bytes"), F.when(capture, digest(F.col("payload"))).alias("payload_digest"), *([F.when(capture, F.col("payload")).alias("payload")] if payload else []),
    ))
    captures = once.filter(capture).drop("concurrent_to", "text")
    others = once.filter(~capture).select(F.col("record_id").alias("other"), F.col("warc_type").alias("kind"), "text")
    named = once.select("record_id", "warc_type", F.explode("concurrent_to").alias("names"))
    # (capture, other), whichever of the two names the other.
    pairs = named.filter(capture).select(F.col("record_id").alias("capture"), F.col("names").alias("other")).unionByName(named.filter(~capture).select(F.col("names").alias("capture"), F.col("record_id").alias("other")))
    ids = captures.select(F.col("record_id").alias("capture"))
    direct = pairs.join(ids, "capture", "left_semi").distinct()
    # Metadata that names a request belongs to that request's captures.
    asked = named.filter("warc_type = 'metadata'").select(F.col("names").alias("request"), F.col("record_id").alias("metadata"))
    through = asked.join(direct.withColumnRenamed("other", "request"), "request").select("capture", F.col("metadata").alias("other"))
    parts = direct.unionByName(through).distinct().join(others, "other")
    one = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("other").alias("id"), "text")))).alias(kind)
    nested = parts.groupBy(F.col("capture").alias("record_id")).agg(one("request"), one("metadata"))
    none = F.array().cast("array<struct<id:string,text:string>>")
    return captures.join(nested, "record_id", "left").withColumns({kind: F.coalesce(kind, none) for kind in ("request", "metadata")})
