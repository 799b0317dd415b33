"""WARC captures: parsing, canonical URLs, and resolution of not-modified revisits.

A revisit is resolved by an as-of join: the latest earlier full response of the same canonical
URL. Its validators must agree: equal entity tags (weak comparison) where both have one, else
equal Last-Modified; a payload digest, where the revisit names one, must be the response's.
Headers that a 304 may update come from the revisit, all others from the response.

The join is a window within (canonical URL, time slice) and one over the slices' last
responses, so a URL that holds a third of all captures is spread over SLICES tasks. Payloads
don't take part; they can be joined by record id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 256
#: Header fields that a not-modified answer may update; fixed values of RFC 9110, 15.4.5.
UPDATED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Query parameters that don't choose a document.
TRACKING = r"(utm_[^=&]*|ref|fbclid|gclid|sessionid)(=[^&]*)?"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without www. and default port, no fragment, no tracking parameters, sorted query, no trailing slash; http counts as https."""
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), r":(80|443)$", ""), r"^www\.", "")
    kept = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}$")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    scheme = F.regexp_replace(F.lower(part(1)), "^http$", "https")
    return F.when(part(1) == "", url).otherwise(F.concat(scheme, F.lit("://"), host, F.regexp_replace(part(3), "/+$", ""), query))


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file one after the other, or the bytes themselves; of a cut or damaged member what can be read, and nothing behind it."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at, rest = memoryview(data), 0, b""
    while at < len(view) or rest:
        member, out = zlib.decompressobj(31), []
        try:
            while not member.eof and (rest or at < len(view)):
                chunk, rest = rest, b""
                if not chunk:
                    chunk, at = bytes(view[at : at + 65_536]), at + 65_536
                out.append(member.decompress(chunk))
        except zlib.error:
            rest, at = b"", len(view)
        else:
            rest = member.unused_data
        yield b"".join(out)


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of a WARC file's bytes, gzipped or not: type, url, record id, date, status, headers (lower-case names), payload.

    A record without a readable length ends where the next one begins, or with the file; a
    record cut off has the payload that is there; bytes that are no record are passed over.
    """
    for member in _members(data):
        yield from _records(member)


def _records(data: bytes) -> Iterator[dict]:
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        cut = data.find(b"\r\n\r\n", start)
        if cut < 0:
            return
        head = _fields(data[start:cut])
        length = head.get("content-length", "")
        if length.isascii() and length.isdigit():
            size = int(length)
        else:
            following = data.find(b"\r\n\r\nWARC/", cut + 2)
            size = (len(data) if following < 0 else max(following, cut + 4)) - cut - 4
        body, at = data[cut + 4 : cut + 4 + size], cut + 4 + size
        status, headers = None, {}
        if head.get("content-type", "").startswith("application/http") and body.startswith(b"HTTP/"):
            top, _, body = body.partition(b"\r\n\r\n")
            first = top.split(b"\r\n", 1)[0].split(b" ")
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
            headers = _fields(top)
        yield {
            "record_id": head.get("warc-record-id"), "kind": head.get("warc-type"), "url": head.get("warc-target-uri"), "ts": head.get("warc-date"),
            "status": status, "headers": headers, "digest": head.get("warc-payload-digest"), "payload": body,
        }


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if _}


#: Statuses of a response whose payload is the whole resource.
FULL = (200, 203)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the WARC files at path, one task a file at most; ts is a timestamp."""
    schema = "record_id string, kind string, url string, ts string, status int, headers map<string,string>, digest string, payload binary"

    def run(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                for record in parse_records(bytes(content)):
                    yield pd.DataFrame([record], columns=["record_id", "kind", "url", "ts", "status", "headers", "digest", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, schema).withColumn("ts", F.to_timestamp("ts"))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """captures (record_id, kind, url, ts, headers, digest) to one row per revisit.

    Returns record_id, url_key, ts, refers_to (the response's record_id, null if there is none
    or its validators disagree), verdict ('resolved', 'no response', 'validators differ'),
    headers (merged) and digest. `kind` is 'response' for a full answer or 'revisit'; others are
    ignored. Of responses at one time the largest record_id counts as the latest; a response at
    the revisit's own time is not earlier. Rows without a url or ts never match: such a revisit
    has 'no response'. Where captures have a status, a response is full if its status is one of
    FULL or null; error pages, redirects and partial answers are passed over, so a revisit refers
    to the full response before them. Other columns are ignored.
    """
    if "status" in captures.columns:
        captures = captures.where((F.col("kind") != "response") | F.coalesce(F.col("status").isin(*FULL), F.lit(True)))
    c = captures.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "ts", F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("headers"), "digest"
    )
    placed = c.where("url_key is not null and ts is not null")
    span = placed.agg(F.min(F.col("ts").cast("double")).alias("a"), F.max(F.col("ts").cast("double")).alias("z")).first()
    first, width = (span["a"] or 0.0), max(((span["z"] or 0.0) - (span["a"] or 0.0)) / SLICES, 1e-9)
    placed = placed.withColumn("slice", F.floor((F.col("ts").cast("double") - first) / width))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "headers", "digest"))
    key = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    slices = placed.groupBy("url_key", "slice").agg(F.max_by(full, key).alias("last"))
    carried = slices.select("url_key", "slice", F.last("last", ignorenulls=True).over(W.partitionBy("url_key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    # earlier within the slice: order by (ts, kind, record_id) with revisits first at one time
    order = W.partitionBy("url_key", "slice").orderBy("ts", F.desc("kind"), "record_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = placed.withColumn("near", F.last(full, ignorenulls=True).over(order)).where("kind = 'revisit'")
    found = near.join(carried, ["url_key", "slice"]).withColumn("r", F.coalesce("near", "carried"))
    lost = c.where("kind = 'revisit' and (url_key is null or ts is null)")
    none = F.lit(None).cast(found.schema["r"].dataType)
    every = found.select("record_id", "url_key", "ts", "headers", "digest", "r").union(lost.select("record_id", "url_key", "ts", "headers", "digest", none.alias("r")))
    tag, old_tag = F.col("headers")["etag"], F.col("r.headers")["etag"]
    since, old_since = F.col("headers")["last-modified"], F.col("r.headers")["last-modified"]
    agree = F.when(tag.isNotNull() & old_tag.isNotNull(), _weak(tag) == _weak(old_tag)).otherwise(F.coalesce(since == old_since, F.lit(False)))
    agree &= F.coalesce(F.col("digest") == F.col("r.digest"), F.lit(True))
    verdict = F.when(F.col("r").isNull(), "no response").when(agree, "resolved").otherwise("validators differ")
    ok = F.col("verdict") == "resolved"
    update = F.map_filter("headers", lambda k, v: k.isin(UPDATED))
    kept = F.map_filter("r.headers", lambda k, v: ~F.map_contains_key(update, k))
    return every.withColumn("verdict", verdict).select(
        "record_id", "url_key", "ts",
        F.when(ok, F.col("r.record_id")).alias("refers_to"),
        "verdict",
        F.when(ok, F.map_concat(kept, update)).alias("headers"),
        F.when(ok, F.col("r.digest")).alias("digest"),
    )
