"""Web archives: writing WARC records from pages, and reading archives back by boundary-chain verification.

Writing: one record per page, as uncompressed WARC/1.0 text through Spark's own writer. Of records with equal payloads (of at least
``revisit_bytes``) the one with the largest page_id is a response, the others are revisits of it and carry no payload.

Reading: archives are split at every occurrence of the version line, also inside large files. Each piece is a candidate record: its
header tells where its successor must start. From the start of each file, pointer jumping (who is reached after 1, 2, 4, ... records)
finds the candidates on the chain; every other occurrence of the version line is payload. A record's pieces are put together again where
its payload holds such lines. Offsets are sums of piece lengths, so they do not depend on how files were split.

Defined cases: a null html is the empty payload; a null url leaves out the target; line breaks in a url are percent-encoded; a null page_id
is never the kept one unless all of its group are null (then all are responses); repeated rows with the largest page_id are all responses;
empty input gives an empty result. A record whose header does not parse ends its file's chain.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workspace import fresh_path, written
from .text import mapped, read

MAGIC = "WARC/1.0\r\n"
CRLF = "\r\n"
# The alphabet of base 32 and the profile of revisit records, as the standards name them.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a 160-bit hexadecimal digest: five hex digits are four letters."""
    out = []
    for block in range(8):
        bits = F.conv(F.substring(digest, 5 * block + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record(page_id: Column, url: Column, html: Column, digest: Column, keeper: Column, date: str) -> Column:
    """The text of one record, but for its last character, which the writer adds as line end."""
    revisit = keeper.isNotNull() & ~page_id.eqNullSafe(keeper)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    size = F.octet_length(html).cast("string")
    http = F.concat(F.lit(HTTP), size, F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, html))
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF + "WARC-Record-ID: "), urn(page_id), F.lit(f"{CRLF}WARC-Date: {date}"),
        F.coalesce(F.concat(F.lit(CRLF + "WARC-Target-URI: "), safe), F.lit("")),
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"), digest, F.lit(CRLF + "X-Payload-Length: "), size,
        F.when(revisit, F.concat(F.lit(CRLF + "WARC-Refers-To: "), urn(keeper), F.lit(f"{CRLF}WARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF), block, F.lit("\r\n\r"))


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of all pages below ``path``. Only payloads that occur twice are joined; their list is written, so that its size is known."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_of_hex(F.sha1(F.col("html").cast("binary"))))
    large = F.octet_length("html") >= revisit_bytes
    keepers = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keepers = written(keepers.select("digest", "keeper"), "warc-keepers")
    text = rows.join(keepers, "digest", "left").select(record(F.col("page_id"), F.col("url"), F.col("html"), F.col("digest"), F.when(large, F.col("keeper")), date))
    text.toDF("value").write.option("lineSep", "\n").option("compression", "none").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _header(value: bytes) -> tuple[dict[str, str], int] | None:
    """Fields (names in lower case) and where the block starts; None if this is no header."""
    end = value.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in value[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, text = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = text.strip()
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def _payload(block: bytes) -> bytes:
    return block[block.find(b"\r\n\r\n") + 4:] if block.startswith(b"HTTP/") else block


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


FIELDS = ("type", "record_id", "target_uri", "refers_to", "header_digest", "header_length")
_NAMES = ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "x-payload-length")
_WITHIN = "file string, block long, within long, length long"


def _walked(batches):
    """(batch, offsets of its pieces from the first piece of their split): pieces of a split follow each other."""
    place, at = None, 0
    for batch in batches:
        starts = []
        for value, file, block in zip(batch.column("value"), batch.column("file").to_pylist(), batch.column("block").to_pylist()):
            if (file, block) != place:
                place, at = (file, block), 0
            starts.append(at)
            at += len(value.as_buffer()) + len(MAGIC)
        yield batch, starts


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per piece: where it lies in its split, what its header says, and the payload's digest if it is complete."""
    def run(batches):
        for batch, starts in _walked(batches):
            out = []
            for value, start, block in zip(batch.column("value"), starts, batch.column("block").to_pylist()):
                data = value.as_py()
                parsed = _header(data) if start or block else None  # what stands before a file's first version line is no record
                if parsed is None:
                    out.append((len(data), None, None, None, None, *[None] * len(FIELDS)))
                    continue
                fields, head = parsed
                need = head + int(fields["content-length"]) + 4
                whole = len(data) == need
                payload = _payload(data[head:-4]) if whole else None
                out.append((len(data), need, head, len(payload) if whole else None, _digest(payload) if whole else None, *[fields.get(n) for n in _NAMES]))
            cols = list(zip(*out)) if out else [[]] * (5 + len(FIELDS))
            kinds = [pa.int64()] * 4 + [pa.string()] * (1 + len(FIELDS))
            arrays = [batch.column("file"), batch.column("block"), pa.array(starts, pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "block", "within", "length", "need", "head", "payload_bytes", "payload_digest", *FIELDS])
    schema = f"{_WITHIN}, need long, head long, payload_bytes long, payload_digest string, " + ", ".join(f"{f} string" for f in FIELDS)
    return mapped(_pieces(spark, path), run, schema)


def _located(pieces: DataFrame) -> DataFrame:
    """``at``: the offset of each piece's version line in its file, from the sums of earlier splits."""
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy("file", "block").agg(F.sum(F.col("length") + len(MAGIC)).alias("bytes")) \
        .select("file", "block", F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("base"))
    return pieces.join(base, ["file", "block"]).withColumn("at", F.col("base") + F.col("within") - len(MAGIC)).drop("block", "within", "base")


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) of the candidates on the chain from offset 0: ``links`` has (file, at, next). Doubles the jump each round."""
    state = written(links.select("file", "at", "next", (F.col("at") == 0).alias("on")), "warc-chain")
    count = state.filter("on").count()
    while True:
        jumps = state.select("file", F.col("at").alias("next"), F.col("next").alias("onward"))
        marks = state.filter("on AND next IS NOT NULL").select("file", F.col("next").alias("at"), F.lit(True).alias("mark")).distinct()
        state = written(state.join(jumps, ["file", "next"], "left").join(marks, ["file", "at"], "left")
                        .select("file", "at", F.col("onward").alias("next"), (F.col("on") | F.coalesce("mark", F.lit(False))).alias("on")), "warc-chain")
        reached = state.filter("on").count()
        if reached == count:
            return state.filter("on").select("file", "at")
        count = reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, at, the header's fields, payload_bytes and payload_digest of every true record."""
    pieces = written(_located(written(_candidates(spark, path), "warc-pieces")), "warc-located")
    proposed = pieces.filter("need IS NOT NULL").select("file", "at", (F.col("at") + len(MAGIC) + F.col("need")).alias("next"))
    chain = written(reachable(proposed), "warc-records")
    records = pieces.join(chain, ["file", "at"])
    out = ["file", "at", *FIELDS, "payload_bytes", "payload_digest"]
    broken = written(records.filter("payload_digest IS NULL").select("file", F.col("at").alias("owner"), "need", "head"), "warc-broken")
    if broken.isEmpty():
        return records.select(*out)
    owner = F.last(F.when(F.col("on"), F.col("at")), True).over(Window.partitionBy("file").orderBy("at"))
    owned = pieces.join(broken.select("file").distinct(), "file").join(chain.withColumn("on", F.lit(True)), ["file", "at"], "left") \
        .select("file", "at", owner.alias("owner")).join(broken, ["file", "owner"])
    joined = _joined(spark, path, written(owned, "warc-owned"))
    fixed = records.filter("payload_digest IS NULL").drop("payload_bytes", "payload_digest").join(joined, ["file", "at"], "left")
    return records.filter("payload_digest IS NOT NULL").select(*out).unionByName(fixed.select(*out))


def _joined(spark: SparkSession, path: str, owned: DataFrame) -> DataFrame:
    """Payloads of records that hold version lines: their pieces are read again and put together."""
    def raw(batches):
        for batch, starts in _walked(batches):
            sizes = pa.array([len(v.as_buffer()) for v in batch.column("value")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(starts, pa.int64()), sizes, batch.column("value")],
                                             ["file", "block", "within", "length", "value"])
    again = _located(mapped(_pieces(spark, path), raw, _WITHIN + ", value binary"))
    parts = again.join(owned, ["file", "at"]).groupBy("file", "owner").agg(
        F.max("need").alias("need"), F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))

    def whole(batches):
        for batch in batches:
            sizes, digests = [], []
            for parts, head, need in zip(batch.column("parts").to_pylist(), batch.column("head").to_pylist(), batch.column("need").to_pylist()):
                data = MAGIC.encode().join(bytes(p["value"]) for p in parts)
                payload = _payload(data[head:need - 4]) if len(data) >= need - 4 else None  # else the file ends before the record does
                sizes.append(None if payload is None else len(payload))
                digests.append(None if payload is None else _digest(payload))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("owner"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                                             ["file", "at", "payload_bytes", "payload_digest"])
    return mapped(parts, whole, "file string, at long, payload_bytes long, payload_digest string")


def page_of(urn: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract({urn}, '^<urn:page:(-?[0-9]+)>$', 1), '') AS bigint)")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path, revisit_bytes=0)
    found = read_archives(spark, path)
    revisit = F.col("type") == "revisit"
    return found.select(
        page_of("record_id").alias("page_id"),
        F.when(revisit, F.expr("try_cast(header_length AS bigint)")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("header_digest", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(revisit, page_of("refers_to")).alias("refers_to"))
