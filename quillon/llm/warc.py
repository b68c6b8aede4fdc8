"""Archive writer and reader: WARC records compressed one by one with a Zstandard dictionary that is built
from archived records and stands in a skippable frame at the head of every file.

Spark's own text sink writes the frames (bytes, with an empty skippable frame as line end), so files go
through the commit protocol to any file system that Spark writes to; the binary file source reads them.

Defined results: a null html is an empty payload; among rows of equal payload of at least `least` bytes
those with the largest page_id are responses (equal page_ids alike) and the others revisit it; null page_ids
sort below all others and are named by an empty id; a null url leaves the target out; an empty table writes
no records; further columns are ignored. Payloads are compared by SHA-1 and length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut

#: Fixed values of the format: skippable frame with the dictionary, and any skippable frame.
DICT_MAGIC, SKIP_MAGIC = 0x184D2A5D, 0x184D2A50
LINE_END = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is built from so many records, each up to so many characters.
SAMPLE_RECORDS, SAMPLE_CHARS, DICT_BYTES = 400, 16_384, 64 << 10
LEVEL, DATE = 6, "2000-01-01T00:00:00Z"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, date: str = DATE) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; with too few samples to train from, their own bytes as a raw one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, sha1, kind and refers_to of every page. Groups are counted before the join,
    and only those of several rows are joined; both sides are dealt anew, so a hot payload is split."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    groups = rows.where(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.where("n > 1").select(F.col("sha1").alias("g_sha1"), F.col("bytes").alias("g_bytes"), "newest"))
    joined = rows.join(groups, (F.col("sha1") == F.col("g_sha1")) & (F.col("bytes") == F.col("g_bytes")), "left")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.select("page_id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("newest")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write the archives. The dictionary is built on the driver from SAMPLE_RECORDS pages at most, those of
    the lowest hash, each cut to SAMPLE_CHARS."""
    # the lowest hashes first, so that no task sends more than a few pages
    rows = pages.select("page_id", "url", F.xxhash64("page_id", "url").alias("h"), F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_CHARS).alias("p"))
    lowest = pages.select(F.xxhash64("page_id", "url").alias("h")).orderBy("h").limit(SAMPLE_RECORDS).agg(F.max("h")).first()[0]
    picked = [] if lowest is None else rows.where(F.col("h") <= lowest).limit(SAMPLE_RECORDS).collect()
    picked.sort(key=lambda r: (r["h"], r["p"]))
    raw = dictionary([record("response", r["page_id"], r["url"], r["p"].encode(), base32(hashlib.sha1(r["p"].encode()).hexdigest())) for r in picked])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(raw)) if raw else zstandard.ZstdCompressor(level=LEVEL)
        head = [struct.pack("<II", DICT_MAGIC, len(raw)) + raw] if raw else []
        for b in batches:
            out, held = head, 0
            head = []
            for page_id, url, payload, sha1, kind, refers_to in zip(*[b.column(c) for c in ("page_id", "url", "payload", "sha1", "kind", "refers_to")]):
                frame = press.compress(record(kind.as_py(), page_id.as_py(), url.as_py(), payload.as_py().encode(), base32(sha1.as_py()), refers_to.as_py()))
                out.append(frame)
                held += len(frame)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    plan(pages, least).mapInArrow(frames, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", LINE_END).option("compression", "none").text(path)


def frame_end(data: bytes | memoryview, at: int) -> int:
    """End of the Zstandard frame at `at`, from its block headers."""
    params = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
    at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * params.has_checksum


def records(data: bytes) -> Iterator[bytes]:
    """The decompressed records of one archive."""
    view, at, opened = memoryview(data), 0, None
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == SKIP_MAGIC:
            if magic == DICT_MAGIC:
                opened = zstandard.ZstdDecompressor(dict_data=_loaded(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        end = frame_end(view, at)
        opened = opened or zstandard.ZstdDecompressor()
        yield opened.decompress(view[at:end])
        at = end


def parse(raw: bytes) -> dict:
    """Headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"][5:]):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its length and digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"][5:], "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None}


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives in path; one task reads a file, of which the writer makes one per task."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                for raw in records(content.as_py()):
                    rows.append(parse(raw))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)
