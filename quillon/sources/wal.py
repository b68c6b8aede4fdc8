"""Binary write-ahead logs as DataFrames.

Record: size u32, type u32, crc32 of the payload u32, version u8 (1 JSON, 2 MessagePack), payload; all little
endian. Version-1 files lack the version byte and hold JSON. A record's place depends on those before it, so
one task reads a file and files are read side by side, by Spark's binary file source from any file system.

A torn tail ends a file; a record with a wrong checksum, an unreadable payload or no _id is kept with ok =
false, and replay passes over it.
"""

from __future__ import annotations

import json
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.log import INSERT, replay
from quillon.sources import msgpack

HEAD = {1: "<III", 2: "<IIIB"}
SCHEMA = "file string, offset long, seq long, op int, version int, crc_ok boolean, ok boolean, _id string, payload string"


def encode(records: Iterable[tuple[int, dict]], codec: int = 1, layout: int = 2) -> bytes:
    """Records (op, document) as the bytes of a log."""
    out = []
    for op, doc in records:
        raw = msgpack.dumps(doc) if codec == 2 else json.dumps(doc, ensure_ascii=False, separators=(",", ":")).encode()
        head = (len(raw), op, zlib.crc32(raw)) + ((codec,) if layout == 2 else ())
        out.append(struct.pack(HEAD[layout], *head) + raw)
    return b"".join(out)


def decode(data: bytes, layout: int = 2) -> Iterator[dict]:
    at, size = 0, struct.calcsize(HEAD[layout])
    while at + size <= len(data):
        n, op, crc, *rest = struct.unpack_from(HEAD[layout], data, at)
        raw = data[at + size : at + size + n]
        if len(raw) < n or n == 0:  # a torn tail, or zeros where nothing was written
            return
        version = rest[0] if rest else 1
        crc_ok = zlib.crc32(raw) == crc
        doc = None
        if crc_ok:
            try:
                doc = msgpack.loads(raw) if version == 2 else json.loads(raw)
            except (ValueError, IndexError, struct.error, RecursionError):
                doc = None
        key = doc.get("_id") if isinstance(doc, dict) else None
        ok = isinstance(key, str) and key != ""
        yield {"offset": at, "op": op, "version": version, "crc_ok": crc_ok, "ok": ok, "_id": key if ok else None, "payload": json.dumps(doc, ensure_ascii=False) if ok else None}
        at += size + n


def read(spark: SparkSession, path: str, layout: int = 2) -> DataFrame:
    """All records of the files at path. seq orders records within a file; order files by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for i, r in enumerate(decode(content, layout)):
                    rows.append({"file": name, "seq": i} | r)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows)[[c.split()[0] for c in SCHEMA.split(", ")]]
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)[[c.split()[0] for c in SCHEMA.split(", ")]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def _ordered(records: DataFrame) -> DataFrame:
    """Readable records with seq as (number in the file's name, file, place), so that 10.log follows 2.log."""
    number = F.regexp_extract("file", r"([0-9]{1,18})[^/0-9]*$", 1)
    return records.where("ok").withColumn("seq", F.struct(F.when(number != "", number.cast("long")).otherwise(0).alias("number"), "file", F.col("seq").alias("at")))


def live(records: DataFrame) -> DataFrame:
    """(_id, payload) of the live documents: later files, then later records win."""
    return replay(_ordered(records).select("_id", "op", "payload", "seq")).select("_id", "payload")


def index(records: DataFrame) -> DataFrame:
    """(_id, file, offset) of the record that holds each live document."""
    return replay(_ordered(records).select("_id", "op", "file", "offset", "seq")).select("_id", "file", "offset")


def save_index(index: DataFrame, path: str) -> None:
    """Write an index sorted by _id within its files, with a Bloom filter on _id in each."""
    index.repartitionByRange("_id").sortWithinPartitions("_id").write.mode("overwrite").option("parquet.bloom.filter.enabled#_id", "true").parquet(path)


def read_at(spark: SparkSession, entries: DataFrame, layout: int = 2) -> DataFrame:
    """(_id, file, offset, found, payload): the record at each entry's place; found is the _id that it has, null where there
    is no readable record. A task reads the files of its entries once each."""
    names = [r["file"] for r in entries.select("file").distinct().collect()]  # one row per file
    schema = "_id string, file string, offset long, found string, payload string"
    if not names:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(names).select(F.col("path").alias("file"), "content")

    def run(wanted: pd.DataFrame, content: pd.DataFrame) -> pd.DataFrame:
        rows = []
        data = content["content"].iloc[0] if len(content) else b""
        for key, file, offset in zip(wanted["_id"], wanted["file"], wanted["offset"]):
            record = next(decode(data[offset:], layout), None)
            rows.append((key, file, offset, record["_id"] if record else None, record["payload"] if record else None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return entries.select("_id", "file", "offset").groupBy("file").cogroup(files.groupBy("file")).applyInPandas(run, schema)


def spot_check(spark: SparkSession, index: DataFrame, layout: int = 2) -> bool:
    """Whether the records of the first and the last _id of an index are where it says."""
    ends = index.orderBy("_id").limit(1).unionByName(index.orderBy(F.col("_id").desc()).limit(1))
    return read_at(spark, ends, layout).where("found is null or found <> _id").limit(1).count() == 0


def open_index(spark: SparkSession, path: str, saved: str, layout: int = 2) -> DataFrame:
    """The index saved at `saved` if it is there and passes the spot check; else it is rebuilt from the log and saved."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{saved}/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        held = spark.read.schema("_id string, file string, offset long").parquet(saved)
        if spot_check(spark, held, layout):
            return held
    save_index(index(read(spark, path, layout)), saved)
    return spark.read.schema("_id string, file string, offset long").parquet(saved)


def migrate(spark: SparkSession, path: str, out: str) -> int:
    """Version-1 files to a Parquet log with one INSERT per live document; returns how many."""
    rows = live(read(spark, path, layout=1)).select(F.lit(0).cast("long").alias("seq"), F.lit(INSERT).alias("op"), "_id", F.col("payload").alias("doc"))
    rows.sortWithinPartitions("_id").write.parquet(out)
    return spark.read.parquet(out).count()


def main() -> None:
    """python -m quillon.sources.wal OLD NEW: migrate version-1 files."""
    old, new = sys.argv[1:3]
    print(f"{migrate(SparkSession.builder.appName('quillon').getOrCreate(), old, new)} document(s)")


if __name__ == "__main__":
    main()
