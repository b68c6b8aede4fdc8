"""Follow a store's Parquet log as a stream: the replica's state after each batch is written as a snapshot.

The checkpoint is the resume point. A batch is folded into the last snapshot by the last record of each key; tombstones
stay in the snapshot, so that late records cannot revive a document. When the log has been compacted, the follower is
lagged: deletions that it has not read may be gone with the old generation. It then takes the new generation as a whole in place
of its state (resync), which also drops its tombstones. Two snapshots are kept.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.log import DELETE, latest
from quillon.plans.find import find as compile_find
from quillon.plans.request import FindRequest
from quillon.store import SCHEMA, Files

KEEP = 2


def _snapshots(state: Files) -> list[tuple[int, int, str]]:
    """Complete snapshots: (batch, generation, folder), oldest first."""
    found = [(m, n) for n in state.names() if (m := re.fullmatch(r"batch=(-?\d+)\.gen=(\d+)", n))]
    return sorted((int(m[1]), int(m[2]), n) for m, n in found if state.exists(f"{n}/_SUCCESS"))


class Follower:
    """A read-only replica of the log at log_path (the `log` folder of a store)."""

    def __init__(self, spark: SparkSession, log_path: str, state_path: str, checkpoint: str):
        self.spark, self.checkpoint = spark, checkpoint
        self.source, self.state = Files(spark, log_path), Files(spark, state_path)

    def _newest(self, below: int | None = None) -> tuple[int, int, str] | None:
        found = [s for s in _snapshots(self.state) if below is None or s[0] < below]
        return found[-1] if found else None

    def _write(self, rows: DataFrame, n: int, generation: int) -> None:
        rows.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{self.state.path}/batch={n}.gen={generation}")
        for _, _, name in _snapshots(self.state)[:-KEEP]:
            self.state.remove(name)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.state.path}/{name}")

    def lagged(self) -> bool:
        """Whether the log has a newer generation than the state."""
        last = self._newest()
        return last is not None and last[1] < self.source.generation()

    def resync(self) -> None:
        """Take the log's current generation as a whole."""
        last, generation = self._newest(), self.source.generation()
        whole = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.source.path}/gen={generation}")
        self._write(latest(whole), last[0] if last else -1, generation)

    def follow(self, available_now: bool = True) -> StreamingQuery:
        """Start following; with available_now the query ends when all there is has been read."""
        if self.lagged():
            self.resync()

        def fold(batch: DataFrame, n: int) -> None:
            last, generation = self._newest(below=n), self.source.generation()
            if last is not None and last[1] < generation:
                whole = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.source.path}/gen={generation}")
                self._write(latest(whole), n, generation)
                return
            # records of older generations are in the state, or in the image that replaced it
            rows = batch.where(F.col("gen") >= (0 if last is None else last[1])).drop("gen")
            self._write(latest(rows if last is None else rows.unionByName(self._read(last[2]))), n, generation if last is None else last[1])

        stream = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.source.path)
        stream = stream.withColumn("gen", F.regexp_extract(F.col("_metadata.file_path"), r"/gen=(\d+)/", 1).cast("int"))
        writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", self.checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def live(self) -> DataFrame:
        """(_id, doc) of the newest snapshot."""
        last = self._newest()
        return self.spark.createDataFrame([], "_id string, doc string") if last is None else self._read(last[2]).where(f"op <> {DELETE}").select("_id", "doc")

    def find(self, request: FindRequest | None = None) -> DataFrame:
        return compile_find(self.live().select("_id", F.parse_json("doc").alias("doc")), request or FindRequest())

    def insert(self, *_: object) -> None:
        raise PermissionError("writes not accepted: follower mode")

    update = delete = compact = insert
