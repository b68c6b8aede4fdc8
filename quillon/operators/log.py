"""The mutation log: (seq, op, _id, payload columns), folded to live state by the last record of each id."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = 1, 2, 3


def latest(log: DataFrame, key: str = "_id", seq: str = "seq") -> DataFrame:
    """The last record of each key, tombstones included. An aggregate, so that tasks combine before the
    shuffle and a hot key is never gathered."""
    rest = [c for c in log.columns if c != key]
    kept = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return kept.select(key, *[F.col("_last")[c].alias(c) for c in rest]).select(*log.columns)


def replay(log: DataFrame, key: str = "_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """Live rows: the last record of each key unless it deletes."""
    return latest(log, key, seq).where(F.col(op) != DELETE)


def counts(log: DataFrame, key: str = "_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """One row: entries, live, dead and waste_ratio of a log."""
    per_key = log.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max_by(op, seq).alias("last"))
    out = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count(F.when(F.col("last") != DELETE, 1)).alias("live"))
    return out.select("entries", "live", (F.col("entries") - F.col("live")).alias("dead"), ((F.col("entries") - F.col("live")) / F.nullif(F.col("entries"), F.lit(0))).alias("waste_ratio"))


def compact(log: DataFrame, key: str = "_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """The smallest log of the same state: one INSERT per live key, sorted by key within its files."""
    return replay(log, key, seq, op).withColumn(op, F.lit(INSERT)).sortWithinPartitions(key)


def merge_runs(runs: list[DataFrame], key: str, op: str | None = None) -> DataFrame:
    """Merge runs, oldest first: the newest run wins a key, tombstones (op = DELETE) vanish."""
    levelled = reduce(DataFrame.unionByName, [r.withColumn("_level", F.lit(i)) for i, r in enumerate(runs)])
    out = latest(levelled, key, "_level").drop("_level")
    return out.where(F.col(op) != DELETE) if op else out


def merge_update(base: DataFrame, patch: DataFrame, key: str = "_id", present: dict[str, Column] | None = None) -> DataFrame:
    """Shallow merge of patch rows into the rows of their keys. present says per field whether a patch row
    sets it (default: not null), so that a patch can set null. Keys that base lacks are ignored (see missing)."""
    fields = [c for c in patch.columns if c != key and c in base.columns]
    flags = {c: (present or {}).get(c, F.col(c).isNotNull()) for c in fields}
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in fields], *[flags[c].alias(f"_s_{c}") for c in fields])
    joined = base.join(p, key, "left")
    return joined.select(*[F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(False)), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def duplicates(batch: DataFrame, live: DataFrame, key: str = "_id") -> DataFrame:
    """Rows of an insert batch whose key is live already or stands in the batch twice."""
    again = batch.groupBy(key).count().where("count > 1").select(key)
    return batch.join(live.select(key).unionByName(again).distinct(), key, "left_semi")


def missing(batch: DataFrame, live: DataFrame, key: str = "_id") -> DataFrame:
    """Rows of an update or delete batch whose key is not live."""
    return batch.join(live.select(key), key, "left_anti")


def without(live: DataFrame, deleted: DataFrame, key: str = "_id") -> DataFrame:
    """Live rows but those of the deleted keys."""
    return live.join(deleted.select(key), key, "left_anti")


def posting_list(df: DataFrame, field: str, key: str) -> DataFrame:
    """Per value of a field: count, least and greatest key (an index entry without its unbounded list)."""
    return df.groupBy(field).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def ordered_dump(df: DataFrame, field: str, key: str) -> DataFrame:
    """(field, key, place): all entries of an index in the order of field, then key. A posting list is a run of places,
    however long."""
    return numbered(df.where(F.col(field).isNotNull()).select(field, key).orderBy(field, key))


def numbered(ordered: DataFrame) -> DataFrame:
    """Rows of a DataFrame that ends in orderBy with `place`, from 1. Sorted partitions are checkpointed; a place is that
    in the partition plus the sizes of the partitions before, of which there is one row each, so that no window sees all
    rows."""
    spark = ordered.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        there = spark.conf.get("spark.checkpoint.dir", None)
        if not there and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(there or f"{tempfile.gettempdir()}/quillon-checkpoints")
    held = ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).checkpoint()
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = held.join(F.broadcast(before), "_part")
    return joined.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of the least keys with their rank; a top-k before the rank, which then sees n rows."""
    return df.orderBy(key).limit(n).withColumn("rank", F.row_number().over(W.orderBy(key)).cast("long"))
