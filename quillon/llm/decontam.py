"""Benchmark decontamination, in DataFrame functions only.

The windows of the benchmark items (`size` normalised words; a shorter item is one window of its own length)
form a set of 64-bit hashes that is broadcast: at most HASH_BYTES at once, counted first, and in slices with a pass
over the documents each where the benchmarks have more. The windows of every document are probed against it; only
those that hit carry their words on, to be verified word by word. Words or whole documents are then removed. No window
that misses is ever shuffled.

Defined results: null texts have no words; a null item_id gives hits but no item; equal item_ids are one
item; documents with equal doc_id are told apart by their text, and fully equal rows each get the same
result; empty tables give no hits; further columns are ignored by `scan` and kept by `remove_documents` and
`remove_spans`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import NON_WORD, ascii_lower, cut, join_small, let, running_max

SIZE = 10
#: Bytes of window hashes, eight each, that are broadcast at once.
HASH_BYTES = 64 << 20


def normalised(text):
    """Words of 0-9, a-z and characters beyond ASCII, after lower-casing A-Z."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def window_hash(ws, i, n: int):
    """Hash of the n words from i on; words past the end leave the hash as it is. (slice() would copy the
    whole array each time.)"""
    return F.xxhash64(*[F.get(ws, i + k) for k in range(n)])


def window_set(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct windows: w_hash, w_words, w_size and the sorted item_ids that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), normalised(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(size))
    rows = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.slice("ws", i, n))).alias("w_words"))
    return rows.groupBy("w_words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(window_hash(F.col("w_words"), F.lit(0), size).alias("w_hash"), "w_words", F.size("w_words").alias("w_size"), "items")


def _key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t_hash")


def _windows(n: int):
    """Size n and the hashes of the windows of n words of `ws`, in order."""
    at = F.sequence(F.lit(0), F.greatest(F.size("ws") - n, F.lit(0)))
    hashes = F.transform(at, lambda i: window_hash(F.col("ws"), i, n))
    return F.struct(F.lit(n).alias("n"), F.when(F.size("ws") >= n, hashes).otherwise(F.array().cast("array<bigint>")).alias("hs"))


def _survivors(docs: DataFrame, hashes: DataFrame, sizes: list[int]) -> DataFrame:
    """The windows of docs whose hash and size are in `hashes` (broadcast): doc_id, t_hash, at, n, h, words."""
    df = docs.select("doc_id", _key(), normalised(F.col("text")).alias("ws"))
    # The arrays are made in a projection of their own, as generators over plain columns are compiled; the
    # outer kind keeps Spark from inferring a filter that would compute the arrays twice.
    df = df.withColumn("sized", F.array(*[_windows(n) for n in sizes]))
    one = df.select("doc_id", "t_hash", "ws", F.explode_outer("sized").alias("s")).select("doc_id", "t_hash", "ws", "s.n", "s.hs")
    probes = one.select("doc_id", "t_hash", "ws", "n", F.posexplode_outer("hs").alias("at", "h"))
    found = probes.join(F.broadcast(hashes), (F.col("h") == F.col("w_hash")) & (F.col("n") == F.col("w_size")), "left_semi")
    return found.select("doc_id", "t_hash", "at", "n", "h", F.slice("ws", F.col("at") + 1, F.col("n")).alias("words"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document with a hit: doc_id, t_hash (of its text), sorted distinct `spans` (first word from 0,
    number of words) and sorted item ids."""
    windows = cut(window_set(benchmark, size))
    counts = {r["w_size"]: r["count"] for r in windows.groupBy("w_size").count().collect()}  # at most `size` rows
    slices = max(1, -(-8 * sum(counts.values()) // HASH_BYTES))
    hashes = windows.select("w_hash", "w_size").distinct()
    parts = [_survivors(docs, hashes.where(F.pmod("w_hash", F.lit(slices)) == k), sorted(counts) or [size]) for k in range(slices)]
    if slices > 1:  # one slice in memory at a time
        parts = [cut(p) for p in parts]
    found = reduce(DataFrame.unionByName, parts).join(windows, (F.col("h") == F.col("w_hash")) & (F.col("words") == F.col("w_words")))
    found = found.select("doc_id", "t_hash", F.struct("at", "n").alias("span"), "items")
    return found.groupBy("doc_id", "t_hash").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans):
    """Words inside at least one of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(a, s):
        end = F.greatest(a["end"], s["at"] + s["n"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], s["at"])).alias("n"))

    return F.aggregate(spans, start, add)["n"]


def scan(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark, size).select(F.col("doc_id").alias("h_id"), F.col("t_hash").alias("h_hash"), covered(F.col("spans")).alias("hit"), "items")
    slim = docs.select("doc_id", _key(), F.size(normalised(F.col("text"))).cast("long").alias("n_words"))
    joined = slim.join(found, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("t_hash") == F.col("h_hash")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("hit").isNotNull().alias("contaminated"),
    )


def _with_hits(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    found = cut(hits(docs, benchmark, size).select(F.col("doc_id").alias("_h_id"), F.col("t_hash").alias("_h_hash"), F.col("spans").alias("_spans")))
    return join_small(docs, found, F.col("doc_id").eqNullSafe(F.col("_h_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_h_hash")))


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents without a hit."""
    return _with_hits(docs, benchmark, size).where("_spans is null").select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """All documents; in those with a hit the text becomes their words outside the hits, joined by spaces."""
    joined = _with_hits(docs, benchmark, size)

    def outside(ws, spans, ends):
        def gap(s, i):
            last = F.coalesce(F.get(ends, i - 1), F.lit(0)).cast("int")
            return F.slice(ws, last + 1, F.greatest(s["at"] - last, F.lit(0)))

        return F.concat(F.flatten(F.transform(spans, gap)), F.slice(ws, F.element_at(ends, -1).cast("int") + 1, F.size(ws)))

    ends = running_max(F.transform("_spans", lambda s: (s["at"] + s["n"]).cast("long")))
    kept = let(normalised(F.col("text")), lambda ws: let(F.col("_spans"), lambda spans: let(ends, lambda e: outside(ws, spans, e))))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(kept, " "))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
