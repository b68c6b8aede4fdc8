"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources share a total by weight, never above `cap` times their size; the excess is shared anew by weight
(water filling, in closed form over the sources sorted by the level at which they are full). Inside a source
the length bands share its target the same way, which gives each document an expected number of copies. Its
whole part is taken for certain. The fraction p is the inclusion probability of Pareto order sampling: with
a random u per document, documents rank by the odds of u divided by the odds of p, and the prefix of the
ranking whose words end nearest to the source's remaining words is taken.

The ranking is cut without sorting a source in one place: sums over 1024 bins of the rank find the bin where
the target falls, sums over 1024 sub-bins of it find the sub-bin, and only that sub-bin is sorted.

Defined results: null and empty texts have size 0 and give no words; a null source is the last source; u
depends on doc_id, text and seed alone, so reruns agree and fully equal rows are taken together; an empty
table gives an empty table; further columns are ignored by `mix` and kept by `sample`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import computed, cut, join_small, words

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"
#: Length bands: texts of fewer words than the bound weigh so much; the last holds the rest.
BANDS = ((64, 1.0), (1024, 2.0), (None, 1.5))
BINS = 1024


def fill(df: DataFrame, group: list[str], cap: str, weight: str, total: str, out: str) -> DataFrame:
    """Add column out: the share of `total` by `weight`, none above `cap`, within each group. Rows that are
    full sit first when sorted by cap / weight; the level is the first one that its row can hold."""
    df = df.withColumn("_full_at", F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(0.0)))
    w = W.partitionBy(*group).orderBy("_full_at")
    df = df.withColumn("_before", F.coalesce(F.sum(cap).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    df = df.withColumn("_rest", F.sum(weight).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
    df = df.withColumn("_level", F.when(F.col("_rest") > 0, (F.col(total) - F.col("_before")) / F.col("_rest")))
    df = df.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "_level"))).over(W.partitionBy(*group))["_level"])
    level = F.coalesce("_level", F.lit(float("inf")))
    return df.withColumn(out, F.when(F.col("_full_at") <= level, F.col(cap)).otherwise(F.col(weight) * level)).drop("_full_at", "_before", "_rest", "_level")


def band(size: Column) -> Column:
    out = F.lit(len(BANDS) - 1)
    for i, (bound, _) in reversed(list(enumerate(BANDS[:-1]))):
        out = F.when(size < bound, F.lit(i)).otherwise(out)
    return out


def draw(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with _size, _band, _hex (a digest of seed, doc_id and text) and _u in (0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    df = docs.withColumn("_size", F.size(words(F.col("text"))).cast("long")).withColumn("_band", band(F.col("_size"))).withColumn("_hex", digest)
    return df.withColumn("_u", (F.conv(F.substring("_hex", 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52)))


def targets(drawn: DataFrame) -> DataFrame:
    """Per source and band: source_size, target, _whole, _p (inclusion probability of one more copy) and
    _want (words of the source still wanted from the ranking). One row per source and band; the order of
    the sources by code point needs all of these few rows in one place."""
    bands = drawn.groupBy(F.col("source").alias("_source"), F.col("_band").alias("_b")).agg(F.sum("_size").alias("_words"))
    sources = bands.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    sources = sources.withColumn("_n", F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), ((F.col("_n") - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = sources.withColumns({"_w": weight, "_cap": F.lit(CAP) * F.col("source_size"), "_total": F.lit(SHARE) * F.sum("source_size").over(W.partitionBy())})
    sources = fill(sources, [], "_cap", "_w", "_total", "target").select(F.col("_source").alias("_s"), "source_size", "target")
    rows = bands.join(sources, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumns({"_bw": F.element_at(F.array(*[F.lit(x) for _, x in BANDS]), F.col("_b") + 1) * F.col("_words"), "_cap": F.lit(CAP) * F.col("_words")})
    rows = fill(rows, ["_source"], "_cap", "_bw", "target", "_share")
    copies = F.when(F.col("_words") > 0, F.least(F.lit(CAP), F.col("_share") / F.col("_words"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("_whole", F.floor(copies).cast("int")).withColumn("_p", copies - F.floor(copies))
    rows = rows.withColumn("_want", F.sum(F.col("_p") * F.col("_words")).over(W.partitionBy("_source")))
    return rows.select("_source", "_b", "source_size", "target", "_whole", "_p", "_want")


def rank(u: Column, p: Column) -> Column:
    """Pareto's rank q = odds(u) / odds(p), as q / (1 + q) so that it stays below 1; null where p is 0."""
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when(p > 0, q / (1 + q))


def _crossing(df: DataFrame, by: str, bin_: Column) -> DataFrame:
    """Per source the bin in which its running words reach _want, and the words before it."""
    sums = df.groupBy("_source", bin_.alias(by)).agg(F.sum("_size").alias("_in"), F.first("_left").alias("_left"))
    w = W.partitionBy("_source").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(w), F.lit(0)))
    hit = (F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_in") >= F.col("_left"))
    return sums.where(hit).select(F.col("_source").alias("_s"), F.col(by), (F.col("_left") - F.col("_before")).alias("_now"))


def cuts(ranked: DataFrame) -> DataFrame:
    """Per source the last (_v, _hex) of the ranking that is taken. ranked: _source, _size, _v, _hex, _want."""
    one, two = F.floor(F.col("_v") * BINS).cast("int"), (F.floor(F.col("_v") * (BINS * BINS)) % BINS).cast("int")
    df = ranked.where("_v is not null and _size > 0").withColumn("_left", F.col("_want"))
    for by, bin_ in (("_bin1", one), ("_bin2", two)):
        at = cut(_crossing(df, by, bin_))
        df = join_small(df, at, F.col("_source").eqNullSafe(F.col("_s")) & (bin_ == F.col(by)), "inner").drop("_s", by).withColumn("_left", F.col("_now")).drop("_now")
        if by == "_bin1":
            bins = at.select("_s", F.col("_bin1"))
        else:
            bins = join_small(bins, at.select(F.col("_s").alias("_t"), "_bin2"), F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
    w = W.partitionBy("_source").orderBy("_v", "_hex").rowsBetween(W.unboundedPreceding, -1)
    mid = F.coalesce(F.sum("_size").over(w), F.lit(0)) + F.col("_size") / 2
    last = df.withColumn("_mid", mid).where("_mid <= _left").groupBy("_source").agg(F.max(F.struct("_v", "_hex")).alias("_last"))
    out = bins.join(last, F.col("_s").eqNullSafe(F.col("_source")), "left")
    floor = (F.col("_bin1") * F.lit(float(BINS)) + F.coalesce("_bin2", F.lit(0))) / F.lit(float(BINS * BINS))  # all before the sub-bin is taken
    return out.select("_s", floor.alias("_floor"), "_last")


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Per source and band what `apply` needs; bounded by sources times bands."""
    slim = cut(draw(docs.select("doc_id", "text", "source"), seed).select("source", "_size", "_band", "_hex", "_u"))
    return _plan(slim)


def _plan(slim: DataFrame) -> DataFrame:
    rows = cut(targets(slim))
    at = join_small(slim, rows, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_band") == F.col("_b")), "inner")
    ends = cuts(at.select("_source", "_size", "_hex", "_want", rank(F.col("_u"), F.col("_p")).alias("_v")))
    return cut(join_small(rows, ends, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def copies(drawn: DataFrame, rows: DataFrame) -> DataFrame:
    """drawn with source_size, target and _copies."""
    df = join_small(drawn, rows, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_band") == F.col("_b")))
    v = rank(F.col("_u"), F.col("_p"))
    more = (v < F.col("_floor")) | (F.struct(v.alias("_v"), F.col("_hex").alias("_hex")) <= F.col("_last"))
    more = v.isNotNull() & F.coalesce(more, F.lit(False))
    return df.withColumn("_copies", F.coalesce(F.col("_whole"), F.lit(0)) + F.when(more, 1).otherwise(0))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    slim = cut(draw(docs.select("doc_id", "text", "source"), seed).drop("text"))
    df = copies(slim, _plan(slim))
    return df.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


def sample(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with the columns of docs."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()]).withColumns({c: F.col(own[c]) for c in ("doc_id", "text", "source")})
    df = copies(computed(draw(named, seed)), plan(docs, seed))
    repeated = df.where("_copies > 0 and _computed >= 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))))
    return repeated.select(*[F.col(x).alias(c) for c, x in own.items()])
