"""Bloom filter, HyperLogLog and Count-Min sketch as plans whose parts are rows (portable and checkable),
and Spark's own sketches by their side. Hashes are digits of md5, which every engine has."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash32(value: Column, salt: int = 0) -> Column:
    """A 32-bit hash as a long: eight hexadecimal digits of the md5 of the value's text."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1 + 8 * salt, 8), 16, 10).cast("long")


def bloom_size(n: int, fp: float = 0.01) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions for n items at a false-positive rate."""
    n, fp = max(1, n), fp if 0 < fp < 1 else 0.01
    m = 64 * math.ceil(-n * math.log(fp) / math.log(2) ** 2 / 64)
    return m, max(1, round(m / n * math.log(2)))


def bloom_rate(n: int, m: int, k: int) -> float:
    """Expected false-positive rate of m bits with n items."""
    return (1 - math.exp(-k * n / m)) ** k


def bloom_positions(value: Column, m: int, k: int) -> Column:
    """The k bit positions of a value, by double hashing with an odd second hash."""
    h1, h2 = hash32(value), hash32(value, 1).bitwiseOR(F.lit(1).cast("long"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda i: (h1 + i * h2) % m)


def bloom_bits(df: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """The set bits, one row each: at most m rows at any input size."""
    return df.select(F.explode(bloom_positions(F.col(column), m, k)).alias("bit")).distinct()


def bloom_fill(bits: DataFrame, m: int, k: int) -> DataFrame:
    """One row: m, k, popcount (set bits) and the false-positive rate that their share implies."""
    return bits.agg(F.lit(m).cast("long").alias("m"), F.lit(k).cast("long").alias("k"), F.count(F.lit(1)).alias("popcount"), F.pow(F.count(F.lit(1)) / F.lit(float(m)), F.lit(float(k))).alias("rate"))


def bloom_matches(probe: DataFrame, column: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """Rows of probe that may be in the filter: all their bits are set."""
    own = probe.select(column).distinct().withColumn("bit", F.explode(F.array_distinct(bloom_positions(F.col(column), m, k))))
    held = own.join(bits.select("bit", F.lit(1).alias("one")), "bit", "left").groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count("one").alias("hit"))
    return probe.join(held.where("n = hit").select(column), column, "left_semi")


def hll_registers(df: DataFrame, column: str, p: int = 10) -> DataFrame:
    """(reg, rank): per register of the first p bits the most leading zeros of the rest, plus one."""
    h = hash32(F.col(column))
    rest = 32 - p
    tail = h % (1 << rest)
    rank = F.when(tail == 0, rest + 1).otherwise(rest - F.length(F.bin(tail)) + 1).cast("long")
    return df.where(F.col(column).isNotNull()).groupBy(F.floor(h / (1 << rest)).cast("long").alias("reg")).agg(F.max(rank).alias("rank"))


def hll_union(*registers: DataFrame) -> DataFrame:
    """Register-wise maximum."""
    out = registers[0]
    for r in registers[1:]:
        out = out.unionByName(r)
    return out.groupBy("reg").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, p: int = 10) -> DataFrame:
    """One row, estimate: harmonic mean of the registers, linear counting while some are empty and it is small, and
    beyond 2^32 / 30 corrected for values that share a 32-bit hash."""
    m = 1 << p
    sums = registers.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n"))
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("s") + (m - F.col("n")))
    small = F.lit(float(m)) * F.ln(F.lit(float(m)) / (m - F.col("n")))
    top = float(1 << 32)
    large = F.lit(-top) * F.ln(F.lit(1.0) - F.least(raw, F.lit(top - 1)) / F.lit(top))
    return sums.select(F.round(F.when((raw <= 2.5 * m) & (F.col("n") < m), small).when(raw > top / 30, large).otherwise(raw), 6).alias("estimate"))


def cms_cells(df: DataFrame, column: str, width: int = 2000, depth: int = 7, times: str | None = None) -> DataFrame:
    """(row, col, n): counters of a Count-Min sketch, at most width * depth rows. times: a column that says how often a row's
    value is added. Values are counted first, so a frequent value crosses the shuffle once per task."""
    per_value = df.where(F.col(column).isNotNull()).groupBy(column).agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))
    cell = per_value.select("n", F.explode(_cells(F.col(column), width, depth)).alias("c"))
    return cell.groupBy(F.col("c.row").alias("row"), F.col("c.col").alias("col")).agg(F.sum("n").alias("n"))


def _cells(value: Column, width: int, depth: int) -> Column:
    return F.array(*[F.struct(F.lit(r).cast("long").alias("row"), (F.conv(F.substring(F.md5(F.concat(F.lit(f"{r}:"), value.cast("string"))), 1, 8), 16, 10).cast("long") % width).alias("col")) for r in range(depth)])


def cms_estimate(values: DataFrame, column: str, cells: DataFrame, width: int = 2000, depth: int = 7) -> DataFrame:
    """(value, estimate): the least of the value's counters, never below its count."""
    own = values.select(column).distinct().select(column, F.explode(_cells(F.col(column), width, depth)).alias("c")).select(column, F.col("c.row").alias("row"), F.col("c.col").alias("col"))
    return own.join(cells, ["row", "col"], "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def native_sketches(df: DataFrame, column: str) -> DataFrame:
    """Spark's own: approximate distinct count, a mergeable HyperLogLog and a Count-Min sketch (binary)."""
    return df.agg(F.approx_count_distinct(column, 0.0325).alias("distinct"), F.hll_sketch_agg(column, 10).alias("hll"), F.count_min_sketch(column, F.lit(0.0014), F.lit(0.999), F.lit(42)).alias("cms"))
