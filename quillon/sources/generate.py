"""Synthetic documents for trials: n rows from spark.range, the same for the same seed."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: City and country go together.
PLACES = (("mexico city", "mx"), ("guadalajara", "mx"), ("new york", "us"), ("austin", "us"), ("madrid", "es"), ("lyon", "fr"))
NAMES = ("quentin", "rosa", "stefan", "tamsin", "ulla", "viktor", "wanda", "yusuf")
CATEGORIES = ("tech", "food", "travel", "music")


def documents(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    def pick(values: tuple, salt: int):
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    def number(low: int, high: int, salt: int):
        return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(high - low + 1)) + low).cast("double")

    place = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(3)), F.lit(len(PLACES)))
    at = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in PLACES]), (place + 1).cast("int"))
    return spark.range(n).select(
        F.format_string("doc-%012d", "id").alias("_id"), pick(NAMES, 1).alias("name"), number(20, 64, 2).alias("age"), at(0).alias("city"), at(1).alias("country"),
        pick(CATEGORIES, 4).alias("category"), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(5)), F.lit(2)) == 1).alias("active"), number(0, 99, 6).alias("score"), F.col("id").cast("double").alias("seq"),
    )


def main() -> None:
    """python -m quillon.sources.generate N PATH: seed a store with N documents."""
    from quillon.operators.log import INSERT

    spark = SparkSession.builder.appName("quillon").getOrCreate()
    made = documents(spark, int(sys.argv[1]))
    rows = made.select(F.monotonically_increasing_id().alias("seq"), F.lit(INSERT).alias("op"), "_id", F.to_json(F.struct(*made.columns)).alias("doc"))
    rows.write.parquet(f"{sys.argv[2]}/log/gen=0/batch={0:020d}")


if __name__ == "__main__":
    main()
