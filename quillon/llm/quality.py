"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares a metric of a text with a cutoff. The cutoffs of all rules form one fixed sequence from lenient to
strict, a rule tightened at each step, and a step rejects what any rule rejects there. Per stratum the steps are
tested in this order on labelled good documents, by exact binomial tests that a step rejects at most `alpha` of the
good documents; the last step that passes gives the cutoffs. Steps are nested, so that neither cutoffs nor rules share
`delta` or `alpha`; only strata share `delta` (Bonferroni). With probability 1 - delta no stratum loses more than
`alpha` of its good documents. Strata with fewer good documents than any proof needs (`least_labels`) are tested
together, and their shared cutoffs are proven for their good documents taken together, not for each of them. Good
documents are those that pass the base rule. A stratum without good labelled documents has no cutoffs.

Defined results: a null or empty text has no words and fails the base rule; a null stratum is a stratum of
its own; null or repeated labels are settled by the lowest label of a doc_id, labels of unknown documents
count for nothing; repeated rows are judged one by one; an empty table gives an empty table; further columns
are ignored by `verdicts` and kept by `keep`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, join_small, let, words

WINDOW = 8
#: Rule -> (metric over the measured columns, grid of cutoffs from strict to lenient).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.28, 0.3)),
    "shouting": ("n_bangs / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)),
    "long_words": ("word_chars / greatest(n_words, 1)", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
}
ALPHA, DELTA = 0.02, 0.05
#: Beyond this many rejections the tail is summed from its largest term down, and not from the first one up.
EXACT_TERMS = 50_000


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measured columns to docs, row by row."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", words(F.col(text))).withColumn("n_words", F.size("_words").cast("long"))
    full = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", full)
    many = F.size("_words") >= WINDOW
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
    df = df.withColumn("_windows", F.when(many, windows))
    return df.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long").alias("n_bangs"),
    )


def _covered(windows: Column) -> Column:
    """Words in windows whose hash stands in the array at least twice: the hashes are sorted with their
    positions, neighbours compared, and the gaps between kept positions summed up to the window's length."""
    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(a: Column) -> Column:
        def equal(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(a, k)["h"] == x["h"], F.lit(False))

        return F.filter(a, lambda x, k: equal(x, k - 1) | equal(x, k + 1))

    at = let(order, lambda a: F.array_sort(F.transform(twice(a), lambda x: x["i"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")))["n"]


def base_failed(repeat_percent: int = 30, least: int = 20) -> Column:
    return (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact but for rounding: summed term by term in logarithms. Beyond EXACT_TERMS terms
    the sum starts at term k and goes down as far as terms count: term k - m is below exp(-m (m - 1) / 2 k) of
    term k, under 1e-18 of it after 9.2 sqrt(k) terms."""
    odds = math.log(p) - math.log1p(-p)

    def add(a: Column, j: Column) -> Column:
        term = a["term"] + F.log(n - j + 1) - F.log(j) + F.lit(odds)
        top = F.greatest(a["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(a["total"], term) - top))).alias("total"))

    first = n * F.lit(math.log1p(-p))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    exact = F.exp(F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add)["total"])

    def stirling(x: Column) -> Column:
        d = x.cast("double")
        return 1 / (12 * d) - 1 / (360 * d * d * d)

    def deviance(x: Column) -> Column:
        return (1 + x) * F.log1p(x) - x

    def down(a: Column, j: Column) -> Column:
        term = a["term"] * (k - j + 1) / (n - k + j) * F.lit((1 - p) / p)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    off = k - n * p
    top = stirling(n) - stirling(k) - stirling(n - k) + 0.5 * (F.log(n / k) - F.log(2 * math.pi * (n - k))) - n * p * deviance(off / (n * p)) - n * (1 - p) * deviance(-off / (n * (1 - p)))
    lower = F.sequence(F.lit(1).cast("long"), F.least(k, F.ceil(9.2 * F.sqrt(k)).cast("long") + 2))
    large = F.exp(top) * F.aggregate(lower, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), down)["total"]
    return F.when(k >= n * p, F.lit(1.0)).when(k > EXACT_TERMS, large).otherwise(exact)


def _good(measured: DataFrame, labels: DataFrame) -> DataFrame:
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality = 1")
    return measured.join(good, "doc_id", "left_semi")


def _strictest(proven: DataFrame) -> DataFrame:
    best = proven.groupBy("_stratum", "c.rule").agg(F.min("c.cutoff").alias("cutoff"))
    return best.groupBy("_stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def steps() -> list[tuple[str, float]]:
    """The fixed sequence: (rule, cutoff), by turns, each rule from lenient to strict."""
    longest = max(len(grid) for _, grid in RULES.values())
    return [(rule, grid[-1 - level]) for level in range(longest) for rule, (_, grid) in RULES.items() if level < len(grid)]


def least_labels(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good documents that a proof needs where none of them is rejected."""
    return math.ceil(math.log(delta / (strata + 1)) / math.log1p(-alpha))


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: _stratum and a map `cutoffs` from rule to its proven cutoff (absent: none). The strata and
    their pool share delta. measured: doc_id, the stratum and the measured columns; labels: doc_id and quality (1: good)."""
    path = steps()
    # the first step that rejects a document; later ones are stricter and reject it too
    first = F.least(*[F.when(F.expr(RULES[rule][0]) > c, F.lit(i)) for i, (rule, c) in enumerate(path)])
    known = _good(measured, labels).where(~base_failed()).select(F.coalesce(F.col(stratum), F.lit("\x00")).alias("_stratum"), F.coalesce(first, F.lit(len(path))).alias("_first"))
    names = [f"k{i}" for i in range(len(path))]
    table = cut(known.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("_first") <= i).cast("long")).alias(k) for i, k in enumerate(names)]))
    strata = max(1, table.count())
    table = table.withColumn("_group", F.when(F.col("n") >= least_labels(strata, alpha, delta), F.col("_stratum")))  # null: the pool
    groups = table.groupBy("_group").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    cells = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(k).alias("k")) for (rule, c), k in zip(path, names)])
    # counts grow along the sequence, so that the steps that pass are its beginning
    proven = groups.select(F.col("_group").alias("_stratum"), "n", F.explode(cells).alias("c")).where(tail(F.col("n"), F.col("c.k"), alpha) <= delta / (strata + 1))
    found = cut(_strictest(proven).withColumnRenamed("_stratum", "_of"))
    return join_small(table.select("_stratum", "_group"), found, F.col("_group").eqNullSafe(F.col("_of")), "inner").select("_stratum", "cutoffs")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Add base_failed and kept to the measured rows."""
    joined = join_small(measured, cutoffs, F.coalesce(F.col(stratum), F.lit("\x00")) == F.col("_stratum"))
    broken = F.lit(False)
    for rule, (metric, _) in RULES.items():
        broken = broken | F.coalesce(F.expr(metric) > F.col("cutoffs")[rule], F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~broken).drop("_stratum", "cutoffs")


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Measured columns, base_failed and kept of every document; texts are read once."""
    measured = cut(measure(docs.select("doc_id", "text", stratum)).drop("text"))
    return judge(measured, thresholds(measured, labels, stratum, alpha, delta), stratum)


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, with their columns. Texts are measured once; a verdict depends on text and
    stratum alone and comes back to its documents by 128 bits of their hash."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    parts = [F.coalesce(F.col(own["text"]), F.lit("")), F.col(own[stratum])]
    keyed = held.withColumns({"_k": F.xxhash64(*parts), "_l": F.xxhash64(F.lit(1), *parts)})
    slim = keyed.select(F.col(own["doc_id"]).alias("doc_id"), parts[0].alias("text"), F.col(own[stratum]).alias(stratum), F.col("_k").alias("_a"), F.col("_l").alias("_b"))
    measured = cut(measure(slim).drop("text"))
    gone = cut(judge(measured, thresholds(measured, labels, stratum, alpha, delta), stratum).where("not kept").select("_a", "_b").distinct())
    kept = join_small(keyed, gone, (F.col("_k") == F.col("_a")) & (F.col("_l") == F.col("_b")), "left_anti")
    return kept.select(*[F.col(x).alias(c) for c, x in own.items()])
