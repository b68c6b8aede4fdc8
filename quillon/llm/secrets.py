"""Secret scan, in DataFrame functions only.

Base kinds are found by pattern. Further spans come from two character Markov models, one of random strings and
one of ordinary identifiers, trained from labelled samples. In the text outside the base spans every long run of
key characters is cut into the segments whose log-likelihood ratio, summed over their transitions, is greatest; a
segment is closed where the sum falls below 0 or by DROP below its peak, and is a secret if the peak reaches the
model's cutoff. So an ordinary path in front of a key does not dilute it. The cutoff is chosen on labelled
samples held out from training: halfway between the peaks that FALSE_SHARE of the ordinary ones exceed and that
MISSED_SHARE of the random ones fall short of.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one; an empty table gives
an empty table; further columns are ignored by `scan` and kept by `redact`; lengths and offsets are code points.
Spans of one kind never overlap, and random ones overlap no other. All work is linear in a text's length but for
the sort of its spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import let, running_max, running_sum

# Fixed values of the contract: kind, pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

#: Symbols of the Markov models; a candidate is a run of these.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: A segment ends where the summed ratio is so far below its peak.
DROP = 12.0
#: Shares of held-out samples, ordinary and random, between whose peaks the cutoff lies.
FALSE_SHARE, MISSED_SHARE = 0.001, 0.01
#: Samples of each label; as many again are held out.
SAMPLES = 4000
#: A segment is widened to the ends of its alphanumeric words, by at most so many characters.
WIDEN = 64

#: Parts of ordinary identifiers, and syllables of ordinary words, for the labelled samples.
PARTS = (
    "get set make user name list item count index value file path read write open close start stop load save update delete insert "
    "query table column row key session request response handler manager factory builder service client server config option error "
    "message event stream buffer cache thread process queue task worker node graph tree root child parent left right first last next "
    "previous total average min max sum time date year month day hour minute second width height color image text string number array "
    "object function method class module package version test check valid format parse print debug trace level default public private "
    "static abstract interface internal external global local remote network socket address port host domain email phone account order "
    "payment product price customer supplier region nation part line document page label http https www com org example content type"
).split()
SYLLABLES = (
    "the ing and ion ent ver sch heit ung lich keit tion ment eau les que con para ado ble are tis ter her est mos nte cion bre ville gen "
    "ein aus ab zer stand wort land buch haus berg fall zeit recht ous re ure ance elle oir age ique able ness ship ful less ward ty al ic"
).split()


@dataclass(frozen=True)
class Model:
    """Log ratio of the transition probabilities, random over ordinary, of each ordered pair of SYMBOLS, and the
    least sum of a secret."""

    ratios: tuple[float, ...]
    cutoff: float


def samples(spark: SparkSession, n: int = SAMPLES, first: int = 0) -> DataFrame:
    """Labelled samples with the numbers from `first` on: `n` random strings (from digests of the numbers, in
    five alphabets and lengths of 20 to 42) and `n` ordinary runs (identifiers in snake, kebab, camel case and as
    paths, compound words, numbers, dates, repeated characters). Columns sample, secret."""
    ids = spark.range(first, first + n)

    def draw(k: int, choices: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(choices)).cast("int")

    key = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256))), "=\r\n", "")
    bare = F.regexp_replace(key, "[+/]", "")
    more = F.sha2(F.concat(F.lit("more"), F.col("id").cast("string")), 256)
    random = F.element_at(F.array(key, F.translate(key, "+/", "-_"), bare, F.upper(bare), F.upper(more)), (F.col("id") % 5 + 1).cast("int"))

    def pick(words: list[str], k: int) -> Column:
        return F.element_at(F.split(F.lit(" ".join(words)), " "), draw(k, len(words)) + 1)

    five = [pick(PARTS, k) for k in range(5)]
    word = F.concat(*[pick(SYLLABLES, 10 + k) for k in range(7)])
    digits = F.lpad(F.abs(F.xxhash64("id", F.lit(30))).cast("string"), 19, "7")
    number = draw(31, 10_000).cast("string")
    plain = F.element_at(
        F.array(
            F.concat_ws("_", *five), F.concat_ws("-", *five), F.concat(five[0], *[F.initcap(x) for x in five[1:]]), F.concat_ws("/", *five), F.upper(F.concat_ws("_", *five)), F.concat(*five),
            word, F.initcap(word), F.concat(digits, number, digits), F.concat_ws("-", F.lit("2024"), number, number, number, F.lit("00"), number), F.repeat(F.substring(F.lit(SYMBOLS), draw(32, len(SYMBOLS)) + 1, F.lit(1)), draw(33, 40) + 20),
            F.concat(five[0], F.lit("/"), five[1], number, F.lit("/"), word, F.lit("-"), number),
        ),
        (F.col("id") % 12 + 1).cast("int"),
    )
    return ids.select(F.substring(random, F.lit(1), 20 + draw(34, 23)).alias("sample"), F.lit(True).alias("secret")).unionAll(ids.select(plain, F.lit(False)))


def ratios(labelled: DataFrame, smoothing: float = 0.5) -> tuple[float, ...]:
    """The log ratios of the two models. What is collected is one count per label and pair, at most
    2 * 66 * 66 rows at any input size."""
    s = F.transform(F.split("sample", ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.struct(F.element_at(s, i).alias("a"), F.coalesce(F.try_element_at(s, i + 1), F.lit(0)).alias("b")))
    rows = labelled.where("sample is not null and secret is not null").select("secret", F.explode(pairs).alias("p")).where("p.a > 0 and p.b > 0").groupBy("secret", "p.a", "p.b").count().collect()
    k = len(SYMBOLS)
    counts = {True: [[smoothing] * k for _ in range(k)], False: [[smoothing] * k for _ in range(k)]}
    for r in rows:
        counts[r["secret"]][r["a"] - 1][r["b"] - 1] += r["count"]
    return tuple(math.log(counts[True][a][b] / sum(counts[True][a])) - math.log(counts[False][a][b] / sum(counts[False][a])) for a in range(k) for b in range(k))


def train(labelled: DataFrame, held_out: DataFrame) -> Model:
    """Ratios from labelled samples; the cutoff from held-out ones (two numbers are collected). Without samples of a
    label on one side the cutoff is the bound of the other, or 0."""
    table = ratios(labelled)
    peak = F.coalesce(F.array_max(F.transform(segments(F.col("sample"), Model(table, 0.0)), lambda s: s["sum"])), F.lit(0.0))
    of = held_out.where("sample is not null").select(F.when(F.col("secret"), peak).alias("random"), F.when(~F.col("secret"), peak).alias("plain"))
    sides = of.agg(F.percentile("plain", F.lit(1 - FALSE_SHARE)).alias("low"), F.percentile("random", F.lit(MISSED_SHARE)).alias("high")).first()
    known = [x for x in sides if x is not None]
    return Model(table, sum(known) / len(known) if known else 0.0)


def default_model(spark: SparkSession, n: int = SAMPLES) -> Model:
    return train(samples(spark, n), samples(spark, n, first=n))


def segments(run: Column, model: Model) -> Column:
    """(start, end, sum) of the segments of a run of SYMBOLS that reach the cutoff."""
    k = len(SYMBOLS)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model.ratios)), ",").cast("array<double>")
    numbers = F.split(F.lit(",".join(str(SYMBOLS.find(chr(i)) + 1) for i in range(128))), ",").cast("array<int>")
    none = F.array().cast("array<struct<start:int,end:int,sum:double>>")

    def steps(codes: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            before = F.get(codes, i - 1)
            return F.when((i > 0) & (before > 0) & (x > 0), F.element_at(table, (before - 1) * k + x)).otherwise(F.lit(0.0))

        return F.transform(codes, step)

    def closed(a: Column) -> Column:
        return F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), a["to"].alias("end"), a["best"].alias("sum"))))

    def add(a: Column, x: Column) -> Column:
        total = a["sum"] + x
        fell, rose = (total < 0) | (total < a["best"] - DROP), total > a["best"]
        return F.struct(
            (a["at"] + 1).alias("at"),
            F.when(fell, 0.0).otherwise(total).alias("sum"),
            F.when(fell, a["at"]).otherwise(a["from"]).alias("from"),
            F.when(fell, 0.0).when(rose, total).otherwise(a["best"]).alias("best"),
            F.when(fell | rose, a["at"] + 1).otherwise(a["to"]).alias("to"),
            F.when(fell & (a["best"] >= model.cutoff), closed(a)).otherwise(a["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0.0).alias("best"), F.lit(1).alias("to"), none.alias("out"))
    codes = F.transform(F.split(run, ""), lambda c: F.coalesce(F.get(numbers, F.ascii(c)), F.lit(0)))
    return F.aggregate(let(codes, steps), zero, add, lambda a: F.when(a["best"] >= model.cutoff, closed(a)).otherwise(a["out"]))


def _widened(run: Column, found: Column) -> Column:
    """The segments of a run, each up to the ends of the alphanumeric words it starts and ends in, disjoint."""

    def of(chars: Column, segs: Column) -> Column:
        def right(s: Column, i: Column) -> Column:
            tail = F.regexp_extract(F.array_join(F.slice(chars, s["end"] + 1, F.lit(WIDEN)), ""), "^[A-Za-z0-9]*", 0)
            return F.least(s["end"] + F.length(tail), F.get(segs, i + 1)["start"])

        def left(s: Column) -> Column:
            head = F.regexp_extract(F.array_join(F.slice(chars, F.greatest(s["start"] - WIDEN, F.lit(0)) + 1, F.least(s["start"], F.lit(WIDEN))), ""), "[A-Za-z0-9]*$", 0)
            return s["start"] - F.length(head)

        ends = F.transform(segs, right)
        return let(ends, lambda e: F.transform(segs, lambda s, i: F.struct(F.greatest(left(s), F.coalesce(F.get(e, i - 1), F.lit(0))).alias("start"), F.get(e, i).alias("end"))))

    return let(F.split(run, ""), lambda chars: let(found, lambda segs: of(chars, segs)))


def find(text: Column, pattern: str, matches: Column) -> Column:
    """Spans (start, end, match) of all matches, at least one: what split leaves between them gives the offsets."""

    def spans(ends: Column) -> Column:
        return F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match")))

    def steps(pieces: Column) -> Column:
        return F.transform(matches, lambda m, i: (F.length(m) + F.length(F.get(pieces, i))).cast("long"))

    return let(running_sum(let(F.split(text, pattern), steps)), spans)


def _blank(text: Column, pattern: str, fills: Column) -> Column:
    """text with its matches replaced by `fills`, in order."""
    return F.array_join(F.zip_with(F.split(text, pattern), fills, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")


def _either(a: Column, b: Column) -> Column:
    """Of two blanked forms of one text the one that is blank where either is (a blank is a space, so that a space of
    the text itself stays one)."""
    both = F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(y == " ", y).otherwise(x)), "")
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def _located(texts: DataFrame, model: Model) -> DataFrame:
    """texts (column _text, not null) with _n_assign, _n_access, _n_hex, _base and _random: sorted spans (start, number of
    kind, end). What a lambda uses more than once is bound by `let` or stands in the array it walks, as Spark would
    compute a projected column anew for each element."""
    text = F.col("_text")
    own = texts.columns
    df = texts.select(*own, *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX))])
    df = df.withColumn("_good", F.when(F.size("_m_assign") > 0, F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE)))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    fills = F.zip_with("_m_assign", "_good", lambda m, k: F.when(k, F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    blanks = {"assign": fills} | {k: F.transform(f"_m_{k}", lambda m: F.repeat(F.lit(" "), F.length(m))) for k in ("access", "hex")}
    cols = []
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX)):
        any_, m = F.size(f"_m_{kind}") > 0, F.col(f"_m_{kind}")
        cols += [F.when(any_, find(text, pattern, m)).otherwise(none).alias(f"_s_{kind}"), F.when(any_, _blank(text, pattern, blanks[kind])).alias(f"_b_{kind}")]
    df = df.select(*own, "_good", *cols)
    good = F.filter(F.zip_with("_s_assign", "_good", lambda s, k: F.when(k, s)), lambda s: s.isNotNull())
    df = df.withColumn("_s_assign", F.when(F.size("_s_assign") > 0, good).otherwise(none))
    df = df.withColumn("_ab", _either(F.col("_b_assign"), F.col("_b_access"))).withColumn("_left", F.coalesce(_either(F.col("_ab"), F.col("_b_hex")), text))
    df = df.withColumn("_runs", F.regexp_extract_all("_left", F.lit(CANDIDATE), F.lit(0)))
    df = df.withColumn("_runs", F.when(F.size("_runs") > 0, find(F.col("_left"), CANDIDATE, F.col("_runs"))).otherwise(none))

    def span(start: Column, kind: str, end: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))

    def tagged(kind: str) -> Column:
        return F.transform(f"_s_{kind}", lambda x: span(x["start"], kind, x["end"]))

    base = F.concat(*map(tagged, KINDS[:3]))
    random = F.flatten(F.transform("_runs", lambda r: F.transform(_widened(r["match"], segments(r["match"], model)), lambda s: span(r["start"] + s["start"], "random", r["start"] + s["end"]))))
    counts = [F.size(f"_s_{k}").cast("long").alias(f"_n_{k}") for k in KINDS[:3]]
    return df.select(*own, *counts, F.array_sort(base).alias("_base"), F.when(F.size("_runs") > 0, random).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("_random"))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    df = _located(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")), model)
    names = F.array(*map(F.lit, KINDS))

    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    return df.select(
        "doc_id",
        *[F.col(f"_n_{k}").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(said(F.col("_base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("_base", "_random"))).alias("spans"),
        F.size("_random").cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, model: Model, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span that `scan` reports replaced by the mask; overlapping spans give one mask. Null texts
    stay null."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    df = _located(held.withColumn("_text", F.coalesce(F.col(own["text"]), F.lit(""))), model).withColumn("_all", F.array_sort(F.concat("_base", "_random")))

    def covered(chars: Column, spans: Column, ends: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ends, i - 1), F.lit(0)).cast("int")
            between = F.array_join(F.slice(chars, before + 1, F.greatest(s["start"].cast("int") - before, F.lit(0))), "")
            return F.when((i > 0) & (s["start"] < before), F.lit("")).otherwise(F.concat(between, F.lit(mask)))

        rest = F.slice(chars, F.element_at(ends, -1).cast("int") + 1, F.size(chars))
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.array_join(rest, ""))

    spans = F.col("_all")
    ends = running_max(F.transform(spans, lambda s: s["end"]))
    masked = let(F.split("_text", ""), lambda chars: let(spans, lambda s: let(ends, lambda e: covered(chars, s, e))))
    text = F.when(F.size("_all") > 0, masked).otherwise(F.col(own["text"]))
    return df.select(*[(text if c == "text" else F.col(x)).alias(c) for c, x in own.items()])
