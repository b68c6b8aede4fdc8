"""Similarity join of documents by the Jaccard coefficient of their word shingles, and its components.

Candidates share prefix tokens under several global orders of the shingles. In a global order a pair of
coefficient t or more shares a token among the first n - ceil(t n) + 1 of each side. The first order puts rare
shingles first (by a count sketch over all documents) and is the join key. Every class carries its prefixes under
further, seeded orders with it, as 32 bits of each token (a superset of what the tokens share): a pair must share
prefix tokens under each of them too, and have signatures that allow the coefficient, before any set is fetched.

Equal sets are one class. Pairs are never listed for a whole group: every list of classes with a common
token is first joined to one leader. Lists whose members are in one component by then are done; the others
are compared across components only, so no link between components is lost.

1. One pass over the texts: set size, class, signature, prefixes under the further orders, and a fixed-size count
   sketch. A class is a 64-bit digest; digests that belong to sets of different second digests are replaced.
2. One pass: prefix tokens by the first order, as compressed blocks by token range; per range the leader of
   each token and its pairs, and the members of longer lists.
3. Prefixes and signatures drop pairs. Of the classes still paired the sets are rebuilt from their texts;
   pairs are verified; links become components.
4. Lists that still span components are compared across components, and what remains is verified the same way.

Defined results: a null or empty text, or one without words, has no shingles and links with nothing (its
component is its own doc_id); a null doc_id takes part but never names a component unless all ids in it are
null; rows of equal doc_id are separate documents; an empty table gives an empty table; further columns are
ignored by `components` and kept by `keep_one`; doc_id may be of any type that has an order.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import bucketed, cut, mix, stored, trim, trimmed, word_hashes

WORDS, PERCENT = 5, 80
#: Seeds of the further orders; their prefixes are the columns p1 and p2.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Counters of the sketch (a power of two) and the blocks it is merged in.
COUNTERS, BLOCKS = 1 << 20, 128
LINKS = "a long, b long"
#: Classes of a block of a list.
LIST_BLOCK = 256
#: Keys of texts that may be broadcast, eight bytes each.
KEY_ROWS = 1_000_000


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, n: int = WORDS):
        self.n = n

    def __call__(self, text: str | None) -> np.ndarray:
        h = word_hashes(text)
        if not len(h):
            return h
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out = np.sort(mix(out))
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def digests(tokens: np.ndarray) -> tuple[int, int, int]:
    """Three 64-bit digests of a set: its class, a check of that, and the class in its place where the check fails."""
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=24).digest()
    return tuple(int.from_bytes(raw[i : i + 8], "little", signed=True) for i in (0, 8, 16))


def class_id(tokens: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """The class of a set; shared: digests that different sets have."""
    cid, _, other = digests(tokens)
    return other if cid in shared else cid


def further(tokens: np.ndarray, percent: int) -> list[bytes]:
    """Per further order the sorted distinct upper halves of the prefix tokens' ranks."""
    out = []
    for seed in SEEDS:
        p = prefix_size(len(tokens), percent) if len(tokens) else 0
        rank = mix(tokens ^ np.uint64(seed))
        out.append(np.unique((np.partition(rank, p - 1)[:p] if p else rank) >> np.uint64(32)).astype(np.uint32).tobytes())
    return out


def signature(tokens: np.ndarray) -> bytes:
    """A bit per bucket of the tokens' first bits that holds a token; four to eight buckets to a token."""
    bits = min(20, max(6, (4 * len(tokens)).bit_length()))
    on = np.zeros(1 << bits, np.uint8)
    on[(tokens >> np.uint64(64 - bits)).astype(np.int64)] = 1
    return np.packbits(on).tobytes()


def may_link(a: bytes, b: bytes, n: int, m: int, percent: int = PERCENT) -> bool:
    """False where the signatures prove that too few tokens are common: a bucket that only one side fills
    holds at least one token that the other lacks."""
    if len(a) > len(b):
        a, b, n, m = b, a, m, n
    x = np.frombuffer(a, np.uint64)
    if len(a) == len(b):
        y = np.frombuffer(b, np.uint64)
    else:  # fold the finer one
        y = np.packbits(np.unpackbits(np.frombuffer(b, np.uint8)).reshape(8 * len(a), -1).any(1)).view(np.uint64)
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return 100 * most >= percent * (n + m - most)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def index_size(n: int, percent: int = PERCENT) -> int:
    """Of two linked sets the smaller one has the first common token among so many: at least
    2 t n / (1 + t) of its tokens are common, none of them before it. (Of equal sizes, both have.)"""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Size filter, then the exact coefficient."""
    n, m = len(a), len(b)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (n + m - both)


SLIM = "fk long, gk long, cid long, ck long, ak long, n long, sig binary, p1 binary, p2 binary"


def _sizes_and_sketch(n: int, percent: int):
    """Rows (doc_id and SLIM) of the documents; then rows (block, counts) of the partition's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sketch, seen = Shingler(n), np.zeros(COUNTERS, np.uint32), False
        names = ["doc_id", *[c.split()[0] for c in SLIM.split(", ")], "block", "counts"]
        kinds = [pa.null(), *[pa.int64()] * 6, *[pa.binary()] * 3, pa.int32(), pa.binary()]
        for b in batches:
            kinds[0] = b.column("doc_id").type
            cols: list[list] = [[] for _ in range(7)]
            for text in b.column("text"):
                tokens = shingle(text.as_py())
                np.add.at(sketch, (tokens & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                for c, x in zip(cols, (*digests(tokens), len(tokens), signature(tokens), *further(tokens, percent))):
                    c.append(x)
            seen = seen or any(cols[3])
            none = [pa.nulls(b.num_rows, k) for k in kinds[10:]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("fk"), b.column("gk"), *[pa.array(c, k) for c, k in zip(cols, kinds[3:10])], *none], names=names)
        if seen:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, BLOCKS)]
            none = [pa.nulls(BLOCKS, k) for k in kinds[:10]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _sum_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTERS // BLOCKS, np.uint64)
    for raw in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(raw), np.uint32)
    level = np.minimum(255, np.floor(8 * np.log2(1 + total.astype(np.float64)))).astype(np.uint8)
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "level": [level.tobytes()]})


def _postings(n: int, percent: int, level, ranges: int, shared: frozenset[int]):
    """Rows (range, block of postings): token, class, set size and centrality of every prefix token. Of the
    copies in a partition one goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, weights, known = Shingler(n), np.frombuffer(level.value, np.uint8), set()
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            token, cid, size, central = (np.concatenate(x) for x in zip(*held))
            at = (mix(token) % np.uint64(ranges)).astype(np.int32)
            order = np.lexsort((token, at))
            at, token, cid, size, central = at[order], token[order], cid[order], size[order], central[order]
            ends = np.flatnonzero(np.diff(at, append=-1)) + 1
            starts = np.concatenate([[0], ends[:-1]])
            raw = [zlib.compress(token[s:e].tobytes() + cid[s:e].tobytes() + size[s:e].tobytes() + central[s:e].tobytes(), 1) for s, e in zip(starts, ends)]
            for i in range(0, len(raw), 256):
                yield pa.RecordBatch.from_arrays([pa.array(at[starts[i : i + 256]], pa.int32()), pa.array(raw[i : i + 256], pa.binary())], names=["range", "block"])

        count = 0
        for b in batches:
            for text in b.column("text"):
                tokens = shingle(text.as_py())
                if not len(tokens) or (cid := class_id(tokens, shared)) in known:
                    continue
                known.add(cid)
                w = weights[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)]
                p = prefix_size(len(tokens), percent)
                rank = (w.astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
                last = rank <= np.partition(rank, p - 1)[p - 1]  # with ties, all of them
                own = tokens[last]
                k = index_size(len(tokens), percent)
                early = (rank <= np.partition(rank, k - 1)[k - 1])[last]
                p = len(own)
                held.append((own, np.full(p, cid, np.int64), early.astype(np.uint32) << np.uint32(31) | np.uint32(len(tokens)), np.full(p, int(w.mean()), np.uint8)))
                count += p
                if count > 3_000_000:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    return run


def _met(n, early_n, m, early_m):
    """Whether a common token may be the first one of a link: early in the smaller set (see index_size)."""
    return ((n > m) | early_n) & ((m > n) | early_m)


def _pairs(percent: int):
    """Of one range: rows (kind 0, leader, member) for every list, (kind 1, token, class, early) for lists of
    three classes or more in which some class has the token early."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for raw in pdf["block"]:
            raw = zlib.decompress(raw)
            k, at = len(raw) // 21, 0
            for col, kind in zip(cols, (np.uint64, np.int64, np.uint32, np.uint8)):
                width = np.dtype(kind).itemsize * k
                col.append(np.frombuffer(raw[at : at + width], kind))
                at += width
        token, cid, size, central = (np.concatenate(x) for x in cols)
        order = np.lexsort((cid, -central.astype(np.int16), token))  # the most central class leads a list
        token, cid, size = token[order], cid[order], size[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])])
        token, cid, early, size = token[new], cid[new], (size[new] >> np.uint32(31)).astype(bool), (size[new] & np.uint32(0x7FFFFFFF)).astype(np.int64)
        first = np.concatenate([[True], token[1:] != token[:-1]])
        group = np.cumsum(first) - 1
        lead = np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))
        count = np.bincount(group)[group]
        some = np.bincount(group, weights=early)[group] > 0
        star = ~first & (100 * np.minimum(size, size[lead]) >= percent * np.maximum(size, size[lead]))
        star &= (count > 2) | _met(size, early, size[lead], early[lead])
        rest = (count >= 3) & some
        pairs = np.unique(np.stack([cid[lead][star], cid[star]], 1), axis=0)
        trim()
        return pd.DataFrame(
            {
                "kind": np.concatenate([np.zeros(len(pairs), np.int32), np.ones(rest.sum(), np.int32)]),
                "a": np.concatenate([pairs[:, 0], token[rest].view(np.int64)]),
                "b": np.concatenate([pairs[:, 1], cid[rest]]),
                "early": np.concatenate([np.zeros(len(pairs), bool), early[rest]]),
            }
        )

    return run


def _sets(n: int, shared: frozenset[int]):
    """Rows (cid, tokens); of repeated rows in a partition one goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known = Shingler(n), set()
        for b in batches:
            got = {}
            for text in b.column("text"):
                tokens = shingle(text.as_py())
                if (cid := class_id(tokens, shared)) not in known:
                    known.add(cid)
                    got[cid] = tokens.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], names=["cid", "tokens"])

    return run


class Filters:
    """What the filters need of a class: set size, signature, prefixes under the further orders."""

    def __init__(self, n: int, sig: bytes, *prefixes: bytes):
        self.n, self.sig, self.raw = n, sig, prefixes

    @functools.cached_property
    def prefixes(self) -> list[frozenset]:
        return [frozenset(np.frombuffer(x, np.uint32).tolist()) for x in self.raw]

    def may_pair(self, other: Filters, percent: int = PERCENT) -> bool:
        """Whether two classes pass all filters: size, signature, a shared prefix token under each order."""
        n, m = self.n, other.n
        if 100 * min(n, m) < percent * max(n, m) or not may_link(self.sig, other.sig, n, m, percent):
            return False
        return all(not x.isdisjoint(y) for x, y in zip(self.prefixes, other.prefixes))


def _filtered(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [[Filters(*x) for x in zip(*[b.column(f"{c}{side}").to_pylist() for c in ("n", "sig", "p1", "p2")])] for side in "ab"]
            keep = pa.array([x.may_pair(y, percent) for x, y in zip(*sides)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b.column("ta"), b.column("tb"))]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def verified(texts: DataFrame, about: DataFrame, pairs: DataFrame, n: int, percent: int, shared: frozenset[int]) -> DataFrame:
    """The pairs that link. The filters drop the pairs that cannot; of each class of the others one text is
    fetched by its key and its set rebuilt. Up to KEY_ROWS keys are broadcast, beyond that texts are shuffled.
    about: a row per class. What pairs are joined with is stored without its partitioning, so that adaptive execution may
    split a leader's pairs."""
    about = stored(about.join(_sides(pairs), "cid", "left_semi"), "jaccard-about")
    sides = [about.select(F.col("cid").alias(c), *[F.col(x).alias(f"{x}{c}") for x in ("n", "sig", "p1", "p2")]) for c in "ab"]
    pairs = cut(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(trimmed(_filtered(percent)), LINKS))
    keys = cut(about.join(_sides(pairs), "cid", "left_semi").select(F.col("fk").alias("k")).distinct())
    few = keys.limit(KEY_ROWS + 1).count() <= KEY_ROWS
    some = texts.join(F.broadcast(keys) if few else keys, F.col("fk") == F.col("k"), "left_semi").select("text")
    sets = stored(some.mapInArrow(trimmed(_sets(n, shared)), "cid long, tokens binary"), "jaccard-sets")
    if sets.groupBy("cid").count().where("count > 1").limit(1).count():  # rows repeated in several partitions
        sets = stored(sets.groupBy("cid").agg(F.first("tokens").alias("tokens")), "jaccard-sets")
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), "b")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(trimmed(_verify(percent)), LINKS).distinct())


def _sides(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()


def _spanning(members: DataFrame) -> DataFrame:
    """members (token, cid, early, comp) of the lists that span components, with the list's size; of lists with the
    same members one is enough."""
    sums = members.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.expr("bit_xor(xxhash64(cid, early))").alias("x"), F.expr("bit_xor(xxhash64(cid, early, 1))").alias("y"))
    some = sums.where("lo <> hi").groupBy("size", "x", "y").agg(F.min("token").alias("token")).select("token", "size")
    return cut(members.join(some, "token"))


def _across(members: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list, of different components, that sizes and signatures allow; `verified` has the prefixes. members: token, cid, early, comp. Lists up to
    LIST_BLOCK classes are compared inside a task; a longer one is cut into blocks, two of which are compared inside a
    task."""
    rows = _spanning(members)
    full = rows.join(about.select("cid", "n", "sig"), "cid")
    item = F.struct("cid", "comp", "n", "sig", "early")
    whole = full.where(F.col("size") <= LIST_BLOCK).groupBy("token").agg(F.collect_list(item).alias("items")).select("items", F.col("items").alias("others"))
    part = F.pmod(F.xxhash64("cid", F.lit(2)), F.ceil(F.col("size") / LIST_BLOCK)).alias("part")
    blocks = cut(full.where(F.col("size") > LIST_BLOCK).groupBy("token", part).agg(F.collect_list(item).alias("items")))
    other = blocks.select(F.col("token").alias("t"), F.col("part").alias("p"), F.col("items").alias("others"))
    both = whole.union(blocks.join(other, (F.col("token") == F.col("t")) & (F.col("part") <= F.col("p"))).select("items", "others"))

    def columns(items: pa.ListScalar) -> tuple:
        x = items.values.flatten()
        sides = [Filters(*y) for y in zip(*[x[i].to_pylist() for i in (2, 3)])]
        return x[0].to_numpy(), x[1].to_numpy(), x[2].to_numpy(), x[4].to_numpy(zero_copy_only=False), sides

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column("items"), b.column("others")):
                (ca, ka, na, ea, sa), (cb, kb, nb, eb, sb) = columns(x), columns(y)
                fit = (ka[:, None] != kb[None]) & (100 * np.minimum(na[:, None], nb[None]) >= percent * np.maximum(na[:, None], nb[None]))
                fit &= _met(na[:, None], ea[:, None], nb[None], eb[None])
                out += [(min(ca[i], cb[j]), max(ca[i], cb[j])) for i, j in np.argwhere(fit).tolist() if sa[i].may_pair(sb[j], percent)]
            pairs = np.unique(np.array(out, np.int64).reshape(-1, 2), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return both.mapInArrow(trimmed(run), LINKS)


def connected(links: DataFrame) -> DataFrame:
    """(cid, comp) of every linked class: the smallest class reachable. Labels go along the links and are
    then replaced by their labels' labels until nothing changes."""
    edges = cut(links.union(links.select("b", "a")).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = edges.join(labels.select(F.col("cid").alias("b"), F.col("comp").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = labels.join(near, labels.cid == near.a).select("cid", F.least("comp", "other").alias("new"), (F.col("other") < F.col("comp")).alias("moved"))
        step = cut(step)
        jump = step.select(F.col("cid").alias("via"), F.col("new").alias("root"))
        moved = step.where("moved").limit(1).count()
        labels = cut(step.join(jump, step.new == jump.via, "left").select("cid", F.coalesce("root", "new").alias("comp")))
        if not moved:
            return labels


def _shared(rows: DataFrame) -> frozenset[int]:
    """Digests that sets of different second digests have: about n^2 / 2^65 of n classes, which are collected."""
    found = rows.where("n > 0").groupBy("cid").agg(F.min("ck").alias("lo"), F.max("ck").alias("hi")).where("lo <> hi").select("cid")
    return frozenset(r["cid"] for r in found.collect())


def classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(slim: doc_id, fk, gk, cid, n of every row; comps: cid, comp of every linked class)."""
    spark: SparkSession = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), *_keys(F.col("doc_id"), F.col("text")))
    first = cut(texts.mapInArrow(trimmed(_sizes_and_sketch(n, percent)), f"doc_id {kind}, {SLIM}, block int, counts binary"))
    rows = first.where("block is null").select("doc_id", *[c.split()[0] for c in SLIM.split(", ")])
    shared = _shared(rows)
    slim = (rows.withColumn("cid", F.when(F.col("cid").isin(list(shared)), F.col("ak")).otherwise(F.col("cid"))) if shared else rows).drop("ck", "ak")
    merged = {r["block"]: bytes(r["level"]) for r in first.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(_sum_blocks, "block int, level binary").collect()}  # BLOCKS rows, COUNTERS bytes in all
    level = spark.sparkContext.broadcast(b"".join(merged.get(i, bytes(COUNTERS // BLOCKS)) for i in range(BLOCKS)))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(texts.select("text").mapInArrow(trimmed(_postings(n, percent, level, ranges, shared)), "range int, block binary").groupBy("range").applyInPandas(_pairs(percent), "kind int, a long, b long, early boolean"))
    pairs = cut(found.where("kind = 0").select("a", "b").distinct())
    # copies meet here after partial aggregation, and no later join takes them to their class's task
    best = slim.where("n > 0").groupBy("cid").agg(F.min(F.struct("fk", "n", "sig", "p1", "p2")).alias("x"))
    about = bucketed(best.select("cid", "x.*"), "cid", "jaccard-classes")
    links = verified(texts, about, pairs, n, percent, shared)
    comps = connected(links)
    lists = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("cid"), "early")
    members = cut(lists.join(comps, "cid", "left").select("token", "cid", "early", F.coalesce("comp", "cid").alias("comp")))
    cross = cut(_across(members, about, percent).distinct().join(pairs.union(pairs.select("b", "a")), ["a", "b"], "left_anti"))
    if cross.limit(1).count():
        comps = connected(links.union(verified(texts, about, cross, n, percent, shared)))
    return slim, comps


def _keys(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that stand for a row."""
    return [F.xxhash64(doc_id, text).alias("fk"), F.xxhash64(F.lit(1), doc_id, text).alias("gk")]


def components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    slim, comps = classes(docs, n, percent)
    sums = slim.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
    named = sums.join(comps, "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp"), "least")
    comp = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = cut(named.join(comp, "comp").select(F.col("cid").alias("c"), "component_id"))
    out = slim.join(ids, (F.col("cid") == F.col("c")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without all but one document of each component: the smallest doc_id stays (null last). Documents
    without shingles stay."""
    slim, comps = classes(docs, n, percent)
    sums = slim.where("n > 0").groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "fk", "gk")).alias("best"))
    best = sums.join(comps, "cid", "left").groupBy(F.coalesce("comp", "cid")).agg(F.min("best").alias("best"))
    keys = cut(best.select(F.col("best.fk").alias("_k"), F.col("best.gk").alias("_l"), F.lit(True).alias("_one")).union(slim.where("n = 0").select("fk", "gk", F.lit(False))).distinct())
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()], *_keys(F.col("doc_id"), F.col("text")))
    joined = held.join(keys, (F.col("fk") == F.col("_k")) & (F.col("gk") == F.col("_l")))
    kept = joined.where("not _one").unionByName(joined.where("_one").dropDuplicates(["fk", "gk"]))
    return kept.select(*[F.col(x).alias(c) for c, x in own.items()])
