"""Language-model scores by deleted interpolation.

P1(w) = a c(w)/N + (1 - a)/(V + 1), and for each longer n-gram up to `order` words P(w | h) = a c(h w)/c(h) + (1 - a) P(w |
h without its first word), where the weight a belongs to the bucket of the context's count c(h) (powers of two, as many
as counts reach) and is 0 for a context never seen. The weights of one length after the other are learned by
expectation-maximisation on a deleted part of the training documents, whose tokens are scored with the counts of the
other training documents; the model then uses the counts of all of them. A text starts with a mark that is a context
like a word. Base: add-0.1 unigrams.

No n-gram is a row and no table of counts is broadcast. A pass over the texts packs the documents of a task into
blocks. For each length a block asks, per range of hashes, for the counts of its distinct n-grams and brings its own
counts along; a range is summed over all blocks in one place, which answers every block in the order asked. An n-gram
whose first or last part occurs in no other block occurs in no other block either, and is not asked for. Blocks are
bucketed by their number, so that they stay where they are. Ranges follow the number of tokens and hold about
RANGE_KEYS keys each, so that a group stays bounded at any size of the input. A frequent word is one entry of a block,
so no key is hot. N-grams go by 64-bit hashes: of n distinct ones a share of n / 2^64 meets another.

Defined results: null and empty texts have the end token alone; a null doc_id counts as empty text (remainder
0: held out); rows of equal doc_id are separate documents; doc_id may be of any type; without training tokens N and V
are 0 and every score is that of an unknown token; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bucketed, cut, forget, from_bytes, to_bytes, word_hashes

#: Documents with this remainder (modulo FOLDS) are held out; those with DELETED train the weights.
FOLDS, HELD_OUT, DELETED = 10, 0, 1
PRIOR, ORDER = 0.1, 3
#: Tokens of a block, and keys of a range of hashes.
BLOCK_TOKENS, RANGE_KEYS = 1_500_000, 4_000_000
#: Context buckets (powers of two of 64-bit counts), steps per power of ten of the histogram that EM runs on, its rounds.
BUCKETS, STEPS, ROUNDS = 64, 200, 200
END, START = np.uint64(0x5EED0E4D), np.uint64(0x5EED057A)  # no word hashes to these but by chance
NONE = -1_000_000  # the step of ratio 0
TRAIN, DEL, OUT = 0, 1, 2


def pack(x: np.ndarray) -> bytes:
    """Compressed integers: the bytes of equal weight stand together."""
    raw = np.ascontiguousarray(x)
    return zlib.compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes(), 1) if len(raw) else b""


def unpack(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.empty(0, kind)
    flat = np.frombuffer(zlib.decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def longer(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of the n-grams with the keys v followed by the words w."""
    x = (v * np.uint64(0x9E3779B97F4A7C15)) ^ (w + (v << np.uint64(7)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, the number of each place's key, and how often each occurs. (np.unique would
    sort stably, which takes several times as long.)"""
    order = np.argsort(keys)
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[order[1:]], keys[order[:-1]], out=new[1:])
    first = np.flatnonzero(new)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return keys[order[first]], order[first], number, np.diff(np.append(first, len(keys)))


class Block:
    """The tokens of a block of documents. Per length n: the sorted distinct n-grams `keys[n]`, the block's own
    counts `own[n]`, and per token the place of the n-gram that ends there, `at[n]` (-1: none so long). Length 1 also
    has the starting mark, once per document."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, vocab: np.ndarray, part: int, order: int):
        self.sizes, self.part, self.order = sizes, part, order
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = int(np.searchsorted(vocab, START))
        words = np.insert(vocab, place, START)
        at = ids.astype(np.int64)
        at += at >= place
        n1 = np.bincount(at, minlength=len(words))
        n1[place] += len(sizes)
        self.start, self.keys, self.own, self.at = place, {1: words}, {1: n1}, {1: at}
        self.ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # per n-gram: places of its first and last n - 1 words
        self.every: dict[int, np.ndarray] = {}
        self.kept: dict[int, np.ndarray] = {}
        word, key = words[at], words[at]
        for n in range(2, order + 1):
            before, context = np.empty_like(key), np.empty_like(at)
            before[1:], context[1:] = key[:-1], self.at[n - 1][:-1]
            if n == 2:
                before[starts], context[starts] = START, place
            else:
                context[starts] = -1
            some = np.flatnonzero(context >= 0)
            key = np.where(context >= 0, longer(before, word), np.uint64(0))
            self.keys[n], one, inverse, self.own[n] = distinct(key[some])
            self.at[n] = np.full(len(at), -1, np.int64)
            self.at[n][some] = inverse
            self.ends[n] = context[some[one]], self.at[n - 1][some[one]]

    def context(self, n: int) -> np.ndarray:
        """Per token the place of the context of its n-gram among those of length n - 1 (-1: none)."""
        out = np.full(len(self.at[1]), -1, np.int64)
        some = np.flatnonzero(self.at[n] >= 0)
        out[some] = self.ends[n][0][self.at[n][some]]
        return out

    def asked(self, n: int) -> np.ndarray:
        """Which n-grams other blocks may have; the answers of the length below must be there."""
        if n == 1:
            return np.ones(len(self.keys[1]), bool)
        own = self.own[n - 1] if self.part != OUT else 0
        elsewhere = self.every[n - 1] > own
        first, last = self.ends[n]
        return elsewhere[first] & elsewhere[last]

    def answer(self, n: int, every: np.ndarray, kept: np.ndarray) -> None:
        """Take the answers of length n. What was not asked for occurs here alone."""
        asked = self.asked(n)
        own = self.own[n]
        self.every[n] = np.where(asked, 0, own if self.part != OUT else 0)
        self.kept[n] = np.where(asked, 0, own if self.part == TRAIN else 0)
        self.every[n][asked] = every
        if self.part == DEL:
            self.kept[n][asked] = kept

    def counts(self, n: int, of: dict[int, np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
        """Per token: the count of its n-gram and of its context (0 where there is none so long)."""
        if n == 1:
            return of[1][self.at[1]], np.full(len(self.at[1]), total)
        at, context = self.at[n], self.context(n)
        return np.where(at >= 0, of[n][np.maximum(at, 0)] if len(of[n]) else 0, 0), np.where(context >= 0, of[n - 1][np.maximum(context, 0)], 0)


def _pack_blocks():
    """One row per block: number, part, tokens, doc_ids, sizes, ids and vocab, packed."""
    names = ["block", "part", "tokens", "docs", "sizes", "ids", "vocab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[list, list, list[np.ndarray]]] = [([], [], []) for _ in range(3)]
        tokens = [0, 0, 0]

        def flush(part: int, kind: pa.DataType) -> pa.RecordBatch:
            nonlocal made
            docs, sizes, hashes = held[part]
            block, made = task << 20 | made, made + 1
            vocab, ids = np.unique(np.concatenate(hashes), return_inverse=True)
            row = [[block], [part], [tokens[part]], [to_bytes(pa.array(docs, kind))], [pack(np.array(sizes, np.int64))], [pack(ids.astype(np.uint32))], [pack(np.diff(vocab, prepend=np.uint64(0)))]]
            held[part], tokens[part] = ([], [], []), 0
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4])], names=names)

        kind = pa.null()
        for b in batches:
            kind = b.column("doc_id").type
            for doc_id, rest, text in zip(b.column("doc_id").to_pylist(), b.column("rest").to_pylist(), b.column("text")):
                words = word_hashes(text.as_py())
                h = np.empty(len(words) + 1, np.uint64)
                h[:-1] = words
                h[-1] = END
                part = OUT if rest == HELD_OUT else DEL if rest == DELETED else TRAIN
                for to, x in zip(held[part], (doc_id, len(h), h)):
                    to.append(x)
                tokens[part] += len(h)
                if tokens[part] >= BLOCK_TOKENS:
                    yield flush(part, kind)
        for part in (TRAIN, DEL, OUT):
            if held[part][0]:
                yield flush(part, kind)

    return run


def _opened(row, answers: pd.DataFrame | None, order: int, upto: int) -> Block:
    """A block with n-grams up to `order` words and the answers to lengths up to `upto`."""
    vocab = np.cumsum(unpack(row["vocab"], np.uint64), dtype=np.uint64)
    block = Block(unpack(row["sizes"], np.int64), unpack(row["ids"], np.uint32), vocab, int(row["part"]), order)
    for n in range(1, upto + 1):
        own = answers[answers["length"] == n].sort_values("range")
        every, kept = (np.concatenate([np.empty(0, np.int64), *[unpack(x, np.int64) for x in own[c]]]) for c in ("every", "kept"))
        block.answer(n, every, kept)
    return block


ASK = "length int, range int, block long, part int, keys binary, counts binary"
ANSWER = "length int, range int, block long, every binary, kept binary"


def _asks(n: int, ranges: int):
    """Per block and range of hashes: the n-grams asked for and the block's own counts."""
    edges = np.array([r * ((1 << 64) // ranges + 1) for r in range(1, ranges)], np.uint64)

    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, row in blocks.iterrows():
            block = _opened(row, answers, n, n - 1)
            asked = block.asked(n)
            keys, own = block.keys[n][asked], block.own[n][asked]
            cuts = [0, *np.searchsorted(keys, edges), len(keys)]
            rows += [(n, r, row["block"], row["part"], pack(np.diff(keys[s:e], prepend=np.uint64(0))), pack(own[s:e].astype(np.int64))) for r, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
        return pd.DataFrame(rows, columns=["length", "range", "block", "part", "keys", "counts"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum one range over all blocks and answer each in its own order: counts in all training documents, and for
    deleted blocks those without the deleted part. For single words one more row (block -1) has tokens and distinct words."""
    n, place = int(pdf["length"].iloc[0]), int(pdf["range"].iloc[0])
    parts = pdf["part"].to_numpy()
    keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in pdf["keys"]]
    size = np.array([len(x) for x in keys])
    keys, _, at, _ = distinct(np.concatenate(keys))
    counts, part = np.concatenate([unpack(x, np.int64) for x in pdf["counts"]]), np.repeat(parts, size)
    kept, every = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    np.add.at(kept, at[part == TRAIN], counts[part == TRAIN])
    np.add.at(every, at[part != OUT], counts[part != OUT])
    rows, ends = [], np.cumsum(size)
    for s, e, p, block in zip(ends - size, ends, parts, pdf["block"]):
        rows.append((n, place, block, pack(every[at[s:e]]), pack(kept[at[s:e]]) if p == DEL else b""))
    if n == 1:
        word = keys != START
        stats = [every[word].sum(), (every[word] > 0).sum(), kept[word].sum(), (kept[word] > 0).sum()]
        rows.append((n, place, -1, np.array(stats, np.int64).tobytes(), b""))
    return pd.DataFrame(rows, columns=["length", "range", "block", "every", "kept"])


def bucket(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(context, 1))).astype(np.int64)


def probabilities(block: Block, of: dict[int, np.ndarray], total: int, vocabulary: int, weights: dict[int, np.ndarray], upto: int) -> np.ndarray:
    """Per token its probability with n-grams up to `upto` words."""
    p = np.full(len(block.at[1]), 1 / (vocabulary + 1))
    for n in range(1, upto + 1):
        count, context = block.counts(n, of, total)
        a = np.where(context > 0, weights[n][bucket(context)], 0.0)
        p = a * count / np.maximum(context, 1) + (1 - a) * p
    return p


def _histogram(n: int, total: int, vocabulary: int, weights: dict[int, np.ndarray]):
    """Of the tokens of deleted blocks: (bucket, step, number, sum of ratios). A ratio is that of c(h w)/c(h) to the
    probability by shorter n-grams, a step its rounded logarithm."""

    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in blocks.iterrows():
            block = _opened(row, answers, n, n)
            count, context = block.counts(n, block.kept, total)
            some = context > 0
            low = probabilities(block, block.kept, total, vocabulary, weights, n - 1)[some]
            ratio = count[some] / context[some] / low
            with np.errstate(divide="ignore"):
                step = np.where(ratio > 0, np.rint(STEPS * np.log10(ratio)), NONE).astype(np.int64)
            cells, at, times = np.unique(np.stack([bucket(context[some]), step], 1), axis=0, return_inverse=True, return_counts=True)
            out.append(pd.DataFrame({"b": cells[:, 0], "step": cells[:, 1], "n": times, "ratio": np.bincount(at.ravel(), weights=ratio, minlength=len(cells))}))
        return pd.concat(out) if out else pd.DataFrame({"b": [], "step": [], "n": [], "ratio": []})

    return run


def learn(cells: pd.DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The weight of each bucket by expectation-maximisation on the histogram, a cell standing for its mean ratio. A
    bucket without deleted tokens takes the weight learned over all buckets, and without any tokens the weight is 1/2."""
    if not len(cells):
        return np.full(BUCKETS, 0.5)

    def em(ratio: np.ndarray, n: np.ndarray) -> float:
        a = 0.5
        for _ in range(rounds):
            a = float((n * a * ratio / (a * ratio + 1 - a)).sum() / n.sum())
            a = min(max(a, 1e-6), 1 - 1e-6)
        return a

    b, n = cells["b"].to_numpy(), cells["n"].to_numpy()
    ratio = cells["ratio"].to_numpy() / n
    weights = np.full(BUCKETS, em(ratio, n))
    for k in np.unique(b):
        weights[k] = em(ratio[b == k], n[b == k])
    return weights


def _score(order: int, total: int, vocabulary: int, weights: dict[int, np.ndarray]):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in names}
        for _, row in blocks.iterrows():
            block = _opened(row, answers, order, order)
            starts = np.concatenate([[0], np.cumsum(block.sizes)[:-1]])
            words = block.every[1][block.at[1]]
            p = probabilities(block, block.every, total, vocabulary, weights, order)
            sums = [np.add.reduceat(x, starts) for x in ((words > 0).astype(np.int64), np.log10((words + PRIOR) / (total + PRIOR * (vocabulary + 1))), np.log10(p))]
            k = len(starts)
            for c, x in zip(names, (from_bytes(row["docs"]), [block.part == OUT] * k, block.sizes, sums[0], [total] * k, sums[1], sums[2])):
                out[c].extend(x)
        frame = pd.DataFrame(out)
        frame["doc_id"] = pd.Series(out["doc_id"], dtype=object)
        return frame

    return run


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rest = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    rows = docs.select("doc_id", rest.alias("rest"), F.col("text").cast("string").alias("text"))
    blocks = bucketed(rows.mapInArrow(_pack_blocks(), "block long, part int, tokens long, docs binary, sizes binary, ids binary, vocab binary"), "block", "lm-blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // RANGE_KEYS))
    answers = spark.createDataFrame([], ANSWER)
    for n in range(1, order + 1):
        asks = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_asks(n, ranges), ASK)
        answers = answers.unionByName(cut(asks.groupBy("range").applyInPandas(_answer, ANSWER)))
        forget(spark)
        if n == 1:  # one row per range
            stats = sum((np.frombuffer(r["every"], np.int64) for r in answers.where("block = -1").select("every").collect()), np.zeros(4, np.int64))
            answers = answers.where("block >= 0")
    total, vocabulary, total_kept, vocabulary_kept = map(int, stats)
    deleted = blocks.where(F.col("part") == DEL)
    weights: dict[int, np.ndarray] = {}
    for n in range(1, order + 1):
        cells = deleted.groupBy("block").cogroup(answers.where(F.col("length") <= n).groupBy("block")).applyInPandas(_histogram(n, total_kept, vocabulary_kept, dict(weights)), "b long, step long, n long, ratio double")
        # bounded by buckets times the steps of a logarithm
        weights[n] = learn(cells.groupBy("b", "step").agg(F.sum("n").alias("n"), F.sum("ratio").alias("ratio")).toPandas().sort_values(["b", "step"]))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(order, total, vocabulary, weights), schema)
