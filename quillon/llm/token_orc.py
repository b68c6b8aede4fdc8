"""Token ids as ORC files: one row per document in ascending doc_id order, integer run-length encoded ids,
row indexes and a Bloom filter on doc_id, so that readers split by stripe and skip by metadata.

Defined results: null and empty texts have the end id alone; null doc_ids come first; documents of equal
doc_id are ordered by a hash of their text (fully equal rows are interchangeable); an empty table writes
files without rows and reads back as an empty table; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import in_worker, join_small, trimmed

END = 1
#: Words whose ids a worker keeps before it starts anew, and the longest such word.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 64
#: ASCII punctuation that may be cut from the end of a word: all but the apostrophe, which starts contractions.
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts that are encoded together.
GROUP = 256
#: Ids in one output batch.
BATCH_IDS = 1_000_000
SCHEMA = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("local_start", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
)
OPTIONS = {"compression": "snappy", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20)}


# The steps of a tokenizer whose ids of a text are those of its lower-cased words in order.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def by_words(model: str) -> bool:
    """Whether a tokenizer takes the steps that encoding word by word relies on."""
    said = json.loads(model)
    steps = (said.get("normalizer") or {}).get("normalizers"), (said.get("pre_tokenizer") or {}).get("pretokenizers")
    bpe = said["model"]
    return steps == (NORMALIZERS, PRE_TOKENIZERS) and bpe.get("type") == "BPE" and bpe.get("end_of_word_suffix") == "</w>" and not bpe.get("dropout") and not bpe.get("continuing_subword_prefix") and all(t["special"] and t["content"].startswith("<|") for t in said["added_tokens"])


def _byte_letters() -> dict[int, str]:
    """The letters by which the byte-level step writes bytes: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes a text word by word with a cache. The tokenizer lower-cases, drops white space and never joins
    characters across it, so the ids of a text are those of its lower-cased words in order. A word that ends in
    a letter and ASCII punctuation gives the ids of its two parts. A word of letters alone, in normal form and
    lower case, is one piece to the tokenizer and goes to its model directly. Texts with a special token's
    opening are encoded whole, and so are all texts if the tokenizer takes other steps (`by_words`)."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.word_wise = Tokenizer.from_str(model), by_words(model)
        if not self.word_wise:
            return
        # The separator must be a special token, which cuts the text before anything else looks at it.
        self.mark = next((t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special)
        self.pieces = Tokenizer.from_str(model)
        self.pieces.normalizer, self.pieces.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[list(ends)] = True
        self.letters = _byte_letters()
        self.cache: dict[bytes, bytes] = {}

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    @staticmethod
    def _cut(ids: np.ndarray, starts: list[int], ends: list[int]) -> list[bytes]:
        raw = ids.tobytes()
        return [raw[4 * a : 4 * e] for a, e in zip(starts, ends)]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, encoded together with a special token between them."""
        mark, number = self.mark
        ids = self._plain(mark.join(w.decode("utf-8", "surrogatepass") for w in words))
        ends = np.append(np.flatnonzero(ids == number), len(ids)).tolist()
        return self._cut(ids, [0, *[e + 1 for e in ends[:-1]]], ends)

    def _encode_pieces(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one piece each, split where a token ends a word."""
        text = b" ".join(words).decode("latin-1").translate(self.letters | {32: " "})
        ids = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        return self._cut(ids, [0, *ends[:-1]], ends) if len(ends) == len(words) else self._encode(words)

    @staticmethod
    def _one_piece(word: bytes) -> bool:
        if word.isalpha():  # ASCII, and lower case by now
            return True
        if word.isascii():
            return False
        text = word.decode("utf-8", "surrogatepass")
        return text.isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text)

    def _learn(self, new: list[bytes]) -> None:
        cache = self.cache
        parts: list[tuple[bytes, bytes, bytes]] = []
        todo: set[bytes] = set()
        for w in new:
            core = w.rstrip(PUNCTUATION)
            if core and len(core) < len(w) and (core[-1:].isalpha() or (core[-1] > 127 and core.decode("utf-8", "surrogatepass")[-1].lower()[-1].isalpha())):
                rest = w[len(core) :]
                parts.append((w, core, rest))
                todo.update(x for x in (core, rest) if x not in cache)
            else:
                todo.add(w)
        pieces = [w for w in todo if self._one_piece(w)]
        others = list(todo.difference(pieces))
        for some, encode in ((pieces, self._encode_pieces), (others, self._encode)):
            for i in range(0, len(some), 4096):
                cache.update(zip(some[i : i + 4096], encode(some[i : i + 4096])))
        cache.update((w, cache[core] + cache[rest]) for w, core, rest in parts)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.word_wise:
            found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)
            return [np.array(x.ids, dtype="<u4").tobytes() for x in found]
        split = [None if b"<|" in t else t.lower().split() for t in texts]
        new: set[bytes] = set().union(*(words for words in split if words))
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        missing = [w for w in new if w not in cache]
        self._learn(missing)
        get = cache.__getitem__
        out = [self._plain(t.decode("utf-8", "surrogatepass")).tobytes() if words is None else b"".join(map(get, words)) for t, words in zip(texts, split)]
        for w in missing:
            if len(w) > CACHE_CHARS:
                del cache[w]
        return out


def _write_batches(model: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, tail = in_worker(hash(model), lambda: Encoder(model)), np.array([end], dtype="<u4").tobytes()
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])

        def flush(doc_ids: list, chunks: list[bytes], first: int) -> pa.RecordBatch:
            sizes = np.array([len(c) // 4 for c in chunks], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(chunks), dtype="<i4")))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(chunks), part, np.int32)), pa.array(doc_ids, pa.int64()), pa.array(first + offsets[:-1]), pa.array(sizes.astype(np.int32)), ids], schema=schema)

        doc_ids, chunks, held, first = [], [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                got = encode([x or b"" for x in some.column("text").cast(pa.binary()).to_pylist()])
                doc_ids += some.column("doc_id").to_pylist()
                chunks += [c + tail for c in got]
                held += sum(len(c) // 4 + 1 for c in got)
                if held >= BATCH_IDS:
                    yield flush(doc_ids, chunks, first)
                    first, held, doc_ids, chunks = first + held, 0, [], []
        if chunks:
            yield flush(doc_ids, chunks, first)

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encode docs with the tokenizer of a file (sent to the executors as text) and write ORC files to path."""
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.mapInArrow(trimmed(_write_batches(model, end)), SCHEMA).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files: part, doc_id, local_start, n (ids), ids. doc_ids: only these, by stripe statistics, row
    indexes and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        raw = memoryview(np.ascontiguousarray(values)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), b.column("local_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32. The files' own totals, one row each,
    are summed in file order."""
    totals = read(spark, path).groupBy("part").agg(F.sum(F.col("n").cast("long")).alias("in_part"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("in_part").over(w), F.lit(0)).alias("before"))
    rows = read(spark, path).drop("n").mapInArrow(trimmed(_digests), "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return join_small(rows, starts, F.col("part") == F.col("p"), "inner").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
