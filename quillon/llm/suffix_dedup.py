"""Removal of repeated byte strings: every byte covered by a string of `size` bytes that also starts
anywhere else in the corpus goes, judged on the input, never across documents.

1. Each string is placed by its anchor: of the GRAM-byte grams in it the one of the least hash. Equal strings
   have equal anchors at equal offsets, and neighbouring strings mostly share one, so a document falls into
   segments (the strings with one anchor). The tasks' documents are packed into blocks; ranges of anchor
   hashes are counted over all blocks, and only segments whose anchor occurs again go on.
2. A block sends its distinct segments to the shard of their anchors. A shard joins equal segments; where an
   anchor has several different ones, their suffixes are sorted by external induced sorting with common-prefix
   values, and neighbours with `size` bytes in common are repeated.
3. An anchor that occurs more than HOT times may have as many different segments (each occurrence has its own
   surroundings), which one shard would have to hold. Its strings go by their 128-bit BLAKE2 digests instead, each
   once per block, spread by digest over all shards and counted there. That rests on the digests being free of
   collisions, and is the one place where strings are not compared themselves.
4. The answers return to the blocks, which remove the bytes.

Blocks are bucketed by their number and stay where they are. The number of ranges follows the bytes of the corpus
(RANGE_BYTES of text each), so that a group stays bounded at any size of the input; a shard beyond that, because of its
anchors, is sorted on disk.

Defined results: a null or empty text has no bytes; texts shorter than `size` keep all; repeated rows repeat
each other; equal doc_ids are separate documents; doc_id may be of any type; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bucketed, cut, forget, from_bytes, scratch_root, task_folder, to_bytes
from quillon.llm.suffix_sort import MEMORY_ITEMS, Scratch, repeated

SIZE, GRAM = 200, 64
#: Occurrences from which an anchor's strings are counted one by one.
HOT = 20_000
#: Bytes of the corpus to a range of hashes.
RANGE_BYTES = 48 << 20
#: Bytes of text in a block; a text is never split.
BLOCK_BYTES = 3 << 20
#: Zstandard level of texts, which are written more than once.
TEXT_LEVEL = 5
#: Positions that share one set of tie-breaking numbers in the choice of anchors.
TILE = 1 << 22
ONCE, AGAIN, MANY = 0, 1, 2
_G = np.random.default_rng(20_240_501)
_BYTE = _G.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_G.integers(1 << 40, 1 << 62)) | 1
_POWERS: list[np.ndarray] = []


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


def grams(b: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position on."""
    if len(b) < n:
        return np.empty(0, np.uint64)
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    return scramble((sums[n:] - sums[:-n]) * down[: len(b) - n + 1])


def segments(b: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First starts of the segments of one document, and the hashes of their anchors."""
    if len(b) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    starts, anchors, width = [], [], size - gram + 1
    for at in range(0, len(b) - size + 1, TILE):
        h = grams(b[at : at + TILE + size - 1], gram)
        low = np.uint64((1 << 24) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost
        span = 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        p = (key & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        starts.append(first + at)
        anchors.append(scramble(h[p[first]] ^ _BYTE[0]))  # the least hashes are small; spread them over the ranges
    return np.concatenate(starts), np.concatenate(anchors)


class Block:
    """Documents of a task: their bytes end to end, and the segments with an index into distinct anchors."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, starts: np.ndarray, anchors: np.ndarray, which: np.ndarray, size: int):
        self.data, self.ends, self.starts, self.anchors, self.which = data, ends, starts, anchors, which
        # a segment's strings start before the next segment and at least `size` bytes before the document's end
        doc = np.searchsorted(ends, starts, side="right")
        after = np.append(starts[1:], np.iinfo(np.int64).max)
        self.lasts = np.minimum(after, ends[doc] - size + 1) if len(starts) else starts

    def told(self, classes: np.ndarray, size: int):
        """What the block asks for in the second round. Segments AGAIN: distinct contents, each with the
        anchor, and the segments' index into them. Strings of segments MANY: their starts, distinct
        digests, and the index."""
        kind = classes[self.which]
        again = np.flatnonzero(kind == AGAIN)
        raw, seen, contents, anchors, index = self.data.tobytes(), {}, [], [], []
        for s, e, w in zip(self.starts[again].tolist(), self.lasts[again].tolist(), self.which[again].tolist()):
            text = raw[s : e + size - 1]
            k = seen.setdefault(text, len(contents))
            if k == len(contents):
                contents.append(text)
                anchors.append(w)
            index.append(k)
        many = np.flatnonzero(kind == MANY)
        length = self.lasts[many] - self.starts[many]
        at = np.repeat(self.starts[many] - np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64), length) + np.arange(int(length.sum()))
        digests = b"".join(hashlib.blake2b(raw[p : p + size], digest_size=16).digest() for p in at.tolist())
        both = np.frombuffer(digests, [("a", np.uint64), ("b", np.uint64)])
        distinct, where = np.unique(both, return_inverse=True)
        return again, contents, np.array(anchors, np.int64), np.array(index, np.int64), at, distinct, where


def squeeze(x, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def planes(x: np.ndarray) -> bytes:
    """Compressed integers, the bytes of equal weight together."""
    return squeeze(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()) if len(x) else b""


def loosen(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw) if raw else b""


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    if not raw:
        return np.empty(0, kind)
    flat = np.frombuffer(loosen(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


PACKED = "block long, size long, ids binary, text binary, ends binary, starts binary, anchors binary, which binary"


def _pack(size: int, gram: int):
    names = [c.split()[0] for c in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids, parts, held, kind = [], [], 0, pa.null()

        def flush() -> pa.RecordBatch:
            nonlocal made
            found = [segments(p, size, gram) for p in parts]
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            starts = np.concatenate([s + e - len(p) for (s, _), e, p in zip(found, ends, parts)])
            anchors, which = np.unique(np.concatenate([a for _, a in found]), return_inverse=True)
            numbers = [task << 20 | made, held]
            row = [to_bytes(pa.array(ids, kind)), squeeze(np.concatenate(parts), TEXT_LEVEL), planes(delta(ends)), planes(delta(starts)), planes(delta(anchors)), planes(which.astype(np.uint32))]
            made += 1
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in numbers], *[pa.array([x], pa.binary()) for x in row]], names=names)

        for b in batches:
            kind = b.column("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids.append(doc_id)
                parts.append(np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8))
                held += len(parts[-1])
                if held >= BLOCK_BYTES:
                    yield flush()
                    ids, parts, held = [], [], 0
        if ids:
            yield flush()

    return run


def _open(row, size: int) -> Block:
    data = np.frombuffer(loosen(row["text"]), np.uint8)
    ends, starts = (np.cumsum(unplanes(row[c], np.int64)) for c in ("ends", "starts"))
    return Block(data, ends, starts, np.cumsum(unplanes(row["anchors"], np.uint64), dtype=np.uint64), unplanes(row["which"], np.uint32).astype(np.int64), size)


def _width(ranges: int) -> np.uint64:
    return np.uint64((1 << 64) // ranges + 1)


def _ask_anchors(ranges: int):
    """Per block and range: distinct anchors and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, a, w in zip(*[b.column(c).to_pylist() for c in ("block", "anchors", "which")]):
                anchors = np.cumsum(unplanes(a, np.uint64), dtype=np.uint64)
                counts = np.bincount(unplanes(w, np.uint32), minlength=len(anchors)).astype(np.uint32)
                cuts = [0, *np.searchsorted(anchors, [np.uint64(r) * _width(ranges) for r in range(1, ranges)]), len(anchors)]
                rows = [(r, block, planes(delta(anchors[s:e])), planes(counts[s:e])) for r, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "block", "keys", "counts"])

    return run


def _answer_anchors(hot: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in pdf["keys"]]
        counts = np.concatenate([unplanes(x, np.uint32) for x in pdf["counts"]])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=counts)[at]
        classes = np.where(total > hot, MANY, np.where(total > 1, AGAIN, ONCE)).astype(np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({"round": 1, "range": pdf["range"], "block": pdf["block"], "answer": [squeeze(classes[e - len(k) : e]) for e, k in zip(ends, keys)]})

    return run


ANSWER = "round int, range int, block long, answer binary"


def _joined(answers: pd.DataFrame, round_: int) -> np.ndarray:
    rows = answers[answers["round"] == round_].sort_values("range")
    return np.concatenate([np.frombuffer(loosen(x), np.uint8) for x in rows["answer"]]) if len(rows) else np.empty(0, np.uint8)


def _order(anchors: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of hashes by range, and the ranges."""
    r = (anchors // _width(ranges)).astype(np.int64)
    return np.argsort(r, kind="stable"), r


def _ask_texts(ranges: int, size: int):
    """Per block and range: distinct contents of segments with their anchors (round 2), distinct
    fingerprints (round 3), and how often the block has each."""

    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {k: [] for k in ("range", "block", "keys", "sizes", "texts", "counts", "prints", "times")}
        for _, row in blocks.iterrows():
            block = _open(row, size)
            _, contents, which, index, _, prints, where = block.told(_joined(answers, 1), size)
            anchors = block.anchors[which]
            counts, times = np.bincount(index, minlength=len(contents)).astype(np.uint32), np.bincount(where, minlength=len(prints)).astype(np.uint32)
            (o2, r2), (o3, r3) = _order(anchors, ranges), _order(prints["a"].astype(np.uint64), ranges)
            c2, c3 = np.searchsorted(r2[o2], np.arange(ranges + 1)), np.searchsorted(r3[o3], np.arange(ranges + 1))
            for r in range(ranges):
                i, j = o2[c2[r] : c2[r + 1]], o3[c3[r] : c3[r + 1]]
                if len(i) or len(j):
                    texts = [contents[k] for k in i.tolist()]
                    new = [r, row["block"], planes(anchors[i]), planes(np.array([len(t) for t in texts], np.uint32)), squeeze(b"".join(texts), TEXT_LEVEL), planes(counts[i]), planes(prints[j].view(np.uint64).reshape(-1, 2).ravel()) if len(j) else b"", planes(times[j])]
                    for k, x in zip(out, new):
                        out[k].append(x)
        return pd.DataFrame(out)

    return run


def judge(texts: list[bytes], anchors: np.ndarray, counts: np.ndarray, size: int, root: str, limit: int = MEMORY_ITEMS) -> list[np.ndarray]:
    """Per distinct text: which of its strings of `size` bytes occur again. Texts that occur twice are
    repeated throughout; those that share an anchor with another one are sorted together."""
    out = [np.full(len(t) - size + 1, c > 1) for t, c in zip(texts, counts)]
    _, group, many = np.unique(anchors, return_inverse=True, return_counts=True)
    pick = np.flatnonzero(many[group] > 1).tolist()
    if not pick:
        return out
    with task_folder(root) as folder:
        # bytes of UTF-8 stop at 0xF4: 1 ends each text, 0 ends all
        whole, at = Scratch(folder, limit).array(sum(len(texts[k]) + 1 for k in pick) + 1, np.uint8), 0
        for k in pick:
            t = np.frombuffer(texts[k], np.uint8)
            whole[at : at + len(t)] = t + np.uint8(2)
            whole[at + len(t)] = 1
            at += len(t) + 1
        hit, at = repeated(whole, size, folder, limit), 0
        for k in pick:
            out[k] = out[k] | hit[at : at + len(out[k])]
            at += len(texts[k]) + 1
    return out


def _answer_texts(size: int, root: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[bytes, int] = {}
        texts, anchors, counts, places = [], [], [], []
        for keys, sizes, raw, times in zip(pdf["keys"], pdf["sizes"], pdf["texts"], pdf["counts"]):
            data, at, own = loosen(raw), 0, []
            for a, n, c in zip(unplanes(keys, np.uint64), unplanes(sizes, np.uint32).tolist(), unplanes(times, np.uint32).tolist()):
                text = data[at : at + n]
                at += n
                k = seen.setdefault(text, len(texts))
                if k == len(texts):
                    texts.append(text)
                    anchors.append(a)
                    counts.append(0)
                counts[k] += c
                own.append(k)
            places.append(own)
        marks = judge(texts, np.array(anchors, np.uint64), np.array(counts, np.int64), size, root) if texts else []
        prints = [unplanes(x, np.uint64).reshape(-1, 2) for x in pdf["prints"]]
        times = [unplanes(x, np.uint32) for x in pdf["times"]]
        both = np.ascontiguousarray(np.concatenate(prints)).view([("a", np.uint64), ("b", np.uint64)]).ravel()
        _, where = np.unique(both, return_inverse=True)
        again = (np.bincount(where, weights=np.concatenate(times)) > 1)[where].astype(np.uint8) if len(both) else np.empty(0, np.uint8)
        ends = np.cumsum([len(p) for p in prints])
        rows = []
        for r, b, own, p, e in zip(pdf["range"], pdf["block"], places, prints, ends):
            rows.append((2, r, b, squeeze(np.concatenate([marks[k] for k in own]).astype(np.uint8)) if own else b""))
            rows.append((3, r, b, squeeze(again[e - len(p) : e]) if len(p) else b""))
        return pd.DataFrame(rows, columns=["round", "range", "block", "answer"])

    return run


def _remove(ranges: int, size: int):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
        for _, row in blocks.iterrows():
            block = _open(row, size)
            out["doc_id"] += from_bytes(row["ids"])
            again, contents, which, index, at, prints, where = block.told(_joined(answers, 1), size)
            hit = np.zeros(len(block.data) + 1, bool)
            # answers stand in the order of ranges; bring them back to the order of the block's own lists
            order, _ = _order(block.anchors[which], ranges)
            length = np.array([len(t) - size + 1 for t in contents], np.int64)
            offset = np.empty(len(contents), np.int64)
            offset[order] = np.concatenate([[0], np.cumsum(length[order])[:-1]]) if len(contents) else []
            marks = _joined(answers, 2)
            for s, k in zip(block.starts[again].tolist(), index.tolist()):
                hit[s : s + length[k]] |= marks[offset[k] : offset[k] + length[k]].astype(bool)
            order, _ = _order(prints["a"].astype(np.uint64), ranges)
            twice = np.empty(len(prints), bool)
            twice[order] = _joined(answers, 3).astype(bool)
            hit[at] |= twice[where]
            step = np.zeros(len(block.data) + size + 1, np.int32)
            starts = np.flatnonzero(hit)
            step[starts] += 1
            step[starts + size] -= 1
            gone = np.cumsum(step)[: len(block.data)] > 0
            raw = block.data
            for e, s in zip(block.ends.tolist(), [0, *block.ends[:-1].tolist()]):
                g = gone[s:e]
                out["n_bytes"].append(e - s)
                out["n_removed"].append(int(g.sum()))
                out["n_spans"].append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
                out["kept"].append(raw[s:e][~g].tobytes())
        df = pd.DataFrame(out)
        df["doc_id"] = pd.Series(out["doc_id"], dtype=object)
        return df

    return run


def remove(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    blocks = bucketed(rows.mapInArrow(_pack(size, gram), PACKED), "block", "suffix-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    asked = blocks.select("block", "anchors", "which").mapInArrow(_ask_anchors(ranges), "range int, block long, keys binary, counts binary")
    first = cut(asked.groupBy("range").applyInPandas(_answer_anchors(hot), ANSWER))
    forget(spark)
    told = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInPandas(_ask_texts(ranges, size), "range int, block long, keys binary, sizes binary, texts binary, counts binary, prints binary, times binary")
    second = cut(told.groupBy("range").applyInPandas(_answer_texts(size, scratch_root(spark)), ANSWER))
    forget(spark)
    kept = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    return blocks.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInPandas(_remove(ranges, size), kept)


def digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """remove, with the SHA-256 of the remaining bytes in their place."""
    return remove(docs, size).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
