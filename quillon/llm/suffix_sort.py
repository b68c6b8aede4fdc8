"""External induced sorting of suffixes, with common-prefix values.

The method: suffixes are of type S (smaller than the next suffix) or L. The leftmost S suffixes of each run
are sorted first (their substrings are sorted and named; equal names are resolved by recursion on the string
of names). All L suffixes follow from them in one ascending sweep, and all S suffixes from those in one
descending sweep: whatever suffix the sweep meets, the suffix one to the left, if of the wanted type, goes to
a priority queue under its first symbol and is met again in that order.

A queued tuple carries the suffix and the length of its common prefix with the tuple queued before it under the
same symbol, which is one more than the least such value between the two suffixes that induced them.

Memory holds some multiples of `limit` items (about 60 bytes each), whatever the length of the text: text, types, names, the
order of a recursion, seeds, results and the runs of the queues lie in files of a scratch folder beyond that many
items, and are read and written in parts of at most `limit` items. Sweeps work on blocks of tuples that cannot induce
into their own block, so all steps are array operations; a symbol with more tuples than fit is swept in parts, in the
order they were queued. Files are unlinked as soon as they are mapped and go with the process. Positions
take four bytes, and eight for texts beyond 2^32 - 1 symbols.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np

#: Items that an array, a queue or a spool holds in memory before it uses the disk.
MEMORY_ITEMS = 4_000_000


class Scratch:
    """Where arrays, spools and queues lie: memory up to `limit` items, files of `folder` beyond."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, max(2, limit)

    def array(self, n: int, kind) -> np.ndarray:
        if n <= self.limit:
            return np.zeros(n, kind)
        path = os.path.join(self.folder, uuid.uuid4().hex)
        out = np.memmap(path, kind, "w+", shape=(n,))
        os.unlink(path)
        return np.asarray(out)

    def parts(self, n: int) -> Iterator[tuple[int, int]]:
        return ((s, min(s + self.limit, n)) for s in range(0, n, self.limit))


class Spool:
    """Append-only columns."""

    def __init__(self, scratch: Scratch, kinds: list):
        self.scratch, self.kinds, self.held, self.count, self.written = scratch, kinds, [], 0, 0
        self.files: list = []

    def __len__(self) -> int:
        return self.written + self.count

    def append(self, *cols: np.ndarray) -> None:
        self.held.append([np.asarray(c, k) for c, k in zip(cols, self.kinds)])
        self.count += len(cols[0])
        if self.count > self.scratch.limit:
            self._flush()

    def _flush(self) -> None:
        if not self.files:
            self.files = [open(os.path.join(self.scratch.folder, uuid.uuid4().hex), "w+b") for _ in self.kinds]
        for f, cols in zip(self.files, zip(*self.held)):
            np.concatenate(cols).tofile(f)
        self.written, self.count, self.held = self.written + self.count, 0, []

    def columns(self) -> list[np.ndarray]:
        """What was appended; the spool is done."""
        if not self.files:
            return [np.concatenate(c) for c in zip(*self.held)] if self.held else [np.empty(0, k) for k in self.kinds]
        if self.held:
            self._flush()
        out = []
        for f, k in zip(self.files, self.kinds):
            f.flush()
            out.append(np.asarray(np.memmap(f.name, k, "r+", shape=(self.written,))))
            f.close()
            os.unlink(f.name)
        return out


def _place(keys: np.ndarray, below: int) -> int:
    """First place of a sorted array of keys that is not under `below` (of the same type, lest it be copied)."""
    return len(keys) if below > np.iinfo(keys.dtype).max else int(keys.searchsorted(keys.dtype.type(below)))


class Queue:
    """Priority queue of (key, further columns) in bulk; equal keys leave in the order they came. Sorted runs go to disk
    beyond the limit; beyond MANY_RUNS of them they are merged into one."""

    MANY_RUNS = 48

    def __init__(self, scratch: Scratch, kinds: list):
        self.scratch, self.kinds = scratch, kinds
        self.runs: list[list] = []  # [columns, cursor, on disk], oldest first

    def push(self, *cols: np.ndarray) -> None:
        if not len(cols[0]):
            return
        cols = [np.asarray(c, k) for c, k in zip(cols, self.kinds)]
        order = np.argsort(cols[0], kind="stable")
        self.runs.append([[c[order] for c in cols], 0, False])
        while len(self.runs) > 1 and not self.runs[-2][2] and self._left(-2) < 2 * self._left(-1):
            self._merge(len(self.runs) - 2)
        if sum(self._left(i) for i, r in enumerate(self.runs) if not r[2]) > self.scratch.limit:
            self._merge(next(i for i, r in enumerate(self.runs) if not r[2]))
            self._to_disk()

    def _to_disk(self) -> None:
        spool = Spool(Scratch(self.scratch.folder, 2), self.kinds)
        for s, e in self.scratch.parts(len(self.runs[-1][0][0])):
            spool.append(*[c[s:e] for c in self.runs[-1][0]])
        self.runs[-1] = [spool.columns(), 0, True]
        if sum(r[2] for r in self.runs) > self.MANY_RUNS:
            old = Queue(self.scratch, self.kinds)
            old.runs = self.runs
            whole = Spool(Scratch(self.scratch.folder, 2), self.kinds)
            while (low := old.least()) is not None:
                for part in old.blocks(low):
                    whole.append(*part)
            self.runs = [[whole.columns(), 0, True]]

    def _left(self, i: int) -> int:
        return len(self.runs[i][0][0]) - self.runs[i][1]

    def _merge(self, first: int) -> None:
        """Runs from `first` on, all in memory, become one."""
        some = self.runs[first:]
        cols = [np.concatenate([r[0][k][r[1] :] for r in some]) for k in range(len(self.kinds))]
        order = np.argsort(cols[0], kind="stable") if len(some) > 1 else slice(None)
        self.runs[first:] = [[[c[order] for c in cols], 0, False]]

    def least(self) -> int | None:
        self.runs = [r for r in self.runs if r[1] < len(r[0][0])]
        return min((int(r[0][0][r[1]]) for r in self.runs), default=None)

    def count(self, below: int) -> int:
        """Tuples with a key under `below`."""
        return sum(max(0, _place(r[0][0], below) - r[1]) for r in self.runs)

    def peek(self, below: int) -> list[np.ndarray]:
        """All tuples with a key under `below`, in order; count them first."""
        ends = [_place(r[0][0], below) for r in self.runs]
        parts = [[np.asarray(r[0][k][r[1] : e]) for r, e in zip(self.runs, ends) if e > r[1]] for k in range(len(self.kinds))]
        if not parts[0]:
            return [np.empty(0, k) for k in self.kinds]
        cols = [np.concatenate(p) for p in parts]
        if len(parts[0]) > 1:
            order = np.argsort(cols[0], kind="stable")
            cols = [c[order] for c in cols]
        return cols

    def drop(self, below: int) -> None:
        for r in self.runs:
            r[1] = max(r[1], _place(r[0][0], below))

    def some(self, key: int) -> list[np.ndarray] | None:
        """Take the next tuples of the least key, in the order they came, as many as fit; None if there are none. Tuples
        pushed meanwhile under that key come last."""
        cols, left = [], self.scratch.limit
        for r in self.runs:
            e = min(_place(r[0][0], key + 1), r[1] + left)
            if e > r[1]:
                cols.append([np.asarray(c[r[1] : e]) for c in r[0]])
                left, r[1] = left - (e - r[1]), e
            if not left:
                break
        return [np.concatenate(c) for c in zip(*cols)] if cols else None

    def blocks(self, low: int) -> Iterator[list[np.ndarray]]:
        """Take tuples from the least key `low` on, in order, in blocks that fit: of several keys where they
        fit together, else of one."""
        below, step = low + 1, 1
        while step < 1 << 62 and self.count(below + step) <= self.scratch.limit:
            below, step = below + step, 2 * step
        if self.count(below) <= self.scratch.limit:
            out = self.peek(below)
            self.drop(below)
            yield out
            return
        while (part := self.some(low)) is not None:
            yield part


class Seeds:
    """The suffixes that start a sweep, in the order met: keys, places, and the common prefix of each with the one before
    (or None). `top`: the columns are read backwards, keys being top less theirs."""

    def __init__(self, keys: np.ndarray, pos: np.ndarray, lcp: np.ndarray | None, top: int | None = None):
        self.keys, self.pos, self.lcp, self.top, self.n = keys, pos, lcp, top, len(pos)

    def key(self, i: int) -> int:
        return int(self.keys[i]) if self.top is None else self.top - int(self.keys[self.n - 1 - i])

    def place(self, below: int) -> int:
        if self.top is None:
            return _place(self.keys, below)
        return self.n - _place(self.keys, max(0, self.top - below + 1))

    def part(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        if self.top is None:
            return np.asarray(self.keys[s:e]), np.asarray(self.pos[s:e]), None if self.lcp is None else np.asarray(self.lcp[s:e])
        a, z = self.n - e, self.n - s
        keys = (self.top - np.asarray(self.keys[a:z][::-1]).astype(np.int64)).astype(self.keys.dtype)
        lcp = None
        if self.lcp is not None:  # the value between two neighbours stands at the later one
            lcp, first = np.zeros(e - s, np.uint8), int(s == 0)
            lcp[first:] = self.lcp[a + 1 : z + 1 - first][::-1]
        return keys, np.asarray(self.pos[a:z][::-1]), lcp


def word_view(buffer: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n positions of a byte buffer on as one integer, first byte lowest;
    the buffer has eight bytes more than n."""
    return np.ndarray((n,), np.dtype("<u8"), buffer, strides=(1,))


def common(words: np.ndarray, p: np.ndarray, q: np.ndarray, cap: int) -> np.ndarray:
    """Lengths of the common prefixes of different suffixes p and q, at most cap, by direct comparison. They differ at the
    latest where one reaches the last symbol, which is unique."""
    out = np.full(len(p), cap, np.int64)
    active, p, q = np.arange(len(p)), p.astype(np.int64), q.astype(np.int64)
    for step in range(0, cap, 8):
        if not len(active):
            break
        x = words[p[active] + step] ^ words[q[active] + step]
        diff = x != 0
        low = x[diff] & (~x[diff] + np.uint64(1))
        out[active[diff]] = np.minimum(cap, step + (np.log2(low.astype(np.float64)) // 8).astype(np.int64))
        active = active[~diff]
    return out


def types(scratch: Scratch, text: np.ndarray) -> np.ndarray:
    """True for S. The last symbol is the unique least one, of type S."""
    n = len(text)
    out = scratch.array(n, bool)
    out[n - 1] = after = True
    for s, e in reversed(list(scratch.parts(n - 1))):
        part = np.asarray(text[s : e + 1])
        same = part[1:] == part[:-1]
        up = part[1:] > part[:-1]
        # a symbol equal to its right neighbour has the neighbour's type
        at = np.where(same, e - s, np.arange(e - s))
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[s:e] = np.append(up, after)[at]
        after = bool(out[s])
    return out


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last] for each pair."""
    table = [values]
    level = np.zeros(len(first), np.int64)
    size = last - first + 1
    level[size > 1] = np.floor(np.log2(size[size > 1])).astype(np.int64)
    for k in range(int(level.max(initial=0))):
        t = table[-1]
        table.append(np.minimum(t[: -(1 << k)], t[1 << k :]))
    out = np.empty(len(first), values.dtype)
    for k in range(len(table)):
        m = level == k
        out[m] = np.minimum(table[k][first[m]], table[k][last[m] - (1 << k) + 1])
    return out


def sweep(scratch: Scratch, text, is_s, want_s: bool, top: int, seeds: Seeds, words, cap: int) -> list[np.ndarray]:
    """One inducing sweep. Returns columns (symbol, suffix, common prefix with the one queued before it under its symbol) of
    the induced suffixes, in the order met. want_s: the descending sweep. Values are carried if the seeds have them."""
    kind, place = text.dtype, seeds.pos.dtype
    key_of = (lambda p: (top - text[p].astype(np.int64)).astype(kind)) if want_s else (lambda p: text[p])
    carry = seeds.lcp is not None
    queue, out = Queue(scratch, [kind, place, np.uint8]), Spool(scratch, [kind, place, np.uint8])
    pending = np.full(top + 1, -1, np.int64) if carry else None  # least value since the last tuple under a symbol
    at, last_key, last_pos, last_queued, width = 0, -1, 0, False, 1024

    def induce(pos: np.ndarray, lcp: np.ndarray | None) -> None:
        """Queue the tuples induced by the suffixes pos met in this order."""
        src = np.flatnonzero(pos > 0)
        pred = pos[src] - 1
        ok = is_s[pred] == want_s
        src, pred = src[ok], pred[ok]
        keys = key_of(pred)
        value = np.zeros(len(pred), np.uint8)
        if carry:
            order = np.argsort(keys, kind="stable")
            k, s = keys[order], src[order]
            same = np.zeros(len(k), bool)
            same[1:] = k[1:] == k[:-1]
            before = np.zeros(len(k), np.int64)
            before[1:] = s[:-1] + 1
            before[~same] = 0
            least = _range_min(lcp, before, s).astype(np.int64)
            head = pending[k[~same]]
            least[~same] = np.where(head < 0, -1, np.minimum(head, least[~same]))
            value[order] = np.minimum(cap, least + 1)
            tail = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1], [cap]])
            np.minimum(pending, int(lcp.min()), out=pending, where=pending >= 0)
            ends = np.flatnonzero(np.append(~same[1:], True)) if len(k) else np.empty(0, np.int64)
            pending[k[ends]] = tail[s[ends] + 1]
        queue.push(keys, pred, value)

    def meet(keys: np.ndarray, pos: np.ndarray, lcp: np.ndarray | None, queued: np.ndarray) -> None:
        """Go on from suffixes met in this order; values are set at the seams: between symbols, and between queued tuples
        and the first seed."""
        nonlocal last_key, last_pos, last_queued
        pos = pos.astype(np.int64)
        if carry:
            new = np.concatenate([[last_key], keys[:-1].astype(np.int64)]) != keys
            lcp = np.where(new, 0, lcp)
            seam = np.flatnonzero(~new & np.concatenate([[last_queued], queued[:-1]]) & ~queued)
            lcp[seam] = common(words, np.concatenate([[last_pos], pos[:-1]])[seam], pos[seam], cap)
            last_key, last_pos, last_queued = int(keys[-1]), int(pos[-1]), bool(queued[-1])
            lcp = lcp.astype(np.uint8)
        induce(pos, lcp)

    def take(keys: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
        """Suffixes that leave the queue are results."""
        symbol = (top - keys.astype(np.int64)).astype(kind) if want_s else keys
        out.append(symbol, pos, value)

    while True:
        head = queue.least()
        low = min((x for x in (head, seeds.key(at) if at < seeds.n else None) if x is not None), default=None)
        if low is None:
            return out.columns()
        high = low + width
        while high > low + 1 and queue.count(high) + seeds.place(high) - at > scratch.limit:
            high = low + max(1, (high - low) // 4)
        if high > low + 1:
            keys, items, values = queue.peek(high)
            end = max(at, seeds.place(high))
            seed_keys, seed_pos, seed_lcp = seeds.part(at, end)
            pos = np.concatenate([items, seed_pos]).astype(np.int64)
            src = pos[pos > 0] - 1
            made = key_of(src[is_s[src] == want_s])
            inner = int(made.min()) if len(made) else high
            if inner < high:  # no further than what the block itself induces
                width = max(1, inner - low)
                high = max(low + 1, inner)
                n_q, n_s = _place(keys, high), _place(seed_keys, high)
                keys, items, values, end = keys[:n_q], items[:n_q], values[:n_q], at + n_s
                seed_keys, seed_pos, seed_lcp = seed_keys[:n_s], seed_pos[:n_s], None if seed_lcp is None else seed_lcp[:n_s]
            else:
                inner, width = high, min(2 * (high - low), 1 << 30)
            if inner > low:
                queue.drop(high)
                take(keys, items, values)
                every = np.concatenate([keys, seed_keys])
                order = np.argsort(every, kind="stable")
                lcp = np.concatenate([values, seed_lcp])[order] if carry else None
                if len(every):
                    meet(every[order], np.concatenate([items, seed_pos])[order], lcp, (np.arange(len(every)) < len(keys))[order])
                at = end
                continue
        # one symbol: what it induces into itself comes after its queued tuples; its seeds, which induce
        # nothing into it, come last
        while (part := queue.some(low)) is not None:
            take(*part)
            meet(part[0], part[1], part[2], np.ones(len(part[0]), bool))
        end = max(at, seeds.place(low + 1))
        while at < end:
            upto = min(end, at + scratch.limit)
            keys, pos, lcp = seeds.part(at, upto)
            meet(keys, pos, lcp, np.zeros(len(keys), bool))
            at = upto
        width = max(width, 2)


def _names(scratch: Scratch, text, is_s, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The substrings between leftmost S positions, sorted: (positions in that order, names of the substrings in the order
    of the text, number of names); equal substrings have equal names. Symbols are compared together with their
    types, so no substring is a prefix of another. Substrings are sorted by their first symbols outside memory; those alike
    so far are sorted on in memory, or the same way again if they do not fit."""
    n, m = len(text), len(lms)
    most = 0
    for s, e in scratch.parts(n):
        most = max(most, int(text[s:e].max()))
    bits = 10 if most < 511 else 64
    per = 64 // bits
    length = scratch.array(n // 2 + 1, lms.dtype)  # by half the position, as two never stand side by side
    for s, e in scratch.parts(m):
        some = np.asarray(lms[s : min(e + 1, m)])
        length[some[: e - s] >> 1] = np.append(np.diff(some) + 1, [] if e < m else [1]).astype(lms.dtype)

    def key(pos: np.ndarray, step: int) -> np.ndarray:
        out, size = np.zeros(len(pos), np.uint64), length[pos >> 1]
        for k in range(per):
            at = np.minimum(pos + step + k, n - 1)
            symbol = (text[at].astype(np.uint64) << np.uint64(1)) + is_s[at] + np.uint64(1)
            out = (out << np.uint64(bits) if per > 1 else out) | np.where(step + k < size, symbol, np.uint64(0))
        return out

    order, names, number, count = Spool(scratch, [lms.dtype]), scratch.array(n // 2 + 1, lms.dtype), -1, 0

    def emit(pos: np.ndarray, new: np.ndarray) -> None:
        nonlocal number, count
        order.append(pos)
        rank = number + np.cumsum(new)
        names[pos >> 1] = rank
        number, count = int(rank[-1]), count + len(pos)

    def in_memory(pos: np.ndarray, keys: np.ndarray, step: int) -> None:
        """Sort on substrings that are in the order of `keys`, their symbols from step on."""
        rank, group = np.zeros(len(pos), np.int64), np.arange(len(pos))
        new = np.append(True, keys[1:] != keys[:-1])
        start = np.maximum.accumulate(np.where(new, group, 0))
        rank[:] = start  # the rank of a group is its first place in the whole order
        single = new & np.append(new[1:], True)
        step += per
        active = np.flatnonzero(~single & (length[pos >> 1] > step))
        while len(active):
            more = key(pos[active], step)
            by = np.lexsort((more, rank[active]))
            a, k = active[by], more[by]
            r = rank[a]
            group = np.append(True, r[1:] != r[:-1])
            new = group | np.append(True, k[1:] != k[:-1])
            places = np.arange(len(a))
            rank[a] = r + np.maximum.accumulate(np.where(new, places, 0)) - np.maximum.accumulate(np.where(group, places, 0))
            single = new & np.append(new[1:], True)
            step += per
            active = a[~single & (length[pos[a] >> 1] > step)]
        by = np.argsort(rank, kind="stable")
        emit(pos[by], np.append(True, rank[by][1:] != rank[by][:-1]))

    def outside(source: np.ndarray, step: int) -> None:
        """Sort substrings that are alike before step."""
        queue = Queue(scratch, [np.uint64, lms.dtype])
        for s, e in scratch.parts(len(source)):
            pos = np.asarray(source[s:e]).astype(np.int64)
            queue.push(key(pos, step), pos)
        while (low := queue.least()) is not None:
            if queue.count(low + 1) <= scratch.limit:
                for keys, pos in queue.blocks(low):
                    in_memory(pos.astype(np.int64), keys, step)
                continue
            alike = Spool(scratch, [lms.dtype])
            while (part := queue.some(low)) is not None:
                alike.append(part[1])
            (alike,) = alike.columns()
            if int(length[int(alike[0]) >> 1]) <= step + per:  # the whole substrings are equal
                for k, (s, e) in enumerate(scratch.parts(len(alike))):
                    emit(np.asarray(alike[s:e]).astype(np.int64), np.arange(e - s) == (0 if k == 0 else -1))
            else:
                outside(alike, step + per)

    outside(lms, 0)
    text_order = scratch.array(m, np.uint32 if number < 1 << 32 else np.uint64)
    for s, e in scratch.parts(m):
        text_order[s:e] = names[np.asarray(lms[s:e]) >> 1]
    return order.columns()[0], text_order, number + 1


def _parts(scratch: Scratch, text, words, cap: int):
    """(L suffixes), (S suffixes): columns of the sweeps; the S ones descending."""
    n = len(text)
    place = np.uint32 if n < 1 << 32 else np.uint64
    is_s, lms, top = types(scratch, text), Spool(scratch, [place]), 0
    for s, e in scratch.parts(n):
        part = np.asarray(is_s[max(0, s - 1) : e])
        part = part if s else np.append(True, part)
        lms.append((np.flatnonzero(part[1:] & ~part[:-1]) + s).astype(place))
        top = max(top, int(text[s:e].max()))
    (lms,) = lms.columns()
    order, names, count = _names(scratch, text, is_s, lms)
    if count < len(lms):
        ranks = suffix_array(scratch, names)
        spool = Spool(scratch, [place])
        for s, e in scratch.parts(len(ranks)):
            spool.append(lms[np.asarray(ranks[s:e])])
        (order,) = spool.columns()
    seeds = Spool(scratch, [text.dtype, place, np.uint8])
    for s, e in scratch.parts(len(order)):
        pos = np.asarray(order[s:e])
        lcp = np.zeros(len(pos), np.uint8)
        if words is not None:
            both = np.asarray(order[max(0, s - 1) : e])
            lcp[int(s == 0) :] = common(words, both[:-1], both[1:], cap)
        seeds.append(text[pos], pos, lcp)
    keys, pos, lcp = seeds.columns()
    ls = sweep(scratch, text, is_s, False, top, Seeds(keys, pos, None if words is None else lcp), words, cap)
    # the last suffix is of type S and starts no sweep: the L suffix before it is induced by its seed
    ss = sweep(scratch, text, is_s, True, top, Seeds(ls[0], ls[1], None if words is None else ls[2], top), words, cap)
    return ls, ss


def suffix_array(scratch: Scratch, text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of integers whose last symbol is its unique least."""
    n = len(text)
    out = scratch.array(n, np.uint32 if n < 1 << 32 else np.uint64)
    out[0] = n - 1
    if n == 1:
        return out
    (l_key, l_pos, _), (s_key, s_pos, _) = _parts(scratch, text, None, 0)
    # under a symbol the L suffixes come first; the least suffix is before all
    up = s_key[::-1]
    for s, e in scratch.parts(len(l_pos)):
        out[1 + np.arange(s, e) + up.searchsorted(np.asarray(l_key[s:e]))] = l_pos[s:e]
    for s, e in scratch.parts(len(s_pos)):
        at = len(s_pos) - 1 - np.arange(s, e)
        out[1 + at + l_key.searchsorted(np.asarray(s_key[s:e]), side="right")] = s_pos[s:e]
    return out


def repeated(text: np.ndarray, size: int, folder: str, limit: int = MEMORY_ITEMS) -> np.ndarray:
    """True at the positions of a text of bytes (last one its unique least) whose next `size` symbols also
    start elsewhere: suffixes with such a neighbour in the order of all suffixes. size: at most 255. text and the
    result may be files."""
    scratch, n = Scratch(folder, limit), len(text)
    out = scratch.array(n, bool)
    if n <= size:
        return out
    buffer = scratch.array(n + 8, np.uint8)
    for s, e in scratch.parts(n):
        buffer[s:e] = text[s:e]
    words = word_view(buffer, n)
    sides = _parts(scratch, buffer[:n], words, size)
    last: list[dict[int, int]] = []
    for keys, pos, lcp in sides:
        found: dict[int, int] = {}  # the last suffix under each symbol: the greatest L and the least S one
        before = 0
        for s, e in scratch.parts(len(pos)):
            some, hit = np.asarray(pos[s:e]).astype(np.int64), np.flatnonzero(np.asarray(lcp[s:e]) >= size)
            out[some[hit]] = True
            out[np.append(before, some[:-1])[hit]] = True
            before = int(some[-1])
            ends = np.flatnonzero(np.append(np.asarray(keys[s + 1 : e]) != np.asarray(keys[s : e - 1]), True))
            found |= zip(np.asarray(keys[s:e])[ends].tolist(), some[ends].tolist())
        last.append(found)
    both = sorted(last[0].keys() & last[1].keys())
    p, q = (np.array([side[c] for c in both], np.int64) for side in last)
    hit = common(words, p, q, size) >= size
    out[p[hit]] = True
    out[q[hit]] = True
    return out
