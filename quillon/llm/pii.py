"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans: the four kinds in notations that the patterns know and in
others ("name (at) host [dot] org", "10[.]0[.]0[.]1", card numbers with dots, phone numbers without a plus), among
words and numbers of other sorts. Texts are read whole, in overlapping windows, and every window is scored. A
window is decoded by Viterbi unless its scores prove that the path without spans is the best one (`certain`). The
spans of all windows of a text are reconciled by weighted interval scheduling: the set of disjoint spans with the
largest total margin over "no span" is kept.

Defined results: null and empty texts have no spans; repeated rows are read one by one; an empty table gives
an empty table; further columns are ignored by `scan` and kept by `mask`; offsets are code points. Pattern spans
stay as they are; spans of the network that touch one are dropped, as are those that begin or end inside a word or
a longer number, and those that break the rules of their kind (an at and a dot, signs or words; parts of an
address; check digit; number of digits).
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import inspect
import io
import random
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import load_bytes, save_bytes, shared_dir

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
#: Characters of a window, and from one to the next; a span of up to their difference lies whole in a window.
WINDOW, STRIDE = 512, 448
HIDDEN, BATCH = 16, 256
#: Steps of the network that are scored at once.
STEPS = 16
#: Least margin of a span of the network over no span, in natural logarithms.
MARGIN = 2.0
#: Labelled windows for training, their length, rounds and seed.
SAMPLES, SAMPLE_CHARS, EPOCHS, SEED = 6000, 128, 10, 7

# Fixed values of the contract; lookbehind and possessive forms keep long runs linear. A digit comes before the
# lookbehind, as the search then runs from digit to digit.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind: str, match: str) -> bool:
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in re.findall(r"[0-9]+", match))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Sorted (start, number of kind, end) of the patterns, leftmost and without overlap per kind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m[0])]
    return sorted(out)


# --- the network -----------------------------------------------------------------------------------

PAD = 0
_ASCII = np.full(128, 1, np.uint8)
for _i, _c in enumerate("\n !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _ASCII[ord(_c)] = 5 + _i
_ASCII[48:58], _ASCII[65:91], _ASCII[97:123] = 2, 3, 4
CLASSES = int(_ASCII.max()) + 2
_OTHER = CLASSES - 1


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(cp: np.ndarray) -> np.ndarray:
    return np.where(cp < 128, _ASCII[np.minimum(cp, 127)], np.uint8(_OTHER))


def init(seed: int = SEED, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Parameters; the first axis of W, U and c is the direction of reading, their last one in, forget, out, cell."""
    g = np.random.default_rng(seed)
    p = {
        "A": np.zeros((LABELS, LABELS)), "V": g.normal(0, 0.2, (2 * hidden, LABELS)), "d": np.zeros(LABELS), "W": g.normal(0, 0.3, (2, CLASSES, 4 * hidden)),
        "U": g.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)), "c": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], hidden), (2, 1)),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def _states(p: dict, x: np.ndarray, keep: list) -> np.ndarray:
    """Hidden states (T, B, 2 H) for classes x (T, B), for training. Both directions step together, gate by gate, so
    that all arrays are contiguous; keep gathers what the gradients need."""
    t, b = x.shape
    n, kind = p["U"].shape[1], p["U"].dtype
    half = np.array([0.5, 0.5, 0.5, 1.0], kind)[:, None, None, None]  # a sigmoid is a tanh of half its argument
    table = (_by_gate(p["W"] + p["c"][:, None]) * half).reshape(-1, n)
    turn = _by_gate(p["U"]) * half
    rows, both = np.arange(8).reshape(4, 2, 1) * CLASSES, np.stack([x, x[::-1]], 1)
    h, c, z, add = np.zeros((2, b, n), kind), np.zeros((2, b, n), kind), np.empty((4, 2, b, n), kind), np.empty((4, 2, b, n), kind)
    hs = np.empty((t, b, 2 * n), kind)
    for i in range(t):
        np.take(table, rows + both[i], axis=0, out=z, mode="clip")
        np.matmul(h, turn, out=add)
        z += add
        np.tanh(z, out=z)
        before, prev = c, h
        c = z[1] * c
        c += before
        add[0] = z[0]
        add[0] *= z[3]
        c += add[0]
        c += z[3]
        c *= kind.type(0.5)
        th = np.tanh(c)
        h = z[2] * th
        h += th
        h *= kind.type(0.5)
        hs[i, :, :n], hs[t - 1 - i, :, n:] = h[0], h[1]
        keep.append((z.copy(), before, th, prev))
    return hs


def _by_gate(x: np.ndarray) -> np.ndarray:
    """(2, K, 4 H) as (4, 2, K, H)."""
    return np.ascontiguousarray(x.reshape(2, x.shape[1], 4, -1).transpose(2, 0, 1, 3))


def _by_way(x: np.ndarray) -> np.ndarray:
    """(4, 2, K, H) as (2, K, 4 H)."""
    return x.transpose(1, 2, 0, 3).reshape(2, x.shape[2], -1)


def _aligned(shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
    """An array that begins at a cache line, which numpy's own do not; vector instructions take whole lines."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    raw = np.empty(size + 64, np.uint8)
    at = -raw.ctypes.data % 64
    return raw[at : at + size].view(kind).reshape(shape)


def emissions(p: dict, x: np.ndarray) -> np.ndarray:
    """x: classes (B, T); scores (B, T, LABELS). The steps are those of `_states`, but nothing is kept: every array is
    used again, some steps' states are scored while they are in the cache, and weights carry the halves of the gates."""
    (b, t), n, kind = x.shape, p["U"].shape[1], p["U"].dtype.type
    half, one = kind(0.5), kind(1)
    by_gate = np.array([0.5, 0.5, 0.5, 1.0], kind)[:, None, None, None]
    table, turn, out = _aligned((8 * CLASSES, n), kind), _aligned((4, 2, n, n), kind), _aligned((2, LABELS, n), kind)
    table[:] = (_by_gate(p["W"] + p["c"][:, None]) * by_gate).reshape(-1, n)
    turn[:] = _by_gate(p["U"]) * by_gate * half  # h below is twice the state
    out[:] = p["V"].reshape(2, n, LABELS).transpose(0, 2, 1) * half
    xt = np.ascontiguousarray(x.T, np.intp)
    rows, both = np.arange(8).reshape(4, 2, 1) * CLASSES, np.stack([xt, xt[::-1]], 1)[:, None]
    z, add, c = _aligned((4, 2, b, n), kind), _aligned((4, 2, b, n), kind), _aligned((2, b, n), kind)
    hs, said = _aligned((STEPS, 2, b, n), kind), _aligned((STEPS, 2, LABELS, b), kind)
    e = np.empty((t, LABELS, b), kind)
    e[:] = p["d"][:, None]
    gates, (gi, gf, go, cell), h = z[:3], z, hs[-1]
    c[:], h[:] = 0, 0
    for i in range(0, t, STEPS):
        k = min(STEPS, t - i)
        for j, at in enumerate(rows + both[i : i + k]):
            np.take(table, at, axis=0, out=z, mode="clip")
            np.matmul(h, turn, out=add)
            np.add(z, add, out=z)
            np.tanh(z, out=z)
            np.add(gates, one, out=gates)  # twice the sigmoids
            np.multiply(gf, c, out=c)
            np.multiply(gi, cell, out=cell)
            np.add(c, cell, out=c)
            np.multiply(c, half, out=c)
            h = hs[j]
            np.tanh(c, out=h)
            np.multiply(h, go, out=h)
        np.matmul(out, hs[:k].transpose(0, 1, 3, 2), out=said[:k])
        e[i : i + k] += said[:k, 0]
        e[t - i - k : t - i] += said[:k, 1][::-1]
    return e.transpose(2, 0, 1)  # a label's scores at a place stand together


def _step(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Loss per window and gradients of the CRF's negative log-likelihood."""
    xt, b, n = np.ascontiguousarray(x.T, np.intp), len(x), p["U"].shape[1]
    kept: list = []
    hs = _states(p, xt, kept)
    e = hs @ p["V"] + p["d"]
    t = len(xt)
    top = e.max(2, keepdims=True)
    w, a = np.exp(e - top), np.exp(p["A"])
    alpha, beta, scale = np.empty_like(w), np.ones_like(w), np.empty((t, b, 1), w.dtype)
    for i in range(t):
        alpha[i] = w[i] if i == 0 else (alpha[i - 1] @ a) * w[i]
        scale[i] = alpha[i].sum(1, keepdims=True)
        alpha[i] /= scale[i]
    for i in range(t - 2, -1, -1):
        beta[i] = ((w[i + 1] * beta[i + 1]) @ a.T) / scale[i + 1]
    pairs = np.einsum("tbi,tbj->ij", alpha[:-1], w[1:] * beta[1:] / scale[1:], optimize=True) * a
    yt = y.T
    rows, cols = np.arange(t)[:, None], np.arange(b)[None]
    loss = (np.log(scale) + top).sum() - e[rows, cols, yt].sum() - p["A"][yt[:-1], yt[1:]].sum()
    de = alpha * beta  # marginals
    de[rows, cols, yt] -= 1
    np.add.at(pairs, (yt[:-1], yt[1:]), -1)
    dhs = de @ p["V"].T
    turn = _by_gate(p["U"]).transpose(0, 1, 3, 2)
    d_turn, dz_all = np.zeros((4, 2, n, n), hs.dtype), np.empty((4, 2, t, b, n), hs.dtype)
    dh, dc, one_ = np.zeros((2, b, n), hs.dtype), np.zeros((2, b, n), hs.dtype), hs.dtype.type(1)
    for i in range(t - 1, -1, -1):
        z, before, th, prev = kept[i]
        gi, gf, go, cell = (z[0] + one_) / 2, (z[1] + one_) / 2, (z[2] + one_) / 2, z[3]
        dh[0] += dhs[i, :, :n]
        dh[1] += dhs[t - 1 - i, :, n:]
        dc = dc + dh * go * (1 - th * th)
        dz = np.stack([dc * cell * gi * (1 - gi), dc * before * gf * (1 - gf), dh * th * go * (1 - go), dc * gi * (1 - cell * cell)])
        dz_all[:, 0, i], dz_all[:, 1, t - 1 - i] = dz[:, 0], dz[:, 1]
        d_turn += prev.transpose(0, 2, 1) @ dz
        dh, dc = (dz @ turn).sum(0), dc * gf
    one = (xt.reshape(-1, 1) == np.arange(CLASSES)).astype(hs.dtype)
    flat = dz_all.reshape(4, 2, -1, n)
    grad = {"A": pairs, "V": hs.reshape(-1, 2 * n).T @ de.reshape(-1, LABELS), "d": de.sum((0, 1)), "U": _by_way(d_turn), "W": _by_way(one.T @ flat), "c": _by_way(flat.sum(2, keepdims=True))[:, 0]}
    return float(loss) / b, {k: (v / b).astype(p[k].dtype) for k, v in grad.items()}


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, batch: int = 32, rate: float = 0.015) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of labelled windows x, y (N, WINDOW)."""
    p, g = init(seed), np.random.default_rng(seed)
    m, v, n = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    steps = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = g.permutation(len(x))
        for s in range(0, len(x), batch):
            _, grad = _step(p, x[order[s : s + batch]], y[order[s : s + batch]])
            n += 1
            norm = np.sqrt(sum(float((d * d).sum()) for d in grad.values()))
            lr = rate * (1 - 0.9 * n / steps)
            for k, d in grad.items():
                d = d * min(1.0, 5.0 / max(norm, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    return p


def viterbi(p: dict, e: np.ndarray) -> np.ndarray:
    """Best labels (B, T) for scores e."""
    b, t, _ = e.shape
    back = np.empty((t, b, LABELS), np.int8)
    best = e[:, 0]
    for i in range(1, t):
        s = best[:, :, None] + p["A"]
        back[i] = s.argmax(1)
        best = s.max(1) + e[:, i]
    path = np.empty((b, t), np.int64)
    path[:, -1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = back[i][np.arange(b), path[:, i]]
    return path


def certain(p: dict, e: np.ndarray) -> np.ndarray:
    """Which windows of scores e have no span on their best path, proven without decoding: all labels but none are
    merged into one, whose scores and transitions are their greatest, and even so no run of it gains on none."""
    a = p["A"] - p["A"][0, 0]
    enter, leave, stay = float(a[0, 1:].max()), float(a[1:, 0].max()), float(a[1:, 1:].max())
    e = e.transpose(2, 1, 0)  # label, place, window
    best = np.maximum(e[1], e[2])
    for label in e[3:]:
        np.maximum(best, label, out=best)
    best -= e[0]
    best += np.float32(stay)
    sums = np.cumsum(best, axis=0)
    # a run from i to j gains sums[j] - sums[i - 1] - stay, and the transitions into and out of it
    start = np.empty_like(sums)
    start[0], start[1:] = 0.0, enter - sums[:-1]
    gain = sums + np.maximum.accumulate(start, axis=0) - stay
    gain[:-1] += leave
    return gain.max(0) < -1e-2  # more than rounding


def decoded(p: dict, e: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """Per window of scores e the spans (start, kind, end, margin): what the span's labels and the transitions into,
    inside and out of it score more than no span."""
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in e]
    a = p["A"] - p["A"][0, 0]
    for w, (path, score) in enumerate(zip(viterbi(p, e), e)):
        gain = np.cumsum(score[np.arange(len(path)), path] - score[:, 0] + np.concatenate([[0], a[path[:-1], path[1:]]]))
        for i in np.flatnonzero((path > 0) & ((path % 2 == 1) | (np.concatenate([[0], path[:-1]]) == 0))).tolist():
            kind, j = (int(path[i]) - 1) // 2, i + 1
            while j < len(path) and path[j] == 2 + 2 * kind:
                j += 1
            end = j if j < len(path) and path[j] == 0 else j - 1  # with the transition back to none
            out[w].append((i, kind, j, float(gain[end] - (gain[i - 1] if i else 0.0))))
    return out


# --- labelled samples ------------------------------------------------------------------------------


def _word(g: random.Random, a: int = 2, z: int = 9) -> str:
    if g.random() < 0.5:
        return "".join(g.choice(("the", "ing", "an", "ver", "sch", "ei", "ou", "la", "re", "ti", "on", "ent", "de", "ch", "é", "ción", "ad", "ung", "st", "qu")) for _ in range(g.randint(1, 4)))[:z]
    return "".join(g.choice("aeiounrtslmdcghkpbvwyäéöü" if g.random() < 0.1 else "aeiounrtslmdcghkpbvwy") for _ in range(g.randint(a, z)))


def _name(g: random.Random) -> str:
    return "".join(g.choice("aeiounrtslmdcghkpbvwyfjz") for _ in range(g.randint(2, 8)))


def _digits(g: random.Random, n: int) -> str:
    return "".join(g.choice("0123456789") for _ in range(n))


def email(g: random.Random, known: float = 0.3) -> str:
    """An address; known: the share in the notation of the patterns."""
    local = g.choice([_name(g), _name(g) + "." + _name(g), _name(g) + "_" + _digits(g, 2), _name(g) + _digits(g, g.randint(1, 4)), _name(g)[0] + "." + _name(g)])
    host = [_name(g) + g.choice(["", "", "-" + _name(g)])] + [_name(g)] * (g.random() < 0.2) + [g.choice(["com", "org", "net", "de", "fr", "es", "example", "io", "edu"])]
    if g.random() < known:
        return local + "@" + ".".join(host)
    at = g.choice(["(at)", " (at) ", "[at]", " [at] ", "{at}", " @ ", "@"])
    dot = {" @ ": [" . ", "."], "@": ["[.]", "(.)", "[dot]"]}.get(at) or [".", "(dot)", "[dot]", " [dot] ", " (dot) "]
    return local + at + g.choice(dot).join(host)


def ip(g: random.Random, known: float = 0.3) -> str:
    return ("." if g.random() < known else g.choice([" . ", "[.]", "(.)", "[dot]", " dot "])).join(str(g.choice([g.randint(0, 255), g.choice([10, 127, 192, 168, 172])])) for _ in range(4))


def card(g: random.Random, known: float = 0.3) -> str:
    n = g.choice([13, 15, 16, 16, 16, 16, 19])
    body = _digits(g, n - 1)
    number = next(body + d for d in "0123456789" if luhn(body + d))
    sep = g.choice(["", " ", "-"]) if g.random() < known else g.choice([".", "/", "_", "  ", " - ", "\u00a0"])
    return sep.join(number[i : i + 4] for i in range(0, n, 4))


def phone(g: random.Random, known: float = 0.3) -> str:
    area, sep = _digits(g, g.randint(2, 4)), g.choice([" ", "-", ".", " ", "-"])
    rest = sep.join([_digits(g, 3), _digits(g, 4)]) if g.random() < 0.6 else _digits(g, g.randint(6, 8))
    if g.random() < known:
        return f"+{g.randint(1, 99)}" + g.choice([f"{sep}{area}{sep}", f" ({area}) "]) + rest
    head = g.choice([f"({_digits(g, 3)}) ", f"(0{_digits(g, 2)}) ", f"{_digits(g, 3)}{sep}", f"00{g.randint(10, 99)}{sep}{area}{sep}", f"0{_digits(g, 3)}/", f"0{_digits(g, 3)} ", f"1-{_digits(g, 3)}-"])
    rest = rest if head[-1] not in "/ " or sep == " " or head[0] == "(" else rest.replace(sep, " ")
    return head + rest


def other(g: random.Random) -> str:
    """What is none of the four kinds but looks a little like one."""
    w, d = functools.partial(_word, g), functools.partial(_digits, g)
    return g.choice(
        [
            lambda: f"{g.randint(1900, 2099)}-{g.randint(1, 12):02}-{g.randint(1, 28):02}", lambda: f"{g.randint(1, 28)}.{g.randint(1, 12)}.{g.randint(1990, 2030)}", lambda: f"{g.randint(1, 12)}/{g.randint(1, 28)}/{g.randint(90, 99)}",
            lambda: f"{g.randint(0, 23):02}:{g.randint(0, 59):02}:{g.randint(0, 59):02}", lambda: f"${g.randint(1, 99999):,}.{d(2)}", lambda: f"{g.randint(1, 9)}.{g.randint(0, 20)}.{g.randint(0, 20)}", lambda: f"#{d(g.randint(2, 7))}", lambda: d(g.randint(1, 12)),
            lambda: f"@{w(4, 10)}", lambda: "".join(g.choice("0123456789abcdef") for _ in range(g.choice([8, 16, 32, 40]))), lambda: f"{w()}={d(3)}", lambda: f"AKIA{''.join(g.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}", lambda: f"{d(3)} | {d(2)} | {d(4)}", lambda: f"{d(2)}%", lambda: f"{w()}{d(2)}", lambda: f"http://{w()}.com/{d(5)}",
            lambda: f"{w()} at {w()}", lambda: f"{w()} at the {w()}. {w().capitalize()}", lambda: f"{w()} at {w()}.{w()}", lambda: f"{w()} dot {w()}", lambda: f"{d(1)} @ {d(2)}.{d(2)}", lambda: f"{w()}.{w()}", lambda: f"www.{w()}.{w()}.com", lambda: f"({w()}) {w()} [{w()}]",
            lambda: f"{d(4)}-{d(4)}", lambda: f"{d(2)} {d(2)} {d(2)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"({d(4)})", lambda: f"({d(1)}) {w()}", lambda: f"{d(2)}.{d(4)}, {d(2)}.{d(4)}", lambda: f"{d(1)}.{d(1)}.", lambda: f"{d(3)}.{d(3)}.{d(3)},{d(2)}", lambda: f"[{d(2)}]", lambda: f"{d(5)} {w().capitalize()}",
            lambda: g.choice(["###", "&&&", "***", "|||", "---", "%%", "<>", "!!!"]) * g.randint(1, 5), lambda: f"{w()}_{w()}_{d(2)}", lambda: f'token = "{"".join(g.choice("0123456789abcdef") for _ in range(32))}"', lambda: f"{d(g.randint(13, 20))}{g.choice('abc#')}",
        ]
    )()


MAKERS = (email, ip, card, phone)


def prose(g: random.Random) -> str:
    """A word and what follows it."""
    w = _word(g, 1, 12)
    return (w.capitalize() if g.random() < 0.15 else w) + g.choice([" ", " ", " ", " ", " ", ", ", ". ", ".\n", ": ", " (", ") ", "! ", "; "])


def labelled_text(g: random.Random, least: int, known: float = 0.3) -> tuple[str, list[tuple[int, int, int]]]:
    """A text of at least so many characters and its spans (start, kind, end)."""
    parts, spans, n = [], [], 0

    def put(piece: str) -> None:
        nonlocal n
        parts.append(piece)
        n += len(piece)

    while n < least:
        for _ in range(g.randint(1, 12)):
            put(prose(g))
        if g.random() < 0.5:
            kind = g.randrange(len(KINDS))
            piece = MAKERS[kind](g, known)
            spans.append((n, kind, n + len(piece)))
            put(piece)
        else:
            put(other(g))
        put(g.choice([" ", ". ", ", ", "\n", ") ", "; "]))
    return "".join(parts), spans


def labelled(n: int = SAMPLES, seed: int = SEED, chars: int = SAMPLE_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """`n` labelled windows, composed by rule; windows start and end anywhere, so spans may be cut."""
    g = random.Random(seed)
    xs, ys = [], []
    for _ in range(n):
        text, spans = labelled_text(g, 2 * chars)
        y = np.zeros(len(text), np.int64)
        for s, kind, e in spans:
            y[s], y[s + 1 : e] = 1 + 2 * kind, 2 + 2 * kind
        s = g.randint(0, len(text) - chars // 2)
        c = classes(codes(text[s : s + chars]))
        xs.append(np.pad(c, (0, chars - len(c))))
        ys.append(np.pad(y[s : s + chars], (0, chars - len(c))))
    return np.stack(xs), np.stack(ys)


@functools.lru_cache(maxsize=2)
def _trained(samples: int, epochs: int, seed: int) -> dict[str, np.ndarray]:
    return train(*labelled(samples, seed), epochs, seed)


_KEPT: dict[str, dict[str, np.ndarray]] = {}


def default_model(spark: SparkSession, samples: int = SAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The network trained on the labelled samples. It is trained once and kept in the shared folder, under a name
    that changes with the parameters and with this file."""
    name = hashlib.sha256(repr((samples, epochs, seed)).encode() + inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark).rstrip('/')}/pii-{name}.npz"
    if path not in _KEPT:
        raw = load_bytes(spark, path)
        if raw is None:
            out = io.BytesIO()
            np.savez(out, **_trained(samples, epochs, seed))
            save_bytes(spark, path, raw := out.getvalue())
        with np.load(io.BytesIO(raw)) as held:
            _KEPT[path] = dict(held)
    return _KEPT[path]


# --- the scan --------------------------------------------------------------------------------------


def windows(n: int) -> range:
    """Starts of the windows of n characters."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE) if n else range(0)


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The disjoint spans of the largest total score; of equal sets the one that ends first."""
    spans = sorted({(e, s, k): w for s, k, e, w in sorted(spans, key=lambda x: x[3])}.items())
    ends, best = [x[0][0] for x in spans], [(0.0, -1, -1)]
    for i, ((_, s, _), w) in enumerate(spans):
        j = bisect.bisect_right(ends, s, 0, i)
        best.append(max((best[i][0], -1, i), (best[j][0] + w, i, j), key=lambda x: x[0]))
    out, i = [], len(spans)
    while i > 0:
        _, took, before = best[i]
        if took >= 0:
            e, s, k = spans[took][0]
            out.append((s, k, e))
        i = before
    return out[::-1]


def _allowed(text: str, start: int, kind: int, end: int) -> bool:
    """No part of a longer word or number, one line, and the rules of the kind."""
    match = text[start:end]
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum() or "\n" in match or not (match[0].isalnum() or match[0] in "(+") or not match[-1].isalnum():
        return False
    if kind == 0:
        return bool(re.search(r"@|\bat\b", match, re.I) and re.search(r"\.|\bdot\b", match, re.I))
    if re.search(r"[0-9]\W?\Z", text[max(0, start - 2) : start]) or re.match(r"\W?[0-9]", text[end : end + 2]):
        return False
    if kind == 1 and len(re.findall(r"[0-9]+", match)) != 4:
        return False
    return valid(KINDS[kind], match)


def find(texts: list[str], model: dict[str, np.ndarray], margin: float = MARGIN) -> list[tuple[list, list]]:
    """Per text the spans of the patterns and the further spans of the network."""
    found: list[list] = [[] for _ in texts]
    waiting: dict[int, list] = {}  # windows by their length, rounded up
    unproven: dict[int, list] = {}  # likewise, those that must be decoded, with their scores

    def flush(size: int) -> None:
        rows = waiting.pop(size)
        x = np.zeros((len(rows), size), np.uint8)
        for k, (_, _, c) in enumerate(rows):
            x[k, : len(c)] = c
        e = emissions(model, x)
        for k in np.flatnonzero(~certain(model, e)).tolist():  # few, so they wait for those of other batches
            unproven.setdefault(size, []).append((*rows[k][:2], e[k].copy()))
        if len(unproven.get(size, ())) >= BATCH:
            decode(size)

    def decode(size: int) -> None:
        rows = unproven.pop(size)
        for (i, s, _), spans in zip(rows, decoded(model, np.stack([e for _, _, e in rows]))):
            found[i] += [(s + a, k, s + z, w) for a, k, z, w in spans if w >= margin]

    for i, text in enumerate(texts):
        c = classes(codes(text))
        for s in windows(len(c)):
            part = c[s : s + WINDOW]
            size = -(-len(part) // 32) * 32
            waiting.setdefault(size, []).append((i, s, part))
            if len(waiting[size]) >= BATCH:
                flush(size)
    for size in sorted(waiting):
        flush(size)
    for size in sorted(unproven):
        decode(size)
    out = []
    for text, spans in zip(texts, found):
        base = base_spans(text)
        starts, longest = [x[0] for x in base], np.maximum.accumulate([x[2] for x in base]) if base else []
        free = []
        for s, k, e, w in spans:
            j = bisect.bisect_left(starts, e)
            if (j == 0 or longest[j - 1] <= s) and _allowed(text, s, k, e):
                free.append((s, k, e, w))
        out.append((base, reconcile(free)))
    return out


def scan(docs: DataFrame, model: dict[str, np.ndarray], margin: float = MARGIN) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_model."""

    def said(spans: list) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = find([x or "" for x in b.column("text").to_pylist()], model, margin)
            count = [[sum(x[1] == k for x in base) for base, _ in got] for k in range(len(KINDS))]
            sha = [hashlib.sha256(said(base).encode()).hexdigest() for base, _ in got]
            every = [said(sorted(base + more)) for base, more in got]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in count], pa.array(sha, pa.string()), pa.array(every, pa.string()), pa.array([len(more) for _, more in got], pa.int64())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_model"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_model long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def mask(docs: DataFrame, model: dict[str, np.ndarray], margin: float = MARGIN) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, e.g. [EMAIL]; null texts stay null.
    Of overlapping spans the one that starts first is replaced."""
    names = docs.columns
    at = names.index("text")

    def cover(text: str, spans: list) -> str:
        out, last = [], 0
        for s, k, e in sorted(spans):
            if s >= last:
                out += [text[last:s], f"[{KINDS[k].upper()}]"]
                last = e
        return "".join(out) + text[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [None if t is None else cover(t, base + more) for t, (base, more) in zip(texts, find([t or "" for t in texts], model, margin))]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else b.column(i) for i in range(len(names))], names=[f"c{i}" for i in range(len(names))])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema).toDF(*names)
