"""Plain versions of the contracts, for comparison. Rows are (doc_id, text) lists; results stand in their order."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD3 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def _spans(text, kinds):
    found = sorted((m.start(), i, m.end()) for i, (_, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text or "") if ok(m))
    said = ",".join(f"{kinds[i][0]}:{s}:{e}" for s, i, e in found)
    return [sum(x[1] == i for x in found) for i in range(len(kinds))], said


def secrets(rows):
    kinds = [("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    return [(k, *n, sha(said)) for k, t in rows for n, said in [_spans(t, kinds)]]


def secret_spans(text, model, symbols, drop, widen):
    """All spans of a text: the base ones, and the segments that the two Markov models tell from what is left."""
    text = text or ""
    kinds = [("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    found = [(m.start(), i, m.end()) for i, (_, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m)]
    left = list(text)
    for s, _, e in found:
        left[s:e] = " " * (e - s)
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}", "".join(left)):
        run, segs, total, start, best, end = m[0], [], 0.0, 0, 0.0, 1
        for i in range(1, len(run) + 1):
            total += model.ratios[symbols.index(run[i - 1]) * len(symbols) + symbols.index(run[i])] if i < len(run) else -1e9
            if total < 0 or total < best - drop:
                if best >= model.cutoff:
                    segs.append((start, end))
                total, start, best, end = 0.0, i, 0.0, i + 1
            elif total > best:
                best, end = total, i + 1
        last = 0
        for k, (s, e) in enumerate(segs):
            e += len(re.match("[A-Za-z0-9]*", run[e : e + widen])[0])
            e = min(e, segs[k + 1][0]) if k + 1 < len(segs) else e
            s = max(last, s - len(re.search("[A-Za-z0-9]*$", run[max(0, s - widen) : s])[0]))
            found.append((m.start() + s, 3, m.start() + e))
            last = e
    return ",".join(f"{['assign', 'access', 'hex', 'random'][k]}:{s}:{e}" for s, k, e in sorted(found))


def _luhn(digits):
    return sum(x // 10 + x % 10 for i, c in enumerate(reversed(digits)) for x in [int(c) * (1 + i % 2)]) % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m[0])


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(_digits(m)) <= 19 and _luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15),
]


def personal(rows):
    return [(k, *n, sha(said)) for k, t in rows for n, said in [_spans(t, PERSONAL)]]


def _network(p, x):
    """Scores (T, labels) of one window of classes, step by step."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    both = []
    for way in (0, 1):
        n = p["U"].shape[1]
        h, c, hs = np.zeros(n), np.zeros(n), []
        for k in x if way == 0 else x[::-1]:
            z = p["W"][way, k].astype(float) + p["c"][way] + h @ p["U"][way]
            c = sigmoid(z[n : 2 * n]) * c + sigmoid(z[:n]) * np.tanh(z[3 * n :])
            h = sigmoid(z[2 * n : 3 * n]) * np.tanh(c)
            hs.append(h)
        both.append(hs if way == 0 else hs[::-1])
    return np.concatenate(both, 1) @ p["V"] + p["d"]


def _best(p, e):
    """Labels of the best path."""
    best, back = [e[0]], []
    for row in e[1:]:
        s = best[-1][:, None] + p["A"]
        back.append(s.argmax(0))
        best.append(s.max(0) + row)
    path = [int(best[-1].argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def personal_spans(text, model, window, stride, margin, classes, allowed):
    """All spans of a text: the base ones, and those of the network in the set of disjoint ones of the largest sum."""
    kinds = ["email", "ip", "card", "phone"]
    base = [(int(s), kinds.index(k), int(e)) for k, s, e in (x.split(":") for x in _spans(text, PERSONAL)[1].split(",") if x)]
    found = {}
    for at in range(0, max(1, len(text) - window + stride) if text else 0, stride):
        x = classes(text[at : at + window])
        x = list(x) + [0] * (-len(x) % 32)
        e = _network(model, x)
        path = _best(model, e)
        a = model["A"] - model["A"][0, 0]
        i = 0
        while i < len(path):
            j = i + 1
            if path[i]:
                kind = (path[i] - 1) // 2
                while j < len(path) and path[j] == 2 + 2 * kind:
                    j += 1
                steps = [(path[t - 1], path[t]) for t in range(max(i, 1), j)] + ([(path[j - 1], 0)] if j < len(path) and path[j] == 0 else [])
                w = sum(e[t, path[t]] - e[t, 0] for t in range(i, j)) + sum(a[u, v] for u, v in steps)
                s, t = at + i, at + j
                if w >= margin and not any(b[0] < t and s < b[2] for b in base) and allowed(text, s, kind, t):
                    found[s, kind, t] = max(w, found.get((s, kind, t), w))
            i = j
    spans = sorted(found.items())

    def best(k, end):
        if k == len(spans):
            return 0.0, []
        (s, kind, e), w = spans[k]
        without = best(k + 1, end)
        if s < end:
            return without
        more = best(k + 1, e)
        return max((without, (more[0] + w, [(s, kind, e), *more[1]])), key=lambda r: r[0])

    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(base + best(0, 0)[1]))


def uncontaminated(text, items):
    """The words of a text outside the windows of the items."""
    windows = {tuple(ws[i : i + n]) for _, t in items for ws in [WORD3.findall((t or "").translate(LOW))] for n in [min(10, len(ws))] for i in range(len(ws) - n + 1) if n}
    ws = WORD3.findall((text or "").translate(LOW))
    hit = {j for n in {len(w) for w in windows} for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows for j in range(i, i + n)}
    return [w for j, w in enumerate(ws) if j not in hit]


def contamination(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        ws = WORD3.findall((text or "").translate(LOW))
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1) if n else ():
            windows[tuple(ws[i : i + n])].add(item)
    out = []
    for k, text in rows:
        ws, hit, found = WORD3.findall((text or "").translate(LOW)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        names = sorted(str(x) for x in found if x is not None)
        out.append((k, len(ws), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def repeats(rows, size=200):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = collections.Counter(b[i : i + size] for _, b in data for i in range(len(b) - size + 1))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((k, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def base_scores(rows):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [zlib.crc32(b"" if k is None else str(k).encode()) % 10 == 0 for k, _ in rows]
    c = collections.Counter(x for ws, h in zip(tokens, held) if not h for x in ws)
    n, v = sum(c.values()), len(c)
    return [(k, h, len(ws), sum(c[x] > 0 for x in ws), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ws), 6)) for (k, _), ws, h in zip(rows, tokens, held)]


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(k, len(s), least.get(root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def quality(rows):
    out = []
    for k, text in rows:
        text = text or ""
        ws = WORD.findall(text)
        seen, cover = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7)), set()
        for i in range(len(ws) - 7):
            if seen[tuple(ws[i : i + 8])] > 1:
                cover.update(range(i, i + 8))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        out.append((k, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(ws) < 20 or 100 * len(cover) > 30 * len(ws)))
    return out


def quality_kept(rows, quality, alpha, delta, grids):
    """Ids that the rules keep. rows: (id, text, stratum); quality: label by id; grids: cutoffs of each rule, strict to lenient."""
    seen = []
    for (k, text, stratum), (_, n, chars, symbols, dup, repeat, failed) in zip(rows, quality_measures(rows)):
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        n = max(n, 1)
        seen.append((k, stratum, failed, (symbols / n, dup / max(lines, 1), repeat / n, (text or "").count("!") / n, chars / n)))
    path = [(i, grid[-1 - level]) for level in range(max(map(len, grids))) for i, grid in enumerate(grids) if level < len(grid)]
    good = collections.defaultdict(list)
    for k, stratum, failed, m in seen:
        if quality.get(k) == 1 and not failed:
            good[stratum].append(m)
    part = delta / (len(good) + 1)
    own = {s: s for s, ms in good.items() if (1 - alpha) ** len(ms) <= part}
    groups = collections.defaultdict(list)
    for s, ms in good.items():
        groups[own.get(s, "pool")] += ms
    cutoffs = {}
    for group, ms in groups.items():
        cutoffs[group] = proven = {}
        tried = {}
        for i, c in path:
            tried[i] = c
            bad = sum(any(m[j] > x for j, x in tried.items()) for m in ms)
            if sum(math.comb(len(ms), j) * alpha**j * (1 - alpha) ** (len(ms) - j) for j in range(bad + 1)) > part:
                break
            proven[i] = c
    return [k for k, s, failed, m in seen if not failed and not any(m[i] > c for i, c in (cutoffs[own.get(s, "pool")] if s in good else {}).items())]


def quality_measures(rows):
    return quality([r[:2] for r in rows])


def lm_scores(rows, order=3, rounds=200):
    """Score of every row by deleted interpolation: plain dictionaries, expectation-maximisation on the tokens themselves."""
    seqs = [["<s>", *(w.translate(LOW) for w in WORD.findall(t or "")), "</s>"] for _, t in rows]
    parts = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 for k, _ in rows]

    def count(of):
        c = collections.Counter()
        for q, part in zip(seqs, parts):
            if part in of:
                c["<s>",] += 1
                c.update(tuple(q[j - n + 1 : j + 1]) for j in range(1, len(q)) for n in range(1, order + 1) if j - n + 1 >= 0 and n <= j + 1)
        words = {k: v for k, v in c.items() if len(k) == 1 and k != ("<s>",)}
        return c, sum(words.values()), len(words)

    def chain(q, j, c, total, v, weights, upto):
        """(probability by n-grams up to upto, per length the bucket and the ratio of its estimate to the shorter ones)"""
        p, seen = 1 / (v + 1), {}
        for n in range(1, upto + 1):
            h = tuple(q[j - n + 1 : j]) if n > 1 else None
            context = total if n == 1 else c[h] if j - n + 1 >= 0 else 0
            if context:
                ml, b = c[(*(h or ()), q[j])] / context, int(math.log2(context))
                seen[n] = b, ml / p
                if n in weights:
                    p = weights[n].get(b, weights[n][None]) * ml + (1 - weights[n].get(b, weights[n][None])) * p
        return p, seen

    def em(ratios):
        a = 0.5
        for _ in range(rounds if ratios else 0):
            a = min(max(sum(a * r / (a * r + 1 - a) for r in ratios) / len(ratios), 1e-6), 1 - 1e-6)
        return a

    kept, weights = count(set(range(2, 10))), {}
    for n in range(1, order + 1):
        found = collections.defaultdict(list)
        for q, part in zip(seqs, parts):
            if part == 1:
                for j in range(1, len(q)):
                    _, seen = chain(q, j, *kept, weights, n)
                    if n in seen:
                        found[seen[n][0]].append(seen[n][1])
        weights[n] = {None: em([r for x in found.values() for r in x])} | {b: em(x) for b, x in found.items()}
    every = count(set(range(1, 10)))
    return [(k, sum(math.log10(chain(q, j, *every, weights, order)[0]) for j in range(1, len(q)))) for (k, _), q in zip(rows, seqs)]
