"""Edit distances of many pairs of texts at once, in code points: bit-parallel columns (Myers, in Hyyro's form for several words)."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_LAST = np.uint64(63)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
# Kinds of code points that are counted apart: those of ASCII are, all others share 32 of them.
KINDS = 128


class Texts:
    """Texts as one array of code points."""

    def __init__(self, texts: list[str]) -> None:
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.start[i] : self.start[i] + self.size[i]]

    def kinds(self) -> np.ndarray:
        """How many code points of each kind a text has, a row each."""
        at = np.repeat(np.arange(len(self.size)), self.size) * KINDS
        at += np.where(self.codes < KINDS, self.codes, self.codes & 31)
        counts = np.bincount(at, minlength=len(self.size) * KINDS).reshape(-1, KINDS)
        return counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.int32)


def single(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two arrays of code points, whole columns as one number each."""
    if len(a) < len(b):
        a, b = b, a
    m = len(a)
    if not len(b):
        return m
    eqs = {c: int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little") for c in np.unique(b).tolist()}
    mask = (1 << m) - 1
    up, down = mask, 0
    # Bits above the mask are of no consequence to those below it.
    for c in b.tolist():
        eq = eqs[c]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = (down | (xh | up) ^ mask) << 1 | 1
        up = ((up & xh) << 1 | (xv | ph) ^ mask) & mask
        down = ph & xv
    return len(b) + up.bit_count() - down.bit_count()


def _run(codes: np.ndarray, x: np.ndarray, y: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
    """How many code points in a row, up to limit, are equal from the places x and y on, forwards (1) or backwards (-1)."""
    n = np.zeros(len(x), np.int64)
    live, width = np.flatnonzero(limit > 0), 16
    while len(live):
        to = n[live, None] + np.arange(width)
        same = to < limit[live, None]
        to = np.minimum(to, limit[live, None] - 1) * way
        same &= codes[x[live, None] + to] == codes[y[live, None] + to]
        whole = same.all(axis=1)
        n[live] += np.where(whole, width, same.argmin(axis=1))
        live = live[whole]
        width = max(16, min(2 * width, (1 << 18) // max(1, len(live))))
    return n


def distances(a: Texts, i: np.ndarray, b: Texts, j: np.ndarray) -> np.ndarray:
    """Edit distances of the texts i of a and j of b, pair by pair."""
    codes = np.concatenate([a.codes, b.codes])
    x, m, y, n = a.start[i], a.size[i], b.start[j] + len(a.codes), b.size[j]
    # Equal beginnings and endings don't count.
    for k in range(0, len(i), 1 << 14):
        s = slice(k, k + (1 << 14))
        head = _run(codes, x[s], y[s], np.minimum(m[s], n[s]), 1)
        x[s], m[s], y[s], n[s] = x[s] + head, m[s] - head, y[s] + head, n[s] - head
        tail = _run(codes, x[s] + m[s] - 1, y[s] + n[s] - 1, np.minimum(m[s], n[s]), -1)
        m[s], n[s] = m[s] - tail, n[s] - tail
    turned = -(-m // 64) * n > -(-n // 64) * m
    x, m, y, n = np.where(turned, y, x), np.where(turned, n, m), np.where(turned, x, y), np.where(turned, m, n)
    out = np.maximum(m, n)
    words = -(-m // 64)
    some = (m > 0) & (n > 0)
    for w in np.unique(words[some]).tolist():
        at = np.flatnonzero(some & (words == w))
        # Those of like lengths together, the longest first: columns end from the right.
        at = at[np.argsort(-n[at], kind="stable")]
        k = 0
        while k < len(at):
            part = at[k : k + max(1, min(8192, (1 << 21) // int(n[at[k]])))]
            if len(part) < 16 * w:
                # Few or long ones: numbers of any size cost less than short arrays of words.
                for p in part.tolist():
                    out[p] = single(codes[x[p] : x[p] + m[p]], codes[y[p] : y[p] + n[p]])
            else:
                out[part] = _columns(codes, x[part], m[part], y[part], n[part], w)
            k += len(part)
    return out


def _columns(codes: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray, w: int) -> np.ndarray:
    """Distances of pairs whose first texts all have w words of 64 code points; the second ones are sorted, the longest first."""
    steps = np.arange(int(n[0]))
    text = codes[np.minimum(y + steps[:, None], len(codes) - 1)]
    letters = np.unique(text)
    if len(letters) * w * len(m) > 1 << 23 and len(m) > 1:
        h = len(m) // 2
        return np.concatenate([_columns(codes, x[s], m[s], y[s], n[s], w) for s in (slice(h), slice(h, None))])
    # Where each letter stands in each first text, as bits: texts x words x letters.
    who = np.repeat(np.arange(len(m)), m)
    place = np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m)
    own = codes[x[who] + place]
    letter = np.searchsorted(letters, own)
    letter[letter == len(letters)] = 0
    known = letters[letter] == own
    bits = np.zeros(len(m) * w * len(letters), np.uint64)
    np.add.at(bits, ((who * w + place // 64) * len(letters) + letter)[known], (_ONE << (place % 64).astype(np.uint64))[known])
    index = np.searchsorted(letters, text)
    index[index == len(letters)] = 0
    index += np.arange(len(m)) * (w * len(letters))

    up = np.full((w, len(m)), _ALL)
    down = np.zeros((w, len(m)), np.uint64)
    eq, xv, xh, ph, mh = (np.empty(len(m), np.uint64) for _ in range(5))
    more, less = np.empty((2, len(m)), np.uint64), np.empty((2, len(m)), np.uint64)
    active = np.searchsorted(-n, -steps, side="left").tolist()
    for t, k in enumerate(active):
        e, v, h, p, l = eq[:k], xv[:k], xh[:k], ph[:k], mh[:k]
        for q in range(w):
            u, o = up[q, :k], down[q, :k]
            at = index[t, :k] + q * len(letters) if q else index[t, :k]
            bits.take(at, out=e, mode="clip")
            np.bitwise_or(e, o, out=v)
            if q:
                e |= less[(q - 1) % 2, :k]
            np.bitwise_and(e, u, out=h)
            h += u
            h ^= u
            h |= e
            np.bitwise_or(h, u, out=p)
            np.invert(p, out=p)
            p |= o
            np.bitwise_and(u, h, out=l)
            if q < w - 1:
                # What the last place of the word hands on to the next word.
                np.right_shift(p, _LAST, out=more[q % 2, :k])
                np.right_shift(l, _LAST, out=less[q % 2, :k])
            np.left_shift(p, _ONE, out=p)
            np.left_shift(l, _ONE, out=l)
            p |= more[(q - 1) % 2, :k] if q else _ONE
            if q:
                l |= less[(q - 1) % 2, :k]
            np.bitwise_or(v, p, out=u)
            np.invert(u, out=u)
            u |= l
            np.bitwise_and(p, v, out=o)
    # The last column's steps down from its first row, which is as many as it has columns to the left.
    used = np.clip(m - 64 * np.arange(w)[:, None], 0, 64).astype(np.uint64)
    used = np.where(used > 63, _ALL, (_ONE << (used & _LAST)) - _ONE)
    return n + np.bitwise_count(up & used).sum(axis=0, dtype=np.int64) - np.bitwise_count(down & used).sum(axis=0, dtype=np.int64)


def nearest(a: Texts, b: Texts, first: np.ndarray, count: np.ndarray, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(which, distance) for every text of a: which of its `count` (1 at least) texts of b, from `first` on, has the least distance / longer length.

    The first wins ties. The code points that two texts have in common, wherever they stand, bound their distance from below; those with
    the least bounds are compared first, and none that can't win any more. Bounds are made for about `most` pairs at a time.
    """
    ka, kb = a.kinds(), b.kinds()
    # With nothing in common the distance is the longer length, so the first one is the nearest unless another has something.
    which, found = np.zeros(len(first), np.int64), np.maximum(a.size, b.size[first])
    best = np.minimum(found, 1).astype(float)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, pairs = 0, np.cumsum(count)
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + most, side="right")))
        n = count[at:to]
        i = np.repeat(np.arange(at, to), n)
        own = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        common = _in_common(ka, i, kb, first[i] + own)
        longest = np.maximum(a.size[i], b.size[first[i] + own])
        least = (longest - common) / np.maximum(longest, 1)
        some = np.flatnonzero((common > 0) | (longest == 0))
        some = some[np.lexsort((own[some], least[some], i[some]))]
        kept.append((i[some].astype(np.int32), own[some].astype(np.int32), least[some]))
        at = to
    live, own, least = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))
    take = 1
    while len(live):
        begin = np.flatnonzero(np.concatenate([[True], live[1:] != live[:-1]]))
        turn = np.arange(len(live)) - np.repeat(begin, np.diff(np.append(begin, len(live)))) < take
        i, w = live[turn], own[turn].astype(np.int64)
        d = distances(a, i, b, first[i] + w)
        ratio = d / np.maximum(np.maximum(a.size[i], b.size[first[i] + w]), 1)
        o = np.lexsort((w, ratio, i))
        o = o[np.concatenate([[True], i[o][1:] != i[o][:-1]])]
        i, w, d, ratio = i[o], w[o], d[o], ratio[o]
        won = (ratio < best[i]) | ((ratio == best[i]) & (w < which[i]))
        best[i[won]], which[i[won]], found[i[won]] = ratio[won], w[won], d[won]
        may = ~turn & ((least < best[live]) | ((least == best[live]) & (own < which[live])))
        live, own, least = live[may], own[may], least[may]
        take *= 2
    return which, found


def _in_common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many code points the rows i of a and j of b have in common, pair by pair."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 4096):
        s = slice(k, k + 4096)
        np.minimum(a[i[s]], b[j[s]]).sum(axis=1, dtype=np.int64, out=out[s])
    return out
