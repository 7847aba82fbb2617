"""An averaged-perceptron character editor for misread words."""

from __future__ import annotations

import difflib
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable

KEEP, DELETE = "k", "d"


def deletions(word: str, most: int = 2) -> set[str]:
    """The word with up to `most` characters left out."""
    out = cur = {word}
    for _ in range(most):
        cur = {w[:i] + w[i + 1 :] for w in cur for i in range(len(w))}
        out = out | cur
    return out


def operations(noisy: str, clean: str) -> list[str] | None:
    """An operation for each character of noisy that turns it into clean: keep, delete, r+text (replace), i+text (keep, then insert).

    None if they differ at more than one place, or there by more than two characters.
    """
    out: list[str] = []
    sites = 0
    for tag, a, b, c, d in difflib.SequenceMatcher(None, noisy, clean, autojunk=False).get_opcodes():
        if tag == "equal":
            out.extend([KEEP] * (b - a))
            continue
        sites += 1
        if sites > 1 or b - a > 2 or d - c > 2:
            return None
        if tag == "insert":
            if not out:
                return None
            out[-1] = "i" + clean[c:d]
        else:
            out.append("r" + clean[c:d] if d > c else DELETE)
            out.extend([DELETE] * (b - a - 1))
    return out


def features(word: str, i: int) -> tuple[str, ...]:
    a, c, b = word[i - 1] if i else "^", word[i], word[i + 1] if i + 1 < len(word) else "$"
    z = word[i + 2] if i + 2 < len(word) else "$"
    return "0" + c, "1" + a + c, "2" + c + b, "3" + a + c + b, "4" + c + b + z


class Editor:
    """Predicts an operation for each character of a word in lower case."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}
        #: Operations other than keep that each character (with the next one, for those that also delete it) has been seen with.
        self.seen: dict[str, list[str]] = {}

    def scores(self, word: str, i: int, labels: Iterable[str]) -> dict[str, float]:
        f = [w for x in features(word, i) if (w := self.weights.get(x))]
        return {y: sum(w.get(y, 0.0) for w in f) for y in labels}

    def train(self, pairs: list[tuple[str, str]], clean: list[str], times: dict[str, int] | None = None, rounds: int = 5, support: int = 3) -> Editor:
        """pairs of (misread, plain) words; clean: words to keep; times: how often a misread word stands in the collection.

        An edit is learned if `support` pairs have it, or two whose words stand there ten times.
        """
        rows: list[tuple[str, list[str]]] = []
        edits: Counter = Counter()
        seen_times: Counter = Counter()
        found = [(n, o) for n, c in pairs if (o := operations(n, c)) and any(x != KEEP for x in o)]
        site = lambda n, o: next((n[i : i + 1 + (o[i + 1 : i + 2] == [DELETE])], o[i]) for i in range(len(o)) if o[i] != KEEP)
        for n, o in found:
            edits[site(n, o)] += 1
            seen_times[site(n, o)] += (times or {}).get(n, 1)
        known = {e for e, k in edits.items() if k >= support or k >= 2 and seen_times[e] >= 10}
        rows = [(n, o) for n, o in found if site(n, o) in known] + [(w, [KEEP] * len(w)) for w in clean]
        seen: dict[str, set[str]] = defaultdict(set)
        for chars, op in known:
            seen[chars].add(op)
        self.seen = {c: sorted(v) for c, v in sorted(seen.items())}
        by_char: dict[str, set[str]] = defaultdict(lambda: {KEEP})
        for n, o in rows:
            for c, x in zip(n, o, strict=True):
                by_char[c].add(x)
        total: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        w: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        step = 0
        rows.sort(key=lambda r: hash_of(r[0]))
        for _ in range(rounds):
            for n, o in rows:
                for i, truth in enumerate(o):
                    labels = by_char[n[i]]
                    step += 1
                    if len(labels) == 1:
                        continue
                    f = features(n, i)
                    guess = max(sorted(labels), key=lambda y: sum(w[x][y] for x in f if x in w))
                    if guess != truth:
                        for x in f:
                            w[x][truth] += 1
                            w[x][guess] -= 1
                            total[x][truth] += step
                            total[x][guess] -= step
        self.weights = {x: {y: v - total[x][y] / max(step, 1) for y, v in ys.items()} for x, ys in w.items()}
        return self

    def sites(self, word: str) -> list[tuple[float, int, int, str]]:
        """(score over keep, start, end, text): single edits the editor knows of, the likeliest first."""
        out = []
        for i in range(len(word)):
            for n in (1, 2):
                for op in self.seen.get(word[i : i + n], ()) if i + n <= len(word) else ():
                    s = self.scores(word, i, (op, KEEP))
                    text = word[i] + op[1:] if op[0] == "i" else op[1:] if op[0] == "r" else ""
                    out.append((s[op] - s[KEEP], i, i + n, text))
        return sorted(out, key=lambda x: (-x[0], x[1:]))

    def candidates(self, word: str, most: int = 24) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(spelling, score, edits): single edits and combinations of up to three, the likeliest first."""
        sites = self.sites(word)[:12]
        if (x := unicodedata.normalize("NFKC", word)) != word and len(word) > 1:  # ligatures and full-width forms
            sites = sorted([*sites, *[(8.0, i, i + 1, y) for i, c in enumerate(word) if (y := unicodedata.normalize("NFKC", c)) != c]], key=lambda s: (-s[0], s[1:]))[:12]
        level: list[tuple[float, list[tuple[int, int, str]]]] = [(s, [(a, b, t)]) for s, a, b, t in sites]
        all_, prev = list(level), level
        for _ in range(2):
            nxt = []
            for s, edits in prev[:8]:
                for s2, a, b, t in sites:
                    if a >= edits[-1][1]:
                        nxt.append((s + s2 - 2.0, [*edits, (a, b, t)]))
            nxt.sort(key=lambda x: (-x[0], x[1]))
            all_.extend(nxt[:12])
            prev = nxt
        all_.sort(key=lambda x: (-x[0], len(x[1]), x[1]))
        out, had = [], {word}
        for s, edits in all_:
            x = apply(word, edits)
            if x and x not in had:
                had.add(x)
                out.append((x, s, edits))
                if len(out) >= most:
                    break
        return out


def apply(word: str, edits: list[tuple[int, int, str]]) -> str:
    """word with edits (start, end, text), in its letter case: text in capitals where all other letters are."""
    rest = "".join(c for i, c in enumerate(word) if c.isalpha() and not any(a <= i < b for a, b, _ in edits))
    caps = len(rest) > 1 and rest.isupper()
    out, at = [], 0
    for a, b, t in edits:
        out.append(word[at:a])
        old = word[a:b]
        out.append(t.upper() if caps or (a == 0 and old[:1].isupper() and len(t) == 1) else t.capitalize() if a == 0 and old[:1].isupper() else t)
        at = b
    return "".join(out) + word[at:]


def hash_of(s: str) -> int:
    """A hash that is the same in every process."""
    h = 1469598103934665603
    for c in s:
        h = (h ^ ord(c)) * 1099511628211 & (1 << 64) - 1
    return h


def mined_pairs(rare: list[str], frequent: list[str]) -> list[tuple[str, str]]:
    """(rare, frequent) words at most two characters apart, by a shared deletion; the nearest frequent word counts."""
    by: dict[str, list[str]] = defaultdict(list)
    for w in frequent:
        for d in deletions(w):
            by[d].append(w)
    out = []
    for w in rare:
        near = {y for d in deletions(w) for y in by.get(d, ())} - {w}
        if near:
            y = max(sorted(near), key=lambda y: difflib.SequenceMatcher(None, w, y, autojunk=False).ratio())
            out.append((w, y))
    return out
