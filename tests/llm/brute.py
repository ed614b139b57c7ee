"""Plain versions of the corpus operators, one document after another."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

BLANKS = re.compile(r"[ \t-\r]+")
WORDS = re.compile(r"[^ \t-\r]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, size):
    words = WORDS.findall(lower(text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def jaccard(docs, size=3, num=90, den=100):
    """doc_id -> (set size, component) of (doc_id, text) pairs with distinct ids."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {p for h in holders.values() for p in combinations(sorted(h), 2)}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substring(docs, size=20):
    """doc_id -> (words, removed, sha256 of what is kept)."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for at in range(len(words) - size + 1):
            window = tuple(words[at : at + size])
            if window in seen:
                gone[at : at + size] = [True] * size
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def lines(docs, min_chars):
    """doc_id -> deleted line numbers: runs of lines that also start earlier, longest first."""
    text = {i: (t or "").split("\n") for i, t in docs}
    starts = {}
    for i in sorted(text):
        for at, line in enumerate(text[i]):
            starts.setdefault(line, []).append((i, at))
    out = {}
    for i, own in text.items():
        gone = set()
        for at, line in enumerate(own):
            best = 0
            for j, other in starts[line]:
                if (j, other) >= (i, at):
                    break
                n = 0
                while (at + n < len(own) and other + n < len(text[j])
                       and own[at + n] == text[j][other + n]):
                    n += 1
                best = max(best, n)
            if sum(len(x) for x in own[at : at + best]) >= min_chars:
                gone.update(range(at, at + best))
        out[i] = gone
    return out
