"""Byte-level BPE over batches of texts, on flat numpy arrays.

Pre-tokens are cut from the characters of a whole batch at once. The distinct ones the cache does
not know are held as ragged arrays of symbols (one flat array, one sequence number per symbol) and
merged in step: in every round each sequence applies its own lowest-ranked pair, wherever it
stands, until no sequence has a pair with a rank. What is left are the token ids.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import regex

CHUNK_CHARS = 1 << 18
CACHE_BITS = 20
POOL_IDS = 1 << 23
POOL_CHARS = 1 << 22
NEVER = np.int32(2**31 - 1)

SPACE, LETTER, NUMBER, OTHER, GAP = 0, 1, 2, 3, 4


def _byte_letters() -> list[str]:
    """The printable letter byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


@functools.cache
def _classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for begin in range(0, 0x110000, 0x800):
        if 0xD800 <= begin < 0xE000:
            continue
        text = "".join(map(chr, range(begin, begin + 0x800)))
        for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for found in regex.finditer(pattern, text):
                out[begin + found.start() : begin + found.end()] = kind
    return out


def starts_of(code: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """True where a pre-token (or a gap between texts) starts.

    A run of letters, of numbers or of other marks is a pre-token and takes one blank before it;
    white space left over is one, and apostrophe endings ('s 't 're 've 'm 'll 'd) stand alone.
    """
    n = len(code)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = GAP, kind[:-1]
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = GAP, kind[1:]
    solid = (kind == LETTER) | (kind == NUMBER) | (kind == OTHER)
    next_solid = (after == LETTER) | (after == NUMBER) | (after == OTHER)
    blank_before = np.zeros(n, bool)
    blank_before[1:] = code[:-1] == 0x20
    white = kind == SPACE
    start = kind == GAP
    start |= (before == GAP) & ~white
    start |= solid & (kind != before) & ~blank_before
    start |= white & ((before != SPACE) | next_solid)
    quotes = np.flatnonzero((code == 0x27) & (before != OTHER) & ~blank_before)
    if len(quotes):
        padded = np.concatenate([code, np.zeros(2, code.dtype)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
        long |= (one == ord("l")) & (two == ord("l"))
        for chosen, width in ((short, 2), (long & ~short, 3)):
            found = quotes[chosen]
            start[found + 1] = False
            end = found + width
            end = end[end < n]
            start[end[kind[end] == LETTER]] = True
    return start


# No pre-token holds a blank behind another mark, so a text may be cut there.
_SEAM = regex.compile(r"[^\s\x1c-\x1f](?= )")


def _cut(text: str) -> list[str]:
    """A very long text in parts of about a chunk, none of which parts a pre-token."""
    parts = []
    while len(text) > 2 * CHUNK_CHARS:
        seam = _SEAM.search(text, CHUNK_CHARS)
        if seam is None:
            break
        parts.append(text[: seam.end()])
        text = text[seam.end() :]
    return [*parts, text]


def _same(
    code: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray,
    width: np.ndarray,
) -> np.ndarray:
    """Whether runs of ``width`` characters (one at least) in two arrays are equal."""
    if not len(width):
        return np.zeros(0, bool)
    total = np.cumsum(width)
    first = total - width
    step = np.arange(total[-1])
    differ = code[step + np.repeat(start - first, width)] != other[
        step + np.repeat(other_start - first, width)]
    return ~np.logical_or.reduceat(differ, first)


class Bpe:
    """A vocabulary file of the `tokenizers` library (byte-level BPE), as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocabulary = data["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.size = max(vocabulary.values()) + 1
        self.byte_id = np.array([vocabulary[c] for c in _byte_letters()], np.int64)
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        pair = left * self.size + right
        order = np.argsort(pair)
        self.pair, self.rank, self.made = pair[order], order.astype(np.int32), made[order]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        odd = np.random.default_rng(7).integers(1, 2**63, 2, np.uint64) | np.uint64(1)
        self.power = odd[0]
        self.inverse = np.uint64(pow(int(odd[0]), -1, 2**64))
        self.mix = odd[1]
        self._powers(CHUNK_CHARS)
        self._forget()

    def _powers(self, n: int) -> None:
        steps = np.ones((2, n), np.uint64)
        steps[0, 1:], steps[1, 1:] = self.power, self.inverse
        self.up, self.down = np.multiply.accumulate(steps, axis=1)

    def _forget(self) -> None:
        """An empty cache: slots by hash, each pointing into a pool of ids and one of characters.

        Pre-tokens may share a hash; the characters tell them apart.
        """
        self.known = np.zeros(1 << CACHE_BITS, np.uint64)
        self.at = np.zeros(1 << CACHE_BITS, np.int32)
        self.length = np.zeros(1 << CACHE_BITS, np.int32)
        self.pool = np.zeros(POOL_IDS, np.int32)
        self.used = 0
        self.width = np.zeros(1 << CACHE_BITS, np.int32)
        self.spelled = np.zeros(1 << CACHE_BITS, np.int32)
        self.letters = np.zeros(POOL_CHARS, np.uint32)
        self.letters_used = 0

    # ---- merging ------------------------------------------------------------------------------

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            pair = symbols[:-1] * self.size + symbols[1:]
            place = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            rank = np.full(len(symbols), NEVER, np.int32)
            known = inside & (self.pair[place] == pair)
            rank[:-1][known] = self.rank[place[known]]
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            best = np.repeat(
                np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            ended = best == NEVER
            if ended.any():
                done_symbols.append(symbols[ended])
                done_owner.append(owner[ended])
            hit = (rank == best) & ~ended
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # In a run such as "aaa" the pairs overlap: every other one is merged, from the left.
            fresh = np.concatenate([[True], np.diff(at) > 1])
            run = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            at = at[(at - run) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.made[place[at]]
            keep = ~ended
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    # ---- batches ------------------------------------------------------------------------------

    def _plain(self, texts: list[str], ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of tokens per text, and all ids if wanted; special strings are plain text here."""
        joined = "\0".join(texts) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind = _classes()[code]
        kind[ends] = GAP
        start = np.flatnonzero(starts_of(code, kind))
        width = np.diff(np.append(start, len(code)))
        if len(code) > len(self.up):
            self._powers(1 << (len(code) - 1).bit_length())
        value = (code.astype(np.uint64) + np.uint64(1)) * self.mix
        value ^= value >> np.uint64(29)
        value *= self.up[: len(code)]
        key = np.add.reduceat(value, start) * self.down[start]
        real = kind[start] != GAP
        start, width, key = start[real], width[real], key[real]
        key ^= key >> np.uint64(32)
        key = (key + width.astype(np.uint64)) * self.mix | np.uint64(1)
        slot = (key >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        hit = (self.known[slot] == key) & (self.width[slot] == width)
        found = np.flatnonzero(hit)
        hit[found] = _same(
            code, start[found], self.letters, self.spelled[slot[found]], width[found])
        missing = np.flatnonzero(~hit)
        new_ids, at, length = None, self.at[slot], self.length[slot]
        if len(missing):
            unique, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            where = missing[first]
            one = where[back]
            alike = width[missing] == width[one]
            alike[alike] = _same(
                code, start[missing[alike]], code, start[one[alike]], width[missing[alike]])
            # Words that share a hash with another one of the batch are merged on their own.
            back[~alike] = len(where) + np.arange(np.count_nonzero(~alike))
            first_new = len(where)
            where = np.concatenate([where, missing[~alike]])
            words = [joined[a : a + b].encode() for a, b in
                     zip(start[where].tolist(), width[where].tolist(), strict=True)]
            new_ids, sizes = self.merge(words)
            offset = np.cumsum(sizes) - sizes
            length[missing] = sizes[back]
            at[missing] = offset[back] + POOL_IDS  # behind the pool
        pool = self.pool
        text_start = ends - np.array([len(t) for t in texts])
        token = np.concatenate([[0], np.cumsum(length)])
        counts = token[np.searchsorted(start, ends)] - token[np.searchsorted(start, text_start)]
        out = None
        if ids:
            if new_ids is not None:
                pool = np.concatenate([pool, new_ids])
            out = pool[np.repeat(at - token[:-1], length) + np.arange(token[-1])]
        if new_ids is not None:
            where, offset, sizes = where[:first_new], offset[:first_new], sizes[:first_new]
            wide = width[where]
            chars = int(wide.sum())
            if len(new_ids) < POOL_IDS and chars < POOL_CHARS:
                if (self.used + len(new_ids) > POOL_IDS
                        or self.letters_used + chars > POOL_CHARS):
                    self._forget()
                self.pool[self.used : self.used + len(new_ids)] = new_ids
                spelled = np.cumsum(wide) - wide
                step = np.arange(chars)
                self.letters[self.letters_used : self.letters_used + chars] = code[
                    step + np.repeat(start[where] - spelled, wide)]
                to = (unique >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
                self.known[to], self.at[to], self.length[to] = unique, offset + self.used, sizes
                self.width[to], self.spelled[to] = wide, spelled + self.letters_used
                # Two new words in one slot: the last assignment of each array wins for all.
                self.used += len(new_ids)
                self.letters_used += chars
        return counts, out

    def encode(self, texts: list[str], ids: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
        """Tokens per text, and the ids of each text unless only counts are wanted.

        Added tokens standing in a text are single tokens, as the library takes them by default.
        """
        pieces, owner, special = [], [], []
        for i, text in enumerate(texts):
            last = 0
            if self.split is not None and any(t in text for t in self.added):
                for found in self.split.finditer(text):
                    pieces += [text[last : found.start()], ""]
                    owner += [i, i]
                    special += [-1, self.added[found.group()]]
                    last = found.end()
            for piece in _cut(text[last:]):
                pieces.append(piece)
                owner.append(i)
                special.append(-1)
        counts = np.zeros(len(pieces), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        begin = size = 0
        for end in range(1, len(pieces) + 1):
            size += len(pieces[end - 1])
            if size < CHUNK_CHARS and end < len(pieces):
                continue
            counts[begin:end], flat = self._plain(pieces[begin:end], ids)
            if ids:
                parts[begin:end] = np.split(flat, np.cumsum(counts[begin:end])[:-1])
            begin, size = end, 0
        for i, token in enumerate(special):
            if token >= 0:
                counts[i], parts[i] = 1, np.array([token], np.int32)
        total = np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
        if not ids:
            return total, []
        if len(pieces) == len(texts):
            return total, parts
        grouped: list[list[np.ndarray]] = [[] for _ in texts]
        for i, part in zip(owner, parts, strict=True):
            grouped[i].append(part)
        return total, [np.concatenate(g) for g in grouped]


@functools.cache
def load(path: str) -> Bpe:
    """The vocabulary of a file, once per worker process."""
    return Bpe(path)
