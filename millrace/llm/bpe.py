"""Byte-level BPE ids for whole batches of texts, by the `tokenizers` library.

A batch is cut into the pattern's pieces with array operations, equal pieces are
found by hash, and only pieces that a bounded cache lacks are encoded. The ids
are those of `Tokenizer.encode(text, add_special_tokens=False)`, so a special
token's literal in a text becomes that token, as the tokenizer has it.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import regex

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_CHUNK = 1 << 20  # code points at a time: bounds the working arrays
_POWERS: dict[int, np.ndarray] = {}


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    out = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            for x in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800) + 0x800, m.end() + 0x800)):
                if x[0] < x[1]:
                    out[x[0] : x[1]] = value
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            with np.errstate(over="ignore"):
                have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _POWERS[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


@functools.cache
def _letters() -> np.ndarray:
    """A random-looking 64-bit value for each code point."""
    return mixed(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x9E37))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Hash of each run values[start:end); runs are in order, and end where the next starts by default.
    `values` are bytes or code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(values)
    with np.errstate(over="ignore"):
        terms = _letters()[values] * powers(_MULT, n)
        if ends is None:
            sums = np.add.reduceat(terms, starts)
            lengths = np.diff(np.append(starts, n))
        else:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
            sums = total[ends] - total[starts]
            lengths = ends - starts
        inverse = powers(pow(_MULT, -1, 1 << 64), n)
        return mixed(sums * inverse[starts] + lengths.astype(np.uint64))


class Encoder:
    """Encodes texts with the tokenizer file at `path`, caching `cache` pieces at most."""

    def __init__(self, path: str, cache: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.limit = cache
        self.known = np.zeros(0, np.uint64)  # hashes of cached pieces, ascending
        self.where, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        # the usual printable stand-ins of byte-level BPE, by its rule
        self.stand_in = {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}

    def piece(self, text: str) -> list[int]:
        mapped = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.stand_in)
        return [t.id for t in self.model.tokenize(mapped)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and how many each text has."""
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)]
        counts = np.zeros(len(texts), np.int64)
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            # contractions and special tokens need the tokenizer itself; NUL ends texts below
            if "'" in t or "\x00" in t or any(x in t for x in self.literals):
                if group:
                    ids.append(self._fast(texts, group, counts))
                    group, size = [], 0
                own = self._slow(t)
                ids.append(own)
                counts[i] = len(own)
                continue
            group.append(i)
            size += len(t)
            if size >= _CHUNK:
                ids.append(self._fast(texts, group, counts))
                group, size = [], 0
        if group:
            ids.append(self._fast(texts, group, counts))
        return np.concatenate(ids), counts

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _add(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode pieces that are new; hashes ascend. Beyond the limit the cache starts anew."""
        if len(self.known) + len(hashes) > self.limit:
            self.known, self.where, self.size, self.used = self.known[:0], self.where[:0], self.size[:0], 0
        found = [self.piece(p) for p in pieces]
        size = np.fromiter(map(len, found), np.int32, len(found))
        new = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))
        if self.used + len(new) > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.zeros(max(self.used, len(new), 1 << 16), np.uint32)])
        self.store[self.used : self.used + len(new)] = new
        where = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += len(new)
        at = np.searchsorted(self.known, hashes)
        self.known, self.where, self.size = np.insert(self.known, at, hashes), np.insert(self.where, at, where), np.insert(self.size, at, size)

    def _fast(self, texts: list[str], group: list[int], counts: np.ndarray) -> np.ndarray:
        joined = "\x00".join(texts[i] for i in group) + "\x00"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _classes()[cp]
        end_mark = cp == 0
        kind[end_mark] = 4
        n = len(cp)
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= end_mark
        # a white-space run before visible text gives up its last character; a space joins that text
        last = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & (kind[1:] != 4))
        start[last] = True
        start[last[cp[last] == 32] + 1] = False
        starts = np.flatnonzero(start)
        hashes = run_hashes(cp, starts)
        real = ~end_mark[starts]
        ends = np.append(starts[1:], n)
        starts, ends, hashes = starts[real], ends[real], hashes[real]
        if not len(starts):
            return np.zeros(0, np.uint32)
        owner = np.searchsorted(np.flatnonzero(end_mark), starts)
        at = np.searchsorted(self.known, hashes)
        if len(self.known):
            lacking = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != hashes)
        else:
            lacking = np.arange(len(hashes))
        if len(lacking):
            fresh, first = np.unique(hashes[lacking], return_index=True)
            first = lacking[first]
            if len(self.known) + len(fresh) > self.limit:  # then all pieces of this batch are encoded anew
                fresh, first = np.unique(hashes, return_index=True)
            self._add(fresh, [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            at = np.searchsorted(self.known, hashes)
        per, where = self.size[at].astype(np.int64), self.where[at]
        before = np.cumsum(per) - per
        index = np.arange(int(per.sum())) + np.repeat(where - before, per)
        counts[np.array(group)] = np.bincount(owner, weights=per, minlength=len(group)).astype(np.int64)[: len(group)]
        return self.store[index]
