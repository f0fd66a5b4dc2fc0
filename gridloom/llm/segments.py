"""Vectorised splitting and hashing of texts that lie one after another in a byte buffer."""

from __future__ import annotations

import hashlib

import numpy as np

from .runtime import ragged

#: Odd multipliers of the two polynomial hashes, and the byte tables that they are applied to.
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)
_BYTES = [np.random.default_rng(20240 + k).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in range(2)]
_powers: dict[int, np.ndarray] = {}
#: Longer segments are hashed by blake2b: polynomials modulo 2^64 are weak on long structured strings.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(k: int, n: int) -> np.ndarray:
    """1, B, B^2 ... (mod 2^64) of base k; kept, as every block needs them."""
    have = _powers.get(k)
    if have is None or len(have) < n:
        n = max(n, 1 << 16)
        full = np.full(n, _BASES[k % 2], np.uint64)
        if k >= 2:  # of the inverse
            full[:] = pow(_BASES[k % 2], -1, 1 << 64)
        full[0] = 1
        have = _powers[k] = np.cumprod(full, dtype=np.uint64)
    return have


class Prefix:
    """Prefix sums of values times powers: the hash of any range in constant time, the same wherever the range stands."""

    def __init__(self, values: np.ndarray, k: int):
        n = len(values)
        self.k, self.sums = k, np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(k, n)[:n], out=self.sums[1:], dtype=np.uint64)
        self.inverse = powers(k + 2, n + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def hash_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, both: bool = True):
    """64-bit hashes (two independent ones if ``both``) of byte ranges; 0 is never a hash."""
    out = []
    long = np.flatnonzero(ends - starts > LONG)
    strong = np.array([np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), np.uint64) for i in long], np.uint64).reshape(-1, 2)
    for k in range(2 if both else 1):
        h = Prefix(_BYTES[k][data], k).hash(starts, ends)
        h[long] = strong[:, k]
        h[h == 0] = 1
        out.append(h)
    return out if both else out[0]


def word_ranges(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """Maximal runs of bytes that are no separators, which don't cross documents: (starts, ends, first word of each document and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


#: The blanks [\x20\x09-\x0D].
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, bytes else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def unicode_blanks(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of white space characters (Unicode's White_Space) in UTF-8."""
    mask = BLANKS[data]
    n = len(data)
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        a, b = data[lead], data[np.minimum(lead + 1, n - 1)]
        two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        c = data[np.minimum(lead + 2, n - 1)]
        spaces = (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three = lead[(a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (spaces | (b == 0x81) & (c == 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)]
        mask[np.concatenate([two, two + 1, three, three + 1, three + 2])] = True
    return mask


def bpe_segments(data: np.ndarray, offsets: np.ndarray):
    """Ranges between places where the GPT-2 pattern always splits: one space and the non-blanks after it, the rest of a
    run of blanks, and its last blank where that is no space. The pattern looks across no other place than these, so
    a text's tokens are its segments' tokens. Returns (starts, ends, first segment of each document and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = unicode_blanks(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    cut = edge[:n].copy()
    before = np.zeros(n, bool)
    before[1:] = blank[:-1]
    cut |= blank & ~before
    ends = np.flatnonzero(blank & ~np.concatenate([blank[1:], [False]]) & ~edge[1:])  # last byte of a run with more text after it
    last = ends.copy()
    for _ in range(2):  # to the last blank's first byte
        last -= (data[last] & 0xC0) == 0x80
    cut[last] = True
    after = ends[data[last] != 32] + 1
    cut[after[after < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


class Vocabulary:
    """Maps 128-bit hashes of segments to rows of ids. Open addressing in numpy; emptied when it holds ``most`` entries,
    so a worker that lives long keeps bounded memory."""

    def __init__(self, most: int = 1_500_000):
        self.most = most
        self.clear()

    def clear(self):
        self.size = 1 << 16
        self.slots = np.full(self.size, -1, np.int32)
        self.n = 0
        self.h1, self.h2 = np.zeros(1 << 15, np.uint64), np.zeros(1 << 15, np.uint64)
        self.start, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.pool, self.used = np.zeros(1 << 17, np.uint32), 0

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(h1), -1, np.int64)
        left, at = np.arange(len(h1)), (h1 & np.uint64(self.size - 1)).astype(np.int64)
        while len(left):
            got = self.slots[at]
            there = got >= 0
            hit = there & (self.h1[got] == h1[left]) & (self.h2[got] == h2[left])
            out[left[hit]] = got[hit]
            on = there & ~hit
            left, at = left[on], (at[on] + 1) & (self.size - 1)
        return out

    def _place(self, entries: np.ndarray):
        at = (self.h1[entries] & np.uint64(self.size - 1)).astype(np.int64)
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            lost = self.slots[at] != entries
            entries, at = entries[lost], (at[lost] + 1) & (self.size - 1)

    def add(self, h1: np.ndarray, h2: np.ndarray, ids: list[np.ndarray] | None = None, lengths=None, flat=None):
        """New entries, which must be distinct and absent."""
        if ids is not None:
            lengths = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.concatenate([np.asarray(x, np.uint32) for x in ids]) if len(ids) else np.zeros(0, np.uint32)
        k = len(h1)
        need, grow = self.n + k, lambda a, n: a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])
        self.h1, self.h2, self.start, self.length = (grow(a, need) for a in (self.h1, self.h2, self.start, self.length))
        self.pool = grow(self.pool, self.used + len(flat))
        new = np.arange(self.n, need, dtype=np.int32)
        self.h1[new], self.h2[new], self.length[new] = h1, h2, lengths
        self.start[new] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.n = need
        if need * 2 > self.size:
            while need * 2 > self.size:
                self.size *= 4
            self.slots = np.full(self.size, -1, np.int32)
            new = np.arange(self.n, dtype=np.int32)
        self._place(new)

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> np.ndarray:
        """Entry of each segment; ``encode(list of bytes)`` gives the ids of those not yet known."""
        if self.n > self.most:
            self.clear()
        h1, h2 = hash_segments(data, starts, ends)
        got = self.find(h1, h2)
        if len(lost := np.flatnonzero(got < 0)):
            _, first = np.unique(h1[lost] ^ mix(h2[lost]), return_index=True)
            new = lost[first]
            raw = data.tobytes()
            self.add(h1[new], h2[new], encode([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]))
            got[lost] = self.find(h1[lost], h2[lost])
        return got

    def ids(self, entries: np.ndarray) -> np.ndarray:
        """The ids of the entries, one after another."""
        return self.pool[ragged(self.start[entries], self.length[entries])]
