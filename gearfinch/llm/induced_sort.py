"""Suffix sorting by external induced sorting, in bulk.

Suffixes are induced in rounds from priority queues that live on disk: tuples (first character, position) wait in
radix buckets of their character, append to files beyond a memory limit, and are taken out in ascending order, equal
characters in the order they came.  One pass induces the L suffixes from the sorted LMS suffixes, a mirrored pass the
S suffixes from the L suffixes.  LMS substrings are sorted by the same two passes, named, and if names repeat the
string of names is sorted by recursion.  The text may be a memory map; arrays held in memory are one bucket's.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY_BYTES = 64 << 20
#: Strings of names that are shorter, or whose names stand fewer times on average, are sorted by doubling instead of
#: recursion: batches between names would be short.
SHORT, REPEATED = 1 << 16, 64


class Spill:
    """Appended arrays of one type, in memory up to a limit and in a temporary file beyond it."""

    def __init__(self, dtype=np.int64, limit: int = MEMORY_BYTES):
        self.dtype, self.limit, self.parts, self.size, self.held, self.file = np.dtype(dtype), limit, [], 0, 0, None

    def append(self, x: np.ndarray) -> None:
        if not len(x):
            return
        x = x.astype(self.dtype, copy=False)
        self.parts.append(x)
        self.size += len(x)
        self.held += x.nbytes
        if self.held > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            for p in self.parts:
                self.file.write(p.tobytes())
            self.parts, self.held = [], 0

    def all(self) -> np.ndarray:
        """What was appended, in order; a memory map if it went to disk."""
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        for p in self.parts:
            self.file.write(p.tobytes())
        self.parts, self.held = [], 0
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r", shape=(self.size,))


class Queue:
    """A monotone priority queue of positions in radix buckets, each a Spill."""

    def __init__(self, buckets: int, limit: int):
        self.buckets: dict[int, Spill] = {}
        self.limit = max(1 << 14, limit // max(1, buckets))

    def push(self, bucket: np.ndarray, position: np.ndarray) -> None:
        order = np.argsort(bucket, kind="stable")
        bucket, position = bucket[order], position[order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            k = int(bucket[a])
            if k not in self.buckets:
                self.buckets[k] = Spill(limit=self.limit)
            self.buckets[k].append(position[a:b])

    def pop(self, bucket: int) -> np.ndarray:
        found = self.buckets.pop(bucket, None)
        return np.array(found.all()) if found else np.zeros(0, np.int64)


def induce(text: np.ndarray, sigma: int, fixed: np.ndarray, limit: int, flip: bool = False) -> Spill:
    """The suffixes induced from the sorted suffixes `fixed`, sorted.

    Going up in rank, a suffix at p induces the one at p - 1 if its first character is not less (from an induced
    suffix) or greater (from a fixed one).  Among suffixes of one first character the induced come before the fixed.
    flip: characters in reversed order, which turns this into the pass for S suffixes."""
    # about as many buckets as a bucket has suffixes, so that few batches are cut
    n_buckets = min(sigma, max(256, int(len(text) ** 0.5) // 2))
    width = -(-sigma // n_buckets)
    char = (lambda p: sigma - 1 - text[p].astype(np.int64)) if flip else (lambda p: text[p].astype(np.int64))
    queue, out = Queue(n_buckets, limit), Spill(limit=limit)
    big = np.int64(1) << 60
    step = max(1 << 16, limit // 64)
    many = np.zeros(n_buckets, np.int64)
    for a in range(0, len(fixed), step):
        many += np.bincount(char(np.asarray(fixed[a : a + step])) // width, minlength=n_buckets)
    first_fixed = np.concatenate([[0], np.cumsum(many)])
    for b in range(n_buckets):
        seed = np.asarray(fixed[first_fixed[b] : first_fixed[b + 1]])
        seed_key = char(seed)
        own = queue.pop(b)
        own_key = char(own)
        order = np.argsort(own_key, kind="stable")
        own, own_key = own[order], own_key[order]
        while True:
            if not len(own) and not len(seed):
                break
            induced = len(own) and (not len(seed) or own_key[0] <= seed_key[0])
            if induced:
                m = int(np.searchsorted(own_key, seed_key[0], "right")) if len(seed) else len(own)
                at, key = own[:m], own_key[:m]
            else:
                m = int(np.searchsorted(seed_key, own_key[0])) if len(own) else len(seed)
                at, key = seed[:m], seed_key[:m]
            before = at - 1
            before_key = char(np.maximum(before, 0))
            child = (before >= 0) & ((before_key >= key) if induced else (before_key > key))
            near = child & (before_key < (b + 1) * width)
            least = np.minimum.accumulate(np.where(near, before_key, big))
            # the longest part of the batch that no child of its own falls into
            m = int(np.count_nonzero(least >= key if induced else least > key))
            at, child, near, before, before_key = at[:m], child[:m], near[:m], before[:m], before_key[:m]
            far = child & ~near
            queue.push(before_key[far] // width, before[far])
            if induced:
                out.append(at)
                own, own_key = own[m:], own_key[m:]
            else:
                seed, seed_key = seed[m:], seed_key[m:]
            if near.any():
                own, own_key = np.concatenate([own, before[near]]), np.concatenate([own_key, before_key[near]])
                order = np.argsort(own_key, kind="stable")
                own, own_key = own[order], own_key[order]
    return out


def _reversed(x: np.ndarray) -> np.ndarray:
    return x[::-1]


def suffix_array(text: np.ndarray, sigma: int, limit: int = MEMORY_BYTES, reach: int | None = None) -> np.ndarray:
    """Positions of all suffixes of text, sorted; if reach is given, by their first `reach` characters at least.
    text: non-negative numbers below sigma."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # S suffixes are less than the one after them; the last suffix counts as L, followed by the empty one
    differ = np.flatnonzero(text[1:] != text[:-1])
    rises = text[differ + 1] > text[differ]
    at = np.searchsorted(differ, np.arange(n))
    is_s = np.concatenate([rises, [False]])[np.minimum(at, len(rises))]
    del differ, at
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    end = np.array([n - 1])  # induced by the empty suffix, which comes first

    def passes(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower = _from_end(text, sigma, order, limit, end)
        upper = induce(text, sigma, _reversed(lower), limit, flip=True).all()
        return lower, _reversed(upper)

    if len(lms) > 1:
        order = lms[np.argsort(text[lms], kind="stable")]
        _, upper = passes(order)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found = np.asarray(upper)[is_lms[upper]]
        names = _names(text, lms, found)
        if names.max() + 1 < len(names):
            n_names, names_reach = int(names.max()) + 1, None if reach is None else -(-reach // 2)
            recurse = len(names) > max(SHORT, REPEATED * n_names)
            order = lms[suffix_array(names, n_names, limit, names_reach) if recurse else doubled(names, names_reach)]
        else:
            order = found
    else:
        order = lms
    lower, upper = passes(order)
    whole = np.concatenate([lower, upper])
    return whole[np.argsort(text[whole].astype(np.int64) * 2 + np.concatenate([np.zeros(len(lower), np.int64), np.ones(len(upper), np.int64)]), kind="stable")]


def doubled(names: np.ndarray, reach: int | None = None) -> np.ndarray:
    """Suffixes of a short string, sorted by prefixes of doubling length."""
    n, k = len(names), 1
    rank = names.astype(np.int64) + 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.concatenate([rank[k:], np.zeros(min(k, n), np.int64)])
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[1], 1 + np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n or k >= n or reach is not None and k >= reach:
            return order


def _from_end(text: np.ndarray, sigma: int, order: np.ndarray, limit: int, end: np.ndarray) -> np.ndarray:
    """The L pass.  The empty suffix, least of all, induces the last: characters move up by one to make room for it."""
    class Moved:
        def __len__(self):
            return len(text)

        def __getitem__(self, p):
            p = np.asarray(p)
            inside = p < len(text)
            return np.where(inside, text[np.minimum(p, len(text) - 1)].astype(np.int64) + 1, 0)

    return induce(Moved(), sigma + 1, np.concatenate([[len(text)], order]), limit).all()


def _names(text: np.ndarray, lms: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order; equal ones (by digest and length) share a name."""
    ends = np.append(lms[1:], len(text) - 1)
    lengths = ends - lms + 1
    from .texts import mix, powers

    at = np.arange(int(lms[0]), len(text)) - np.repeat(lms, np.append(np.diff(lms), len(text) - lms[-1]))
    terms = mix(text[lms[0] :].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()) + 1)[at]
    digest = np.add.reduceat(terms, lms - lms[0])
    # the last character of a substring is the first of the next
    closing = mix(text[ends].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()) + 1)[lengths - 1]
    digest[:-1] += closing[:-1]
    digest[-1] ^= np.uint64(0x5851F42D4C957F2D)  # the last one ends with the text: like no other
    place = np.searchsorted(lms, found)
    new = (digest[place][1:] != digest[place][:-1]) | (lengths[place][1:] != lengths[place][:-1])
    names = np.empty(len(lms), np.int64)
    names[place] = np.concatenate([[0], np.cumsum(new)])
    return names
