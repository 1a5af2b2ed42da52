"""External induced sorting of the suffixes of one shard, with common prefixes carried along.

The left-most S suffixes are sorted first. The L suffixes are induced from them bucket by bucket (a bucket holds the
suffixes of one first letter), from the smallest letter up, and the S suffixes from all larger ones, from the
largest letter down. Queues hold tuples (place, common prefix with the tuple before it in the bucket): a tuple's predecessor
enters the bucket of its letter with 1 + the least common prefix since that bucket's last entry. Queues keep
a bounded number of bytes in memory and the rest in a file; so do the sorted buckets, and they are given out in pieces.

The left-most S suffixes are themselves a shorter text, of the names of the pieces between them. Where they are
more than `base`, that text is sorted by the same induction, recursively; below, by ever longer blocks in memory. Their
common prefixes are compared on the text. A letter of 0 ends a string; suffixes are compared up to it.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Bytes that queues hold in memory; left-most S suffixes that are sorted in memory; tuples handled at once.
QUEUE_BYTES, BASE, PIECE = 32 << 20, 3 << 20, 1 << 16
U = np.uint64
Piece = tuple[np.ndarray, np.ndarray]


class Queue:
    """Tuples (place, common prefix) by bucket, first in, first out; beyond `most` bytes all that is held goes to one file."""

    def __init__(self, most: int):
        self.most, self.held, self.spilled = most, 0, 0
        self.parts: dict[int, deque] = {}
        self.file = None

    def push(self, bucket: int, places: np.ndarray, lcps: np.ndarray) -> None:
        self.parts.setdefault(bucket, deque()).append((places, lcps))
        self.held += places.nbytes + lcps.nbytes
        if self.held > self.most:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # the task's own scratch: a lost task starts anew
        end = self.file.seek(0, os.SEEK_END)
        for bucket, parts in self.parts.items():
            for k, p in enumerate(parts):
                if isinstance(p[0], np.ndarray):
                    data = p[0].astype(np.int64).tobytes() + p[1].tobytes()
                    self.file.write(data)
                    parts[k] = (end, len(p[0]))
                    end += len(data)
        self.spilled += self.held
        self.held = 0

    def _read(self, part: tuple) -> Piece:
        if isinstance(part[0], np.ndarray):
            return part
        at, n = part
        self.file.seek(at)
        data = self.file.read(9 * n)
        return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.uint8, n, 8 * n)

    def take(self, bucket: int) -> Iterator[Piece]:
        """Pieces of a bucket, those that are pushed meanwhile too; small ones that wait are handed out together."""
        while parts := self.parts.get(bucket):
            got, n = [], 0
            while parts and n < PIECE:
                part = parts.popleft()
                if isinstance(part[0], np.ndarray):
                    self.held -= part[0].nbytes + part[1].nbytes
                got.append(self._read(part))
                n += len(got[-1][0])
            yield got[0] if len(got) == 1 else tuple(np.concatenate(x) for x in zip(*got))
        self.parts.pop(bucket, None)

    def look(self, bucket: int, backward: bool = False) -> Iterator[Piece]:
        """Pieces of a bucket, which stay; backward: the last one first, each turned round."""
        parts = self.parts.get(bucket, ())
        for part in reversed(parts) if backward else parts:
            places, lcps = self._read(part)
            yield (places[::-1], lcps[::-1]) if backward else (places, lcps)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.parts.clear()


def _ascending(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S: the next different letter is larger. Ends count as S. From the right, a piece at a time."""
    n = len(text)
    out = np.empty(n, bool)
    after, state = None, True
    for b in range(n, 0, -PIECE):
        a = max(b - PIECE, 0)
        t = text[a:b].astype(np.int64)
        rise = np.sign(np.diff(t, append=after if after is not None else t[-1]))
        m = len(t)
        nxt = np.where(rise != 0, np.arange(m), m)
        nxt = np.minimum.accumulate(nxt[::-1])[::-1]
        s = np.where(nxt < m, rise[np.minimum(nxt, m - 1)] > 0, state)
        s[t == 0] = True
        out[a:b] = s
        after, state = t[0], bool(s[0]) if t[0] > 0 else True
    return out


def _blocks(text: np.ndarray, at: np.ndarray, stop: np.ndarray | None, size: int, bits: int, pad: int) -> np.ndarray:
    """The next `size` letters from each place as one number: 0 after an end; `pad` from `stop` on, where that is given."""
    key, alive = np.zeros(len(at), U), np.ones(len(at), bool)
    last = len(text) - 1
    for k in range(size):
        p = at + k
        c = np.where(alive & (p <= last), text[np.minimum(p, last)], 0).astype(U)
        if stop is not None:
            c = np.where(p >= stop, U(pad), c)
        else:
            alive &= c > 0
        key = (key << U(bits)) | c
    return key


def _highest(x: np.ndarray) -> np.ndarray:
    """Number of the highest bit that is set (from 0); x > 0."""
    # a run of ones below it would round up
    return np.frexp((x & ~(x >> U(1))).astype(np.float64))[1] - 1


def _same(x: np.ndarray, y: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Letters before the first difference of blocks that differ."""
    return (bits * size - 1 - _highest(x ^ y)) // bits


def _before_end(x: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Letters of blocks before their end."""
    lowest = np.frexp((x & (~x + U(1))).astype(np.float64))[1] - 1
    return np.where(x > 0, size - lowest // bits, 0)


def _ordered(text: np.ndarray, places: np.ndarray, depth: int | None, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, names, common prefixes up to `depth`) of the suffixes at some places by their first `depth` letters (None: up to their ends), or of pieces up to `stop`: blocks are named, and the blocks that follow break ties."""
    bits = int(int(text.max(initial=0)) + 1).bit_length()
    pad, size = (1 << bits) - 1, 63 // bits
    last = U(pad if stop is not None else 0)
    key = _blocks(text, places, stop, size, bits, pad)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    common = np.full(len(key), min(depth or 255, 255), np.int64)

    def told(which: np.ndarray, step: int) -> None:
        """Common prefixes of suffixes that differ from the one before in this block, or end in it as that one does."""
        k = which[new[which] & (which > 0)]
        common[k] = step + _same(key[k - 1], key[k], size, bits)
        k = which[~new[which] & ((key[which] & U(pad)) == 0)]
        common[k] = step + _before_end(key[k], size, bits)

    told(np.arange(len(key)), 0)
    step, name = size, np.cumsum(new) - 1
    while depth is None or step < depth:
        # names held by several suffixes that have not ended in the last block
        which = np.flatnonzero((np.bincount(name)[name] > 1) & ((key & U(pad)) != last))
        if not len(which):
            break
        fresh = _blocks(text, places[order[which]] + step, None if stop is None else stop[order[which]], size, bits, pad)
        # names whose blocks are all alike are in order already
        own = name[which]
        mixed = np.zeros(name[-1] + 1, bool)
        mixed[own[1:][(own[1:] == own[:-1]) & (fresh[1:] != fresh[:-1])]] = True
        at = np.flatnonzero(mixed[own])
        sub = at[np.lexsort((fresh[at], own[at]))]
        order[which[at]], fresh[at] = order[which[sub]], fresh[sub]
        key[which] = fresh
        inner = which[~new[which]]  # ties so far: both of the pair are among these
        new[inner] = key[inner] != key[inner - 1]
        told(inner, step)
        name = np.cumsum(new) - 1
        step += size
    common[:1] = 0
    return order, name, np.minimum(common, min(depth or 255, 255)).astype(np.uint8)


def _seeds_in_order(text: np.ndarray, lms: np.ndarray, depth: int | None, most: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends first, then the other seeds in the order of their suffixes; and common prefixes, if there is a depth."""
    end = text[lms] == 0
    seeds = lms[~end]
    n_ends, none = int(end.sum()), np.zeros(len(lms), np.uint8)
    if len(seeds) <= max(base, 1):
        order, _, common = _ordered(text, seeds, depth)
        return np.concatenate((lms[end], seeds[order])), np.concatenate((none[:n_ends], common))
    # pieces from one seed to the next, that one's letter included
    order, name, _ = _ordered(text, seeds, None, np.append(lms[1:], len(text) - 1)[~end] + 1)
    if name[-1] + 1 < len(seeds):
        names = np.empty(len(seeds), np.uint32)
        names[order] = name + 1
        short = np.zeros(len(lms), np.uint32)
        short[~end] = names
        out = np.concatenate([lms[end], *[lms[p] for p, _ in induced(short, None, most, base)]])
    else:
        out = np.concatenate((lms[end], seeds[order]))
    return out, _common(text, out, depth) if depth else none


def _common(text: np.ndarray, places: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, up to `cap` letters, of each suffix with the one before it; compared on the text block by block."""
    out = np.zeros(len(places), np.uint8)
    bits = int(int(text.max(initial=0)) + 1).bit_length()
    size = 63 // bits
    live = np.arange(1, len(places))
    for step in range(0, cap, size):
        if not len(live):
            break
        x = _blocks(text, places[live - 1] + step, None, size, bits, 0)
        y = _blocks(text, places[live] + step, None, size, bits, 0)
        diff = x ^ y
        # letters before the first difference, and before an end in both
        same = np.full(len(live), size, np.int64)
        for k in range(size):
            shift = U(bits * (size - 1 - k))
            here = ((diff >> shift) != 0) | (((x >> shift) & U((1 << bits) - 1)) == 0)
            same = np.where((same == size) & here, k, same)
        out[live] = np.minimum(step + same, cap)
        live = live[same == size]
    return out


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of values[a..b] for each pair, by minima over powers of two."""
    n = b - a + 1
    level = np.frexp(n.astype(np.float64))[1] - 1
    out, row = np.empty(len(a), values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            row = np.minimum(row[:-half], row[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[a[at]], row[b[at] - (1 << k) + 1])
    return out


class _Targets:
    """Where predecessors go: their queue, and for each bucket the least common prefix since its last entry."""

    def __init__(self, text: np.ndarray, ascending: np.ndarray, want: bool, most: int, letters: int, cap: int):
        self.text, self.ascending, self.want, self.cap = text, ascending, want, cap
        self.queue = Queue(most)
        if cap:
            self.since, self.fresh = np.full(letters, 255, np.uint8), np.ones(letters, bool)

    def scan(self, places: np.ndarray, lcps: np.ndarray) -> None:
        for a in range(0, len(places), PIECE):
            self._scan(places[a : a + PIECE], lcps[a : a + PIECE])

    def _scan(self, places: np.ndarray, lcps: np.ndarray) -> None:
        p = places - 1
        d = self.text[np.maximum(p, 0)]
        at = np.flatnonzero((p >= 0) & (d > 0) & (self.ascending[np.maximum(p, 0)] == self.want))
        if not len(at):
            if self.cap and len(lcps):
                np.minimum(self.since, lcps.min(), out=self.since)
            return
        at = at[np.argsort(d[at], kind="stable")]
        d, p = d[at], p[at]
        first = np.ones(len(d), bool)
        first[1:] = d[1:] != d[:-1]
        f = np.flatnonzero(first)
        if self.cap:
            before = np.concatenate(([-1], at[:-1]))
            new = _least(lcps, np.where(first, 0, before + 1), at)
            new[f] = np.minimum(new[f], self.since[d[f]])
            new = np.minimum(new + 1, self.cap).astype(np.uint8)
            new[f[self.fresh[d[f]]]] = 0
            self.fresh[d[f]] = False
            rest = np.append(np.minimum.accumulate(lcps[::-1])[::-1][1:], np.uint8(255))
            np.minimum(self.since, lcps.min(), out=self.since)
            self.since[d[f]] = rest[at[np.append(f[1:], len(d)) - 1]]
        else:
            new = np.zeros(len(d), np.uint8)
        for a, b in zip(f.tolist(), [*f[1:].tolist(), len(d)]):
            self.queue.push(int(d[a]), p[a:b], new[a:b])


def _run(text: np.ndarray, place: int) -> int:
    """How often the letter at a place is repeated from there on."""
    k, c = place, text[place]
    while k < len(text) and text[k] == c:
        k += 1
    return k - place


def induced(text: np.ndarray, cap: int | None, most: int = QUEUE_BYTES, base: int = BASE) -> Iterator[Piece]:
    """(places, common prefix with the suffix before) in order, a piece at a time, without the ends.

    Suffixes are told apart by their first `cap` letters at least, and common prefixes count up to that (255 at most); None: wholly, and common prefixes are not counted.
    """
    n = len(text)
    if not n:
        return
    count = cap or 0
    s = _ascending(text)
    seed = s.copy()
    seed[1:] &= ~s[:-1]
    seed[0] = False
    seed |= text == 0
    lms = np.flatnonzero(seed)
    del seed
    letters = np.unique(text)
    lms, common = _seeds_in_order(text, lms, cap, most, base)
    at = np.searchsorted(text[lms], letters)
    upto = np.append(at[1:], len(lms))
    low, size = Queue(most), int(letters[-1]) + 1
    seam = lambda a, b: min(_run(text, a), _run(text, b), count)  # noqa: E731  the next letters differ: one is smaller, the other larger
    # L suffixes, from the smallest letter up
    to = _Targets(text, s, False, most, size, count)
    for c, x, y in zip(letters.tolist(), at.tolist(), upto.tolist()):
        last = None
        for places, lcps in to.queue.take(c):
            low.push(c, places, lcps)
            to.scan(places, lcps)
            last = int(places[-1])
        if y > x:
            own = common[x:y].copy()
            own[0] = seam(last, int(lms[x])) if last is not None and c else 0
            to.scan(lms[x:y], own)
    to.queue.close()
    del lms, common
    # S suffixes, from the largest letter down: here a common prefix is with the suffix after
    high = Queue(most)
    to = _Targets(text, s, True, most, size, count)
    for c in letters[::-1].tolist():
        if c == 0:
            continue
        last = None
        for places, lcps in to.queue.take(c):
            high.push(c, places, lcps)
            to.scan(places, lcps)
            last = int(places[-1])
        carried = None
        for places, lcps in low.look(c, backward=True):
            shifted = np.empty_like(lcps)
            shifted[1:] = lcps[:-1]
            shifted[0] = carried if carried is not None else seam(int(places[0]), last) if last is not None else 0
            carried = lcps[-1]
            to.scan(places, shifted)
    to.queue.close()
    for c in letters.tolist():
        last = None
        for places, lcps in low.look(c):
            yield places, lcps
            last = int(places[-1])
        carried = None
        for places, lcps in high.look(c, backward=True):
            # going up, a suffix's common prefix with the one before is what that one has with the one after
            up = np.concatenate(([carried if carried is not None else (seam(last, int(places[0])) if last is not None else 0)], lcps[:-1])).astype(np.uint8)
            carried = lcps[-1]
            yield places, up
    low.close()
    high.close()
