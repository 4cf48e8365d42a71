"""Suffix order of a byte shard by induced sorting over disk-backed queues.

Sorted left-most-S suffixes induce the order of all L suffixes, those the order of
all S suffixes.  Induction is a priority queue keyed by (first byte, order of
insertion): elements only ever enter the bucket being read or a later one, so
each bucket is a queue that is read once, as one array (a run of one byte, which
enters its own bucket again and again, is laid out at once).  ``Queues`` holds the
buckets, and moves them to unnamed temporary files when they exceed its memory.
Only the queues spill: the text, its words, shapes and the full order stay in
memory, so a shard must fit there.

Every element in a queue carries the length of the prefix it shares with the
element before it (up to ``depth``).  A suffix and its predecessor in a bucket
were induced by two elements read before; they share one byte more than the
least common prefix read between these two.  ``_Reader`` answers that for whole
arrays with range minima.

Two inductions and one recursion step sort a shard: the first orders the
left-most-S substrings, which become names; the names are ordered by doubling
(their alphabet is as large as their string, so there are no buckets to queue
in); the second induces the suffixes.  Order is wanted up to ``depth`` bytes;
suffixes that agree that far stand together in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Elements read at once; bounds the range-minimum tables.
BLOCK = 1 << 19


class Queues:
    """First-in-first-out arrays of (position, shared prefix), one queue for each byte."""

    def __init__(self, budget: int, symbols: int):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.budget, self.held, self.file = budget, 0, None

    def push(self, c: int, positions: np.ndarray, shared: np.ndarray) -> None:
        self.parts[c].append((positions, shared))
        self.held += positions.nbytes + shared.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for queue in self.parts:
            for k, part in enumerate(queue):
                if isinstance(part[0], np.ndarray):
                    at = self.file.tell()
                    for array in part:
                        array.tofile(self.file)
                    queue[k] = (at, len(part[0]), part[0].dtype)
        self.held = 0

    def drain(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Queue ``c`` in order; nothing enters it any more."""
        parts = []
        for part in self.parts[c]:
            if isinstance(part[0], np.ndarray):
                self.held -= part[0].nbytes + part[1].nbytes
            else:
                at, n, dtype = part
                self.file.seek(at)
                part = np.fromfile(self.file, dtype, n), np.fromfile(self.file, np.uint8, n)
            parts.append(part)
        self.parts[c] = []
        if len(parts) == 1:
            return parts[0]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in parts]), np.concatenate([s for _, s in parts])


def _minima(steps: np.ndarray):
    """A function giving the least of ``steps[lo..hi]`` for arrays of bounds."""
    tables = [steps]
    while 2 ** len(tables) <= len(steps):
        half = 2 ** (len(tables) - 1)
        last = tables[-1]
        tables.append(np.minimum(last[:-half], last[half:]))

    def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.log2(hi - lo + 1).astype(np.int64)
        out = np.empty(len(lo), steps.dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(tables[k][lo[at]], tables[k][hi[at] - 2**k + 1])
        return out

    return least


class _Reader:
    """One pass: what is read, in order, inserts its predecessors into ``queues``."""

    def __init__(self, text: np.ndarray, queues: Queues, cap: int):
        self.text, self.queues, self.cap = text, queues, cap
        symbols = len(queues.parts)
        self.least = np.full(symbols, cap, np.uint8)  # read since the last insertion into each bucket
        self.used = np.zeros(symbols, bool)

    def read(self, positions: np.ndarray, steps: np.ndarray, keep) -> None:
        """``steps``: prefix shared with the element read before; ``keep`` of the inserted bytes."""
        for begin in range(0, len(positions), BLOCK):
            self._read(positions[begin : begin + BLOCK], steps[begin : begin + BLOCK], keep)

    def _read(self, positions, steps, keep) -> None:
        at = np.flatnonzero(positions > 0)
        before = positions[at] - 1
        keys = self.text[before]
        chosen = keep(keys)
        at, before, keys = at[chosen], before[chosen], keys[chosen]
        low = steps.min()
        if not len(at):
            np.minimum(self.least, low, out=self.least)
            return
        order = np.argsort(keys, kind="stable")
        at, before, keys = at[order], before[order], keys[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        lo = np.concatenate([[0], at[:-1] + 1])
        lo[first] = 0
        least = _minima(steps)
        shared = least(lo, at)
        heads = np.flatnonzero(first)
        symbols = keys[heads]
        shared[heads] = np.minimum(shared[heads], self.least[symbols])
        shared = np.minimum(shared + np.uint8(1), np.uint8(self.cap))
        shared[heads[~self.used[symbols]]] = 0
        last = at[np.concatenate([heads[1:] - 1, [len(at) - 1]])] + 1
        np.minimum(self.least, low, out=self.least)
        inner = last < len(steps)
        self.least[symbols] = self.cap
        if inner.any():
            self.least[symbols[inner]] = least(last[inner], np.full(int(inner.sum()), len(steps) - 1))
        self.used[symbols] = True
        for a, b, c in zip(heads.tolist(), [*heads[1:].tolist(), len(at)], symbols.tolist()):
            self.queues.push(c, before[a:b], shared[a:b])


def _shape(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one; equal bytes from it on, and before it."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    place = np.arange(n - 1)
    nearest = np.minimum.accumulate(np.where(step != 0, place, n - 2)[::-1])[::-1]  # next place where the byte changes
    rising = np.ones(n, bool)
    rising[:-1] = step[nearest] > 0
    run = np.ones(n, np.int32)
    run[:-1] = nearest - place + 1
    back = np.zeros(n, np.int32)
    back[1:] = place + 1 - np.maximum.accumulate(np.where(step != 0, place + 1, 0))
    return rising, run, back


def _stretch(positions: np.ndarray, steps: np.ndarray, back: np.ndarray, cap: int):
    """Elements of a bucket with all that they induce into it: their runs of one byte.

    Those with one more byte of the run follow all those with one less, in the same order.
    """
    count = back[positions]
    if not len(positions) or not count.any():
        return positions, steps
    count = count + 1
    which = np.repeat(np.arange(len(positions)), count)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    order = np.argsort(turn, kind="stable")
    which, turn = which[order], turn[order]
    shared = np.minimum(turn, cap)
    same = np.flatnonzero(turn[1:] == turn[:-1]) + 1
    if len(same):
        shared[same] = np.minimum(_minima(steps)(which[same - 1] + 1, which[same]) + turn[same], cap)
    shared[0] = steps[0]
    return (positions[which] - turn).astype(positions.dtype), shared.astype(np.uint8)


def _induce(text: np.ndarray, shape, lms: np.ndarray, shared: np.ndarray, cap: int, budget: int):
    """All suffixes in order with the prefix each shares with the one before it.

    ``lms`` are the left-most-S suffixes in order, ``shared`` their common prefixes.
    """
    _, run, back = shape
    symbols = int(text.max()) + 1
    edge = np.searchsorted(text[lms], np.arange(symbols + 1))
    meet = lambda a, b: min(int(run[a[-1]]), int(run[b[0]]), cap) if len(a) and len(b) else 0
    rising, larger = Queues(budget, symbols), Queues(budget, symbols)
    reader = _Reader(text, rising, cap)
    for c in range(symbols):
        l_pos, steps = _stretch(*rising.drain(c), back, cap)
        if len(l_pos):
            larger.push(c, l_pos, steps)
            reader.read(l_pos, steps, lambda keys: keys > c)
        s_pos = lms[edge[c] : edge[c + 1]]
        if len(s_pos):
            steps = shared[edge[c] : edge[c + 1]].copy()
            steps[0] = meet(l_pos, s_pos)
            reader.read(s_pos, steps, lambda keys: keys > c)
    falling = Queues(budget, symbols)
    reader = _Reader(text, falling, cap)
    out: list[tuple[np.ndarray, np.ndarray]] = []  # from the last suffix to the first
    for c in range(symbols - 1, -1, -1):
        s_pos, s_step = _stretch(*falling.drain(c), back, cap) if c else (lms[:1], np.zeros(1, np.uint8))
        if len(s_pos) and c:
            reader.read(s_pos, s_step, lambda keys: keys < c)
        l_pos, l_step = larger.drain(c)
        l_pos = l_pos[::-1]
        between = meet(s_pos, l_pos)
        if len(l_pos):
            reader.read(l_pos, np.concatenate([[between], l_step[:0:-1]]).astype(np.uint8), lambda keys: keys < c)
        # downwards, an element's step is shared with the one above; the lowest of each part meets the next
        if len(s_pos):
            out.append((s_pos, np.append(s_step[1:], np.uint8(between))))
        out.append((l_pos, l_step[::-1]))
    order = np.concatenate([p for p, _ in out])[::-1]
    return order, np.concatenate([s for _, s in out])[::-1]


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every position on, packed (zeros past the end)."""
    w = np.concatenate([data, np.zeros(72, data.dtype)]).astype(np.uint64)
    for k in (1, 2, 4):
        w = (w[:-k] << np.uint64(8 * k)) | w[k:]
    return w


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """How many bytes from ``a`` and from ``b`` agree, up to ``cap`` of each pair."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    top = len(words) - 1
    while live.size:
        at = out[live]
        x = words[np.minimum(a[live] + at, top)] ^ words[np.minimum(b[live] + at, top)]
        same = np.zeros(len(x), np.int64)
        for k in range(8):
            same += x < np.uint64(1 << (8 * k)) if k else x == 0
        out[live] += same
        live = live[(same == 8) & (out[live] < cap[live])]
    return np.minimum(out, cap)


def _suffixes(shard: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions by their first ``depth`` bytes, prefix shared with the one before)."""
    n = len(shard)
    if n < 2:
        return np.arange(n), np.zeros(n, np.uint8)
    text = np.concatenate([shard.astype(np.uint16) + 1, np.zeros(1, np.uint16)])  # 0 ends the text
    kind = np.int32 if n < 2**31 - 1 else np.int64
    shape = _shape(text)
    rising = shape[0]
    lms = (np.flatnonzero(rising[1:] & ~rising[:-1]) + 1).astype(kind)
    words = _words(shard.astype(np.uint8))
    order = lms[np.argsort(text[lms], kind="stable")]
    if len(lms) > 1:
        is_lms = np.zeros(n + 1, bool)
        is_lms[lms] = True
        order, _ = _induce(text, shape, order, np.zeros(len(lms), np.uint8), depth, budget)
        order = _sort_names(words, lms, order[is_lms[order]], depth)
    shared = np.zeros(len(order), np.uint8)
    shared[1:] = _common(words, order[1:], order[:-1], np.minimum(depth, n - np.maximum(order[1:], order[:-1]).astype(np.int64)))
    suffixes, shared = _induce(text, shape, order, shared, depth, budget)
    return suffixes[1:], shared[1:]  # without the end itself


def _sort_names(words, lms, order, depth) -> np.ndarray:
    """Left-most-S positions by their suffixes, given them by their substrings."""
    rank_of = np.searchsorted(lms, order)
    size = np.diff(np.concatenate([lms, lms[-1:]])).astype(np.int64) + 1
    size = np.minimum(size, depth + 8)
    k = rank_of
    cap = np.minimum(size[k[1:]], size[k[:-1]])
    equal = (size[k[1:]] == size[k[:-1]]) & (_common(words, order[1:], order[:-1], cap) >= cap)
    name = np.zeros(len(lms), np.int64)
    name[k] = np.concatenate([[0], np.cumsum(~equal)])
    step = 1
    while 2 * step <= depth + 1 and name.max() + 1 < len(lms):
        ahead = np.zeros(len(lms), np.int64)
        ahead[:-step] = name[step:] + 1
        # only names that several substrings share can still be told apart
        count = np.bincount(name)
        tied = np.flatnonzero(count[name] > 1)
        key = name[tied] * (len(lms) + 2) + ahead[tied]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        new_group = np.concatenate([[True], name[tied[1:]] != name[tied[:-1]]])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.cumsum(count) - count  # first place of each name
        place = np.arange(len(tied)) - np.maximum.accumulate(np.where(new_group, np.arange(len(tied)), 0))
        first = np.maximum.accumulate(np.where(new_key, np.arange(len(tied)), 0))
        fine = start[name]
        fine[tied] = start[name[tied]] + place[first]
        used = np.zeros(len(lms), bool)
        used[fine] = True
        name = (np.cumsum(used) - 1)[fine]
        step *= 2
    return lms[np.argsort(name, kind="stable")]


def suffix_order(shard: np.ndarray, depth: int, budget: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``shard`` (bytes 1 to 254, 0 separates) and their common prefixes.

    Positions are sorted by ``depth`` bytes (255 at most); the second array is the
    prefix each shares with the one before it, up to ``depth``.
    """
    return _suffixes(shard, depth, budget)


def prefix_classes(shard: np.ndarray, starts: np.ndarray, depth: int, budget: int = 256 << 20) -> np.ndarray:
    """Class of each window of ``depth`` bytes: equal windows, equal class.

    ``starts`` are the positions with ``depth`` bytes ahead before any separator,
    all of them.
    """
    wanted = np.full(len(shard) + 1, -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    order, shared = suffix_order(shard, depth, budget)
    keep = wanted[order] >= 0
    out = np.zeros(len(starts), np.int64)
    out[wanted[order[keep]]] = np.cumsum(shared[keep] < depth) - 1
    return out
