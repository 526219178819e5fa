"""External induced sorting of suffixes, with common-prefix values.

The suffixes that begin a local minimum of the text (LMS) are sorted first: their substrings up to the next one are
named, and the string of names is sorted by the same procedure, or by prefix doubling while its names fit in ``room``. Then every other suffix is induced from the one behind
it: a priority queue carries (first symbol, place, common prefix with the entry before) in order of arrival; popping in
order of the first symbol yields the suffixes sorted, first those larger than what follows them, then the smaller ones.

The common prefix of two neighbours in a queue is one more than the least value between the two entries that induced
them. Values are kept up to ``cap``.

Queues hold ``room`` entries in memory; beyond that they write sorted runs to unnamed temporary files, which only the
task that wrote them reads and which vanish with it, like the spill files of a sort. The text, the names and the sorted
places stay in memory, so callers bound a sort by the size of its text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

FAR = 1 << 30


class BucketQueue:
    """Priority queue for few symbols: entries of a symbol leave in order of arrival."""

    def __init__(self, room: int):
        self.room, self.held = room, 0
        self.blocks: dict[int, list] = {}  # symbol -> arrays of (place, prefix), or (offset, entries) in the file
        self.file = None

    def push(self, symbol: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        self.blocks.setdefault(symbol, []).append(np.stack([places, prefixes]))
        self.held += len(places)
        if self.held > self.room:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, blocks in self.blocks.items():
            for k, b in enumerate(blocks):
                if isinstance(b, np.ndarray):
                    blocks[k] = (self.file.tell(), b.shape[1])
                    self.file.write(np.ascontiguousarray(b, np.int64).tobytes())
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray | None:
        """The next entries of this symbol, ``room`` of them or a little more: places and prefixes."""
        blocks = self.blocks.pop(symbol, None)
        if not blocks:
            return None
        out, size = [], 0
        while blocks and size < self.room:
            b = blocks.pop(0)
            if isinstance(b, tuple):
                self.file.seek(b[0])
                b = np.frombuffer(self.file.read(16 * b[1]), np.int64).reshape(2, b[1])
            else:
                self.held -= b.shape[1]
            out.append(b)
            size += b.shape[1]
        if blocks:
            self.blocks[symbol] = blocks
        return out[0] if len(out) == 1 else np.concatenate(out, 1)


class NameQueue:
    """Priority queue for many symbols, counted from 0: the places of a symbol leave in order of arrival."""

    def __init__(self, symbols: int, room: int):
        self.room, self.held = room, 0
        self.places: list[list[int] | None] = [None] * symbols
        self.runs: dict[int, list[tuple[int, int]]] = {}  # symbol -> (offset, entries) of its sorted runs in the file
        self.file = None

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, places in enumerate(self.places):
            if places:
                self.runs.setdefault(symbol, []).append((self.file.tell(), len(places)))
                self.file.write(np.array(places, np.int64).tobytes())
                self.places[symbol] = None
        self.held = 0

    def pop(self, symbol: int) -> list[int]:
        """The places that have arrived since the last call."""
        out = []
        for offset, n in self.runs.pop(symbol, ()):
            self.file.seek(offset)
            out += np.frombuffer(self.file.read(8 * n), np.int64).tolist()
        late = self.places[symbol]
        if late:
            self.places[symbol] = None
            self.held -= len(late)
            out += late
        return out


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """For each place whether its suffix is smaller than the next one; true for the last symbol, the only smallest."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    last = np.maximum.accumulate(np.where(step[::-1] != 0, np.arange(n - 1), -1))[::-1]  # the next change, from behind
    kind = np.ones(n, bool)
    known = last >= 0
    kind[:-1][known] = step[n - 2 - last[known]] > 0
    kind[:-1][~known] = False
    return kind


def _named(t: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Rank of each substring among the distinct ones. A substring that goes on where another ends is the smaller one
    there, hence a mark above all symbols at the end. As many symbols as fit are compared as one integer, those of
    substrings that go on by the next integers, the rest of very long ones byte by byte."""
    used = np.flatnonzero(np.bincount(t))
    dense = np.zeros(int(t.max()) + 1, np.int64)
    dense[used] = np.arange(1, len(used) + 1)
    mark = len(used) + 1
    bits = int(mark).bit_length()
    first = max(1, 63 // bits)
    padded = np.r_[dense[t], np.zeros(first, np.int64)]
    sizes = stops - starts
    ranks, open_ = np.zeros(len(starts), np.int64), np.arange(len(starts))
    for lo in range(0, 4 * first, first):
        at, left = starts[open_] + lo, sizes[open_] - lo
        key = np.zeros(len(open_), np.int64)
        for k in range(first):
            key = key << bits | np.where(k < left, padded[np.minimum(at + k, len(padded) - 1)], np.where(k == left, mark, 0))
        ranks = _refined(ranks, open_, key)
        open_ = open_[left >= first]
        if not len(open_):
            return ranks
    data = t.astype(">u4").tobytes()
    pieces = [data[4 * a:4 * b] + b"\xff\xff\xff\xff" for a, b in zip((starts[open_] + 4 * first).tolist(), stops[open_].tolist(), strict=True)]
    names = {p: n for n, p in enumerate(sorted(set(pieces)))}
    return _refined(ranks, open_, np.fromiter(map(names.__getitem__, pieces), np.int64, len(pieces)))


def _dense(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each value among the distinct ones, and their number."""
    order = np.argsort(key)
    rising = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.r_[False, rising[1:] != rising[:-1]])
    return rank, int(rank[order[-1]]) + 1


def _refined(ranks: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks by ``ranks`` and then by ``key`` of the places ``at``; of one rank all places are among these, or none."""
    rank, n = _dense(key)
    both = ranks * n
    both[at] += rank
    return _dense(both)[0]


def sort_lms(t: np.ndarray, kind: np.ndarray, room: int) -> np.ndarray:
    """Places of the LMS suffixes of ``t``, sorted."""
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    if len(lms) < 2:
        return lms
    string = _named(t, lms, np.r_[lms[1:], len(t) - 1] + 1)
    if string.max() + 1 == len(lms):
        return lms[np.argsort(string)]
    return lms[doubled(string) if len(string) <= room else sort_suffixes(string, room)]


def doubled(t: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a string of ranks, whose last one is its only smallest, by prefix doubling: ranks of twice as many symbols
    come from two ranks. Suffixes that stand alone in their rank are not sorted again."""
    n = len(t)
    rank, size = _dense(t)[0], 1
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    rank = (np.cumsum(np.bincount(rank, minlength=n)) - np.bincount(rank, minlength=n))[rank]  # the smaller suffixes
    while len(open_):
        key = rank[open_] * (n + 1) + np.where(open_ + size < n, rank[np.minimum(open_ + size, n - 1)] + 1, 0)
        order = np.argsort(key)
        key, open_ = key[order], open_[order]
        old = rank[open_]
        place = np.arange(len(open_))
        heads = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        rank[open_] = old + np.maximum.accumulate(np.where(new, place, 0)) - heads
        open_ = open_[~(new & np.r_[new[1:], True])]
        size *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def sort_suffixes(t: np.ndarray, room: int) -> np.ndarray:
    """Sorted suffixes of a string of names, whose last name is its only smallest."""
    n = len(t)
    kind = smaller_than_next(t)
    seeds = sort_lms(t, kind, room).tolist()
    names = t.tolist()
    symbols = max(names) + 1

    def induce(seeds: list[int], order: range, want: bool) -> list[int]:
        """Suffixes of kind ``want`` in popping order. Seeds come in order; of one symbol the induced ones go first."""
        follows = np.zeros(n, bool)
        follows[1:] = kind[:-1] == want  # whether a suffix induces the one before it
        induces = follows.tolist()
        queue, out, at, last = NameQueue(symbols, room), [], 0, len(seeds)
        places = queue.places
        for symbol in order:
            while got := queue.pop(symbol):
                out += got
                for i in got:
                    if induces[i]:
                        c = names[i - 1]
                        if places[c] is None:
                            places[c] = [i - 1]
                        else:
                            places[c].append(i - 1)
                        queue.held += 1
                if queue.held > room:
                    queue.spill()
            while at < last and names[seeds[at]] == symbol:
                i = seeds[at]
                at += 1
                if induces[i]:
                    c = names[i - 1]
                    if places[c] is None:
                        places[c] = [i - 1]
                    else:
                        places[c].append(i - 1)
                    queue.held += 1
            if queue.held > room:
                queue.spill()
        return out
    large = induce(seeds, range(symbols), False)
    small = [n - 1] + induce(large[::-1], range(symbols - 1, -1, -1), True)[::-1]  # nothing induces the last suffix
    # within a symbol the suffixes larger than the next come first
    both = np.array(large + small, np.int64)
    rank = 2 * t[both] + (np.arange(n) >= len(large))
    return both[np.argsort(rank, kind="stable")]


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of the suffixes at ``a`` and ``b``, up to ``cap``, by comparison; ``t`` has ``cap`` symbols to spare."""
    out = np.empty(len(a), np.int64)
    span = np.arange(cap)
    for lo in range(0, len(a), 1 << 14):
        same = t[a[lo:lo + (1 << 14), None] + span] == t[b[lo:lo + (1 << 14), None] + span]
        out[lo:lo + (1 << 14)] = np.where(same.all(1), cap, same.argmin(1))
    return out


def _induce(t: np.ndarray, seeds: np.ndarray, prefixes: np.ndarray, kind: np.ndarray, want: bool, symbols: list[int], cap: int,
            room: int) -> dict[int, np.ndarray]:
    """Suffixes of kind ``want`` by first symbol, in popping order, each with its prefix with the one before.

    ``seeds`` come in popping order with their prefixes; ``symbols`` is the order of the first symbols.
    """
    queue = BucketQueue(room)
    out: dict[int, list[np.ndarray]] = {}
    since = np.full(int(max(symbols)) + 1, -1, np.int64)  # least value since a symbol was last pushed; -1 before
    first = t[seeds]
    cuts = {int(first[a]): (a, b) for a, b in _runs(first)}

    def scan(places: np.ndarray, values: np.ndarray) -> None:
        for lo in range(0, len(places), 1 << 16):
            block, value = places[lo:lo + (1 << 16)], values[lo:lo + (1 << 16)]
            pushing = block > 0
            pushing[pushing] = kind[block[pushing] - 1] == want
            at = np.flatnonzero(pushing)
            symbol = t[block[at] - 1]
            order = np.argsort(symbol, kind="stable")
            at, symbol = at[order], symbol[order]
            pushed = np.zeros(len(since), bool)
            for a, b in _runs(symbol):
                c, who = int(symbol[a]), at[a:b]
                firsts = np.zeros(len(who), np.int64)
                firsts[1:] = who[:-1] + 1
                least = np.minimum.reduceat(value[:who[-1] + 1], firsts)
                least[0] = min(least[0], since[c])
                since[c] = value[who[-1] + 1:].min() if who[-1] + 1 < len(value) else FAR
                pushed[c] = True
                queue.push(c, block[who] - 1, np.minimum(least + 1, cap))
            still = ~pushed
            since[still] = np.minimum(since[still], value.min())

    for c in symbols:
        last = None
        while (got := queue.pop(c)) is not None:
            out.setdefault(c, []).append(got)
            last = int(got[0, -1])
            scan(got[0], got[1])
        if c in cuts:
            a, b = cuts[c]
            values = prefixes[a:b].copy()
            values[0] = 0 if last is None else common(t, np.array([last]), seeds[a:a + 1], cap)[0]
            scan(seeds[a:b], values)
    return {c: np.concatenate(blocks, 1) for c, blocks in out.items()}


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if len(x):
        cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
        yield from zip(cuts[:-1], cuts[1:], strict=True)


def suffix_array(text: np.ndarray, cap: int, room: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of a text of small unsigned symbols that ends with its only 0, and the common prefix of each with the
    one before, up to ``cap``."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    t = np.r_[text, np.zeros(cap, text.dtype)].astype(np.int16)
    kind = smaller_than_next(text)
    seeds = sort_lms(text, kind, room)
    symbols = np.unique(text).astype(int).tolist()
    large = _induce(t, seeds, np.r_[0, common(t, seeds[:-1], seeds[1:], cap)], kind, False, symbols, cap, room)
    down: list[np.ndarray] = []
    for c in reversed(symbols):
        if c in large:
            places, values = large[c]
            down.append(np.stack([places[::-1], np.r_[0, values[:0:-1]]]))
    back = np.concatenate(down, 1) if down else np.empty((2, 0), np.int64)
    small = _induce(t, back[0], back[1], kind, True, symbols[::-1], cap, room)
    places, values = [], []
    for c in symbols:
        for k, part in enumerate((large.get(c), small.get(c))):
            if c == 0 and k and part is None:
                part = np.array([[n - 1], [0]])
            if part is None:
                continue
            p, v = part if not k else (part[0, ::-1], np.r_[0, part[1, :0:-1]])
            v = v.copy()
            v[0] = common(t, places[-1][-1:], p[:1], cap)[0] if places else 0
            places.append(p)
            values.append(v)
    return np.concatenate(places), np.concatenate(values)
