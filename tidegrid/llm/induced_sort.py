"""External induced sorting of suffixes with capped common-prefix values, in numpy batches.

The text is an array of symbols cut by zeros; each zero is a separator of its own, smaller than all symbols and than
every later separator, so no comparison passes one. Sorting follows the induced scheme: suffixes that begin a rising
stretch behind a falling one (the seeds) are put in order first - their substrings by one round of induction, then, by
names, recursively - and all others follow from them in an upward scan for falling and a downward scan for rising
suffixes. A scanned suffix pushes its left neighbour into the queue of the symbol before it. As a queue's items come in
order, the priority queue over suffixes is a first-in-first-out queue for each symbol, whose size is known from the
symbol counts: the queues hold tuples (position, common prefix with the neighbour pushed before) and lie one behind the
other in one array. Common prefixes are induced along: one more than the least value passed since the last push to the
same symbol, capped at `cap`.

All arrays that grow with the text come from a Store: they are held in memory while they keep within `memory` bytes
together, and are files on the worker's disk beyond that, so that a text far larger than memory can be sorted; what is
worked on at a time is bounded by BATCH. Texts of names have large alphabets; runs of their symbols are scanned together
up to the first one that is pushed to from within the run. Reduced texts of up to `base` names are ranked in memory by
doubling; larger ones go through the same procedure again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .common import scratch_file, spread

MEMORY = 64 << 20
BASE = 3 << 19
#: Suffixes scanned at a time.
BATCH = 1 << 17
#: Alphabets larger than this are scanned in runs of symbols.
WIDE = 1024


class Store:
    """Arrays in memory while all of them keep within `memory` bytes, else in files on the worker's disk."""

    def __init__(self, memory: int):
        self.memory, self.held, self.on_disk = memory, 0, 0

    def array(self, n: int, kind) -> np.ndarray:
        """Zeros."""
        size = n * np.dtype(kind).itemsize
        if not n or self.held + size <= self.memory:
            self.held += size
            return np.zeros(n, kind)
        with scratch_file() as f:
            f.truncate(size)
            self.on_disk += size
            return np.memmap(f, kind, "r+", shape=(n,))

    def free(self, *arrays: np.ndarray) -> None:
        """The caller has no more use for them."""
        for a in arrays:
            if isinstance(a, np.memmap):
                self.on_disk -= a.nbytes
            else:
                self.held -= a.nbytes


def batches(n: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, BATCH):
        yield a, min(n, a + BATCH)


def _at(a: np.ndarray, b: int | slice | np.ndarray) -> np.ndarray:
    """Items as an array of its own in memory."""
    return np.array(a[b])


def _count(into: np.ndarray, x: np.ndarray) -> None:
    if len(into) <= WIDE:
        into += np.bincount(x, minlength=len(into))
    elif len(x):
        u, n = np.unique(x, return_counts=True)
        into[u] += n


def _heads(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class Queues:
    """First-in-first-out queues by symbol of positions and, if wanted, common prefixes, one behind the other."""

    def __init__(self, store: Store, heads: np.ndarray, kind, prefixes: bool):
        self.head, self.end = heads, heads[:-1].copy()
        self.pos = store.array(int(heads[-1]), kind)
        self.lcp = store.array(int(heads[-1]), np.uint8) if prefixes else None

    def push(self, symbols: np.ndarray, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        """Items in order, sorted by symbol."""
        first = np.concatenate([[True], symbols[1:] != symbols[:-1]])
        start = np.flatnonzero(first)
        own = symbols[start]
        n = np.diff(np.concatenate([start, [len(symbols)]]))
        dest = spread(self.end[own], n)
        self.pos[dest] = pos
        if self.lcp is not None:
            self.lcp[dest] = lcp
        self.end[own] += n

    def items(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray | None]:
        return self.pos[a:b].astype(np.int64), None if self.lcp is None else _at(self.lcp, slice(a, b))

    def free(self, store: Store) -> None:
        store.free(self.pos, *([] if self.lcp is None else [self.lcp]))


#: The greatest k with 1 << k of at most n, by n.
_LEVEL = (np.frexp(np.arange(BATCH + 2, dtype=np.float64))[1] - 1).astype(np.int8)


class _Least:
    """The least value passed since the last push to each symbol."""

    def __init__(self, symbols: int, cap: int):
        self.run, self.met, self.cap = np.full(symbols, 255, np.uint8), np.zeros(symbols, bool), cap

    def of(self, l: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Common prefixes of pushes: item at[k] of the batch pushes to target[k]; both sorted by target, then place."""
        levels = max(1, len(l).bit_length())
        table = np.empty((levels, len(l)), np.uint8)  # row k: the least of 1 << k items from each on
        table[0] = l
        for k in range(1, levels):
            step, n = 1 << (k - 1), len(l) - (1 << k) + 1
            np.minimum(table[k - 1, :n], table[k - 1, step : step + n], out=table[k, :n])
        first = np.concatenate([[True], target[1:] != target[:-1]])
        low = np.where(first, 0, np.concatenate([[0], at[:-1] + 1]))
        level = _LEVEL[at - low + 1].astype(np.int64) if len(l) < len(_LEVEL) else np.frexp((at - low + 1).astype(np.float64))[1] - 1
        row, flat = level * len(l), table.reshape(-1)
        value = np.minimum(flat[row + low], flat[row + at - (1 << level) + 1])
        heads = target[first]
        value[first] = np.where(self.met[heads], np.minimum(value[first], self.run[heads]), 255)
        out = np.where(value == 255, 0, np.minimum(value.astype(np.int32) + 1, self.cap)).astype(np.uint8)
        last = at[np.concatenate([first[1:], [True]])]
        tail = np.concatenate([np.minimum.accumulate(l[::-1])[::-1], [255]])
        self.run = np.minimum(self.run, tail[0])
        self.run[heads] = tail[last + 1]
        self.met[heads] = True
        return out

    def passed(self, l: np.ndarray) -> None:
        if len(l):
            self.run = np.minimum(self.run, l.min())


class Sorter:
    def __init__(self, text: np.ndarray, cap: int = 0, memory: int = MEMORY, base: int = BASE, store: Store | None = None):
        """cap: the largest common prefix of interest, at most 200; 0: none are made. The text ends with a zero."""
        self.t, self.cap, self.base, self.store = text, cap, base, store or Store(memory)
        n = len(text)
        self.kind = np.int32 if n < 1 << 31 else np.int64
        self.symbols = 1 + max((int(text[a:b].max()) for a, b in batches(n)), default=0)
        self.is_seed = self.store.array(n, bool)
        falls, rises, seeds = (np.zeros(self.symbols, np.int64) for _ in range(3))
        behind = True  # whether the suffix behind the batch is of the rising kind
        for a, b in reversed(list(batches(n))):
            x = np.concatenate([text[a:b], text[b : b + 1] if b < n else np.zeros(1, text.dtype)])
            same = x[1:] == x[:-1]
            at = np.where(same, b - a, np.arange(b - a))
            at = np.minimum.accumulate(at[::-1])[::-1]
            up = np.concatenate([x[:-1] < x[1:], [behind]])
            x = x[:-1]
            rise = up[at] | (x == 0)
            before = np.concatenate([text[a - 1 : a] if a else np.zeros(1, text.dtype), x[:-1]])
            seed = (x == 0) | (rise & (before > x))
            self.is_seed[a:b] = seed
            _count(falls, x[~rise])
            _count(rises, x[rise & (x > 0)])
            _count(seeds, x[seed])
            behind = bool(rise[0])
        self.fall_heads, self.rise_heads, self.seed_heads = map(_heads, (falls, rises, seeds))
        self.seeds = self.store.array(int(self.seed_heads[-1]), self.kind)
        k = 0
        for a, b in batches(n):
            s = np.flatnonzero(self.is_seed[a:b]) + a
            self.seeds[k : k + len(s)] = s
            k += len(s)

    def close(self) -> None:
        self.store.free(self.is_seed, self.seeds)

    def _prefix(self, x: int, y: int) -> int:
        """Common prefix of two suffixes, compared symbol by symbol."""
        n = 0
        while n < self.cap and self.t[x + n] == self.t[y + n] != 0:
            n += 1
        return n

    def _push(self, queues: Queues, least: _Least | None, x: np.ndarray, l: np.ndarray | None, ok: np.ndarray, before: np.ndarray) -> None:
        at = np.flatnonzero(ok)
        if not len(at):
            if least is not None:
                least.passed(l)
            return
        order = np.argsort(before[at], kind="stable")
        at = at[order]
        target = before[at].astype(np.int64)
        queues.push(target, x[at] - 1, least.of(l, at, target) if least is not None else None)

    def _up(self, c: int, falling: Queues, least: _Least | None, seeds: np.ndarray, seed_lcp: np.ndarray | None) -> None:
        """One symbol of the upward scan."""
        t, end, at = self.t, None, int(falling.head[c])
        while at < (stop := min(int(falling.end[c]), at + BATCH)):
            x, l = falling.items(at, stop)
            at = stop
            before = t[x - 1]
            self._push(falling, least, x, l, before >= c, before)
            end = int(x[-1])
        a, b = int(self.seed_heads[c]), int(self.seed_heads[c + 1])
        for i in range(a, b, BATCH):
            x = seeds[i : min(b, i + BATCH)].astype(np.int64)
            l = None
            if seed_lcp is not None:
                l = _at(seed_lcp, slice(i, i + len(x)))
                if i == a:
                    l[0] = self._prefix(end, int(x[0])) if end is not None and c else 0
            before = t[x - 1]
            self._push(falling, least, x, l, before > c, before)

    def _down(self, c: int, rising: Queues, falling: Queues, least: _Least | None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """One symbol of the downward scan: its suffixes from the greatest down."""
        t, lcp, end, at = self.t, least is not None, None, int(rising.head[c])
        while at < (stop := min(int(rising.end[c]), at + BATCH)):
            x, l = rising.items(at, stop)
            at = stop
            yield x, l
            before = t[x - 1]
            self._push(rising, least, x, l, (before <= c) & (before > 0), before)
            end = int(x[-1])
        kept = None  # common prefix of the last item given and the next one
        stop, first = int(falling.end[c]), int(falling.head[c])
        while stop > first:
            start = max(first, stop - BATCH)
            x, a = falling.items(start, stop)
            x, l, stop = x[::-1], None, start
            if lcp:
                head = kept if kept is not None else (self._prefix(end, int(x[0])) if end is not None else 0)
                l = np.concatenate([[head], a[1:][::-1]]).astype(np.uint8)
                kept = int(a[0])
            yield x, l
            before = t[x - 1]
            self._push(rising, least, x, l, (before < c) & (before > 0), before)

    def _runs_up(self, falling: Queues, seeds: np.ndarray) -> None:
        """The upward scan over runs of symbols, each up to the first symbol that the run pushes to."""
        t, c, width = self.t, 0, 64
        while c < self.symbols:
            stop = min(self.symbols, c + width)
            queued, own = falling.end[c:stop] - falling.head[c:stop], np.diff(self.seed_heads[c : stop + 1])
            total = int(queued.sum() + own.sum())
            if stop - c > 1 and total <= BATCH:
                x = np.concatenate([falling.pos[spread(falling.head[c:stop], queued)], seeds[int(self.seed_heads[c]) : int(self.seed_heads[stop])]]).astype(np.int64)
                key = np.concatenate([np.repeat(np.arange(c, stop) * 2, queued), np.repeat(np.arange(c, stop) * 2 + 1, own)])
                order = np.argsort(key, kind="stable")
                x, key = x[order], key[order]
                before = t[x - 1].astype(np.int64)
                ok = before >= (key >> 1) + (key & 1)
                within = before[ok & (before < stop)]
                if len(within):
                    stop = int(within.min())
                if stop > c:
                    ok &= key >> 1 < stop
                    self._push(falling, None, x, None, ok, before)
                    width = max(2, 2 * (stop - c))
                    c = stop
                    continue
            elif stop - c > 1:
                width = max(1, (stop - c) // 2)
                continue
            self._up(c, falling, None, seeds, None)
            width, c = 2, c + 1

    def _runs_down(self, rising: Queues, falling: Queues) -> Iterator[np.ndarray]:
        """The downward scan over runs of symbols, likewise."""
        t, c, width = self.t, self.symbols - 1, 64
        while c > 0:
            low = max(1, c - width + 1)
            up, down = (rising.end[low : c + 1] - rising.head[low : c + 1])[::-1], (falling.end[low : c + 1] - falling.head[low : c + 1])[::-1]
            total = int(up.sum() + down.sum())
            if c > low and total <= BATCH:
                places = spread(falling.head[low : c + 1][::-1], down)
                symbols = np.arange(c, low - 1, -1)
                back = np.repeat(falling.head[low : c + 1][::-1] + falling.end[low : c + 1][::-1] - 1, down) - places
                x = np.concatenate([rising.pos[spread(rising.head[low : c + 1][::-1], up)], falling.pos[back]]).astype(np.int64)
                symbol = np.concatenate([np.repeat(symbols, up), np.repeat(symbols, down)])
                fall = np.concatenate([np.zeros(int(up.sum()), np.int64), np.ones(int(down.sum()), np.int64)])
                order = np.argsort((self.symbols - symbol) * 2 + fall, kind="stable")
                x, symbol, fall = x[order], symbol[order], fall[order]
                before = t[x - 1].astype(np.int64)
                ok = (before <= symbol - fall) & (before > 0)
                within = before[ok & (before >= low)]
                if len(within):
                    low = int(within.max()) + 1
                if low <= c:
                    keep = symbol >= low
                    self._push(rising, None, x, None, ok & keep, before)
                    yield x[keep]
                    width = max(2, 2 * (c - low + 1))
                    c = low - 1
                    continue
            elif c > low:
                width = max(1, (c - low + 1) // 2)
                continue
            for x, _ in self._down(c, rising, falling, None):
                yield x
            width, c = 2, c - 1

    def induce(self, seeds: np.ndarray, seed_lcp: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """All suffixes but the separators, from the greatest down, in batches, with the common prefix of each and the one given before it."""
        lcp, wide = seed_lcp is not None, self.symbols > WIDE and seed_lcp is None
        falling = Queues(self.store, self.fall_heads, self.kind, lcp)
        if wide:
            self._runs_up(falling, seeds)
        else:
            least = _Least(self.symbols, self.cap) if lcp else None
            for c in range(self.symbols):
                self._up(c, falling, least, seeds, seed_lcp)
        rising = Queues(self.store, self.rise_heads, self.kind, lcp)
        if wide:
            for x in self._runs_down(rising, falling):
                yield x, None
        else:
            least = _Least(self.symbols, self.cap) if lcp else None
            for c in range(self.symbols - 1, 0, -1):
                yield from self._down(c, rising, falling, least)
        falling.free(self.store)
        rising.free(self.store)

    def _from_the_end(self, order: np.ndarray, parts: Iterator[np.ndarray]) -> int:
        """Put parts, which come from the greatest down, into order from its end; where they begin."""
        at = len(order)
        for x in parts:
            order[at - len(x) : at] = x[::-1]
            at -= len(x)
        return at

    def _named(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(seeds in the order of their substrings up to the next seed, a name for each seed in text order, number of names): equal names for equal substrings, in their order."""
        t, seeds, store, n = self.t, self.seeds, self.store, len(self.seeds)
        rough = store.array(n, self.kind)
        end = self.seed_heads[:-1].copy()
        for a, b in batches(n):
            x = seeds[a:b]
            own = t[x].astype(np.int64)
            by = np.argsort(own, kind="stable")
            u, counts = np.unique(own, return_counts=True)
            rough[spread(end[u], counts)] = x[by]
            end[u] += counts
        order = store.array(n, self.kind)
        zeros = int(self.seed_heads[1])
        order[:zeros] = rough[:zeros]
        at = self._from_the_end(order, (x[self.is_seed[x]] for x, _ in self.induce(rough, None)))
        assert at == zeros
        store.free(rough)
        number = store.array(len(t), self.kind)
        for a, b in batches(n):
            number[seeds[a:b]] = np.arange(a, b)
        names, name = store.array(n, self.kind), 0
        for a, b in batches(n):
            x = order[a:b].astype(np.int64)
            if a:
                x = np.concatenate([order[a - 1 : a], x])
            place = number[x]
            stop = np.where(place + 1 < n, seeds[np.minimum(place + 1, n - 1)], len(t) - 1).astype(np.int64)
            length = np.where(t[x] == 0, 0, stop - x)
            same = (length[1:] == length[:-1]) & (length[1:] > 0) & (t[stop[1:]] != 0)
            k, live = 0, np.flatnonzero(same)
            while len(live):
                differ = t[x[live] + k] != t[x[live + 1] + k]
                same[live[differ]] = False
                live = live[~differ]
                live = live[length[live] > k]
                k += 1
            found = name + np.cumsum(np.concatenate([[False], ~same]))
            names[place[1:] if a else place] = found[1:] if a else found
            name = int(found[-1])
        store.free(number)
        return order, names, name + 1

    def ordered_seeds(self) -> np.ndarray:
        order, names, n = self._named()
        if n == len(names):
            self.store.free(names)
            return order
        if len(names) <= self.base:
            place = doubled(names.astype(np.int64))
        else:
            text = self.store.array(len(names) + 1, np.int32 if n < 1 << 30 else np.int64)
            for a, b in batches(len(names)):
                text[a:b] = names[a:b] + 1
            inner = Sorter(text, 0, base=self.base, store=self.store)
            place = self.store.array(len(names), self.kind)
            first = inner.ordered_seeds()
            assert self._from_the_end(place, (x for x, _ in inner.induce(first, None))) == 0
            inner.close()
            self.store.free(text, first)
        for a, b in batches(len(names)):
            order[a:b] = self.seeds[place[a:b]]
        self.store.free(names)
        return order

    def descending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Suffixes from the greatest down with capped common prefixes."""
        seeds = self.ordered_seeds()
        lcp = self.store.array(len(seeds), np.uint8)
        for a, b in batches(len(seeds) - 1):
            x, y, n = seeds[a:b].astype(np.int64), seeds[a + 1 : b + 1].astype(np.int64), np.zeros(b - a, np.uint8)
            live = np.arange(b - a)
            for k in range(self.cap):
                own = self.t[x[live] + k]
                live = live[(own == self.t[y[live] + k]) & (own != 0)]
                if not len(live):
                    break
                n[live] += 1
            lcp[a + 1 : b + 1] = n
        yield from self.induce(seeds, lcp)
        self.store.free(seeds, lcp)


def doubled(names: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a text of names, in memory; suffixes that run out are smaller."""
    n = len(names)
    order = np.argsort(names)  # equal names get one rank, so any order among them will do
    s = names[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    live, h, head = order, 0, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    rank[order] = np.repeat(head, np.diff(np.concatenate([head, [n]])))
    while True:
        size = np.diff(np.concatenate([head, [len(live)]]))
        live = live[np.repeat(size > 1, size)]
        if not len(live):
            break
        h = h * 2 or 1
        key = rank[live] * (n + 1) + rank[np.minimum(live + h, n)] + 1
        by = np.argsort(key)
        live, key = live[by], key[by]
        old = rank[live]
        first = np.concatenate([[True], old[1:] != old[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        i = np.arange(len(live))
        head = i[new]
        rank[live] = old + head[np.cumsum(new) - 1] - i[first][np.cumsum(first) - 1]
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


def least_owners(text: np.ndarray, length: int, owner: Callable[[np.ndarray], np.ndarray], store: Store, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each position, the least owner for each number): positions where the same `length` symbols start have one number."""
    number = store.array(len(text), np.int32 if len(text) < 1 << 31 else np.int64)
    low = store.array(len(text) + 1, np.int64)
    k, least = 0, np.iinfo(np.int64).max
    sorter = Sorter(text, length, base=base, store=store)
    for x, l in sorter.descending():
        new = l < length
        own = k + np.cumsum(new)
        number[x] = own
        at = np.flatnonzero(np.concatenate([[True], new[1:]]))
        found = np.minimum.reduceat(owner(x), at)
        groups = own[at]
        if groups[0] == k:
            found[0] = min(found[0], least)
        low[groups] = found
        k, least = int(groups[-1]), int(found[-1])
    sorter.close()
    return number, low
