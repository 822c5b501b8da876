"""Buckets of hash keys: keys travel as compressed columns for a part of the key space, and are compared part by part.

Rows (part, then one compressed column for each of the numbers) are made from arrays in memory by `cut`, gathered by
part in a grouped Arrow function by `gathered`, and compared bucket by bucket: `forest` gives all pairs of bit strings
within a limit for small buckets, and for large ones the edges of a spanning forest of that graph, never all pairs;
`cross_pairs` gives the pairs of rows with different tags.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import squeeze, unsqueeze

#: Buckets up to this size are compared pair by pair.
SMALL = 8
#: Buckets up to this size are compared all at once where tags differ, larger ones row by row.
SHIFTS = 64
#: Rows compared at once.
BLOCK = 1 << 16


def schema(columns: int) -> str:
    return "part long, " + ", ".join(f"c{i} binary" for i in range(columns))


def cut(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each part that occurs; part must be sorted."""
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.concatenate([at[1:], [len(part)]]) if len(at) else at
    cols = [pa.array([squeeze(np.ascontiguousarray(c[a:b])) for a, b in zip(at.tolist(), ends.tolist())], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int64)), *cols], ["part", *(f"c{i}" for i in range(len(columns)))])


def gathered(batches: Iterator[pa.RecordBatch], kinds: list) -> list[np.ndarray]:
    """The columns of a part."""
    found: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in batches:
        for i, kind in enumerate(kinds):
            found[i] += [unsqueeze(x.as_py(), kind) for x in b.column(b.schema.get_field_index(f"c{i}"))]
    return [np.concatenate(f) if f else np.zeros(0, k) for f, k in zip(found, kinds)]


def distance(bits: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    total = np.bitwise_count(bits[0][i] ^ bits[0][j]).astype(np.int64)
    for b in bits[1:]:
        total += np.bitwise_count(b[i] ^ b[j])
    return total


def forest(keys: np.ndarray, bits: list[np.ndarray], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, root): pairs of rows of a bucket within `limit` bits, whose components are those of all such pairs; keys are sorted.

    root is -1 for small buckets, of which all pairs are given; else the first row of the component, found breadth
    first from the first row of the bucket on.
    """
    if len(keys) < 2:
        return
    first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    size = np.diff(np.concatenate([first, [len(keys)]]))
    small = np.repeat(size <= SMALL, size)
    for step in range(1, SMALL):
        i = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:])) if len(keys) > step else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[distance(bits, i, i + step) <= limit]
        yield i, i + step, np.full(len(i), -1, np.int64)
    for a, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        yield from _tree(np.arange(a, a + n), bits, limit)


def _tree(rest: np.ndarray, bits: list[np.ndarray], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    while len(rest) > 1:
        root, queue, rest = int(rest[0]), [int(rest[0])], rest[1:]
        at = 0
        while at < len(queue) and len(rest):
            head, at = queue[at], at + 1
            hit = np.concatenate([distance(bits, np.full(len(r), head), r) <= limit for r in (rest[k : k + BLOCK] for k in range(0, len(rest), BLOCK))])
            if hit.any():
                new = rest[hit]
                yield np.full(len(new), head), new, np.full(len(new), root)
                queue += new.tolist()
                rest = rest[~hit]


def cross_pairs(keys: np.ndarray, bits: list[np.ndarray], limit: int, tags: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a bucket within `limit` bits that have different tags; keys are sorted."""
    if len(keys) < 2:
        return
    first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    size = np.diff(np.concatenate([first, [len(keys)]]))
    small = np.repeat(size <= SHIFTS, size)
    for step in range(1, min(SHIFTS, len(keys))):
        i = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:]))
        if not len(i):
            break
        i = i[tags[i] != tags[i + step]]
        i = i[distance(bits, i, i + step) <= limit]
        yield i, i + step
    for a, n in zip(first[size > SHIFTS].tolist(), size[size > SHIFTS].tolist()):
        if (tags[a : a + n] == tags[a]).all():
            continue
        for i in range(a, a + n - 1):
            for k in range(i + 1, a + n, BLOCK):
                j = np.arange(k, min(a + n, k + BLOCK))
                j = j[tags[j] != tags[i]]
                j = j[distance(bits, np.full(len(j), i), j) <= limit]
                if len(j):
                    yield np.full(len(j), i), j
