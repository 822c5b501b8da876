"""Exact removal of repeated passages with suffix arrays, shard by shard.

Every `LENGTH`-byte string of a document belongs to the shard of its minimizer, the least hash among its K-byte
strings; equal strings have equal minimizers and so meet in one shard, whatever surrounds them. Consecutive strings
with one minimizer form a segment.

1. Documents are dealt into groups of about GROUP_BYTES, minimizers into a shard for each SHARD_BYTES, but at most SHARDS.
   Each group sends the minimizers it has to their shards, once.
2. A shard answers each group with those that more than one document has; nothing else can repeat.
3. Each group sends its segments with these minimizers, each distinct one once, with its smallest doc_id.
4. A shard sorts the suffixes of its distinct segments by external induced sorting (see induced_sort), which also gives
   common prefixes; suffixes that share LENGTH bytes are the places of one string, whose smallest doc_id goes back to
   the groups in runs.
5. Each group marks, in every document, the strings that have a smaller doc_id elsewhere, and removes the bytes they
   cover.

A group is bounded by the input dealt to it (or by its longest document). A shard isn't: at most SHARDS of them, so that
groups exchange a number of rows that grows in proportion to the input, they grow with it, and one minimizer that is
frequent in many surroundings makes a large one. A shard therefore reads its rows one by one, and keeps what grows with
it - digests, text, seeds, names, queues, owners - in arrays that are files on the worker's disk beyond `memory`
bytes. A passage that all documents share counts once in each group. All exchanges are keyed by group or shard number,
so that lost tasks are made again from their inputs. Equal segments are told by 128-bit digests.

Nulls and odd input: a null text is empty. Rows with the same doc_id don't remove from each other; a null doc_id counts
as greater than all others. Ids that aren't integers are ordered as Spark orders them, by their ranks. Texts under LENGTH
bytes are kept. An empty table gives an empty table. Columns of the input with the names of the result are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import induced_sort
from .common import fresh, offsets_of, scratch_file, settle, small_batches, spread, squeeze, trim, unsqueeze

LENGTH = 50
K = 24
GROUP_BYTES = 16 << 20
#: Bytes of the input for each shard; its segments are about half as many for distinct, four times as many for repeated text.
SHARD_BYTES = 4 << 20
#: Most shards. Beyond SHARDS * SHARD_BYTES of input shards grow, and are sorted on disk.
SHARDS = 4096
#: Minimizers or digests of a shard that are compared in memory at once.
PASS = 1 << 20
#: Most strings of a segment.
STARTS = 256
#: Window starts hashed at a time.
STEP = 1 << 20
#: A null doc_id.
LAST = np.iinfo(np.int64).max

NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of documents data[offsets[i]:offsets[i + 1]]: (first start, number of starts, minimizer, document)."""
    span = LENGTH - K + 1
    found = []
    total = len(data) - LENGTH + 1
    for a in range(0, max(0, total), STEP):
        b = min(a + STEP, total)
        w = data[a : b + LENGTH - 1].tobytes()
        m = len(w) - K + 1
        with np.errstate(over="ignore"):
            x, y, z = (np.ndarray((m,), "<u8", w, o, (1,)) for o in (0, 8, 16))
            h = x * np.uint64(0x9E3779B185EBCA87) + y * np.uint64(0xC2B2AE3D27D4EB4F) + z * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        width = 1
        while width * 2 <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
        ok = np.ones(b - a, bool)
        lo, hi = np.searchsorted(offsets, [a, b + LENGTH], side="left")
        for e in offsets[lo:hi].tolist():
            ok[max(0, e - LENGTH + 1 - a) : max(0, e - a)] = False
        fresh_run = ok.copy()
        fresh_run[1:] &= ~ok[:-1] | (h[1:] != h[:-1])
        start = np.flatnonzero(fresh_run)
        stops = np.flatnonzero(fresh_run | ~ok)
        after = np.searchsorted(stops, start, side="right")
        end = np.where(after < len(stops), stops[np.minimum(after, max(0, len(stops) - 1))], b - a) if len(stops) else start
        found.append((start + a, end - start, h[start]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    start, count, key = (np.concatenate(c) for c in zip(*found))
    with np.errstate(over="ignore"):  # least hashes crowd near zero; they are spread again, one to one
        key = (key ^ key >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(29)
    doc = np.searchsorted(offsets, start, side="right") - 1
    # Steps cut segments where they happen to end; joined again, segments don't depend on the order of documents.
    first = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + count[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(start) else start
    start, count, key, doc = start[first], np.add.reduceat(count, first) if len(first) else count, key[first], doc[first]
    pieces = -(-count // STARTS)  # a run of one letter is a single segment; cut evenly, it is one distinct piece and a rest
    k = spread(np.zeros(len(count), np.int64), pieces)
    start, count, key, doc = (np.repeat(c, pieces) for c in (start, count, key, doc))
    return start + k * STARTS, np.minimum(STARTS, count - k * STARTS), key, doc


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy()


def _texts(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    return offsets_of(pa.concat_arrays([c.cast(pa.large_binary()) for c in table.column(name).chunks]) if table.column(name).num_chunks else pa.array([], pa.large_binary()))


def _one_of(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


_KEYS = "shard long, g long, keys binary, several binary"
_CHOSEN = "g long, keys binary"
_SEGMENTS = "shard long, g long, keys binary, segments binary, sizes binary, owners binary"
_ANSWERS = "shard long, g long, keys binary, at binary, least binary"


def _send_keys(shards: int, order_by: str):
    def of_group(key: tuple, table: pa.Table) -> pa.Table:
        data, offsets = _texts(table, "text")
        _, _, k, doc = runs(data, offsets)
        ids = _ids(table.column(order_by))[doc]
        order = np.argsort(k, kind="stable")
        k, ids = k[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        several = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)).astype(np.uint8) if len(k) else np.zeros(0, np.uint8)
        k = k[first]
        shard = _shard(k, shards)
        cut = np.searchsorted(shard, np.arange(shards + 1))
        rows = [(s, key[0].as_py(), squeeze(k[a:b]), squeeze(several[a:b])) for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
        return _table(rows, _KEYS)

    return of_group


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds[t]) for i, (n, t) in enumerate(fields)})


def _rows(out: list[tuple], schema: str) -> pa.RecordBatch:
    return _table(out, schema).combine_chunks().to_batches()[0] if out else pa.RecordBatch.from_pylist([], _table([], schema).schema)


class _Spool:
    """Binary cells kept in a file, in the order in which they come."""

    def __init__(self):
        self.file, self.size, self.at = scratch_file(), 0, []

    def add(self, data: bytes) -> None:
        self.file.write(data)
        self.at.append((self.size, len(data)))
        self.size += len(data)

    def __iter__(self) -> Iterator[bytes]:
        self.file.flush()
        for at, n in self.at:
            self.file.seek(at)
            yield self.file.read(n)


def _choose(memory: int):
    """Minimizers of a shard that more than one document has, for each group that has them."""

    def of_shard(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, keys, several, sizes = [], _Spool(), _Spool(), []
        for b in batches:
            groups += b.column(b.schema.get_field_index("g")).to_pylist()
            for k, n in zip(b.column(b.schema.get_field_index("keys")), b.column(b.schema.get_field_index("several"))):
                keys.add(k.as_py())
                several.add(n.as_py())
                sizes.append(zstandard.frame_content_size(n.as_py()))
        store, first = induced_sort.Store(memory), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        total = int(first[-1])
        whole, flags = store.array(total, np.uint64), store.array(total, np.uint8)
        for a, k, n in zip(first.tolist(), keys, several):
            k, n = unsqueeze(k, np.uint64), unsqueeze(n, np.uint8)
            whole[a : a + len(k)], flags[a : a + len(k)] = k, n
        passes = max(1, math.ceil(total / PASS))
        low, high = min((int(whole[a]) for a in first[:-1]), default=0), max((int(whole[a - 1]) for a in first[1:]), default=0)
        edges = [low + (high + 1 - low) * i // passes for i in range(passes)]
        cuts = [[*np.searchsorted(whole[a:b], np.array(edges, np.uint64)).tolist(), b - a] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        for p in range(passes):
            spans = [(a + c[p], a + c[p + 1]) for a, c in zip(first.tolist(), cuts) if c[p + 1] > c[p]]
            if not spans:
                continue
            at = np.concatenate([np.arange(a, b) for a, b in spans])
            k = whole[at]
            order = np.argsort(k, kind="stable")
            k = k[order]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            n = np.diff(np.concatenate([head, [len(k)]]))
            hot = (n > 1) | (np.maximum.reduceat(flags[at][order], head) > 0)
            flags[at[order]] = np.repeat(hot, n)
        for g, a, b in zip(groups, first[:-1].tolist(), first[1:].tolist()):
            mine = whole[a:b][flags[a:b] > 0]
            if len(mine):
                yield _rows([(g, squeeze(np.array(mine)))], _CHOSEN)
        del whole, flags
        trim()

    return of_shard


def _chosen_runs(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
    start, count, key, doc = runs(data, offsets)
    keep = _one_of(key, known)
    return start[keep], count[keep], key[keep], doc[keep]


def _cut(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist())]


def _digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(n, 2): a digest of each data[start:stop]."""
    digest, view, out = xxhash.xxh3_128_digest, memoryview(data), np.empty((len(start), 2), np.uint64)
    for k in range(0, len(start), PASS >> 3):
        some = slice(k, k + (PASS >> 3))
        out[some] = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(start[some].tolist(), stop[some].tolist())]), np.uint64).reshape(-1, 2)
    return out


def _distinct(data: np.ndarray, offsets: np.ndarray, keys: pa.ChunkedArray, shards: int) -> tuple[np.ndarray, ...]:
    """Segments with these minimizers: (start, count, document, number) of each; and of the distinct ones, by number: (shard, a place among the segments, order of all segments by number, the first of each in it)."""
    known = np.sort(np.concatenate([unsqueeze(x.as_py(), np.uint64) for x in keys])) if len(keys) else np.zeros(0, np.uint64)
    start, count, key, doc = _chosen_runs(data, offsets, known)
    d, shard = _digests(data, start, start + count + LENGTH - 1), _shard(key, shards)
    order = np.lexsort((d[:, 1], d[:, 0], shard))
    s, d = shard[order], d[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1]).any(axis=1)]) if len(s) else np.zeros(0, bool)
    number = np.empty(len(s), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return start, count, doc, number, s[first], order[first], order, first


def _send_segments(shards: int, order_by: str):
    def of_group(key: tuple, docs: pa.Table, chosen: pa.Table) -> pa.Table:
        if not chosen.num_rows or not docs.num_rows:
            return _table([], _SEGMENTS)
        data, offsets = _texts(docs, "text")
        start, count, doc, _, shard, place, order, first = _distinct(data, offsets, chosen.column("keys"), shards)
        owners = np.minimum.reduceat(_ids(docs.column(order_by))[doc[order]], first) if len(first) else np.zeros(0, np.int64)
        sizes = (count[place] + LENGTH - 1).astype(np.int64)
        known = np.unique(np.concatenate([unsqueeze(x.as_py(), np.uint64) for x in chosen.column("keys")]))
        of_key = _shard(known, shards)
        packer, rows = zstandard.ZstdCompressor(level=3), []
        for s in np.unique(shard).tolist():
            a, b = np.searchsorted(shard, [s, s + 1]).tolist()
            mine = known[np.searchsorted(of_key, s) : np.searchsorted(of_key, s + 1)]
            segments = data[spread(start[place[a:b]], sizes[a:b])]
            rows.append((s, key[0].as_py(), squeeze(mine), packer.compress(segments.tobytes()), squeeze(sizes[a:b].astype(np.int32)), squeeze(owners[a:b])))
        out = _table(rows, _SEGMENTS)
        trim()
        return out

    return of_group


def _sorted_shard(memory: int, base: int):
    def of_shard(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spools = {c: _Spool() for c in ("keys", "segments", "sizes", "owners")}
        groups, first = [], [0]
        for b in batches:
            groups += b.column(b.schema.get_field_index("g")).to_pylist()
            for c, spool in spools.items():
                for x in b.column(b.schema.get_field_index(c)):
                    spool.add(x.as_py())
                    if c == "sizes":
                        first.append(first[-1] + zstandard.frame_content_size(x.as_py()) // 4)
        store, n = induced_sort.Store(memory), first[-1]
        size, owner, digest = store.array(n, np.int32), store.array(n, np.int64), store.array(2 * n, np.uint64)
        unpacker, plain = zstandard.ZstdDecompressor(), True
        for a, blob, s, o in zip(first, spools["segments"], spools["sizes"], spools["owners"]):
            blob, s = np.frombuffer(unpacker.decompress(blob), np.uint8), unsqueeze(s, np.int32)
            stop = np.cumsum(s, dtype=np.int64)
            size[a : a + len(s)], owner[a : a + len(s)] = s, unsqueeze(o, np.int64)
            digest[2 * a : 2 * (a + len(s))] = _digests(blob, stop - s, stop).reshape(-1)
            plain = plain and bool(blob.all())
        same = _representatives(digest, owner, store)
        store.free(digest)
        place, total = store.array(n, np.int64), 0
        for a, b in induced_sort.batches(n):
            own = np.where(same[a:b] == np.arange(a, b), size[a:b] + 1, 0).astype(np.int64)
            ends = total + np.cumsum(own)
            place[a:b] = ends - own
            total = int(ends[-1])
        text = store.array(total, np.uint8 if plain else np.uint16)
        starts = store.array(int(sum(np.count_nonzero(same[a:b] == np.arange(a, b)) for a, b in induced_sort.batches(n))), np.int64)
        owners, k = store.array(len(starts), np.int64), 0
        for a, b, blob in zip(first, first[1:], spools["segments"]):
            blob, s = np.frombuffer(unpacker.decompress(blob), np.uint8), size[a:b].astype(np.int64)
            mine = np.flatnonzero(same[a:b] == np.arange(a, b))
            begin = np.cumsum(s) - s
            symbols = blob[spread(begin[mine], s[mine])]
            text[spread(place[a:b][mine], s[mine])] = symbols if plain else symbols.astype(np.uint16) + 1
            starts[k : k + len(mine)], owners[k : k + len(mine)] = place[a:b][mine], owner[a:b][mine]
            k += len(mine)
        place_of = _places(starts, total, store)
        number, low = induced_sort.least_owners(text, LENGTH, lambda x: owners[place_of(x)], store, base)
        for g, a, b, keys in zip(groups, first, first[1:], spools["keys"]):
            count = size[a:b].astype(np.int64) - LENGTH + 1
            at, value, done = [], [], 0
            for i in range(0, b - a, PASS >> 6):
                some = slice(i, i + (PASS >> 6))
                v = low[number[spread(place[same[a:b][some]], count[some])]]
                new = np.flatnonzero(np.concatenate([[not value or value[-1][-1] != v[0]], v[1:] != v[:-1]]))
                if len(new):
                    at.append((new + done).astype(np.int64))
                    value.append(np.array(v[new]))
                done += len(v)
            yield _rows([(key[0].as_py(), g, keys, squeeze(np.concatenate(at)), squeeze(np.concatenate(value)))], _ANSWERS)
        del size, owner, same, place, text, starts, owners, number, low
        trim()

    return of_shard


def _places(starts: np.ndarray, total: int, store: induced_sort.Store) -> Callable[[np.ndarray], np.ndarray]:
    """The number of the last of the (distinct, sorted) starts that isn't behind a position, by a bit for each position and counts of them by word."""
    bits, before = store.array((total >> 6) + 1, np.uint64), store.array((total >> 6) + 1, np.int64)
    for a, b in induced_sort.batches(len(starts)):
        x = np.array(starts[a:b])
        word = x >> 6
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        bits[word[head]] |= np.bitwise_or.reduceat(np.uint64(1) << (x & 63).astype(np.uint64), head)
    done = 0
    for a, b in induced_sort.batches(len(bits)):
        sums = done + np.cumsum(np.bitwise_count(bits[a:b]), dtype=np.int64)
        before[a:b] = sums - np.bitwise_count(bits[a:b])
        done = int(sums[-1])

    def of(x: np.ndarray) -> np.ndarray:
        word = x >> 6
        return before[word] + np.bitwise_count(bits[word] << (63 - (x & 63)).astype(np.uint64)) - 1

    return of


def _representatives(digest: np.ndarray, owner: np.ndarray, store: induced_sort.Store) -> np.ndarray:
    """For each segment the first one with its digest, whose owner becomes the least of theirs. Digests are compared in passes over ranges of them."""
    n = len(owner)
    bits = max(0, math.ceil(math.log2(max(1, n / PASS))))
    same, by, counts = store.array(n, np.int64), store.array(n, np.int64), np.zeros(1 << bits, np.int64)
    of = lambda a, b: (digest[2 * a : 2 * b : 2] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(b - a, np.int64)
    for a, b in induced_sort.batches(n):
        counts += np.bincount(of(a, b), minlength=1 << bits)
    end = np.cumsum(counts) - counts
    for a, b in induced_sort.batches(n):
        r = of(a, b)
        order = np.argsort(r, kind="stable")
        u, m = np.unique(r, return_counts=True)
        by[spread(end[u], m)] = order + a
        end[u] += m
    for a, b in zip((end - counts).tolist(), end.tolist()):
        if b > a:
            i = np.array(by[a:b])
            x, y = digest[2 * i], digest[2 * i + 1]
            order = np.lexsort((i, y, x))
            i, x, y = i[order], x[order], y[order]
            head = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            same[i] = np.repeat(i[head], np.diff(np.concatenate([head, [len(i)]])))
            owner[i[head]] = np.minimum.reduceat(owner[i], head)
    store.free(by)
    return same


def _covered(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, answers: pa.Table, shards: int) -> np.ndarray:
    """Which bytes a string covers that has a smaller doc_id elsewhere."""
    hit = np.zeros(len(data) + 1, bool)
    if answers.num_rows:
        start, count, doc, number, shard, place, _, _ = _distinct(data, offsets, answers.column("keys"), shards)
        base = np.concatenate([[0], np.cumsum(count[place])])
        low = np.full(int(base[-1]), LAST)
        for s, at, least in zip(answers.column("shard").to_pylist(), answers.column("at"), answers.column("least")):
            a, b = base[np.searchsorted(shard, [s, s + 1])].tolist()
            at = unsqueeze(at.as_py(), np.int64)
            low[a:b] = np.repeat(unsqueeze(least.as_py(), np.int64), np.diff(np.concatenate([at, [b - a]])))
        for k in range(0, len(start), PASS >> 4):
            some = slice(k, k + (PASS >> 4))
            where = spread(start[some], count[some])
            hit[where[low[spread(base[number[some]], count[some])] < np.repeat(ids[doc[some]], count[some])]] = True
    out = np.zeros(len(data), bool)
    for a in range(0, len(data), STEP):
        before = max(0, a - LENGTH + 1)
        sums = np.concatenate([[0], np.cumsum(hit[before : a + STEP], dtype=np.int32)])
        i = np.arange(a, min(a + STEP, len(data)))
        out[a : a + STEP] = sums[i + 1 - before] > sums[np.maximum(i + 1 - LENGTH - before, 0)]
    return out


def _remove(shards: int, columns: list[str], names: list[str], order: str):
    def of_group(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets = _texts(docs, "text")
        gone = _covered(data, offsets, _ids(docs.column(order)), answers, shards) if docs.num_rows else np.zeros(0, bool)
        made: dict[str, list] = {n: [] for n in NAMES}
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            g = gone[a:b]
            removed = int(np.count_nonzero(g))
            kept = data[a:b][~g].tobytes() if removed else data[a:b].tobytes()
            made["n_bytes"].append(b - a)
            made["n_removed"].append(removed)
            made["n_spans"].append(int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if removed else 0)
            made["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if "kept_text" in names:
                made["kept_text"].append(kept.decode(errors="ignore"))
        out = {c: docs.column(c) for c in columns}
        table = pa.table(out | {n: pa.array(made[n], pa.string() if n.startswith("kept") else pa.int64()) for n in names})
        trim()
        return table

    return of_group


def _ranked(ids: DataFrame, name: str) -> DataFrame:
    """(name, rank) of the distinct ids that aren't null, in Spark's order: numbered within ranges, after the sizes of the ranges before."""
    sorted_ids = ids.select(F.col(name)).where(F.col(name).isNotNull()).distinct().repartitionByRange(name).sortWithinPartitions(name)
    at = settle(sorted_ids.withColumn("__at", F.monotonically_increasing_id()), "ids")
    sizes = at.groupBy(F.shiftright("__at", 33).alias("__range")).count().orderBy("__range").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["__range"], total))
        total += r["count"]
    starts = ids.sparkSession.createDataFrame(before, "__r long, __before long")
    return at.join(F.broadcast(starts), F.shiftright("__at", 33) == F.col("__r")).select(F.col(name), (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("__rank"))


def remove_repeats(docs: DataFrame, columns: list[str] | None = None, with_text: bool = True, group_bytes: int = GROUP_BYTES, shard_bytes: int = SHARD_BYTES, memory: int = induced_sort.MEMORY, base: int = induced_sort.BASE, most_shards: int = SHARDS) -> DataFrame:
    """The named columns of docs (all by default), and n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    Strings are judged on the input. kept_text is what is left, without the bytes of characters that a cut broke.
    """
    small_batches(docs.sparkSession)
    names = NAMES if with_text else NAMES[:-1]
    columns = [c for c in (docs.columns if columns is None else columns) if c.lower() not in NAMES]
    read = list(dict.fromkeys([*columns, "doc_id", "text"]))
    g, o = fresh(docs, "g"), "doc_id"
    rows = docs.select(*(f"`{c}`" for c in read))
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        o = fresh(docs, "o")
        ranks = _ranked(docs.select("doc_id"), "doc_id").withColumnRenamed("doc_id", "__own_id")
        rows = rows.join(ranks, F.col("doc_id") == F.col("__own_id"), "left").select(*(f"`{c}`" for c in read), F.col("__rank").alias(o))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, shards = max(1, math.ceil(size / group_bytes)), max(1, min(most_shards, math.ceil(size / shard_bytes)))
    # All steps of a group take the same columns, so that documents are dealt out once.
    dealt = rows.withColumn(g, F.pmod(F.xxhash64(o, "text"), F.lit(groups))).repartition(g)
    keys = dealt.groupBy(g).applyInArrow(_send_keys(shards, o), _KEYS)
    chosen = keys.groupBy("shard").applyInArrow(_choose(memory), _CHOSEN)
    segments = dealt.groupBy(g).cogroup(chosen.groupBy("g")).applyInArrow(_send_segments(shards, o), _SEGMENTS)
    answers = segments.groupBy("shard").applyInArrow(_sorted_shard(memory, base), _ANSWERS)
    kinds = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "kept_text": T.StringType()}
    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(n, kinds[n]) for n in names)])
    return dealt.groupBy(g).cogroup(answers.groupBy("g")).applyInArrow(_remove(shards, columns, names, o), schema)
