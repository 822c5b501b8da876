"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Each segment (the last padded with zeros) is a word of
the binary Golay code; with a bit that makes its weight even it lies at distance 0, 2 or 4 from the extended code, and
its nearest codewords (1, 1 or 6) are its keys. Two words that differ in at most 2 bits share a key. With at most 3
differing bits over the fingerprint, by the pigeonhole principle either one segment has none - then one of the other
two has at most one - or each segment has exactly one, and then one half of the last segment has none:

* exact segment t and a codeword of segment s, for the six ordered pairs (t, s): up to 36 keys;
* a codeword of segment 0, one of segment 1, and a half of segment 2: up to 72 keys.

So every pair within 3 bits shares a key, and no bucket is cut short. Distinct fingerprints (never documents) are dealt
by key; within a bucket all members are compared, in blocks, and only the edges of a spanning forest leave the task.
Components are then found over fingerprints: tasks put stars in place of their edges, and what is still too much for one
task goes through alternating large-star and small-star steps, each written to the shared folder. They are given back to
documents.

Near copies by similarity (near_copies, one_of_each) are groups of texts whose sets of `words`-word shingles have a
Jaccard similarity of `similarity` or more (five and 0.8 by default). At 0.8 some 15 % of SimHash bits differ, so a
wider fingerprint of six 23-bit segments is used: its keys are a codeword of each of two segments (15 pairs of segments,
28 keys each on average), and rows that meet are candidates if their other four segments differ in no more bits than
all but one in 200 pairs of that similarity do. Links are then verified on the whole texts:

* distinct shingle sets are nodes; buckets of up to 8 nodes give all candidate pairs, larger ones a spanning forest of
  theirs, so copies are never expanded into all pairs;
* of each node the pair with the smallest partner is verified;
* the pairs that still lie in different groups, and whole components of forests in which there are such pairs, make
  components that are compared all with all, in pairs of blocks of BLOCK_NODES, with the overlaps of whole shingle sets
  as matrix products; only links that join different groups leave a task. So a pair that is alike is never lost to the
  forest, and no more pairs than nodes are sent to be verified.

A pair of similarity 0.8 exactly meets in some bucket with probability 0.96 (0.85: 0.99, 0.9: 0.998).

Nulls and odd input: a null or wordless text has fingerprint zero and is linked like any other; a null doc_id takes
part and never becomes a component's id (a component of null ids only has a null id); repeated rows and ids stay as
they are; empty tables give empty tables; other columns aren't read. In near_copies a text of fewer words than a shingle
is one shingle, and texts without words are copies of each other. one_of_each keeps of each group the first row by
doc_id, then by a hash of the row; rows with a null doc_id can't be named as copies and all stay; rows that are equal in
every column count as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets
from .common import BROADCAST_ROWS, as_bytes, discard, hashable, settle, small_batches, trim, word_runs

# Bits of the segments, and the generator polynomial of the (23, 12) Golay code,
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
SEGMENT_BITS = (23, 23, 18)
GENERATOR = 0b110001110101
HASH_SEED = 42
MAX_BITS = 3
#: Distinct fingerprints of a task that makes keys.
KEY_ROWS = 20_000
# Odd constants that the hashes of a shingle's words are multiplied by (the fractional part of the golden
# ratio, and the mixing constants of the 64-bit finalizers in the literature).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Near copies: words of a shingle, similarity, segments of the wide fingerprint, and keys of a part.
WORDS, SIMILARITY = 5, 0.8
SEGMENTS = 6
PART_KEYS = 1 << 20
#: Nodes of a block that are compared all with all, and shared shingles counted at once.
BLOCK_NODES, OVERLAP_COLUMNS = 1024, 4096
#: Nodes whose keys are made at once.
NODES = 4096
#: Edges that one task joins.
STAR_EDGES = 1 << 17


def fingerprint(data: bytes, words_per_shingle: int = 3) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half the shingles' XXH64."""
    counts, n, carry = np.zeros(64, np.int64), 0, []
    xx, k = xxhash.xxh64_intdigest, words_per_shingle
    for run in word_runs(data.lower()):
        w = carry + run
        hashes = [xx(b" ".join(t), HASH_SEED) for t in zip(*(w[i:] for i in range(k)))]
        carry = w[-(k - 1) :] if len(w) >= k - 1 else w
        if hashes:
            counts += _bit_counts(np.array(hashes, np.uint64))
            n += len(hashes)
    if not n and carry:
        counts, n = _bit_counts(np.array([xx(b" ".join(carry), HASH_SEED)], np.uint64)), 1
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        total += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return total


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _golay() -> tuple[list[np.ndarray], np.ndarray]:
    """(remainders by byte, error patterns by remainder): up to 6 patterns of weight 0, 2 or 4 in the extended word, -1 where there are fewer."""
    by_byte = [np.array([_remainder(b << s) for b in range(1 << min(8, 23 - s))], np.uint32) for s in (0, 8, 16)]
    unit = [_remainder(1 << i) for i in range(23)] + [0]  # bit 23: the parity bit, outside the 23-bit word
    patterns: dict[int, list[int]] = {0: [0]}
    for weight in (2, 4):
        found: dict[int, list[int]] = {}
        for at in combinations(range(24), weight):
            s = p = 0
            for i in at:
                s ^= unit[i]
                p |= (1 << i) & 0x7FFFFF
            if s not in patterns:
                found.setdefault(s, []).append(p)
        patterns |= found
    out = np.full((2048, 6), -1, np.int64)
    for s, ps in patterns.items():
        out[s, : len(ps)] = ps
    return by_byte, out


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords near each 23-bit word: (n, 6), -1 where there are fewer."""
    by_byte, patterns = _golay()
    w = words.astype(np.int64)
    p = patterns[by_byte[0][w & 255] ^ by_byte[1][w >> 8 & 255] ^ by_byte[2][w >> 16]]
    return np.where(p < 0, -1, (w[:, None] ^ p) >> 11)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint's keys."""
    f = fps.astype(np.uint64)
    segs, shift = [], 0
    for b in SEGMENT_BITS:
        segs.append((f >> np.uint64(shift) & np.uint64((1 << b) - 1)).astype(np.int64))
        shift += b
    near = [codewords(s) for s in segs]
    rows, keys = [], []

    def put(family: int, codes: np.ndarray, ok: np.ndarray) -> None:
        r, c = np.nonzero(ok)
        rows.append(r)
        keys.append(family << 44 | codes[r, c])

    for n, (t, s) in enumerate((t, s) for t in range(3) for s in range(3) if s != t):
        put(n, segs[t][:, None] << 12 | near[s], near[s] >= 0)
    pairs = (near[0][:, :, None] << 12 | near[1][:, None, :]).reshape(len(f), 36)
    ok = ((near[0] >= 0)[:, :, None] & (near[1] >= 0)[:, None, :]).reshape(len(f), 36)
    for n, half in enumerate((segs[2] & 511, segs[2] >> 9)):
        put(6 + n, pairs << 9 | half[:, None], ok)
    return np.concatenate(rows), np.concatenate(keys)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(x) for x in as_bytes(b.column(1))), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 2000):
            rows, keys = keys_of(fps[i : i + 2000].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[i : i + 2000][rows])], ["key", "fp"])


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph of pairs within MAX_BITS, found breadth first and in blocks."""
    f = fps.view(np.uint64)
    left, right, rest = [], [], np.arange(len(f))
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            head, frontier = frontier[:256], frontier[256:]
            near = np.bitwise_count(f[head][:, None] ^ f[rest][None, :]) <= MAX_BITS
            hit = near.any(axis=0)
            if hit.any():
                new = rest[hit]
                left.append(head[near[:, hit].argmax(axis=0)])
                right.append(new)
                frontier = np.concatenate([frontier, new])
                rest = rest[~hit]
    if not left:
        return fps[:0], fps[:0]
    return fps[np.concatenate(left)], fps[np.concatenate(right)]


def _verify(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """(n, 2) verified edges of whole buckets; keys are sorted."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    first = np.concatenate([[0], cut])
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    out = []
    small = np.repeat(sizes, sizes) <= 8
    for step in range(1, 8):
        i = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:])) if len(keys) > step else np.zeros(0, int)
        if not len(i):
            break
        a, b = fps[i], fps[i + step]
        ok = np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS
        out.append(np.stack([a[ok], b[ok]], axis=1))
    for at, n in zip(first[sizes > 8], sizes[sizes > 8]):
        out.append(np.stack(_forest(fps[at : at + n]), axis=1))
    e = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return np.unique(np.sort(e, axis=1), axis=0)


def _edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last bucket of a batch waits for the next one."""
    keys, fps = [], []

    def flush(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        e = _verify(k, f) if len(k) > 1 else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    for b in batches:
        k, f = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        keys.append(k)
        fps.append(f)
        if k[0] == k[-1] and keys[0][0] == k[0]:
            continue
        k, f = np.concatenate(keys), np.concatenate(fps)
        end = int(np.searchsorted(k, k[-1]))
        keys, fps = [k[end:]], [f[end:]]
        if end:
            yield flush(k[:end], f[:end])
    if keys:
        yield flush(np.concatenate(keys), np.concatenate(fps))


def links(distinct_fps: DataFrame, tasks: int = 0) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all pairs of fingerprints within 3 bits; keys are made in `tasks` tasks, if given."""
    dealt = distinct_fps.select("fp").repartition(tasks, "fp") if tasks else distinct_fps.select("fp")
    keyed = dealt.mapInArrow(_key_batches, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_edge_batches, "a long, b long").distinct()


def _star_edges(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """(node, least node of its component among these edges) of each node that isn't the least."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(at[: len(left)].tolist(), at[len(left) :].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    top = np.array(root, np.int64)
    while (top != (up := top[top])).any():
        top = up
    other = np.flatnonzero(top != np.arange(len(top)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[top[other]])], ["a", "b"])


def _stars(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of the edges of a task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in it]
    if held:
        yield _star_edges(*(np.concatenate(c) for c in zip(*held)))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches, where that is another.

    Tasks put stars in place of STAR_EDGES edges each, as long as that halves them; what fits one task is then joined
    there, more by alternating large-star and small-star steps.
    """
    now = settle(edges.select("a", "b").where("a <> b"), "edges")
    n = now.count()
    while n > STAR_EDGES:
        before, most = now, n // 2
        now = settle(before.repartition(math.ceil(n / STAR_EDGES)).mapInArrow(_stars, "a long, b long").distinct(), "edges")
        discard(before)
        n = now.count()
        if n > most:
            break
    if n <= STAR_EDGES:
        out = settle(now.coalesce(1).mapInArrow(_stars, "a long, b long"), "roots")
        discard(now)
        return out.select(F.col("a").alias("node"), F.col("b").alias("root"))
    was = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, now = now, settle(small, "edges")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == was:
            break
        was = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and component_id (the smallest doc_id of the component) of each row."""
    small_batches(docs.sparkSession)
    fps = settle(docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema), "fps")
    nodes = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    roots = connected(links(nodes, max(1, math.ceil(nodes.count() / KEY_ROWS))))
    member = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(ids, "root").select(F.col("fp").alias("n_fp"), "component_id")
    return fps.join(named, fps["fp"] == named["n_fp"], "left").select("doc_id", "fp", "component_id")


# Near copies by similarity.


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(MIX[5])
    h = (h ^ h >> np.uint64(29)) * np.uint64(MIX[6])
    return h ^ h >> np.uint64(32)


def shingles(data: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of that many words (A-Z lower-cased); of the whole sequence, if it is shorter."""
    found, carry, n = [], np.zeros(0, np.uint64), 0
    scale = np.array([MIX[k % len(MIX)] + 2 * k for k in range(words)], np.uint64)
    with np.errstate(over="ignore"):
        for run in word_runs(data.lower()):
            w = np.concatenate([carry, np.fromiter(map(xxhash.xxh64_intdigest, run), np.uint64, len(run))])
            m = len(w) - words + 1
            if m > 0:
                h = w[:m] * scale[0]
                for k in range(1, words):
                    h += w[k : k + m] * scale[k]
                found.append(np.unique(_mixed(h)))
                n += m
            carry = w[max(0, m) :]
        if not n and len(carry):
            found.append(_mixed(np.array([(carry * scale[: len(carry)]).sum(dtype=np.uint64) + np.uint64(len(carry))], np.uint64)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SEGMENTS words of 23 bits: a bit is set if it is set in over half of the (mixed) hashes."""
    with np.errstate(over="ignore"):
        counts = np.concatenate([_bit_counts(h if not k else _mixed(h + np.uint64(MIX[k]))) for k in range(3)])
    bits = (counts * 2 > len(h))[: 23 * SEGMENTS].reshape(SEGMENTS, 23)
    return bits @ (1 << np.arange(23))


def candidate_limit(similarity: float) -> int:
    """Bits of four segments that all but one in 200 pairs of that similarity differ in at most."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    n = 23 * (SEGMENTS - 2)
    return math.ceil(n * p + 2.58 * math.sqrt(n * p * (1 - p)))


_FACTS = "row_hash long, set_high long, set_low long, " + ", ".join(f"s{k} int" for k in range(SEGMENTS))


def _fact_batches(words: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            facts, sets = np.zeros((b.num_rows, SEGMENTS), np.int32), np.zeros((b.num_rows, 2), np.int64)
            for i, x in enumerate(as_bytes(b.column(1))):
                h = shingles(x, words)
                facts[i] = wide_fingerprint(h)
                sets[i] = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
            cols = [b.column(0), b.column(2), *(pa.array(sets[:, k]) for k in (0, 1)), *(pa.array(facts[:, k]) for k in range(SEGMENTS))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f.split()[0] for f in _FACTS.split(", "))])
        trim()

    return batches


_PAIRS = list(combinations(range(SEGMENTS), 2))


def _node_keys(parts: int):
    """Rows: node, segments. Each pair of segments has parts of its own."""

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in it:
            held.append(b)
            if sum(h.num_rows for h in held) >= NODES:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(it):
            for at in range(0, table.num_rows, NODES):
                b = table.slice(at, NODES)
                node, *segs = (c.to_numpy().astype(np.int64) for c in b.columns)
                near = [codewords(s) for s in segs]
                for family, (s, t) in enumerate(_PAIRS):
                    code = (near[s][:, :, None] << 12 | near[t][:, None, :]).reshape(len(node), -1)
                    ok = ((near[s] >= 0)[:, :, None] & (near[t] >= 0)[:, None, :]).reshape(len(node), -1)
                    r, c = np.nonzero(ok)
                    code = code[r, c]
                    part = (code * 0x9E3779B1 >> 8) % parts + family * parts
                    order = np.argsort(part << 24 | code)
                    r, code, part = r[order], code[order], part[order]
                    u, v, x, y = (segs[k] for k in range(SEGMENTS) if k not in (s, t))
                    low, high = (u | v << 23 | (x & 0x3FFFF) << 46).astype(np.uint64), (x >> 18 | y << 5).astype(np.uint32)
                    yield buckets.cut(part, [code.astype(np.uint32), node[r], low[r], high[r]])

    return batches


_CANDIDATES = "a long, b long, root long, part long"
_CANDIDATE_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _CANDIDATES.split(", ")])


def _candidates(limit: int):
    """Pairs of nodes of a part: a < b, and the component of the part's forest that they are from (-1: of a small bucket).

    Trees of buckets that share nodes are one tree of the part, so that a group costs an edge a node, in however many buckets it meets.
    """

    def of_part(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, node, low, high = buckets.gathered(batches, [np.uint32, np.int64, np.uint64, np.uint32])
        order = np.lexsort((node, code))
        code, node, low, high = code[order], node[order], low[order], high[order]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        root: dict[int, int] = {}
        tree: list[tuple[int, int]] = []

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def made(e: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(e[:, k]) for k in range(3)), pa.array(np.full(len(e), key[0].as_py()))], schema=_CANDIDATE_ARROW)

        def small() -> pa.RecordBatch:
            i, j = (np.concatenate(c) for c in zip(*held))
            return made(np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.full(len(i), -1)], axis=1), axis=0))

        for i, j, own in buckets.forest(code, [low, high], limit):
            if len(own) and own[0] >= 0:
                for x, y in zip(node[i].tolist(), node[j].tolist()):
                    p, q = top(x), top(y)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        tree.append((min(x, y), max(x, y)))
                continue
            held.append((i, j))
            if sum(len(h[0]) for h in held) > buckets.BLOCK:
                yield small()
                held = []
        if held:
            yield small()
        for k in range(0, len(tree), buckets.BLOCK):
            yield made(np.array([(x, y, top(x)) for x, y in tree[k : k + buckets.BLOCK]], np.int64))
        trim()

    return of_part


def _candidate_pairs(nodes: DataFrame, n: int, limit: int) -> DataFrame:
    """nodes: node, segments; n: how many there are."""
    parts = max(1, math.ceil(n * 28.4 / PART_KEYS))
    dealt = nodes.select("node", *(f"s{k}" for k in range(SEGMENTS))).repartition(max(1, math.ceil(n / KEY_ROWS)), "node")
    return dealt.mapInArrow(_node_keys(parts), buckets.schema(4)).groupBy("part").applyInArrow(_candidates(limit), _CANDIDATES)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right): how many hashes each pair of sets shares."""
    out = np.zeros((len(left), len(right)), np.float32)
    x, y = (np.concatenate([np.zeros(0, np.uint64), *sets]) for sets in (left, right))
    both = np.intersect1d(x, y)
    of_x, of_y = (np.repeat(np.arange(len(sets)), [len(h) for h in sets]) for sets in (left, right))
    at_x, at_y = np.searchsorted(both, x), np.searchsorted(both, y)
    in_x, in_y = ((at < len(both)) & (both[np.minimum(at, len(both) - 1)] == h) if len(both) else np.zeros(len(h), bool) for at, h in ((at_x, x), (at_y, y)))
    for k in range(0, len(both), OVERLAP_COLUMNS):
        cells = []
        for sets, at, of, inside in ((left, at_x, of_x, in_x), (right, at_y, of_y, in_y)):
            m = np.zeros((len(sets), min(OVERLAP_COLUMNS, len(both) - k)), np.float32)
            some = inside & (at >= k) & (at < k + OVERLAP_COLUMNS)
            m[of[some], at[some] - k] = 1
            cells.append(m)
        out += cells[0] @ cells[1].T
    return out


def _block_links(words: int, similarity: float):
    """Rows: comp, low and high block, own block, node, tag, text. Links between different tags that join these, in a pair of blocks."""

    def of_pair(key: tuple, table: pa.Table) -> pa.Table:
        node, tag, own = (table.column(c).to_numpy() for c in ("node", "tag", "own"))
        sets = [shingles(x, words) for x in as_bytes(table.column("text").combine_chunks())]
        low, high = key[1].as_py(), key[2].as_py()
        i, j = (np.flatnonzero(own == k) for k in (low, high))
        size = np.array([len(h) for h in sets])
        both = overlaps([sets[k] for k in i], [sets[k] for k in j])
        near = (both >= similarity * (size[i][:, None] + size[j][None, :] - both)) & (tag[i][:, None] != tag[j][None, :])
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for x, y in np.argwhere(near).tolist():
            p, q = top(int(tag[i[x]])), top(int(tag[j[y]]))
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(node[i[x]]), int(node[j[y]])))
        trim()
        return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate("ab")})

    return of_pair


def _joined_blocks(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """members: comp, node, tag. Links between nodes of a component that have different tags, enough to join what is linked."""
    sizes = members.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK_NODES).alias("blocks")).withColumnRenamed("comp", "z_comp")
    cut = members.join(sizes, F.col("comp") == F.col("z_comp")).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = pairs.select("comp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", F.col("node").alias("m_node"), "tag")
    full = rows.join(texts, F.col("m_node") == texts["node"]).select("comp", "low", "high", "own", "node", "tag", "text")
    return settle(full.groupBy("comp", "low", "high").applyInArrow(_block_links(words, similarity), "a long, b long"), "joined")


def _jaccard(words: int, similarity: float):
    """Rows: a, b, text of a, text of b; which pairs are similar enough."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in it:
            out = []
            for a, x, y in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                if known[0] != a:
                    known = a, shingles(x, words)
                h = shingles(y, words)
                both = len(np.intersect1d(known[1], h, assume_unique=True))
                out.append(both >= similarity * (len(h) + len(known[1]) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["a", "b", "near"])
        trim()

    return batches


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b, near) of pairs of nodes, by their whole texts."""
    x, y = (texts.select(F.col("node").alias(f"{n}_node"), F.col("text").alias(f"{n}_text")) for n in "xy")
    met = pairs.join(x, pairs["a"] == x["x_node"]).join(y, pairs["b"] == y["y_node"]).select("a", "b", "x_text", "y_text")
    return settle(met.mapInArrow(_jaccard(words, similarity), "a long, b long, near boolean"), "verified")


def _members(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct nodes of a part's pairs."""
    node = np.unique(np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy() for b in batches for c in "ab"]))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), key[0].as_py())), pa.array(node)], ["part", "node"])


def _torn(key: tuple, pairs: pa.Table, tops: pa.Table) -> pa.Table:
    """A part's pairs and the roots of its nodes. Stars in place of the trees that join what isn't alike, and of the pairs outside trees that do."""
    a, b, tree = (pairs.column(c).to_numpy() for c in ("a", "b", "root"))
    node, top = (tops.column(c).to_numpy() for c in ("node", "top"))
    order = np.argsort(node)
    x, y = (top[order[np.searchsorted(node, ends, sorter=order)]] for ends in (a, b))
    apart = x != y
    keep = np.where(tree < 0, apart, np.isin(tree, np.unique(tree[apart])))
    out = pa.Table.from_batches([_star_edges(a[keep], b[keep])])
    trim()
    return out


def _facts(docs: DataFrame, words: int) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64(*hashable(docs)).alias("row_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return settle(rows.mapInArrow(_fact_batches(words), f"doc_id {kind}, {_FACTS}"), "facts")


def _grouped(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(facts of each row with their node, roots of the nodes that have copies)."""
    facts, limit = _facts(docs, words), candidate_limit(similarity)
    own = F.min(F.struct("doc_id", "row_hash")).alias("own")
    nodes = settle(facts.groupBy("set_high", "set_low").agg(*(F.min(f"s{k}").alias(f"s{k}") for k in range(SEGMENTS)), own).withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = facts.join(nodes.select("set_high", "set_low", "node"), ["set_high", "set_low"])
    pairs = settle(_candidate_pairs(nodes, nodes.count(), limit).distinct(), "candidates")
    edges = pairs.select("a", "b").distinct()
    if pairs.isEmpty():
        return rows, pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    met = edges.select(F.explode(F.array("a", "b")).alias("m_node")).distinct()
    wanted = settle(nodes.join(met, nodes["node"] == met["m_node"], "left_semi").select("node", F.col("own.doc_id").alias("w_id"), F.col("own.row_hash").alias("w_hash")), "wanted")
    few = wanted.count() <= BROADCAST_ROWS  # else texts are shuffled
    keyed = docs.select("doc_id", "text", F.xxhash64(*hashable(docs)).alias("row_hash"))
    same = (F.col("row_hash") == F.col("w_hash")) & F.col("doc_id").eqNullSafe(F.col("w_id"))
    texts = settle(keyed.join(F.broadcast(wanted) if few else wanted, same).select("node", "text").dropDuplicates(["node"]), "texts")
    first = _verified(edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, words, similarity)
    links = first.where("near").select("a", "b")
    roots = connected(links)
    named = pairs.groupBy("part").applyInArrow(_members, "part long, node long")
    tops = named.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("part", "node", F.coalesce("root", "node").alias("top"))
    whole = settle(pairs.groupBy("part").cogroup(tops.groupBy("part")).applyInArrow(_torn, "a long, b long"), "torn")
    if not whole.isEmpty():
        again = connected(whole)
        own = again.select(F.col("node").alias("o_node"), F.col("root").alias("comp")).unionByName(again.select(F.col("root").alias("o_node"), F.col("root").alias("comp")).distinct())
        tagged = own.join(roots.select(F.col("node").alias("t_node"), F.col("root").alias("t_root")), F.col("o_node") == F.col("t_node"), "left")
        members = tagged.select("comp", F.col("o_node").alias("node"), F.coalesce("t_root", "o_node").alias("tag"))
        third = _joined_blocks(members, texts, words, similarity)
        if not third.isEmpty():
            roots = connected(links.union(third))
    return rows, roots


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, row_hash and copy_of (the smallest doc_id of the group of near copies) of each row."""
    rows, roots = _grouped(docs, words, similarity)
    named = rows.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").withColumn("group", F.coalesce("root", "node"))
    ids = named.groupBy("group").agg(F.min("doc_id").alias("copy_of"))
    return named.join(ids, "group").select("doc_id", "row_hash", "copy_of")


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows that stay: of each group of near copies the first by (doc_id, hash of the row), and all with a null id."""
    rows, roots = _grouped(docs, words, similarity)
    named = rows.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").withColumn("group", F.coalesce("root", "node"))
    own = F.struct("doc_id", "row_hash")
    first = named.where("doc_id IS NOT NULL").groupBy("group").agg(F.min(own).alias("own"))
    kept = settle(first.select(F.col("own.doc_id").alias("k_id"), F.col("own.row_hash").alias("k_hash")).distinct(), "kept")
    row_hash = F.xxhash64(*hashable(docs))
    stay = docs.join(kept, (docs["doc_id"] == kept["k_id"]) & (row_hash == kept["k_hash"]), "left_semi")
    repeated = rows.groupBy("doc_id", "row_hash").count().where("count > 1").join(kept, (F.col("doc_id") == F.col("k_id")) & (F.col("row_hash") == F.col("k_hash")), "left_semi")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates([c.strip("`") for c in hashable(docs)])
    return stay.unionByName(docs.where("doc_id IS NULL"))
