"""Copies among images by local descriptors.

1. Images (binary PGM, PPM or 8-bit PNG; JPEG isn't decoded) become grey values. Images are read once, in one pass that
   also takes digests; of images with equal bytes one counts from then on.
2. Corners: local maxima of the Harris measure on a pyramid of SCALES that pass a share of the strongest, at least GAP
   pixels apart on their scale, so that their number grows with the area.
3. Each corner gets an orientation (direction of its patch's centre of mass) and BITS binary tests between smoothed
   points of the patch, turned by the orientation, so that descriptors bear turning, scaling, brightness and contrast.
4. Hamming tables: TABLES words of WORD_BITS bits are the keys of a descriptor; two descriptors that share a word and
   differ in at most MAX_BITS bits match. Rows are dealt by word in compressed columns. Small buckets give all their
   matches, large ones the edges of a spanning forest, so a picture with thousands of copies isn't matched with each
   copy of each.
5. Geometric consensus: the matches of two images each propose a similarity transform; a pair is a link if INLIERS
   matches agree with one within TOLERANCE pixels, and with its turn and scale.
6. Links make classes (connected components).
7. Where a forest joins descriptors of different classes, all matches between different classes of that bucket are
   made, added to those of step 4, and steps 5 and 6 are done again for pairs of images of different classes. So
   classes are those of all matches.

Nulls and odd input: a null or undecodable image, or one without corners, has no links and is its own class (with equal
ones, if it has bytes at all); so is one of more than MAX_PIXELS. Null ids take part, and a class of null ids only has a
null id. Rows are neither merged nor lost. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets
from .common import settle, small_batches, squeeze, trim, unsqueeze
from .simhash import connected

SCALES = (1.0, 0.8, 0.64)
RADIUS = 17
GAP = 6
BITS, TABLES, WORD_BITS = 128, 6, 21
MAX_BITS = 20
INLIERS = 6
TOLERANCE = 4.0
#: Largest deviations of a match's turn (radians) and scale (factor) from those of the transform.
TURN, GROWTH = 0.45, 1.35
MAX_PIXELS = 1 << 27
#: Rows of a part of the words.
PART_ROWS = 1 << 20
SEED = 29
#: Digests that a task remembers.
SEEN = 1 << 18
#: Corners described at a time.
STEP = 2048


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM, PPM or 8-bit, non-interlaced PNG of at most MAX_PIXELS, else None."""
    if not data:
        return None
    try:
        return _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else _netpbm(data)
    except (ValueError, IndexError, zlib.error):
        return None


def _grey(a: np.ndarray) -> np.ndarray:
    return a[..., :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32) if a.shape[2] >= 3 else a[..., 0].astype(np.float32)


def _netpbm(data: bytes) -> np.ndarray | None:
    if data[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    depth = 3 if data[:2] == b"P6" else 1
    if not 0 < top <= 255 or not 0 < w * h <= MAX_PIXELS:
        return None
    return _grey(np.frombuffer(data, np.uint8, w * h * depth, at + 1).reshape(h, w, depth)) * (255.0 / top)


def _png(data: bytes) -> np.ndarray | None:
    at, body, head = 8, b"", b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        head, body = (part if kind == b"IHDR" else head), body + part if kind == b"IDAT" else body
        at += n + 12
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[9])
    if head[8] != 8 or depth is None or head[12] or not 0 < w * h <= MAX_PIXELS:
        return None
    raw = np.frombuffer(zlib.decompressobj().decompress(body, h * (w * depth + 1)), np.uint8).reshape(h, w * depth + 1)
    out = np.zeros((h, w * depth), np.uint8)
    for y in range(h):
        line, up = raw[y, 1:].astype(np.int64), (out[y - 1] if y else np.zeros(w * depth, np.uint8)).astype(np.int64)
        how = raw[y, 0]
        if how == 0:
            out[y] = line
        elif how == 2:
            out[y] = (line + up) & 255
        else:
            for i in range(w * depth):
                left = int(out[y, i - depth]) if i >= depth else 0
                corner = int(up[i - depth]) if i >= depth else 0
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + int(up[i])) // 2
                else:
                    p = left + int(up[i]) - corner
                    guess = min((left, int(up[i]), corner), key=lambda v: abs(p - v))
                out[y, i] = (line[i] + guess) & 255
    return _grey(out.reshape(h, w, depth))


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of 2r + 1, edges repeated."""
    p = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0, dtype=np.float64).cumsum(1)
    k = 2 * r + 1
    return ((p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)).astype(np.float32)


def _resize(a: np.ndarray, s: float) -> np.ndarray:
    h, w = max(1, round(a.shape[0] * s)), max(1, round(a.shape[1] * s))
    y = np.clip((np.arange(h) + 0.5) / s - 0.5, 0, a.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) / s - 0.5, 0, a.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0)[None, :].astype(np.float32)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


_RNG = np.random.default_rng(SEED)
_TESTS = np.clip(_RNG.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
_YX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_YX**2).sum(0) <= RADIUS**2


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    """Greatest value within squares of 2r + 1."""
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        n, width = a.shape[axis], 1
        while width * 2 <= 2 * r + 1:
            p = np.maximum(np.take(p, range(p.shape[axis] - width), axis), np.take(p, range(width, p.shape[axis]), axis))
            width *= 2
        rest = 2 * r + 1 - width
        a = np.maximum(np.take(p, range(n), axis), np.take(p, range(rest, n + rest), axis))
    return a


def _turned(a: np.ndarray, smooth: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angle, descriptor) of the corners at y, x."""
    patch = a[y[:, None, None] + _YX[0], x[:, None, None] + _YX[1]] * _DISC
    angle = np.arctan2((patch * _YX[0]).sum((1, 2)), (patch * _YX[1]).sum((1, 2)))
    c, n = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    px = x[:, None, None] + c * _TESTS[None, :, :, 0] - n * _TESTS[None, :, :, 1]
    py = y[:, None, None] + n * _TESTS[None, :, :, 0] + c * _TESTS[None, :, :, 1]
    v = smooth[np.rint(py).astype(int), np.rint(px).astype(int)]
    return angle, np.packbits(v[:, :, 0] < v[:, :, 1], axis=1)


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keypoints: x, y, scale, angle in the image's own pixels; descriptors: (n, BITS / 8) bytes)."""
    points, bits, strength = [], [], []
    for s in SCALES:
        a = image if s == 1 else _resize(_box(image, 1), s)
        if min(a.shape) < 2 * RADIUS + 5:
            break
        gy, gx = np.gradient(_box(a, 1))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        m = RADIUS + 1
        core = r[m:-m, m:-m]
        best = core > max(1e-3, 0.005 * float(r.max()))
        best &= core >= _highest(r, GAP)[m:-m, m:-m]
        y, x = np.nonzero(best)
        if not len(y):
            continue
        strength.append(core[y, x])
        y, x = y + m, x + m
        smooth = _box(a, 2)
        for k in range(0, len(y), STEP):
            angle, d = _turned(a, smooth, y[k : k + STEP], x[k : k + STEP])
            bits.append(d)
            points.append(np.stack([x[k : k + STEP] / s, y[k : k + STEP] / s, np.full(len(angle), 1 / s), angle], axis=1))
    if not points:
        return np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    top = np.argsort(-np.concatenate(strength), kind="stable")
    return np.concatenate(points)[top], np.concatenate(bits)[top]


def pack_places(points: np.ndarray) -> np.ndarray:
    """x and y in eighths of a pixel (20 bits each), the scale's number (4) and the angle (12) in one long."""
    xy = np.clip(np.rint(points[:, :2] * 8), 0, (1 << 20) - 1).astype(np.int64)
    scale = np.argmin(np.abs(1 / points[:, 2:3] - np.array(SCALES)), axis=1)
    angle = np.rint((points[:, 3] + np.pi) / (2 * np.pi) * 4096).astype(np.int64) & 4095
    return xy[:, 0] << 36 | xy[:, 1] << 16 | scale << 12 | angle


def unpack_places(packed: np.ndarray) -> np.ndarray:
    x, y = packed >> 36, packed >> 16 & (1 << 20) - 1
    return np.stack([x / 8, y / 8, 1 / np.array(SCALES)[packed >> 12 & 15], (packed & 4095) / 4096 * 2 * np.pi - np.pi], axis=1)


_SEEN = "digest binary, points binary, low binary, high binary"


def _described(kind: str):
    """Rows: id, image. A row for each: id, digest of the bytes, and its corners, if the task hasn't described the same bytes before."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in it:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                rows = []
                for data in b.column(1):
                    data = data.as_py()
                    digest = None if data is None else hashlib.sha256(data).digest()
                    corners = (None, None, None)
                    if digest is not None and digest not in seen:
                        seen.add(digest)
                        if len(seen) > SEEN:
                            seen = {digest}
                        a = decode(data)
                        p, d = describe(a) if a is not None else (np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8))
                        halves = np.ascontiguousarray(d).view("<u8").reshape(-1, 2)
                        corners = squeeze(pack_places(p)), squeeze(np.ascontiguousarray(halves[:, 0])), squeeze(np.ascontiguousarray(halves[:, 1]))
                    rows.append((digest, *corners))
                cols = [pa.array([r[k] for r in rows], pa.binary()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *(f.split()[0] for f in _SEEN.split(", "))])
        trim()

    return batches


def words_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(tables, rows): the words of descriptors."""
    bits = np.unpackbits(np.stack([low, high], axis=1).view(np.uint8).reshape(len(low), 16), axis=1, bitorder="little")[:, : TABLES * WORD_BITS]
    return (bits.reshape(len(low), TABLES, WORD_BITS) @ (1 << np.arange(WORD_BITS, dtype=np.int64))).T


def _word_rows(parts: int):
    """Rows: number, points, low, high. The rows of each table by part: word, image, place, descriptor."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                place, low, high = ([unsqueeze(x.as_py(), k) for x in b.column(c)] for c, k in ((1, np.int64), (2, np.uint64), (3, np.uint64)))
                image = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in place])
                place, low, high = (np.concatenate(x) for x in (place, low, high))
                for t, word in enumerate(words_of(low, high)):
                    part = (word * 0x9E3779B1 >> 8) % parts + t * parts
                    order = np.argsort(part << 21 | word, kind="stable")
                    yield buckets.cut(part[order], [word[order].astype(np.uint32), image[order], place[order], low[order], high[order]])

    return batches


_MATCHES = "a long, b long, a_place long, b_place long, tree long"
_MATCH_ARROW = pa.schema([(f.split()[0], pa.int64()) for f in _MATCHES.split(", ")])


def _pair_rows(i: np.ndarray, j: np.ndarray, image: np.ndarray, place: np.ndarray, tree: np.ndarray) -> pa.RecordBatch:
    swap = image[i] > image[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    rows = np.unique(np.stack([image[i], image[j], place[i], place[j], tree], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(5)], schema=_MATCH_ARROW)


def _matches(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of a part of the words. tree: -1 in small buckets; else the part and first row of a forest's component, of which also edges within an image are given."""
    word, image, place, low, high = buckets.gathered(batches, [np.uint32, np.int64, np.int64, np.uint64, np.uint64])
    order = np.lexsort((place, image, word))
    word, image, place, low, high = (c[order] for c in (word, image, place, low, high))
    held: list[tuple[np.ndarray, ...]] = []

    def made() -> pa.RecordBatch:
        i, j, tree = (np.concatenate(c) for c in zip(*held))
        return _pair_rows(i, j, image, place, tree)

    for i, j, root in buckets.forest(word, [low, high], MAX_BITS):
        keep = (root >= 0) | (image[i] != image[j])
        held.append((i[keep], j[keep], np.where(root[keep] >= 0, key[0].as_py() << 32 | root[keep], -1)))
        if sum(len(h[0]) for h in held) > buckets.BLOCK or len(held) > 4096:
            yield made()
            held = []
    if held:
        yield made()
    trim()


def _tree_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: tree, image, class, place, low, high; as columns of parts."""
    for b in batches:
        tree, *cols = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        part = (tree >> 32) * 31 + (tree & 0xFFFFFFFF) % 31
        order = np.argsort(part, kind="stable")
        yield buckets.cut(part[order], [c[order].astype(np.int64) for c in (tree, *cols)])


def _cross_matches(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches between different classes within each tree."""
    tree, image, own, place, low, high = buckets.gathered(batches, [np.int64] * 6)
    order = np.lexsort((place, image, tree))
    tree, image, own, place, low, high = (c[order] for c in (tree, image, own, place, low, high))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def made() -> pa.RecordBatch:
        i, j = (np.concatenate(c) for c in zip(*held))
        return _pair_rows(i, j, image, place, np.full(len(i), -1))

    for i, j in buckets.cross_pairs(tree, [low.view(np.uint64), high.view(np.uint64)], MAX_BITS, own):
        held.append((i, j))
        if sum(len(h[0]) for h in held) > buckets.BLOCK or len(held) > 4096:
            yield made()
            held = []
    if held:
        yield made()
    trim()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows that are equal in the first `keys` columns, many at a time; rows come sorted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(k)[b.num_rows - 1].as_py() for k in range(keys)]
        same = np.ones(b.num_rows, bool)
        for k in range(keys):
            same &= b.column(k).to_numpy(zero_copy_only=False) == last[k]
        end = int(np.argmax(same))
        if end:
            yield pa.Table.from_batches([*held, b.slice(0, end)])
            held = []
        elif held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != last[k] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(end))
    if held:
        yield pa.Table.from_batches(held)


def consensus(p: np.ndarray, q: np.ndarray, enough: int | None = None) -> int:
    """Most matches p[i] to q[i] (x, y, scale, angle) that one of their similarity transforms explains - the place, and the match's own turn and scale -, each place of either image once. Or, if given, the first number found that is `enough`."""
    most, growth, turn = 0, np.log(q[:, 2] / p[:, 2]), np.exp(1j * (q[:, 3] - p[:, 3]))
    at, to = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    cells = [np.rint(z[:, 0] / TOLERANCE) * (1 << 20) + np.rint(z[:, 1] / TOLERANCE) for z in (p, q)]
    for k in range(0, len(p), 64):
        i = np.arange(k, min(len(p), k + 64))[:, None]
        off = np.abs((at - at[i]) * np.exp(growth[i]) * turn[i] - (to - to[i]))
        ok = (off <= TOLERANCE * np.maximum(1.0, np.exp(growth[i]))) & ((turn / turn[i]).real >= np.cos(TURN)) & (np.abs(growth - growth[i]) <= np.log(GROWTH))
        number = ok.sum(axis=1)
        for h in np.argsort(-number, kind="stable").tolist():
            if number[h] <= most:
                break
            most = max(most, min(len(np.unique(c[ok[h]])) for c in cells))
            if enough is not None and most >= enough:
                return most
    return most


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, 2):
        a, b, p, q = (t.column(c).to_numpy() for c in t.column_names)
        cut = (np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist()
        links = []
        for i, j in zip([0, *cut], [*cut, len(a)]):
            if j - i >= INLIERS:
                pairs = np.unique(np.stack([p[i:j], q[i:j]], axis=1), axis=0)
                if consensus(unpack_places(pairs[:, 0]), unpack_places(pairs[:, 1]), INLIERS) >= INLIERS:
                    links.append((int(a[i]), int(b[i])))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])


def _links(matches: DataFrame) -> DataFrame:
    """Pairs of images that enough of their matches agree on."""
    rows = matches.where("a <> b").select("a", "b", "a_place", "b_place").distinct()
    return settle(rows.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_link_batches, "a long, b long"), "links")


def _classed(rows: DataFrame, image: str, roots: DataFrame, name: str) -> DataFrame:
    """rows with the class of an image: its root, or itself."""
    r = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(r, F.col(image) == F.col("__node"), "left").withColumn(name, F.coalesce("__root", image)).drop("__node", "__root")


def classes(corners: DataFrame) -> DataFrame:
    """corners: number, points, low, high of distinct images. (node, root) of the images that have copies."""
    n = corners.agg(F.sum(F.octet_length("low"))).first()[0] or 0
    parts = max(1, math.ceil(n / 8 / PART_ROWS))  # at most eight bytes, compressed, for each row of a table
    dealt = corners.select("number", "points", "low", "high").mapInArrow(_word_rows(parts), buckets.schema(5))
    matches = settle(dealt.groupBy("part").applyInArrow(_matches, _MATCHES), "matches")
    links = _links(matches)
    roots = connected(links)
    both = _classed(_classed(matches.where("tree >= 0"), "a", roots, "a_class"), "b", roots, "b_class")
    mixed = both.where("a_class <> b_class").select("tree").distinct()
    ends = both.join(mixed, "tree", "left_semi").select("tree", F.explode(F.array(F.struct(F.col("a").alias("image"), F.col("a_class").alias("class"), F.col("a_place").alias("place")), F.struct(F.col("b").alias("image"), F.col("b_class").alias("class"), F.col("b_place").alias("place")))).alias("r"))
    rows = settle(ends.select("tree", "r.image", "r.class", "r.place").distinct(), "mixed")
    if rows.isEmpty():
        return roots
    points = corners.join(rows.select(F.col("image").alias("m_image")).distinct(), F.col("number") == F.col("m_image"), "left_semi").select("number", "points", "low", "high").mapInArrow(_unpacked, "number long, n_place long, low long, high long")
    full = rows.join(points, (F.col("image") == F.col("number")) & (F.col("place") == F.col("n_place"))).select("tree", "image", "class", "place", "low", "high")
    more = settle(full.mapInArrow(_tree_cuts, buckets.schema(6)).groupBy("part").applyInArrow(_cross_matches, _MATCHES), "matches")
    apart = _classed(_classed(matches.union(more).where("a <> b"), "a", roots, "a_class"), "b", roots, "b_class").where("a_class <> b_class")
    added = _links(apart)
    return roots if added.isEmpty() else connected(links.union(added))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for number, *cells in zip(*(c.to_pylist() for c in b.columns)):
            cols = [unsqueeze(x, np.int64) for x in cells]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), number)), *map(pa.array, cols)], ["number", "n_place", "low", "high"])


def copies(images: DataFrame, id_column: str = "id", image_column: str = "image") -> DataFrame:
    """id and class_id (the smallest id of the class) of each row."""
    small_batches(images.sparkSession)
    source = images.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{image_column}`").alias("image"))
    kind = source.schema["id"].dataType.simpleString()
    made = source.mapInArrow(_described(kind), f"id {kind}, {_SEEN}").withColumn("number", F.monotonically_increasing_id())
    rows = settle(made.withColumn("digest", F.coalesce(F.hex("digest"), F.concat(F.lit("null-"), F.col("number").cast("string")))), "described")
    first = rows.groupBy("digest").agg(F.min(F.when(F.col("points").isNotNull(), F.col("number"))).alias("described"), F.min("number").alias("least_number"), F.min("id").alias("least"))
    first = first.select("digest", F.coalesce("described", "least_number").alias("first"), "least")
    corners = rows.where("points IS NOT NULL").join(first.select(F.col("first")), F.col("number") == F.col("first"), "left_semi")
    roots = classes(corners)
    known = _classed(first, "first", roots, "root")
    ids = known.groupBy("root").agg(F.min("least").alias("class_id"))
    named = known.join(ids, "root").select(F.col("digest").alias("n_digest"), "class_id")
    return rows.join(named, rows["digest"] == named["n_digest"]).select("id", "class_id")


# A stand-in for a media column: a picture of an embedding.

CELLS, CELL = 32, 4
_MIX = np.random.default_rng(SEED + 1).integers(0, 64, (CELLS * CELLS, 3))


def picture(vector: list[float] | None) -> bytes | None:
    """A PGM mosaic of CELLS x CELLS squares, each grey by the sum of three components of the vector."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float32)
    cells = np.clip(128 + 300 * v[_MIX % len(v)].sum(axis=1), 0, 255).astype(np.uint8).reshape(CELLS, CELLS)
    side = CELLS * CELL
    return b"P5 %d %d 255\n" % (side, side) + np.kron(cells, np.ones((CELL, CELL), np.uint8)).tobytes()


def pictures(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and image of each row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([picture(x) for x in part.column(1).to_pylist()], pa.binary())], ["id", "image"])

    return vectors.select(id_column, vector_column).mapInArrow(batches, f"id {vectors.schema[id_column].dataType.simpleString()}, image binary")
