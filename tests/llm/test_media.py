import zlib

import numpy as np
from tidegrid.llm import media


def pgm(a):
    a = np.clip(a, 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def png(a, how):
    h, w = a.shape
    rows = []
    for y in range(h):
        line, up = a[y].astype(int), (a[y - 1].astype(int) if y else np.zeros(w, int))
        left, corner = np.concatenate([[0], line[:-1]]), np.concatenate([[0], up[:-1]])
        p = left + up - corner
        d = np.stack([abs(p - left), abs(p - up), abs(p - corner)]).argmin(0)
        guess = [0 * line, left, up, (left + up) // 2, np.choose(d, [left, up, corner])][how]
        rows.append(bytes([how]) + ((line - guess) & 255).astype(np.uint8).tobytes())
    part = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")


def scene(rng):
    a = np.full((160, 200), 120.0)
    for _ in range(60):
        y, x = rng.integers(0, 150), rng.integers(0, 190)
        h, w = rng.integers(6, 40, 2)
        a[y : y + h, x : x + w] = rng.integers(0, 255)
    return media._box(a, 1)


def test_decoders_round_trip():
    a = np.random.default_rng(1).integers(0, 255, (9, 13)).astype(np.uint8)
    assert (media.decode(pgm(a)) == a).all()
    assert (media.decode(b"P5\n# note\n13 9\n255\n" + a.tobytes()) == a).all()
    for how in range(5):
        assert (media.decode(png(a, how)) == a).all()
    assert [media.decode(x) for x in (None, b"", b"junk", b"P5 9", b"P5 99 99 255\nxx", b"P5 2 1 0\nab", b"P5 0 0 255\n")] == [None] * 7
    bomb = png(np.zeros((9, 13), np.uint8), 0).replace((13).to_bytes(4, "big") + (9).to_bytes(4, "big"), (1 << 20).to_bytes(4, "big") * 2)
    assert media.decode(bomb) is None


def test_places_round_trip():
    p = np.array([[3.125, 900.5, 1.0, -3.0], [0, 0, 1 / 0.64, 3.1]])
    assert np.abs(media.unpack_places(media.pack_places(p)) - p).max() < 0.01


def test_crops_and_edits_are_found_and_others_left_alone(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(12):
        a = scene(rng)
        rows.append((i * 10, pgm(a)))
        for j, e in enumerate([a[10:150, 15:190], a * 0.7 + 40, np.rot90(a), a + rng.normal(0, 4, a.shape), a[20:, :170] * 1.2]):
            rows.append((i * 10 + j + 1, pgm(e)))
        rows.append((i * 10 + 6, pgm(a)))
    rows += [(None, None), (1000, None), (1001, b"junk"), (1002, b"junk"), (1003, pgm(np.zeros((50, 50))))]
    out = {r["id"]: r["class_id"] for r in media.copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    own = {k: v for k, v in out.items() if k is not None and k < 1000}
    assert all(v // 10 == k // 10 for k, v in own.items())
    assert sum(v == k // 10 * 10 for k, v in own.items()) >= 0.97 * len(own)
    assert {k: v for k, v in out.items() if k is None or k >= 1000} == {None: None, 1000: 1000, 1001: 1001, 1002: 1001, 1003: 1003}


def test_pictures_of_near_vectors_are_copies(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.125, (20, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(50, (v[3] * 1.05).tolist()), (51, v[4].tolist()), (52, None), (53, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {r["id"]: r["class_id"] for r in media.copies(media.pictures(vectors, "vec_id", "embedding")).collect()}
    assert out[50] == 3 and out[51] == 4 and all(out[i] == i for i in range(20)) and out[52] == 52 and out[53] == 53


def test_empty_table(spark):
    assert media.copies(spark.createDataFrame([], "id long, image binary")).collect() == []


def brute(images):
    """Class of each image: every pair of descriptors of every pair of images."""
    seen = [media.describe(media.decode(x)) for x in images]
    places = [media.unpack_places(media.pack_places(p)) for p, _ in seen]
    halves = [np.ascontiguousarray(d).view("<u8").reshape(-1, 2) for _, d in seen]
    words = [media.words_of(np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])) for h in halves]
    root = list(range(len(images)))
    for j in range(len(images)):
        for i in range(j):
            x = seen[i][1][:, None, :] ^ seen[j][1][None, :, :]
            meets = (words[i][:, :, None] == words[j][:, None, :]).any(0)
            a, b = np.nonzero(meets & (np.bitwise_count(x).sum(2) <= media.MAX_BITS))
            if len(a) >= media.INLIERS and media.consensus(places[i][a], places[j][b]) >= media.INLIERS:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_classes_equal_all_pairs(spark, monkeypatch):
    """Copies whose corners also occur, a few each, in different earlier pictures; buckets compared pair by pair, and by forests."""
    rng = np.random.default_rng(8)
    parts = [scene(rng)[:80, :66] for _ in range(6)]
    images = []
    for part in parts:
        a = scene(rng)
        a[40:120, 60:126] = part
        images.append(a)
    sheet = np.vstack([np.hstack(parts[:3]), np.hstack(parts[3:])])
    images += [sheet, sheet * 0.9 + 9, sheet * 0.8 + 20, sheet[:, :190] * 0.95]
    for _ in range(3):
        a = scene(rng)
        images += [a, a * 0.9 + 5, scene(rng)]
    images = [pgm(a) for a in images]
    want = brute(images)
    assert len(set(want)) < len(want) and want[6:10] == [want[6]] * 4
    data = spark.createDataFrame(list(enumerate(images)), "id long, image binary")
    assert [r["class_id"] for r in media.copies(data).orderBy("id").collect()] == want
    got = forests_only(spark, images)
    assert got == want


def forests_only(spark, images):
    """Classes where every bucket counts as large: matches of forests, mixed trees and what they add, in one process."""
    import pyarrow as pa
    from tidegrid.llm import buckets

    seen = [media.describe(media.decode(x)) for x in images]
    rows = [(np.full(len(p), i, np.int64), media.pack_places(p), *np.ascontiguousarray(np.ascontiguousarray(d).view("<u8").reshape(-1, 2).T)) for i, (p, d) in enumerate(seen)]
    image, place, low, high = (np.concatenate(c) for c in zip(*rows))
    was, buckets.SMALL = buckets.SMALL, 1
    try:
        found = []
        for t, word in enumerate(media.words_of(low, high)):
            batch = buckets.cut(np.full(len(word), t), [word.astype(np.uint32), image, place, low, high])
            for b in media._matches((pa.scalar(t),), iter([batch])):
                found += b.to_pylist()
        trees = sorted({m["tree"] for m in found})
        assert min(trees) >= 0
        roots = linked(found, len(images))
        mixed = {m["tree"] for m in found if roots[m["a"]] != roots[m["b"]]}
        ends = sorted({(m["tree"], m[e], m[f"{e}_place"]) for m in found if m["tree"] in mixed for e in "ab"})
        bits = {(i, p): (x, y) for i, p, x, y in zip(image.tolist(), place.tolist(), low.tolist(), high.tolist())}
        cols = [np.array(c) for c in zip(*((t, i, roots[i], p, *bits[i, p]) for t, i, p in ends))]
        batch = buckets.cut(np.zeros(len(ends), np.int64), [c.astype(np.uint64).view(np.int64) for c in cols])
        for b in media._cross_matches((pa.scalar(0),), iter([batch])):
            found += b.to_pylist()
    finally:
        buckets.SMALL = was
    return linked(found, len(images))


def linked(matches, n):
    pairs = {}
    for m in matches:
        if m["a"] != m["b"]:
            pairs.setdefault((m["a"], m["b"]), set()).add((m["a_place"], m["b_place"]))
    root = list(range(n))
    for (a, b), at in pairs.items():
        p, q = (media.unpack_places(np.array([x[k] for x in sorted(at)])) for k in (0, 1))
        if media.consensus(p, q) >= media.INLIERS:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root


def test_a_hundred_copies_and_repeated_ids(spark):
    """Large buckets: many near-equal copies of one picture, beside others; ids that occur twice."""
    rng = np.random.default_rng(6)
    a, others = scene(rng), [scene(rng) for _ in range(5)]
    rows = [(i, pgm(a * (0.7 + 0.003 * i) + rng.normal(0, 1, a.shape))) for i in range(100)] + [(200 + i, pgm(x)) for i, x in enumerate(others)] + [(200, pgm(a)), (None, pgm(others[1]))]
    out = [(r["id"], r["class_id"]) for r in media.copies(spark.createDataFrame(rows, "id long, image binary")).collect()]
    assert len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, [(i, 0) for i in range(100)] + [(200, 200), (201, 201), (202, 202), (203, 203), (204, 204), (200, 0), (None, 201)]))


def test_small_crop_of_a_less_contrasty_part_is_found(spark):
    """The crop has none of the strongest corners of the large picture."""
    rng = np.random.default_rng(12)
    a = np.hstack([np.vstack([scene(rng) for _ in range(3)]) for _ in range(3)])
    a[:160, :200] = 120 + (a[:160, :200] - 120) * 0.8
    crop = a[20:140, 30:170]
    p, _ = media.describe(media.decode(pgm(a)))
    x, y = p[:20, 0], p[:20, 1]
    assert ((x >= 30) & (x < 170) & (y >= 20) & (y < 140)).sum() < media.INLIERS
    rows = [(0, pgm(a)), (1, pgm(crop)), (2, pgm(scene(rng)))]
    out = {r["id"]: r["class_id"] for r in media.copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert out == {0: 0, 1: 0, 2: 2}
