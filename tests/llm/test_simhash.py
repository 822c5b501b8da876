import random

import numpy as np
import xxhash
from tidegrid.llm import simhash

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(doc_id -> (fingerprint, component)) by definition, over all pairs."""
    fps = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h)))
    a = np.array(fps, np.uint64)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 3) + i + 1:
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((doc, fps[i], min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)


def test_words_two_bits_apart_share_a_codeword():
    rng = np.random.default_rng(3)
    w = rng.integers(0, 1 << 23, 3000)
    for flips in (1, 2):
        v = w.copy()
        for i in range(len(v)):
            for b in rng.choice(23, flips, replace=False):
                v[i] ^= 1 << int(b)
        x, y = simhash.codewords(w), simhash.codewords(v)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(x, y))


def test_fingerprints_three_bits_apart_share_a_key():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        keys = [set(simhash.keys_of(np.array([x], np.uint64))[1]) for x in (a, b)]
        assert keys[0] & keys[1] and len(keys[0]) <= 108


def test_against_brute_force_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_nulls_ties_empty_and_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    rows = [(5, None), (3, ""), (4, " \n\t"), (None, "a b c"), (9, "A B C"), (9, "A B C"), (7, "one"), (8, long), (6, long + " tail"), (None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_dense_bucket_and_chain(spark):
    import pyarrow as pa

    base = 0x0123456789ABCDEF
    chain, f = [base], base
    for i in range(20):
        f ^= 0b111 << (3 * i)
        chain.append(f)
    rng = random.Random(1)
    dense = [base ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(200)]
    far = [rng.getrandbits(64) for _ in range(50)]
    fps = np.unique(np.array(chain + dense + far, np.uint64))
    table = pa.table({"fp": fps.view(np.int64)})
    edges = simhash.links(spark.createDataFrame(table.to_pandas()))
    roots = {r["node"]: r["root"] for r in simhash.connected(edges).collect()}
    got = {}
    for x in fps.view(np.int64):
        got.setdefault(roots.get(int(x), int(x)), set()).add(int(x) % 2**64)
    sizes = sorted(map(len, got.values()))
    assert sizes[-1] == len(set(chain) | set(dense)) and sum(sizes) == len(fps)


def test_one_of_each_keeps_one_row_and_columns(spark):
    rows = [(1, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (3, "p q r s t", None), (3, "p q r s t", "z"), (None, "a b c d", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"]) for r in out.collect()), key=str) == [1, 3, None]


def jaccard_groups(texts, words=5, similarity=0.8):
    """Smallest index of each text's group, by definition, over all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_equal_all_pairs(spark):
    """Edits around the limit, chains, short and wordless texts, repeated words."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "a b c", "A b  C", "a b d", "one", "a b c d e", "a b c d f"]
    for _ in range(40):
        base = " ".join(rng.choices(words, k=rng.randint(60, 300)))
        texts += [base, base.upper(), *(edited(rng, base, n) for n in (1, 1, 2, 4, 6))]
    chain = " ".join(rng.choices(words, k=300))
    for _ in range(15):
        texts.append(chain)
        chain = edited(rng, chain, 4)
    texts += ["ab " * 500, "ab " * 700, "ab " * 700 + "cd"]
    rng.shuffle(texts)
    want = jaccard_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["copy_of"] for r in simhash.near_copies(docs).collect()}
    assert all(want[got[i]] == want[i] for i in range(len(texts)))  # nothing is joined that isn't alike
    split = sum(got[i] != w for i, w in enumerate(want))
    assert split <= 0.02 * len(texts) and len(set(want)) < 0.8 * len(texts)


def test_large_group_of_distinct_near_copies(spark, monkeypatch):
    """All buckets of a group are large: a forest is verified, and what fails in it is compared again."""
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    other = edited(rng, base, 12)
    texts = [edited(rng, base, 1) for _ in range(60)] + [edited(rng, other, 1) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = jaccard_groups(texts)
    for block in (1024, 7):
        monkeypatch.setattr(simhash, "BLOCK_NODES", block)
        got = {r["doc_id"]: r["copy_of"] for r in simhash.near_copies(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_overlaps_of_sets(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(simhash, "OVERLAP_COLUMNS", 5)
    left, right = ([np.unique(rng.integers(0, 40, n)).astype(np.uint64) for n in sizes] for sizes in ((0, 5, 30, 60), (10, 0, 60)))
    assert simhash.overlaps(left, right).astype(int).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    """A text without a copy stays, though its id also names a copy; the row that stays doesn't depend on partitions."""
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (2, "something totally other than that one")]
    for parts in (1, 3):
        out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        assert sorted(map(tuple, out.collect())) == [rows[0], rows[2]]
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    named = spark.createDataFrame([("b", "x y", "1"), ("a", "x y", "2")], "doc_id string, text string, NODE string")
    assert [tuple(r) for r in simhash.one_of_each(named).collect()] == [("a", "x y", "2")]


def test_pairs_at_the_limit_meet():
    """Recall of the keys and the candidate limit for pairs of similarity 0.8."""
    rng = np.random.default_rng(2)
    limit, met = simhash.candidate_limit(0.8), 0
    for _ in range(300):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (160, 20, 20))
        x, y = (simhash.wide_fingerprint(np.concatenate([both, own])) for own in (a, b))
        for s, t in simhash._PAIRS:
            near = [[set(c[c >= 0].tolist()) for c in simhash.codewords(np.array([x[k], y[k]]))] for k in (s, t)]
            bits = sum(int(x[k] ^ y[k]).bit_count() for k in range(simhash.SEGMENTS) if k not in (s, t))
            if near[0][0] & near[0][1] and near[1][0] & near[1][1] and bits <= limit:
                met += 1
                break
    assert met >= 0.9 * 300


def test_components_by_stars_in_tasks(spark, monkeypatch):
    """A dense group, chains and pairs: the same components whether one task joins the edges, or tasks thin them out, or rounds follow; one task needs few jobs."""
    rng = random.Random(8)
    dense = [(a, b) for a, b in ((rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(6000))]
    chain = [(5000 + k, 5001 + k) for k in range(200)]
    pairs = [(9001 + 2 * k, 9000 + 2 * k) for k in range(200)]
    edges = spark.createDataFrame([*dense, *chain, *pairs], "a long, b long").repartition(7).localCheckpoint()
    want = {k: 5000 for k in range(5001, 5201)} | {9001 + 2 * k: 9000 + 2 * k for k in range(200)} | {k: min(min(p) for p in dense) for p in dense for k in p}
    want = {k: v for k, v in want.items() if k != v}
    sc = spark.sparkContext
    for most in (1 << 17, 1000, 100):
        monkeypatch.setattr(simhash, "STAR_EDGES", most, raising=False)
        sc.setJobGroup(f"stars {most}", "")
        found = simhash.connected(edges)
        sc.setJobGroup("other", "")
        assert {r["node"]: r["root"] for r in found.collect()} == want
        assert most < 1 << 17 or len(sc.statusTracker().getJobIdsForGroup(f"stars {most}")) <= 6
    assert simhash.connected(edges.where("a < 0")).collect() == []


def test_torn_trees_of_a_part_become_stars():
    """Many trees over the same nodes leave a part as one edge a node; trees that join what is alike, and such pairs, stay out."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = [(k, p := 100 + rng.randrange(k - 100), 1000 + t, k, p) for t in range(50) for k in range(101, 200)]
    rows += [(301, 300, 7, 300, 300), (302, 301, 7, 300, 300), (401, 400, -1, 400, 400), (501, 500, -1, 501, 500)]
    a, b, root, x, y = zip(*rows)
    pairs = pa.table({"a": a, "b": b, "root": root})
    top = dict(zip(a, x)) | dict(zip(b, y))
    assert all(top[p] == u and top[q] == v for p, q, u, v in zip(a, b, x, y))
    nodes = sorted(top, key=lambda k: k % 7)
    got = simhash._torn((pa.scalar(0),), pairs, pa.table({"node": nodes, "top": [top[k] for k in nodes]})).to_pylist()
    assert sorted(tuple(r.values()) for r in got) == [*((k, 100) for k in range(101, 200)), (501, 500)]
    own = [r for out in simhash._members((pa.scalar(3),), iter(pairs.to_batches(max_chunksize=100))) for r in out.to_pylist()]
    assert own == [{"part": 3, "node": k} for k in sorted(top)]
