import hashlib
import random

import numpy as np
import pytest
from tidegrid.llm import induced_sort, suffix_dedup

SF = "/root/testdata/sf0.001"
PASSAGE = "Some passage of more than fifty bytes that is shared — with äöü — by several documents, all of it. "


def brute(rows):
    first = {}
    for d, t in rows:
        b, k = (t or "").encode(), suffix_dedup.LAST if d is None else d
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], k), k)
    out = []
    for d, t in rows:
        b, k = (t or "").encode(), suffix_dedup.LAST if d is None else d
        g = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                g[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(b, g) if not m)
        out.append((d, len(b), sum(g), sum(1 for i in range(len(g)) if g[i] and (not i or not g[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs, ["doc_id"], False, **how).collect()), key=str)


def odd_rows():
    p = PASSAGE
    return [
        (None, p * 2), (None, p), (7000, None), (7001, ""), (7002, "x" * 300), (7003, "x" * 200 + "y"), (7003, "x" * 200 + "y"), (7004, "\0" * 80 + "ab"),
        (7005, "\0" * 90), (6999, "z" + "x" * 120), (7006, p[:49]), (7007, p[1:51]), (-5, p + "tail"), (7008, "ab" * 400), (7009, "ba" * 300),
    ]


@pytest.mark.parametrize("how", [{}, {"group_bytes": 200_000, "memory": 1 << 14, "base": 50}])
def test_against_brute_force(spark, how):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + odd_rows()
    assert run(spark, rows, **how) == brute(rows)


def test_shard_far_larger_than_its_memory(spark, tmp_path):
    """One shard for all, sorted on disk and by recursion."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    assert sum(len(t) for _, t in rows) > 4 * (1 << 14)
    assert run(spark, rows, most_shards=1, memory=1 << 14, base=100) == brute(rows)


def test_hot_minimizer_in_many_surroundings(spark, monkeypatch):
    """A string frequent in ever other contexts, a passage behind it shared by a few."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    rows = [(i, word(60) + "-" * 24 + (word(60) if i % 7 else "a passage that one row in seven shares, word by word ") + "=" * 80 + word(40)) for i in range(400)]
    monkeypatch.setattr(suffix_dedup, "PASS", 64)
    assert run(spark, rows, memory=1 << 12, base=50) == brute(rows)


def test_ids_of_other_types(spark):
    rows = [("b", PASSAGE + "one"), ("a", PASSAGE + "two"), (None, PASSAGE), ("c", "x")]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["kept_text"] for r in out} == {"a": PASSAGE + "two", "b": "one", None: "", "c": "x"}


def test_one_very_long_text(spark):
    rows = [(1, PASSAGE + "a"), (2, "".join(f"{i} words, " for i in range(200_000)) + PASSAGE), (3, "x" * 1_000_000), (4, "y" + "x" * 300)]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, len(PASSAGE.encode()), 0, 300]


def test_copies_columns_and_empty_table(spark):
    rows = [(i, PASSAGE, "mine", i) for i in range(400)] + [(1000, "new words " + PASSAGE + "end", "mine", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, extra int")
    out = suffix_dedup.remove_repeats(docs, group_bytes=5000)
    assert out.columns == ["doc_id", "text", "extra", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 401 and got[0]["n_removed"] == 0 and all(got[i]["kept_text"] == "" for i in range(1, 400))
    assert got[1000]["kept_text"] == "new words end"
    assert run(spark, []) == []


def test_induced_order_and_prefixes(monkeypatch):
    rng = random.Random(1)
    for _ in range(300):
        letters = rng.choice([1, 2, 3, 26])
        segs = [bytes(rng.randint(1, letters) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5))] * rng.choice([1, 2])
        cap = rng.choice([3, 50])
        monkeypatch.setattr(induced_sort, "BATCH", rng.choice([1, 2, 5, 1 << 17]))
        monkeypatch.setattr(induced_sort, "WIDE", rng.choice([0, 2, 1024]))
        t = np.frombuffer(b"\0".join(segs) + b"\0", np.uint8)
        batches = list(induced_sort.Sorter(t, cap, memory=rng.choice([0, 20, 1 << 20]), base=rng.choice([0, 3, 1 << 20])).descending())
        x = [int(i) for b, _ in batches for i in b]
        lcp = [int(i) for _, b in batches for i in b]
        zeros = np.flatnonzero(t == 0)
        key = lambda i: (t[i : (e := int(zeros[np.searchsorted(zeros, i)]))].tobytes(), e)  # noqa: B023, E731
        assert x == sorted((i for i in range(len(t)) if t[i]), key=key, reverse=True)
        for a, b, n in zip(x, x[1:], lcp[1:]):
            p, q = key(a)[0], key(b)[0]
            assert n == next((k for k in range(min(len(p), len(q), cap)) if p[k] != q[k]), min(len(p), len(q), cap))


def test_places_among_starts_and_doubled_ranks(monkeypatch):
    """The segment of a position without a search, and the order of all suffixes of names with many equal ones."""
    rng = np.random.default_rng(4)
    for total, memory in ((1, 1 << 20), (63, 0), (64, 0), (5000, 0), (5000, 1 << 20)):
        monkeypatch.setattr(induced_sort, "BATCH", int(rng.choice([1, 7, 1 << 17])))
        starts = np.concatenate([[0], 1 + np.flatnonzero(rng.random(total - 1) < 0.1)])
        x = rng.integers(0, total, 3000)
        assert (suffix_dedup._places(starts, total, induced_sort.Store(memory))(x) == np.searchsorted(starts, x, side="right") - 1).all()
    for names in (rng.integers(0, 3, 200), np.zeros(100, np.int64), np.tile([2, 0, 1], 50), np.array([5])):
        assert induced_sort.doubled(names).tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())


def test_segments_do_not_depend_on_order_or_steps(monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidegrid.llm.common import offsets_of

    texts = pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).combine_chunks()

    def segments(column, step):
        monkeypatch.setattr(suffix_dedup, "STEP", step)
        data, offsets = offsets_of(column)
        start, count, key, doc = suffix_dedup.runs(data, offsets)
        assert (np.diff(offsets)[doc] >= suffix_dedup.LENGTH).all()
        return sorted(zip(key.tolist(), suffix_dedup._cut(data, start, count)))

    order = np.random.default_rng(1).permutation(len(texts))
    assert segments(texts, 1 << 20) == segments(texts.take(pa.array(order)), 1000)


def test_squeezed_numbers_round_trip():
    for a in (np.zeros(0, np.int64), np.arange(-5, 300, dtype=np.int64), np.array([1, 2**63], np.uint64), np.array([7], np.uint8)):
        assert (suffix_dedup.unsqueeze(suffix_dedup.squeeze(a), a.dtype) == a).all()
