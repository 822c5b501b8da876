import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tidegrid.llm import language_id, linear, mixing, packing, quality_neighbours, quality_rules, queries, toxicity
from tidegrid.llm.common import bounded_sample, held_out, table

SF = "/root/testdata/sf0.01"
ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (None, "some words here"), (-5, "12 34 !!"), (-6, "word " * 60_000), (-6, "word " * 60_000)]


def odd(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1.0, "x") for i, t in ODD], "doc_id long, text string, lang string, source string, Score double, predicted string")
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


# Samples and regression.


def test_sample_is_bounded_even_and_held_in(spark, docs, labels):
    known = labels.where(~held_out(F.col("doc_id")))
    rows = bounded_sample(known, docs, ["quality"], 40)
    assert 40 < len(rows) <= 80 and rows == bounded_sample(known.repartition(7), docs, ["quality"], 40)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in rows)
    assert bounded_sample(known.limit(0), docs, ["quality"], 40) == []


def test_regression_separates_and_calibrates():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.3).astype(float)
    rows = [(np.array([0, 1 + int(a), 3 + int(rng.integers(5))]), np.ones(3)) for a in y]
    x = linear.Rows.of(rows, 8)
    out = linear.out_of_fold(x, y, 4)
    assert (((out > 0) == (y == 1)).mean()) == 1.0
    a, b = linear.calibrate(rng.normal(y * 2 - 1, 1.5), y)
    assert 0 < a < 3 and linear.fit(x, np.ones(400)).bias == 6.0 and abs(b) < 3
    assert linear.fit(linear.Rows.of([], 8), np.zeros(0)).bias == -6.0


# Toxicity.


def test_toxicity_held_out(spark, docs, labels):
    named = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    chain = toxicity.learn(docs, named.where("doc_id % 3 <> 0"), ["junk", "toxic"])
    got = toxicity.score(docs.select("doc_id", "text"), chain).join(labels.select("doc_id", F.col("toxic").alias("want")), "doc_id").where("doc_id % 3 = 0").select("toxic", "want", "toxic_score").collect()
    assert np.mean([r["toxic"] == r["want"] for r in got]) > 0.93
    assert all(0 <= r["toxic_score"] <= 1 for r in got)


def test_toxicity_chain_uses_earlier_categories():
    rng = random.Random(3)
    texts, y = [], []
    for i in range(400):
        a, b = i % 2, int(i % 4 == 3)
        texts.append(" ".join(["alpha" if a else "beta", "gamma" if b else "delta", *rng.sample(["one", "two", "three", "four"], 2)]).encode())
        y.append((a, b))
    chain = toxicity.fit_chain(texts, np.array(y, float), ["first", "second"])
    assert len(chain.models[1].weight) == len(chain.models[0].weight) + 1
    p = chain.probabilities(linear.Rows.of([(f, np.ones(len(f))) for f in map(toxicity.features, texts)], 1 << toxicity.BITS))
    assert ((p > 0.5) == np.array(y)).mean() > 0.99


def test_toxicity_odd_input(spark, labels):
    chain = toxicity.learn(odd(spark), labels.select("doc_id", "toxic").limit(0), ["toxic"])
    out = toxicity.score(odd(spark), chain)
    assert out.columns[-2:] == ["toxic_score", "toxic"] and out.count() == len(ODD) and out.agg(F.sum("toxic")).first()[0] == 0
    assert toxicity.score(odd(spark).limit(0), chain).count() == 0


# Quality rules.


def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    number = Counter(windows)
    often = {w for w, n in number.items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    n, r = len(words), len(covered)
    return n, sum(c not in " \t\n\x0b\x0c\r" for c in text), sum(c in "#*$%&|<>" for c in text), dup, r, n < 50 or 100 * r > 50 * n


def test_quality_rules_counts_by_brute_force(spark, docs, labels):
    model = quality_rules.learn(docs, labels)
    some = docs.select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    got = quality_rules.judge(some, model).collect()
    assert len(got) > 700
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_counts(r["text"]), r["doc_id"]
        assert 0 <= r["quality_score"] <= 1 and r["kept"] == (not r["base_failed"] and r["quality_score"] >= 0.5)
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    clean = [r for r in got if want.get(r["doc_id"]) == 1 and not r["base_failed"]]
    junk = [r for r in got if want.get(r["doc_id"]) == 0]
    assert np.mean([r["kept"] for r in clean]) > 0.99 and np.mean([r["kept"] for r in junk]) < 0.05


def test_quality_score_equals_the_model_over_features(docs, labels):
    model = quality_rules.learn(docs, labels)
    for text in ("", "abc", "some wörds in a text, and more ***" * 5, "x" * 3000):
        words = text.encode().split()
        x = linear.Rows.of([quality_rules.features(text, words)], len(model.logistic.weight))
        assert abs(model.logistic.logit(x)[0] - model.logit(text, words)) < 1e-6


# Neighbour voting.


def test_quality_neighbours_held_out_and_brute_force(spark, docs, labels):
    model = quality_neighbours.learn(docs, labels)
    got = quality_neighbours.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97
    texts = [r["text"].encode() for r in got[:30]]
    v = model.embed(np.stack([quality_neighbours.terms(t) for t in texts]))
    for a, s in zip(v, model.scores(texts)):
        cosine = model.vectors.astype(float) @ a.astype(float)
        near = np.argsort(-cosine, kind="stable")[: quality_neighbours.NEIGHBOURS]
        w = np.clip(cosine[near], 1e-6, 1) ** quality_neighbours.SHARPNESS
        assert abs((w * model.votes[near]).sum() / w.sum() - s) < 1e-3


def test_quality_neighbours_odd_input(spark, docs, labels):
    for model in (quality_neighbours.learn(docs, labels), quality_neighbours.learn(docs, labels.limit(0)), quality_neighbours.learn(docs, labels.where("quality = 1").limit(3))):
        out = quality_neighbours.score(odd(spark), model)
        assert out.columns == ["doc_id", "text", "lang", "source", "score", "predicted"]
        rows = out.collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


# Language.


def test_language_held_out(spark, docs):
    contents = language_id.learn(docs)
    assert sorted(contents) == ["de", "en", "es", "fr"]
    got = language_id.identify(docs.select("doc_id", "text", "lang"), contents).where(held_out(F.col("doc_id"))).collect()
    long = [r for r in got if len(r["text"]) >= 100]
    assert np.mean([r["lang"] == r["lang_pred"] for r in long]) > 0.98 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.96


def test_language_odd_input(spark, docs):
    for contents in (language_id.learn(docs), {}):
        rows = language_id.identify(odd(spark), contents).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        und = [r["text"] for r in rows if r["lang_pred"] == "und"]
        assert set(map(str, und)) >= {"None", "", " \n\t ", "12 34 !!"} and (contents or len(und) == len(ODD))
    nolang = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.learn(nolang) == {}


def test_language_scorer_takes_the_smallest_total():
    s = language_id.Scorer({"x": b"the quick brown fox " * 50, "y": b"ein schneller fuchs " * 50})
    for text, want in (("A quick brown fox, the quick fox, and again the quick brown fox of the fox", "x"), ("ein schneller fuchs und ein schneller fuchs, ein fuchs und kein schneller", "y")):
        data = language_id.letters(text)
        assert len(data) > language_id.SHORT_BYTES and s.predict(text)[0] == want == "xy"[int(np.argmin([len(c.compress(data)) for c in s.compressors]))]
    for text, want in (("quick fox", "x"), ("schneller fuchs", "y"), ("the", "x")):
        totals = [sum(len(c.compress(language_id.CARRIER + language_id.letters(text))) for c in own) for own in s.fine]
        assert s.predict(text)[0] == want == "xy"[int(np.argmin(totals))]


def test_language_of_short_texts(spark, docs):
    """Texts under 40 characters that weren't learned from, of the larger table."""
    more = table(spark, "/root/testdata/sf0.1", "documents").where("length(text) < 40")
    got = language_id.identify(more.where(held_out(F.col("doc_id"))).select("text", "lang"), language_id.learn(docs)).where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(got) >= 10 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.6


# Empty tables and clashing columns.


def test_empty_tables_and_clashing_names(spark, docs, labels):
    none = odd(spark).limit(0)
    clash = odd(spark).withColumnsRenamed({"Score": "KEPT", "predicted": "Quality_Score", "lang": "toxic_SCORE", "source": "Lang_Pred"})
    rules, near, chain, contents = quality_rules.learn(docs, labels), quality_neighbours.learn(docs, labels), toxicity.learn(docs, labels, ["toxic"]), language_id.learn(docs)
    for run, names in (
        (lambda d: quality_rules.judge(d, rules), quality_rules.NAMES),
        (lambda d: quality_neighbours.score(d, near), ["score", "predicted"]),
        (lambda d: toxicity.score(d, chain), ["toxic_score", "toxic"]),
        (lambda d: language_id.identify(d, contents), ["lang_pred", "score", "margin", "accepted"]),
    ):
        assert run(none).count() == 0
        out = run(clash)
        assert out.columns[-len(names) :] == names and out.count() == len(ODD) and len({c.lower() for c in out.columns}) == len(out.columns)
    empty = docs.limit(0)
    assert quality_rules.learn(empty, labels).probability("some text", [b"some", b"text"]) < 0.01
    assert quality_neighbours.score(odd(spark), quality_neighbours.learn(empty, labels)).agg(F.max("score")).first()[0] == 0


def test_sample_takes_the_first_usable_rows(spark):
    """A class with no more rows than wanted is taken whole; rows whose text is missing or too long leave their place to others."""
    docs = spark.createDataFrame([(i, "t" * (5 if i % 3 else 500)) for i in range(300)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i >= 200)) for i in range(400)], "doc_id long, quality int")
    rows = bounded_sample(known, docs, ["quality"], 200, max_bytes=100)
    want = {i for i in range(300) if i % 3}
    assert {r["doc_id"] for r in rows} == want
    few = bounded_sample(known, docs, ["quality"], 20, max_bytes=100)
    assert Counter(r["quality"] for r in few) == {0: 20, 1: 20}


def test_ties_of_similarity_go_by_place():
    rng = np.random.default_rng(3)
    texts = [b"the same words again"] * 40 + [bytes(rng.integers(97, 122, 60).astype(np.uint8)) for _ in range(40)]
    model = quality_neighbours.fit_model(texts, np.array([1.0] * 25 + [0.0] * 55))
    assert model.scores([b"the same words again"])[0] == 1.0
    assert (model.scores(texts[:1] * 7)[0] == model.scores(texts)[0]).all()


# Packing.


def test_ids_equal_the_tokenizer(docs):
    ids = packing.Ids(queries.tokenizer_path())
    texts = [r["text"] for r in docs.where("doc_id < 120").collect()]
    texts += ["it's don't we'll O'Brien 's", "a\x1cb c", "<|endoftext|> x y<|endoftext|>z", "ΑΣ ΣΑΣ. x", "é café​ zero", " 　lead", "İstanbul ǅ ß STRASSE", "123 4,567 a1b2 %%%###!!", "𝒳𝓎 漢字 👩‍👩", "", None, "\x85a b\x0bc\x00d", "x" * 500, "a᠎b", "end.", "!!", "don't!"]
    for t in texts:
        assert np.frombuffer(ids(t), "<u4").tolist() == ids.tok.encode(t or "", add_special_tokens=False).ids, t


def test_plain_texts_are_cut_into_pieces_at_once():
    """Latin texts with ever other words: ids as the tokenizer gives them, and no chunk between white space is learnt; characters that compose or lower otherwise are left to the tokenizer."""
    rng = random.Random(9)
    ids = packing.Ids(queries.tokenizer_path())
    plain = [chr(c) for c in [*range(1, 0x250), *range(0x2010, 0x205F), 0x20AC] if c not in range(28, 32) and not packing._ODD.search(chr(c))]
    assert len(plain) > 500 and {*"aZ9'é€²ß \n"} <= {*plain} and not {*"İ\u0301Ω漢\x85\u2028"} & {*plain}
    texts = [" ".join("".join(rng.choices(plain, k=rng.randint(1, 12))) for _ in range(60)) for _ in range(60)]
    texts += [w + "'s" + v + "'LL 'Re" + w for w, v in zip(plain, plain[1:])] + [c * n for c in "aé'.²" for n in (2, 199, 250)]
    for t, got in zip(texts, ids.of(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids.tok.encode(t, add_special_tokens=False).ids, t
    assert not ids.chunks
    mixed = ["cafe\u0301 e\u0301t\u00e9", "İI ǅ", "ΟΔΟΣ x", "a\x85b\u2028c", "x\u200by"]
    assert [np.frombuffer(got, "<u4").tolist() for got in ids.of(mixed)] == [ids.tok.encode(t, add_special_tokens=False).ids for t in mixed]


def test_packing_is_exact_and_tight(spark, docs):
    some = docs.select("doc_id", "text").where("doc_id < 300").unionByName(odd(spark).select("doc_id", "text"))
    got = [r.asDict() for r in packing.pack(some, queries.tokenizer_path(), block=64).collect()]
    ids = packing.Ids(queries.tokenizer_path())
    want = []
    for r in some.collect():
        whole = ids.tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(r["doc_id"], k, a, len(whole[a : a + 4096]), zlib.crc32(np.array(whole[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(whole), 4096))]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 8
    assert packing.pack(some.limit(0), queries.tokenizer_path()).count() == 0


def test_genetic_steps_keep_every_piece_and_never_get_worse():
    rng = random.Random(5)
    lengths = [rng.choice([1300, 1400, 1500, 2100, 2700, 900, 1000]) + rng.randint(0, 40) for _ in range(240)]
    p = packing.Packer(lengths, 4096, 1)
    a, b = p.first(), p.first(0.05)
    for bins in (a, b, p.crossover(a, b), p.mutate(a), p.evolve([a, b, p.first(0.1)], 8, 0)):
        assert sorted(i for x in bins for i in x) == list(range(240)) and all(p.fill(x) <= 4096 for x in bins)
    assert packing.lower_bound(np.array(lengths), 4096) <= len(p.evolve([a, b], 8, 0)) <= min(len(a), len(b))
    assert packing.lower_bound(np.array([3000, 3000, 3000]), 4096) == 3 and packing.lower_bound(np.array([2049, 2049, 2047, 2047]), 4096) == 2
    assert packing.lower_bound(np.array([2000, 2000, 2000]), 4096) == 2 and packing.lower_bound(np.zeros(0, int), 4096) == 0


def test_islands_evolve_apart_and_elites_migrate(spark):
    """Three islands of a block run in three tasks; whole populations are kept; every island takes in its neighbour's elite."""
    rng = random.Random(5)
    lengths = [rng.choice([1300, 1400, 1500, 2100, 2700, 900, 1000]) + rng.randint(0, 40) for _ in range(240)]
    sizes = spark.createDataFrame([(0, lengths)], "block long, lengths array<long>")
    trace = []
    best = packing.evolved(sizes, 1, 4096, trace).collect()
    first = trace[0].withColumn("task", F.input_file_name()).collect()
    assert sorted(r["island"] for r in first) == [0, 1, 2] and len({r["task"] for r in first}) == 3
    bound = packing.lower_bound(np.array(lengths), 4096)
    assert not any(r["done"] for r in first) or len(trace) == 1
    assert all(r["done"] or len(r["population"]) == packing.POPULATION for r in first)
    bins = packing._bins(best[0]["labels"])
    assert sorted(i for b in bins for i in b) == list(range(240)) and bound <= len(bins) <= len(packing.Packer(lengths, 4096, 0).first())
    if len(trace) > 1:
        elite = {r["island"]: r["n_bins"] for r in first}
        for r in trace[1].collect():
            assert r["n_bins"] <= min(elite[r["island"]], elite[(r["island"] - 1) % 3])


def test_caches_are_bounded_and_given_back():
    ids = packing.Ids(queries.tokenizer_path())
    for k in range(0, 200_000, 2000):
        ids.of([" ".join(f"word{i}x" for i in range(k, k + 2000))])
        assert ids.held <= packing.CACHE_BYTES + 2000 * 1000
    ids.forget()
    assert not ids.chunks and not ids.words and ids.held == 0


# Mixing.


def mixed(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return [r.asDict() for r in mixing.mix(df, **how).collect()]


def test_mixture_meets_limit_and_covers(spark):
    rows = [(i, "big" if i % 10 else ("small" if i % 20 else None), "w " * 10) for i in range(4000)]
    got = mixed(spark, rows, max_repetition=2.0)
    count = {s: sum(r["source"] == s for r in got) / sum(x[1] == s for x in rows) for s in ("big", "small", None)}
    assert count["big"] == 1 and abs(count["small"] - 2) < 0.02 and abs(count[None] - 2) < 0.02 and len({r["doc_id"] for r in got}) == 4000
    weights = {r["source"]: r["mix_weight"] for r in got}
    p = np.array([0.9, 0.05, 0.05])
    a = 1 - np.log(2) / np.log(0.9 / 0.05)
    assert np.allclose([weights["big"], weights["small"], weights[None]], p**a / (p**a).sum(), atol=1e-5)


def test_mixture_meets_entropy_and_budget(spark):
    rows = [(i, "abc"[min(2, i % 7)], "w " * (1 + i % 5)) for i in range(3000)]
    got = mixed(spark, rows, target_entropy=1.0, budget=6000.0)
    w = np.array([next(r["mix_weight"] for r in got if r["source"] == s) for s in "abc"])
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-5 and abs(w.sum() - 1) < 1e-9
    tokens = {s: sum(len(r["text"].split()) for r in got if r["source"] == s) for s in "abc"}
    assert np.allclose([tokens[s] for s in "abc"], w * 6000, rtol=0.05)
    for s in "abc":  # whole epochs before partial ones
        per = {}
        for r in got:
            if r["source"] == s:
                per[r["doc_id"]] = per.get(r["doc_id"], 0) + 1
        assert max(per.values()) - min(per.values()) <= 1 or min(per.values()) == 0


def test_mixture_odd_input(spark):
    assert mixed(spark, [], max_repetition=2.0) == []
    assert sorted(r["doc_id"] for r in mixed(spark, [(1, "a", None), (2, "a", ""), (3, None, " ")], max_repetition=2.0)) == [1, 2, 3]
    rows = [(None, "a", "x y"), (5, "a", "x y"), (5, "a", "x y"), (6, "z", None), (7, "b", "q " * 100_000)]
    got = mixed(spark, rows, max_repetition=1.0)
    assert sorted(str(r["doc_id"]) for r in got) == ["5", "5", "6", "7", "None"]
    df = spark.createDataFrame([(1, "a", "x", 9)], "doc_id long, source string, text string, MIX_EPOCH int")
    assert mixing.mix(df).columns == ["doc_id", "source", "text", "mix_epoch", "mix_block", "mix_order", "mix_weight"]


def test_language_dictionaries_take_every_sampled_text(spark):
    """Also from behind the texts' common first kilobyte."""
    rows = [(i, f"{'boilerplate ' * 90}{f'mark{chr(97 + i // 26)}{chr(97 + i % 26)} ' * 300}", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    used = language_id.bounded_sample(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "lang"), docs, ["lang"], 256)
    made = language_id.learn(docs)["en"]
    assert len(used) > 100 and len(made) <= language_id.DICT_BYTES
    assert all(f"mark{chr(97 + r['doc_id'] // 26)}{chr(97 + r['doc_id'] % 26)}".encode() in made for r in used)


def spark_hash(*values, start=42):
    """Spark's xxhash64 of integers."""
    h = start
    for kind, v in values:
        h = xxhash.xxh64_intdigest(struct.pack(kind, v), h)
    return h - (1 << 64) if h >> 63 else h


def test_block_plan_by_hand(spark):
    """Which rows come how often, from the definition: blocks by hash, whole epochs, then blocks in hash order up to the rest."""
    rows = [(i, "abc"[min(2, i % 9)], "w " * (1 + i % 5)) for i in range(2000)]
    got = mixed(spark, rows, budget=9000.0, max_repetition=4.0, blocks=16)
    total = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in "abc"}
    weight = {r["source"]: r["mix_weight"] for r in got}
    share = np.array([total[s] / sum(total.values()) for s in "abc"])
    for a in np.linspace(0, 1, 2001):  # the smallest exponent that repeats no source more than four times
        w = share**a / (share**a).sum()
        if (w * 9000 / np.array([total[s] for s in "abc"])).max() <= 4:
            break
    assert np.allclose([weight[s] for s in "abc"], w, atol=1e-3)
    block = {i: spark_hash(("<i", 7), ("<q", i)) % 16 for i, _, _ in rows}
    want = Counter()
    for s in "abc":
        due = round(weight[s] * 9000 / total[s], 9)
        size = Counter()
        for i, x, t in rows:
            if x == s:
                size[block[i]] += len(t.split())
        text = s.encode()
        seed = xxhash.xxh64_intdigest(s.encode(), spark_hash(("<i", 8), ("<q", int(due))) % 2**64)
        order = sorted(size, key=lambda b: (spark_hash(("<q", b), start=seed), b))
        left, more = (due - int(due)) * total[s], set()
        upto = 0
        for b in order:
            upto += size[b]
            if upto - size[b] / 2 < left:
                more.add(b)
        for i, x, _ in rows:
            if x == s:
                want[i] = int(due) + (block[i] in more)
    assert Counter(r["doc_id"] for r in got) == +want
    for r in got:
        assert 0 <= r["mix_epoch"] < want[r["doc_id"]] and r["mix_block"] == block[r["doc_id"]]
