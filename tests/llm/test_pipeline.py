import corpus_pipeline
from pyspark.sql import functions as F
from tidegrid.llm import mixing, packing, quality_neighbours, queries, suffix_dedup
from tidegrid.llm.common import settle, table

from test_simhash import jaccard_groups

SF = "/root/testdata/sf0.001"


def test_stages_by_their_operators(spark):
    """Each stage against its operator, on its own input; the operators are held against brute force elsewhere."""
    docs = table(spark, SF, "documents")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF), name)
        out.append(docs)
    start = table(spark, SF, "documents")
    assert all(d.columns == start.columns for d in out[:-1])
    model = quality_neighbours.learn(start, table(spark, SF, "labels"))
    kept = {r["doc_id"] for r in quality_neighbours.score(start, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in out[0].collect()} == kept and 0 < len(kept) < start.count()
    before = sorted((r["doc_id"], r["text"]) for r in out[0].collect())
    first = jaccard_groups([t for _, t in before])
    assert {r["doc_id"] for r in out[1].collect()} == {before[i][0] for i in first} and out[1].count() < out[0].count()
    cut = {r["doc_id"]: r["kept_text"] for r in suffix_dedup.remove_repeats(out[1]).collect()}
    assert {r["doc_id"]: r["text"] for r in out[2].collect()} == cut and any(r["text"] != cut[r["doc_id"]] for r in out[1].collect())
    assert out[2].where(F.char_length("text") != F.col("n_chars")).count() == 0
    want = mixing.mix(out[2], max_repetition=queries.MAX_REPETITION).groupBy("doc_id").count().collect()
    got = {r["doc_id"]: r["count"] for r in out[3].groupBy("doc_id").count().collect()}
    assert got == {r["doc_id"]: r["count"] for r in want} and set(got) == set(cut)
    last = out[4].collect()
    assert len(last) >= out[3].count() and sorted(set(r["doc_id"] for r in last)) == sorted(got)
    fill = {}
    for r in last:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= packing.CAPACITY and len(fill) <= -(-sum(fill.values()) // packing.CAPACITY) + 1
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def test_stages_take_empty_and_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (5, "word " * 30_000, "en", None, 150_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data, first in ((rows, 1), (rows, 0), ([], 0)):
        docs = spark.createDataFrame(data, schema).withColumn("score", F.lit("mine")).withColumn("KEPT_TEXT", F.lit(1))
        for name, stage in corpus_pipeline.STAGES[first:]:
            before = docs.columns
            docs = settle(stage(spark, docs, SF), name)
            assert name == "best_fit_packing" or docs.columns == before
        n = docs.count()
        assert n == 0 if not data else n >= (4 if first else 0)
