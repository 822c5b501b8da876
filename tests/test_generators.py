import datetime as dt

import pytest
from tidegrid.functions.text import parse_rate
from tidegrid.operators import datasets, iql

START = int(dt.datetime(2006, 1, 2, tzinfo=dt.UTC).timestamp()) * 10**9
SECOND = 10**9


def make(spark, dataset, **how):
    p = datasets.plan(datasets.Options(dataset, start_ns=how.pop("start_ns", START), **how))
    return p, [r.asDict() for r in datasets.generate(spark, p).orderBy("seq").collect()]


def test_rates():
    assert [parse_rate(x) for x in ("100/s", "10k/s", "1.5k", "2m/s", "7ps")] == [100, 10_000, 1500, 2_000_000, 7]
    for bad in ("", "0", "-1/s", "x", "1..2"):
        with pytest.raises(ValueError):
            parse_rate(bad)


def test_high_cardinality(spark):
    p, rows = make(spark, "high-cardinality", rate=3, duration_ns=2 * SECOND, batch_size=4, hosts=2, pids=3)
    assert (p.total, p.batches) == (6, 2)
    assert [(r["host"], r["pid"]) for r in (rows[0], rows[-1])] == [("host-0000", "pid-00000000"), ("host-0001", "pid-00000002")]


def test_stress_basic_lines(spark):
    p = datasets.plan(datasets.Options("stress-basic", start_ns=START, points=2, series=3, batch_size=4, precision="s"))
    lines = [r["line"] for r in datasets.lines(datasets.generate(spark, p), p).orderBy("seq").collect()]
    assert (p.total, p.batches) == (6, 2)
    assert lines[0] == "cpu,host=server-0,location=us-west value=0.000 1136160010"
    assert [x.rsplit(" ", 1)[1] for x in lines] == ["1136160010"] * 3 + ["1136160020"] * 3
    assert p.data_range_ns == (START + 10 * SECOND, START + 20 * SECOND)
    q = datasets.plan(datasets.Options("stress-basic", start_ns=START, points=2, series=2, precision="s"))
    assert datasets.lines(datasets.generate(spark, q), q).orderBy("seq").collect()[2]["line"] == "cpu,host=server-0,location=us-west value=74.000 1136160020"


def test_out_of_order_and_covering_block(spark):
    _, rows = make(spark, "out-of-order", rate=10, duration_ns=2 * SECOND, hosts=1, ratio=0.2)
    assert rows[10]["time_ns"] < rows[9]["time_ns"] and rows[10]["time_ns"] == rows[0]["time_ns"]
    p, rows = make(spark, "covering-block", rate=10, duration_ns=2 * SECOND, hosts=2)
    assert rows[14]["time_ns"] < rows[13]["time_ns"] and rows[14]["time_ns"] == START
    assert len({r["time_ns"] for r in rows}) == 14


def test_demo_cpu_times(spark):
    start = int(dt.datetime(2018, 11, 3, tzinfo=dt.UTC).timestamp()) * 10**9
    _, rows = make(spark, "demo-cpu", rate=2, duration_ns=SECOND, start_ns=start)
    assert [r["time_ns"] for r in rows] == [1783209600000000000, 1783209600500000000]
    assert all(abs(r["usage_user"] + r["usage_system"] + r["usage_idle"] - 100) < 1e-9 for r in rows)


def test_bad_options():
    for how in ({"batch_size": 100_001}, {"rate": 0}, {"ratio": 1.5}, {"hosts": -1}, {"precision": "years"}):
        with pytest.raises(ValueError):
            datasets.plan(datasets.Options("demo-cpu", **how))
    with pytest.raises(ValueError):
        datasets.plan(datasets.Options("nothing"))


def test_stream_equals_batch(spark):
    p = datasets.plan(datasets.Options("demo-cpu", start_ns=START, rate=50, duration_ns=2 * SECOND))
    stream = datasets.stream(spark, p, rows_per_batch=100)
    name = "gen_stream"
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        while spark.table(name).count() < p.total:
            q.awaitTermination(1)
    finally:
        q.stop()
    batch = datasets.generate(spark, p).drop("batch")
    assert spark.table(name).exceptAll(batch).count() == 0 and batch.exceptAll(spark.table(name).limit(p.total)).count() == 0


SCRIPT = """# mock
SET Database [iqldb]
SET RetentionPolicy [autogen]
SET Precision [s]
SET StartDate [2006-01-02]
SET BatchSize [2]
SET WriteConcurrency [4]
set writeconcurrency [5]

INSERT
cpu,host=server-[float inc(0) 2]
value=[int inc(10) 0]
3 10s

QUERY
SELECT count(value) FROM cpu
DO 2

CREATE DATABASE iqldb
WAIT
"""


def lines(run):
    return [r["line"] for r in run.lines.orderBy("statement", "seq").collect()]


def test_iql_script(spark):
    r = iql.run(spark, SCRIPT, dry_run=False)
    assert (r.points, r.batches, r.skipped_queries, r.raw) == (3, 2, 2, 1)
    assert r.settings.ignored == ["WriteConcurrency"] and r.settings.database == "iqldb"
    assert lines(r) == ["cpu,host=server-0 value=10i 1136160000", "cpu,host=server-1 value=10i 1136160000", "cpu,host=server-0 value=11i 1136160010"]
    assert [x["batch"] for x in r.lines.orderBy("seq").collect()] == [0, 0, 1]


def test_iql_first_tag_is_fastest(spark):
    r = iql.run(spark, "SET StartDate [2006-01-02]\nINSERT\ncpu,host=h[float inc(0) 2],\nregion=[a|b|c]\nvalue=[int inc(1) 0]\n7 10s\n")
    got = lines(r)
    assert [x.split(" ")[0] for x in got[:6]] == [f"cpu,host=h{i % 2},region={'abc'[i // 2]}" for i in range(6)]
    assert [x.split(" ")[1] for x in got] == ["value=1i"] * 6 + ["value=2i"] and got[6].endswith(" 1136160010")


def test_iql_forced_settings(spark):
    s = iql.Settings(database="mine", precision="ms", batch_size=100, forced=frozenset({"database", "precision", "batchsize", "startdate"}))
    r = iql.run(spark, SCRIPT, s)
    assert s.database == "mine" and r.batches == 1 and lines(r)[0].endswith(" 1451606400000")


def test_iql_errors_and_error_words(spark):
    for bad, what in (("INSERT\nm,t=[float inc(0) 0]\nv=1\n1 1s\n", "finite cardinality"), ("INSERT\nm,t=[a\nv=1\n1 1s\n", "unterminated"), ("INSERT\nm v=1\n", "without"), ("INSERT\nm\nv=1\n0 1s\n", "positive")):
        with pytest.raises(iql.IqlError, match=what):
            iql.run(spark, bad)
    with pytest.raises(iql.IqlError, match="database is required for iql ingest"):
        iql.run(spark, "INSERT\nm\nv=1\n1 1s\n", dry_run=False)
    r = iql.run(spark, "INSERT\nm\na=[bool inc(1) 0],b=[int dec(1) 0],c=[float dec(1) 0],d=[str inc(1) 0]\n1 1s\n")
    assert lines(r)[0].startswith("m a=IQL_TEMPLATE_ERROR,b=IQL_INT_ERROR,c=IQL_FLOAT_ERROR,d=IQL_STR_ERROR ")
    assert iql.run(spark, "QUERY\nx\nDO 3\n").skipped_queries == 3


def test_iql_random_values(spark):
    text = "INSERT\nm\na=[int rand(10) 0],b=[int rand(0) 0],c=\"[str rand(5) 0]\",d=[float rand(100) 3]\n3000 1s\n"
    got = [dict(p.split("=") for p in x.split(" ")[1].split(",")) for x in lines(iql.run(spark, text))]
    assert got == [dict(p.split("=") for p in x.split(" ")[1].split(",")) for x in lines(iql.run(spark, text, partitions=7))]
    assert {x["a"] for x in got} == {f"{i}i" for i in range(10)} and {x["b"] for x in got} == {"0i"}
    assert len({x["c"] for x in got}) > 2900 and all(len(x["c"]) == 7 for x in got) and len({x["d"] for x in got}) <= 3
