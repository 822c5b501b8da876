import datetime as dt
import io
import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidegrid import cli, completion, config, render
from tidegrid.functions import epoch, text
from tidegrid.operators import series
from tidegrid.plans.lexer import QueryError
from tidegrid.session import Session
from tidegrid.sources import history, lineproto
from tidegrid.sources.catalog import Catalog, RetentionPolicy
from tidegrid.streaming.watch import Watch


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog(spark)
    c.create_database("metrics", [RetentionPolicy("autogen", default=True), RetentionPolicy("short", "24h0m0s", "1h0m0s")])
    c.create_database("telegraf", [RetentionPolicy("raw", "720h0m0s", "24h0m0s", default=True)])
    t = dt.datetime(2026, 7, 4)
    frame = lambda f, kind, tag: spark.createDataFrame([(t, "a", 1.0), (t + dt.timedelta(minutes=1), "b", 2.0)], f"ts timestamp, {tag} string, {f} {kind}")
    cpu = frame("value", "double", "host").withColumn("region", F.lit("west")).withColumn("usage_idle", F.lit(3.5))
    c.register("metrics", "autogen", "cpu", cpu, "ts", ["region", "host"], ["value", "usage_idle"])
    c.register("metrics", "autogen", "mem", frame("used_percent", "double", "host"), "ts", ["host"], ["used_percent"])
    c.register("metrics", "autogen", "disk", frame("used_bytes", "double", "path").withColumn("used_bytes", F.col("used_bytes").cast("long")), "ts", ["path"], ["used_bytes"])
    return c


def rows(df):
    return [tuple(r) for r in df.collect()]


# Catalog and session.


def test_listings(catalog):
    assert rows(catalog.show_measurements("metrics")) == [("cpu",), ("disk",), ("mem",)]
    assert rows(catalog.schema("metrics", None, "cpu")) == [("cpu", "field", "usage_idle", "float"), ("cpu", "field", "value", "float"), ("cpu", "tag", "host", ""), ("cpu", "tag", "region", "")]
    assert ("disk", "used_bytes", "integer") in rows(catalog.field_keys("metrics"))
    assert [r[1] for r in rows(catalog.show_retention_policies("metrics"))] == ["autogen", "short"]


def test_default_policy(spark):
    c = Catalog(spark)
    c.create_database("one", [RetentionPolicy("only")])
    c.create_database("two", [RetentionPolicy("a"), RetentionPolicy("b")])
    c.create_database("none", [])
    assert c.default_policy("one") == "only"
    for db in ("two", "none", "missing"):
        with pytest.raises(LookupError):
            c.default_policy(db)


def test_use_db_and_policy(spark, catalog):
    s = Session(spark, catalog)
    for command, want in ((":use metrics", ("metrics", "autogen")), (":db telegraf", ("telegraf", "raw")), (":use metrics.short", ("metrics", "short")), (":rp autogen", ("metrics", "autogen"))):
        assert rows(s.execute(command).df) == [want]
    assert s.execute(":rps").df.count() == 2 and s.execute(":rps telegraf").df.count() == 1 and Session(spark, catalog).execute(":rps").df.count() == 3
    assert s.execute(":schema cpu").kind() == "schema" and rows(s.execute(":tags disk").df) == [("disk", "path")]
    assert s.execute(":fields").df.columns == ["measurement", "field", "type"] and s.execute(":help").df.count() == 12
    assert dict(rows(s.execute(":status").df))["database"] == "metrics" and s.prompt() == "metrics.autogen> "
    s.execute(":refresh schema")
    for bad in (":nothing", ":use", ":schema", ":explain x", ":use metrics."):
        with pytest.raises(QueryError):
            s.execute(bad)
    assert "usage" in s.error and s.latency > 0


def test_results_have_series(spark, catalog):
    s = Session(spark, catalog, "metrics", "autogen")
    r = s.execute("SELECT value FROM cpu GROUP BY host")
    assert r.kind() == "series" and sorted(rows(r.series.select("name", F.col("tags")["host"], "value"))) == [("value", "a", 1.0), ("value", "b", 2.0)]
    assert s.execute("SELECT value FROM cpu WHERE host = 'x'").kind() == "empty" and s.execute("SHOW MEASUREMENTS").kind() == "table"
    assert "value{host=a}" in render.render(r.df, "auto", r.series) and "points=1" in render.render(r.df, "sparkline", r.series)


def test_cache_expires_and_clears(catalog):
    made = []
    catalog.cached(("k",), lambda: made.append(1))
    catalog.cached(("k",), lambda: made.append(1))
    assert len(made) == 1
    catalog.refresh()
    catalog.cached(("k",), lambda: made.append(1))
    assert len(made) == 2


# Completion.


@pytest.mark.parametrize(
    ("line", "want"),
    [
        (":us", [":use"]),
        (":use m", ["metrics", "metrics.autogen", "metrics.short"]),
        (":rp s", ["short"]),
        (":schema c", ["cpu"]),
        ("SELECT * FROM c", ["cpu"]),
        ("SELECT * FROM cpu WHERE ", ["host", "region"]),
        ("SELECT mean(value) FROM cpu GROUP BY h", ["host"]),
        ("sel", ["SELECT"]),
        ("SELECT value FROM cpu LI", ["LIMIT"]),
        ("SHOW re", ["RETENTION POLICIES"]),
        ("SELECT value FROM cpu LIMIT 1 o", ["OR", "ORDER BY"]),
    ],
)
def test_completion(catalog, line, want):
    assert completion.complete(catalog, line, None, "metrics", "autogen").candidates == want


def test_completion_inside_select(catalog):
    q = "SELECT max(mean(u FROM cpu"
    assert completion.complete(catalog, q, 17, "metrics", "autogen").candidates == ["usage_idle", "used_bytes", "used_percent"]
    assert completion.complete(catalog, "SELECT  FROM cpu", 7, "metrics", "autogen").candidates == ["FROM", "GROUP BY", "LIMIT", "ORDER BY", "WHERE", "host", "region", "usage_idle", "value"]
    assert [completion.measurement_of(x) for x in ("SELECT a FROM cpu", 'SELECT a FROM "rp"."cpu"', 'SELECT a FROM "cpu load" WHERE x', "SHOW MEASUREMENTS", "SELECT f(a FROM b")] == ["cpu", "cpu", "cpu load", "", ""]


def test_line_editor_candidates(catalog, monkeypatch):
    assert completion.suffixes(catalog, "SELECT value FROM c", None, "metrics", "autogen") == ["pu"]
    monkeypatch.setattr(completion, "complete", lambda *a: time.sleep(0.5))
    assert completion.suffixes(catalog, "SEL", seconds=0.01) == []


# History.


def test_history(tmp_path, spark):
    s = history.Store(tmp_path / "h.jsonl")
    for q in ("SELECT cpu", "show databases", "  ", "SELECT mem"):
        s.append(q, "metrics")
    assert [e["id"] for e in s.search("", 2)] == [3, 2] and [e["id"] for e in s.search("CPU")] == [1] and len(s.search("metrics")) == 3
    assert oct(s.path.stat().st_mode & 0o777) == "0o600"
    assert rows(history.load(spark, str(s.path)).select("id", "query").orderBy("id")) == [(1, "SELECT cpu"), (2, "show databases"), (3, "SELECT mem")]


def test_history_compacts_and_skips_bad_lines(tmp_path):
    s = history.Store(tmp_path / "h.jsonl", max_entries=2)
    for q in "abc":
        s.append(q)
    with s.path.open("a") as f:
        f.write("not json\n[]\n" + json.dumps({"query": ""}) + "\n")
    assert [e["query"] for e in s.search()] == ["c", "b"]
    assert history.Store(tmp_path / "missing").search() == []


# Line protocol.


def test_escapes(spark):
    row = spark.createDataFrame([("host=1,west a", 'quoted "value"', 123)], "`host name` string, `field name` string, time_ns long")
    assert row.select(lineproto.line("demo cpu,main", ["host name"], ["field name"], row)).first()[0] == r'demo\ cpu\,main,host\ name=host\=1\,west\ a field\ name="quoted \"value\"" 123'


def test_kinds_and_blank_parts(spark):
    row = spark.createDataFrame([("", None, 1.5, 7, True, None, 1_500_000_000)], "a string, b string, f double, i long, t boolean, n double, time_ns long")
    assert row.select(lineproto.line("m", ["a", "b"], ["f", "i", "t", "n"], row, "s")).first()[0] == "m f=1.500,i=7i,t=true 1"
    bad = spark.createDataFrame([("",), ("# note",), ("no fields",), ("m f=1",)], "line string")
    assert rows(lineproto.parse(bad).select("measurement", "time_ns")) == [(None, None), ("m", None)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(st.characters(blacklist_categories=("Cs", "Cc", "Z")), min_size=1, max_size=6).filter(lambda s: "\\" not in s), st.text(st.characters(blacklist_categories=("Cs", "Cc")), max_size=6), st.integers(-(2**40), 2**40)), min_size=1, max_size=20))
def test_lines_round_trip(spark, cases):
    df = spark.createDataFrame([(i, a, b, n, n) for i, (a, b, n) in enumerate(cases)], "id int, tag string, note string, n long, time_ns long")
    p = lineproto.parse(df.select("id", lineproto.line("m x", ["tag"], ["note", "n"], df).alias("line")))
    got = rows(p.select("measurement", F.col("tags")["tag"], lineproto.typed(F.col("fields")["note"], "string"), lineproto.typed(F.col("fields")["n"], "integer"), "time_ns").orderBy("id"))
    assert got == [("m x", a, b, n, n) for a, b, n in cases]


def test_write_and_read(spark, tmp_path):
    lines = spark.createDataFrame([("cpu,host=a value=1.500,up=true 10",), ("cpu,host=b value=2.500,n=7i 20",), ("",)], "line string")
    lineproto.write(lines, str(tmp_path), "db", unit="s")
    got = lineproto.read(spark, str(tmp_path), "db", "autogen", "cpu", ["host"], {"value": "float", "n": "integer", "up": "boolean"}).orderBy("time")
    assert rows(got) == [(dt.datetime(1970, 1, 1, 0, 0, 10), 10**10, "a", 1.5, None, True), (dt.datetime(1970, 1, 1, 0, 0, 20), 2 * 10**10, "b", 2.5, 7, None)]
    with pytest.raises(ValueError):
        lineproto.write(lines, str(tmp_path), "")


# Functions and series operators.


def test_precisions():
    assert [epoch.precision(x) for x in ("", "rfc3339", "n", "us", "MS", "h")] == ["ns", "ns", "ns", "u", "ms", "h"]
    assert [epoch.write_precision(x) for x in ("", "rfc3339nano", "ns", "us", "S")] == ["", "", "n", "u", "s"]
    assert epoch.asks_for_epoch("ns") and not epoch.asks_for_epoch("n") and not epoch.asks_for_epoch("rfc3339")


@pytest.mark.parametrize("unit", ["h", "m", "s", "ms", "u", "ns"])
def test_epochs_round_trip_and_overflow(spark, unit):
    df = spark.createDataFrame([(n,) for n in (-3, -1, 0, 1, 400_000)], "n long")
    assert all(a == b for a, b in rows(df.where("n >= 0" if unit in "hm" else "true").select("n", epoch.encode(epoch.ns_to_time(epoch.to_ns(F.col("n") * (1000 if unit == "ns" else 1), unit)), unit) / (1000 if unit == "ns" else 1))))
    assert rows(spark.range(1).select(epoch.to_ns(F.lit(2**62), "h"), epoch.text_to_ns(F.lit("1e300"), "s"), epoch.text_to_ns(F.lit("x"), "s"))) == [(None, None, None)]


def test_formats():
    assert [text.format_float(x) for x in (2.5, 100000.0, 0.00012345)] == ["2.5", "1e+05", "0.0001234"]
    assert [text.format_value(x) for x in (None, True, 1.0, 1e21, "a\n\tb ", dt.datetime(2026, 1, 2, 3, 4, 5, 600000))] == ["", "true", "1", "1000000000000000000000", "a b", "2026-01-02T03:04:05.6Z"]
    assert [text.truncate("abcdef", w) for w in (10, 5, 2)] == ["abcdef", "ab...", "ab"]
    assert [text.truncate_cells("潮汐表格", w) for w in (8, 7, 5, 4, 3, 2, 0)] == ["潮汐表格", "潮汐...", "潮...", "....", "...", "..", ""]
    assert text.cell_width("e\u0301x") == 2 and text.truncate_cells("e\u0301xyz", 4) == "e\u0301xyz"
    assert text.quote_identifier('a."b"') == '"a"."b"' and text.clean_identifier('"db"."rp"."m x"') == "m x"


def long(spark, values, name="cpu", tags=None):
    t = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(name, tags, t + dt.timedelta(seconds=i), v) for i, v in enumerate(values)], "name string, tags map<string,string>, time timestamp, value double")


@settings(max_examples=6, deadline=None)
@given(st.integers(1, 300), st.integers(1, 60))
def test_downsampling_takes_every_point_once(spark, n, width):
    df = spark.range(n).select(F.lit("s").alias("name"), "id", F.col("id").cast("double").alias("value"))
    got = {r["bucket"]: (r["value"], r["points"]) for r in series.downsample(df, ["name"], ["id"], width).collect()}
    if n <= width:
        assert got == {i: (float(i), 1) for i in range(n)}
    else:
        edges = [j * n // width for j in range(width + 1)]
        assert got == {j: (sum(range(a, b)) / (b - a), b - a) for j, (a, b) in enumerate(zip(edges, edges[1:]))}


def test_sparkline_and_chart(spark):
    s = render.sparkline(long(spark, [-1.0, 2.0], tags={"host": "a"}))
    assert s == "cpu{host=a}  ▁█  min=-1 max=2 avg=0.5 points=2"
    assert render.sparkline(long(spark, [7.0, 7.0, 7.0])).split("  ")[1] == "▅▅▅"
    reduced, _ = render.reduced(long(spark, [-5.0, -2.0, 0.0, 2.0, 4.0, 8.0]), 3)
    assert reduced[0].values == [-3.5, 1.0, 6.0] and reduced[0].low == -5
    c = render.chart(long(spark, [1.0, 4.0, 2.0, 8.0]), 32)
    assert "points=4" in c and c.count("*") == 4 and "|" in c
    assert render.chart(long(spark, [float("nan"), None]), max(1, 32)) == render.NO_POINTS
    two = long(spark, [1.0]).unionByName(long(spark, [2.0], "mem"))
    assert render.sparkline(two, most=1).endswith("... 1 more series")


def test_table(spark):
    df = spark.createDataFrame([("cpu", 1), ("mem", 2)], "name string, n int")
    assert render.table(df, 1) == "name  n\n----  -\ncpu   1\n... 1 more rows" and render.table(df.limit(0)) == "no rows"
    assert render.limited([50, 50, 4], 40) == [16, 16, 4] and render.limited([60, 3], None) == [48, 3]
    assert json.loads(render.as_json(df))["rows"][1] == {"name": "mem", "n": 2}
    whole = json.loads(render.render(spark.range(500), "json"))
    assert len(whole["rows"]) == 500 and whole["series"] is None and whole["metadata"]["rows"] == 500
    with_series = json.loads(render.as_json(df, long(spark, [1.0, 2.0], tags={"host": "a"}), {"kind": "select"}))
    assert [p["value"] for p in with_series["series"][0]["points"]] == [1.0, 2.0] and with_series["metadata"] == {"kind": "select", "rows": 2, "points": 2, "series": 1}
    assert [render.summary(*x) for x in ((None,), (3,), (300, 5, 2), (0, 1))] == ["", "rows 3", "rows 300 shown 200, points 5, series 2", "rows 0, points 1"]
    assert render.result_summary(df, long(spark, [1.0, 2.0])) == "rows 2, points 2, series 1"
    with pytest.raises(ValueError):
        render.normalize_format("odd")


# Watch, configuration, command line.


def test_watch_keeps_the_last_good_result(spark):
    state = {"fail": False, "n": 0}

    def run():
        state["n"] += 1
        if state["fail"]:
            raise RuntimeError("broken")
        return spark.range(state["n"])

    w = Watch(spark, run, lambda df: df.count(), 0.1)
    assert w.seconds == 1 and w.adjust(10_000) == 3600
    assert w.refresh() and w.result == 1
    state["fail"] = True
    assert not w.refresh() and w.result == 1 and "broken" in w.error
    w._busy.acquire()
    assert not w.refresh() and w.dropped == 1
    w._busy.release()
    state["fail"] = False
    w.seconds = 0.05
    w.start()
    while w.refreshes < 3:
        pass
    w.stop()
    assert w.result >= 3


def test_statement_of_a_watch():
    from tidegrid.streaming.watch import choose

    assert [choose(*x) for x in (("new", "last", True), ("new", "last", False), ("", "last", False), ("new", "", True))] == ["last", "new", "last", "new"]


def test_watch_command(spark, catalog, monkeypatch):
    out, n = [], []
    session = Session(spark, catalog, "metrics", "autogen")
    monkeypatch.setattr(cli.time, "sleep", n.append)
    args = cli.parser().parse_args(["watch", "SELECT count(value) FROM cpu", "--times", "2", "--every", "1"])
    assert cli.watch(session, args, config.resolve({}, {}, None), out.append) == 0 and len(out) == 2 and "count" in out[0] and len(n) == 1
    args.text = "SELECT nothing FROM cpu"
    assert cli.watch(session, args, config.resolve({}, {}, None), out.append) == 1 and out[-1].startswith("error")


def test_lines_that_are_odd(spark):
    """Repeated keys, escapes, quotes and broken pairs beside plain lines."""
    given_ = ["m,a=1,a=2,b=x v=1,v=2 5", "m,a=1 v=1", "m v=1i,w=t 7", r'm\ 2,a\,b=c\=d v="x, y=z" 9', "m,a v=1", "m", "# note", " ", "m,a=1 v=x=y 3"]
    got = {r["line"]: r for r in lineproto.parse(spark.createDataFrame([(x, x) for x in given_], "line string, own string").withColumnRenamed("own", "copy").select("line", "copy"), column="copy").collect()}
    assert len(got) == 7
    one = got[given_[0]]
    assert one["tags"] == {"a": "2", "b": "x"} and one["fields"] == {"v": "2"} and one["time_ns"] == 5
    assert got[given_[1]]["time_ns"] is None and got[given_[2]]["tags"] == {} and got[given_[2]]["fields"] == {"v": "1i", "w": "t"}
    assert got[given_[3]]["measurement"] == "m 2" and got[given_[3]]["tags"] == {"a,b": "c=d"} and got[given_[3]]["fields"] == {"v": '"x, y=z"'}
    assert got[given_[4]]["tags"] == {} and got["m"]["measurement"] is None and got[given_[8]]["fields"] == {"v": "x=y"}


def test_ranks_by_slices(spark):
    """Places of points in their series, whatever the order column is: spread, all equal, text, negative."""
    rows_ = [(s, t, k) for s in "ab" for k, t in enumerate([5, 5, 5, -7, 100, 3, 3, 10**12, 0] * 3)]
    df = spark.createDataFrame(rows_, "s string, t long, k int")
    for order in (["t", "k"], ["k", "t"]):
        got = {(r["s"], r["k"]): (r["__i"], r["__n"]) for r in series.ranks(df, ["s"], order, 7).collect()}
        for s in "ab":
            mine = sorted((x for x in rows_ if x[0] == s), key=lambda x: (x[1], x[2]) if order[0] == "t" else (x[2], x[1]))
            assert [got[s, k] for _, _, k in mine] == [(i, 27) for i in range(27)]
    named = series.ranks(df.withColumn("t", F.col("t").cast("string")), ["s"], ["t", "k"]).agg(F.max("__i"), F.min("__n")).first()
    assert tuple(named) == (26, 27)


def test_history_of_many_parts(spark, tmp_path):
    lines = [json.dumps({"query": f"q{i}"}) if i % 10 else "broken" for i in range(300)]
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("\n".join(lines[k * 100 : (k + 1) * 100]))
    got = sorted((r["id"], r["query"]) for r in history.load(spark, str(tmp_path)).collect())
    assert [i for i, _ in got] == list(range(1, 271)) and len({q for _, q in got}) == 270


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    from tidegrid import scratch

    conf = SimpleNamespace(get=lambda *a: None)
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_configuration(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("default: prod\nprofiles:\n  local:\n    database: here\n  prod:\n    database: there  # note\n    max_rows: 7\n    token: secret\n    color: off\n")
    c = config.resolve({"format": "json", "database": None}, {"TIDEGRID_MAX_ROWS": "9"}, p)
    assert (c.profile, c.database, c.max_rows, c.format, c.color) == ("prod", "there", 9, "json", False)
    assert "token=***" in c.redacted() and config.resolve({"profile": "local"}, {}, p).database == "here" and config.resolve({}, {}, None).max_rows == 200
    for text_, what in (("profiles:\n  a:\n    url: x\n", "url"), ("profiles:\n  a:\n    odd: x\n", "unknown"), ("x", "key: value")):
        with pytest.raises(config.ConfigError, match=what):
            config.parse_profiles(text_)
    with pytest.raises(config.ConfigError):
        config.resolve({"profile": "none"}, {}, p)


def test_repl_and_command_line(spark, catalog, tmp_path):
    out, store = [], history.Store(tmp_path / "h")
    cli.repl(Session(spark, catalog, "metrics", "autogen"), io.StringIO("SELECT value\nFROM cpu;\n:format json\nSHOW MEASUREMENTS\nSELECT nothing FROM cpu\n:history cpu\n:dbs\n:q\nSHOW DATABASES\n"), out.append, "table", store)
    assert "value" in out[0] and any("unknown field" in x for x in out) and [e["query"] for e in store.search()] == ["SHOW MEASUREMENTS", "SELECT value\nFROM cpu"]
    lines = []
    assert cli.main(["ingest", "stress-basic", "--points", "2", "--series", "3", "--start", "2006-01-02", "--dry-run", "--batch-size", "4"], lines.append) == 0
    assert len(lines) == 6 and lines[0].endswith("1136160010000000000")
    shown = []
    assert cli.main(["config", "show"], shown.append) == 0 and "database=-" in shown[0]
