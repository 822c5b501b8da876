import datetime as dt

import pytest
from tidegrid.plans import lexer, parser
from tidegrid.plans.compiler import Compiler
from tidegrid.sources.catalog import Catalog, RetentionPolicy

NOW = dt.datetime(2024, 1, 1, 6)


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(dt.datetime(2024, 1, 1, h, m), host, float(h * 60 + m) if not (h == 2 and host == "b") else None, h) for h in range(5) for m in (0, 20, 40) for host in ("a", "b") if not (h == 3 and host == "a")]
    df = spark.createDataFrame(rows, "ts timestamp, host string, usage double, n int")
    c = Catalog(spark)
    c.create_database("metrics", [RetentionPolicy("autogen", default=True), RetentionPolicy("short")])
    c.register("metrics", "autogen", "cpu load", df, "ts", ["host"], ["usage", "n"])
    c.register("metrics", "short", "cpu", df, "ts", ["host"], ["usage", "n"])
    return c


@pytest.fixture(scope="module")
def run(spark, catalog):
    return lambda text: Compiler(spark, catalog, "metrics", "autogen", lambda: NOW).run(text)


def test_names_and_star(run):
    assert run('SELECT * FROM "cpu load"').columns == ["time", "host", "n", "usage"]
    assert run('SELECT usage FROM "short"."cpu"').count() == run('SELECT usage FROM "metrics"."short"."cpu"').count() == 27
    assert run('SELECT usage FROM "metrics".."cpu load"').count() == 27
    for bad in ("SELECT nothing FROM short.cpu", "SELECT usage FROM nowhere", "SELECT f(usage) FROM short.cpu", "SELECT mean(usage), usage FROM short.cpu", "SELECT usage FROM short.cpu GROUP BY usage"):
        with pytest.raises((lexer.QueryError, KeyError)):
            run(bad)


def test_time_bounds_and_clock(run):
    assert run("SELECT usage FROM short.cpu WHERE time >= now() - 2h AND time < now() - 1h - 30m").count() == 4
    assert run("SELECT usage FROM short.cpu WHERE '2024-01-01T04:00:00Z' <= time").count() == 6
    assert run("SELECT usage FROM short.cpu WHERE time = 1704067200000000000").count() == 2
    assert run("SELECT now()").first()[0] == NOW


def test_fill_kinds(run):
    q = "SELECT mean(usage) FROM short.cpu WHERE time >= '2024-01-01T01:00:00Z' AND time < '2024-01-01T05:00:00Z' GROUP BY time(1h), host FILL({})"
    get = lambda how: {(r["host"], r["time"].hour): r["mean"] for r in run(q.format(how)).collect()}
    assert get("null")["a", 3] is None and get("null")["b", 2] is None and len(get("null")) == 8
    assert get("-1")["a", 3] == -1 and get("-1")["b", 2] == -1
    assert get("previous")["a", 3] == 140 and get("previous")["b", 2] == 80
    assert get("linear")["a", 3] == 200 and get("linear")["b", 2] == 140
    assert len(get("none")) == 7


def test_bounds_of_data_without_a_where(run):
    rows = run("SELECT count(usage) FROM short.cpu GROUP BY time(30m) FILL(0)").collect()
    assert [r["time"] for r in rows] == [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * i) for i in range(10)]


def test_limits_per_series_and_series_limits(run):
    got = run("SELECT usage FROM short.cpu GROUP BY host ORDER BY time DESC LIMIT 2 OFFSET 1").collect()
    assert sorted((r["host"], r["time"].minute) for r in got) == [("a", 0), ("a", 20), ("b", 0), ("b", 20)]
    assert {r["host"] for r in run("SELECT mean(usage) FROM short.cpu GROUP BY host SLIMIT 1 SOFFSET 1").collect()} == {"b"}
    assert {r["host"] for r in run("SELECT mean(usage) FROM short.cpu GROUP BY *").collect()} == {"a", "b"}


def test_statements_comments_and_dialects(run):
    got = run("SELECT count(n) FROM short.cpu -- one; two\n; /* x; */ SELECT max(n) AS top FROM short.cpu")
    assert got.columns == ["statement", "count", "top"] and [tuple(r) for r in got.orderBy("statement").collect()] == [(0, 27, None), (1, None, 4)]
    with pytest.raises(lexer.QueryError, match="flux"):
        run('from(bucket: "x") |> range(start: -1h)')
    assert lexer.kind("SHOW databases") == "show" and lexer.kind(":schema cpu") == "schema" and lexer.kind(" explain select 1") == "explain" and lexer.kind(":x") == "meta"
    assert any("Scan" in r[0] for r in run("EXPLAIN SELECT usage FROM short.cpu").collect())


def test_parser_refuses():
    for bad in ("SELECT", "SELECT a FROM", "SELECT a FROM b WHERE", "SELECT a FROM b GROUP BY time(x)", "SELECT a FROM b LIMIT x", "SELECT a FROM b FILL(odd)", "SELECT 'a FROM b", "SHOW nothing", "SELECT a FROM b c", "SELECT a FROM a.b.c.d", "DROP x"):
        with pytest.raises(lexer.QueryError):
            parser.parse(bad)
    q = parser.parse("SELECT max(f) AS m FROM x WHERE a =~ /b\\/c/ GROUP BY time(1h30m, -5m), t FILL(-2) ORDER BY time DESC")
    assert (q.every_ns, q.offset_ns, q.tags, q.fill, q.descending, q.where.right.value) == (5400 * 10**9, -300 * 10**9, ["t"], -2, True, "b/c")


@pytest.mark.parametrize(
    ("lines", "done"),
    [
        (["SELECT a \\", "FROM b"], None),
        (["SELECT a", "FROM b;"], "SELECT a\nFROM b"),
        (["SELECT ';", "' FROM b;"], "SELECT ';\n' FROM b"),
        (["SELECT a FROM b"], "SELECT a FROM b"),
        (["SELECT a FROM b;"], "SELECT a FROM b"),
        (["SELECT a FROM b WHERE x = 1 and"], None),
        (["SELECT mean(a", ") FROM b;"], "SELECT mean(a\n) FROM b"),
        (["SELECT now()"], "SELECT now()"),
        (["from(bucket: 1) |>", "range(start: 1);"], "from(bucket: 1) |>\nrange(start: 1)"),
        (["SELECT a FROM brand"], None),
    ],
)
def test_statement_buffer(lines, done):
    b = lexer.StatementBuffer()
    got = [b.add(x) for x in lines]
    assert got[:-1] == [None] * (len(lines) - 1) and got[-1] == done


def test_neighbours_and_choices(run):
    rows = lambda q: [tuple(r) for r in run(q).collect()]
    assert {r[2] for r in rows("SELECT difference(usage) FROM short.cpu GROUP BY host")} == {20.0, 80.0, 140.0 - 60.0} | {200.0 - 80.0 - 40.0}
    assert rows("SELECT moving_average(max(usage), 2) AS m, cumulative_sum(count(usage)) AS c FROM short.cpu WHERE host = 'b' GROUP BY time(1h)")[0][1:] == (None, 3)
    assert [r[-1] for r in rows("SELECT top(usage, 2) FROM short.cpu GROUP BY host ORDER BY time")] == [260.0, 280.0] * 2
    assert sorted(r[-1] for r in rows("SELECT distinct(n) FROM short.cpu")) == [0, 1, 2, 3, 4]
    assert rows("SELECT count(distinct(n)) AS c FROM short.cpu WHERE host = 'a'") == [(4,)]
    assert run("SELECT mean(*) FROM short.cpu").columns == ["mean_n", "mean_usage"] and run("SELECT max(mean(*)) FROM short.cpu GROUP BY time(1h)").columns == ["max_n", "max_usage"]
    assert rows("SELECT usage / 0 AS a, n % 0 AS b FROM short.cpu LIMIT 1")[0][1:] == (None, None)
    for bad in ("SELECT difference(usage), usage FROM short.cpu", "SELECT top(usage) FROM short.cpu", "SELECT derivative(mean(usage)) FROM short.cpu", "SELECT 1 + difference(usage) FROM short.cpu", "SELECT moving_average(usage) FROM short.cpu", "SELECT top(usage, 1), n FROM short.cpu", "SELECT elapsed(usage, 3) FROM short.cpu"):
        with pytest.raises(lexer.QueryError):
            run(bad)


def test_patterns_into_series_and_drop(spark):
    c = Catalog(spark)
    made = []
    for k, name in enumerate(("tide", "tidal gauge", "wind")):
        df = spark.createDataFrame([(dt.datetime(2020, 1, 1, h), f"port {p}", float(h + k)) for h in range(3) for p in "ab"], "ts timestamp, port string, level double")
        c.register_later("sea", "autogen", name, lambda df=df: made.append(1) or df, "ts", ["port"], ["level"])
    c.create_database("sea", [RetentionPolicy("autogen", default=True)])
    run = lambda q: Compiler(spark, c, "sea", "autogen").run(q)
    assert [r["name"] for r in run("SHOW MEASUREMENTS").collect()] == ["tidal gauge", "tide", "wind"] and not made
    assert {r["measurement"]: r["count"] for r in run("SELECT count(level) FROM /^tid/").collect()} == {"tide": 6, "tidal gauge": 6}
    assert len(made) == 2
    assert [r["key"] for r in run('SHOW SERIES FROM "tidal gauge"').collect()] == [f"tidal\\ gauge,port=port\\ {p}" for p in "ab"]
    assert len(run("SHOW TAG VALUES WITH KEY = port").collect()) == 6 and run("SHOW TAG VALUES WITH KEY = none").collect() == []
    assert run("SELECT max(level) INTO peak FROM wind GROUP BY port").first()["written"] == 2
    assert [tuple(r) for r in run("SELECT max FROM peak GROUP BY port").select("port", "max").collect()] == [("port a", 4.0), ("port b", 4.0)]
    run("DROP MEASUREMENT wind")
    with pytest.raises(KeyError):
        run("SELECT level FROM wind")
    with pytest.raises(lexer.QueryError):
        run("SELECT level FROM /nothing/")
    assert c.ping()
    run("DROP DATABASE sea")
    assert run("SHOW DATABASES").collect() == []


def test_sketched_quantiles(run):
    got = run("SELECT median_approx(usage) AS m, percentile_approx(usage, 90) AS p, median(usage) AS e FROM short.cpu").first()
    assert abs(got["m"] - got["e"]) <= 20 and got["p"] >= 240
