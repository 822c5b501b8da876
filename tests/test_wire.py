"""Responses against a small normalizer written from the rules, over bodies made up here."""

import datetime as dt
import json
import random

import pytest
from tidegrid.sources.wire import WireError, normalize, raw_results

NOON = dt.datetime(2019, 3, 21, 12)


def series(name, columns, values, tags=None):
    return {"name": name, "columns": columns, "values": values} | ({"tags": tags} if tags else {})


def body(*parts):
    """A body with a result for each list of series."""
    return json.dumps({"results": [{"statement_id": i, "series": p} for i, p in enumerate(parts)]})


def run(spark, *bodies, precision=""):
    return normalize(spark.createDataFrame([(b,) for b in bodies], "body string"), precision)


def text_of(cell):
    return None if cell is None else str(cell).lower() if isinstance(cell, bool) else str(cell)


def by_hand(text):
    """(columns, rows as text, points) of a body with integer, text and boolean cells and times in seconds or as text."""
    results = json.loads(text)["results"]
    every = [(r.get("statement_id", 0), s) for r in results for s in r.get("series", [])]
    tags = sorted({k for _, s in every for k in s.get("tags", {})})
    lead = (["statement"] if len(results) > 1 else []) + (["measurement"] if tags or len(every) > 1 else []) + tags
    names = list(dict.fromkeys(lead + [c for _, s in every for c in s["columns"]]))
    rows, points = [], []
    for statement, s in every:
        for row in s["values"]:
            own = {"statement": str(statement), "measurement": s["name"], **s.get("tags", {})}
            cells = dict(zip(s["columns"], row))
            rows.append(tuple(text_of(cells.get(n)) if cells.get(n) is not None else own.get(n) for n in names))
            time = next((v for c, v in cells.items() if c.lower() == "time"), None)
            if time is None or time == "never":
                continue
            at = int(dt.datetime.fromisoformat(time).timestamp()) * 10**9 if isinstance(time, str) else time
            for c, v in cells.items():
                if c.lower() != "time" and isinstance(v, (int, float)) and not isinstance(v, bool):
                    points.append((s["name"] if c in ("value", "mean") else f"{s['name']}.{c}", tuple(sorted(s.get("tags", {}).items())), at, float(v)))
    return names, rows, sorted(points)


def check(spark, text):
    r = run(spark, text)
    names, rows, points = by_hand(text)
    assert r.columns == names and [tuple(x) for x in r.table.collect()] == rows
    assert sorted((p["name"], tuple(sorted((p["tags"] or {}).items())), p["time_ns"], p["value"]) for p in r.series.collect()) == points
    return r


def stamp(minutes):
    return (NOON + dt.timedelta(minutes=minutes)).isoformat() + "Z"


def test_names_only_is_a_table(spark):
    r = check(spark, body([series("policies", ["name"], [["keep"], ["weekly"], ["forever"]])]))
    assert r.kind() == "table" and r.counters() == {"statements": 1, "rows": 3, "points": 0, "series": 0}


def test_points_and_null_cells(spark):
    r = check(spark, body([series("tide", ["time", "mean"], [[stamp(10 * i), None if i == 1 else 40 + i * i] for i in range(5)], {"port": "brest"})]))
    assert r.kind() == "series" and r.counters() == {"statements": 1, "rows": 5, "points": 4, "series": 1}


def test_made_up_responses(spark):
    """Any number of statements and series; tags that differ, rows that are short or long, cells of every kind."""
    rng = random.Random(11)
    for _ in range(6):
        results = []
        for _ in range(rng.randint(1, 3)):
            own = []
            for name in rng.sample(["tide", "wind", "swell"], rng.randint(0, 3)):
                columns = ["time", *rng.sample(["value", "height", "gust", "port"], rng.randint(1, 3))]
                cell = lambda: rng.choice([rng.randint(-9, 9), "calm", True, None])
                values = [[rng.choice([stamp(rng.randint(0, 90)), "never"]), *(cell() for _ in range(rng.randint(0, len(columns) + 1)))] for _ in range(rng.randint(0, 4))]
                own.append(series(name, columns, values, {t: t.upper() for t in rng.sample(["port", "zone"], rng.randint(0, 2))}))
            results.append(own)
        check(spark, body(*results))


@pytest.mark.parametrize(("cell", "precision", "ns"), [(86_400_000_000_000, "ns", 86_400 * 10**9), ("25e1", "s", 250 * 10**9), ("0.75", "s", 750_000_000), (31, "ms", 31_000_000), (3, "h", 10_800 * 10**9), (12, "", 12), (9, "u", 9000)])
def test_epochs(spark, cell, precision, ns):
    text = '{"results":[{"series":[{"name":"m","columns":["time","value"],"values":[[%s,1]]}]}]}' % cell
    assert [p["time_ns"] for p in run(spark, text, precision=precision).series.collect()] == [ns]


def test_nanoseconds_survive(spark):
    p = run(spark, body([series("m", ["Time", "value"], [["2019-03-21T12:00:01.000000789Z", 1]])])).series.first()
    assert p["time_ns"] % 10**9 == 789 and p["time"] == NOON + dt.timedelta(seconds=1)


def test_errors_fail_the_whole_response(spark):
    with pytest.raises(WireError, match="no such port"):
        run(spark, json.dumps({"results": [{"series": [series("m", ["time"], [])]}, {"error": "no such port"}]}))
    with pytest.raises(WireError, match="closed"):
        run(spark, json.dumps({"error": "closed"}))


def test_empty_and_raw(spark):
    r = run(spark, '{"results":[{"statement_id":0}]}')
    assert r.kind() == "empty" and r.columns == [] and r.statements == 1
    raw = raw_results(spark.createDataFrame([(body([series("fields", ["fieldKey"], [["height"]])], []),)], "body string"))
    got = raw.selectExpr("result", "statement", "CAST(series AS STRING) AS s").orderBy("result").collect()
    assert [(x["result"], x["statement"]) for x in got] == [(0, 0), (1, 1)] and json.loads(got[0]["s"])[0]["values"] == [["height"]]


def test_two_responses_at_a_time(spark):
    """Nothing is shared between responses that are read side by side."""
    a, b = run(spark, body([series("tide", ["x"], [[1]])])), run(spark, body([series("wind", ["y"], [[2]])]))
    assert [tuple(r) for r in a.table.collect()] == [("1",)] and [tuple(r) for r in b.table.collect()] == [("2",)]
