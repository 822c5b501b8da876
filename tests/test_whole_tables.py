import duckdb
from pyspark.sql import functions as F
from tidegrid.functions import epoch, text
from tidegrid.plans import catalogue
from tidegrid.sources import wire

SF = "/root/testdata/sf0.001"


def test_bodies_hold_every_order_and_stay_bounded(spark):
    one = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority")
    span = one.agg(F.max("o_orderkey")).first()[0] // catalogue._BODY_KEYS * catalogue._BODY_KEYS + catalogue._BODY_KEYS
    many = spark.range(20).select((F.col("id") * span).alias("far")).crossJoin(one).withColumn("o_orderkey", F.col("o_orderkey") + F.col("far"))
    longest = [catalogue._order_bodies(d).agg(F.max(F.length("body"))).first()[0] for d in (one, many)]
    assert longest[0] == longest[1]
    got = wire.normalize(catalogue._order_bodies(one)).series.select("name", F.col("tags")["o_orderstatus"], "time_ns", F.round("value", 6)).collect()
    want = duckdb.sql(f"SELECT 'orders', o_orderstatus, epoch_ns(o_orderdate), round(o_totalprice, 6) FROM '{SF}/orders.parquet'").fetchall()
    assert len(want) == one.count() and sorted(map(tuple, got)) == sorted(want)


def test_whole_texts_are_escaped(spark):
    """Separators behind the first 200 characters too."""
    t = F.col("text")
    got = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", text.escape_measurement(t), text.escape_key(t), text.quote_field(t)).collect()
    want = duckdb.sql(rf"""SELECT doc_id, replace(replace(replace(text, '\', '\\'), ',', '\,'), ' ', '\ '), replace(replace(replace(replace(text, '\', '\\'), ',', '\,'), ' ', '\ '), '=', '\='), '"' || replace(replace(text, '\', '\\'), '"', '\"') || '"' FROM '{SF}/documents.parquet'""").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert max(len(r[1] or "") for r in want) > 1000 and sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_epochs_beyond_the_nanoseconds_of_a_long(spark, tmp_path):
    """Hours after 2262, and halves that a double's text has an exponent for."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    far = spark.createDataFrame([(0,), (3_000_000,), (6_000_000,), (30_000_001,)], "far long")
    e.crossJoin(far).withColumn("event_id", F.col("event_id") + F.col("far")).drop("far").write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.QUERIES["fn_epoch_decode"](spark, str(tmp_path)).collect()
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = duck.execute(catalogue.ORACLE_SQL["fn_epoch_decode"]).fetchall()
    assert len(want) == 4 * e.count() and sorted(map(tuple, got)) == sorted(want)


def test_whole_epochs_to_times(spark):
    """Down to the microsecond below, null beyond its range."""
    n = F.col("id")
    got = spark.createDataFrame([(-1,), (2**62,)], "id long").select(*(epoch.micros(epoch.to_time(n, u)) for u in ("ns", "u", "ms", "s", "m", "h", None))).collect()
    assert list(map(tuple, got)) == [(-1, -1, -1000, -(10**6), -60 * 10**6, -3600 * 10**6, -1), (2**62 // 1000, 2**62, None, None, None, None, 2**62 // 1000)]
