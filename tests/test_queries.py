"""Registered queries on small tables of the relational schema, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import layout
from loomgraph.plans import queries


@pytest.fixture
def tables(spark, tmp_path):
    """A function that writes rows as a table of the folder and returns the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def parts(tables, keys, brand=lambda k: "B", kind=lambda k: "T"):
    rows = [(k, f"n{k}", brand(k), kind(k), 1, 1.0) for k in keys]
    return tables("part", rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")


def links(tables, orders):
    """Each order is a list of parts, of which consecutive ones are linked."""
    rows = [(o, i + 1, k) for o, x in enumerate(orders) for i, k in enumerate(x)]
    return tables("lineitem", rows, "l_orderkey long, l_linenumber int, l_partkey long")


def test_components_of_all_edges(spark, tables):
    r = random.Random(4)
    orders = [[1, 2, 3, 4, 5], [5, 9], [11, 10], [12, 11, 14], *([a, b] for a, b in ((r.randrange(20, 60), r.randrange(20, 60)) for _ in range(25)))]
    parts(tables, range(1, 61))
    d = links(tables, orders)
    root = {k: k for k in range(1, 61)}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in orders:
        for a, b in zip(x, x[1:]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {x.id: x.component for x in queries.connected_components(spark, d).collect()}
    assert got == {k: find(k) for k in root} and got[9] == 1


def test_every_query_has_a_nearest_point(spark, tables):
    keys = [1, 2, 3, 17, 250, 911]
    d = parts(tables, keys)
    sites = [(k, k * 37 % 1000, k * 101 % 1009) for k in keys]
    got = {x["query"]: (x.d2, x.id) for x in queries.nearest_neighbour(spark, d).collect()}
    assert got == {k: min(((k * 53 % 997 - x) ** 2 + (k * 71 % 991 - y) ** 2, i) for i, x, y in sites) for k in keys}


def test_nearest_points_far_off(spark):
    r = random.Random(2)
    pts = [(i, r.gauss(0, 3), r.gauss(0, 3)) for i in range(60)] + [(70, 9000.0, -5e5), (71, 9000.0, -5e5), (72, float("nan"), 0.0), (73, float("inf"), 0.0)]
    q = [(i, r.gauss(0, 10**k), r.gauss(0, 10**k)) for k in range(7) for i in range(8 * k, 8 * k + 8)] + [(90, float("nan"), 0.0), (91, None, 1.0)]
    p, a = spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(q, "query long, x double, y double")
    want = {i: min((x - u) ** 2 + (y - v) ** 2 for _, u, v in pts[:62]) for i, x, y in q[:56]}
    for cell in (None, 1.0):
        got = {x["query"]: x for x in layout.nearest(a, p, cell).collect()}
        assert got.keys() == want.keys() and all(got[i].d2 == pytest.approx(want[i]) and got[i].id != 71 for i in want)
    assert layout.nearest(a, p.limit(0)).count() == 0 == layout.nearest(a.limit(0), p).count()


def test_nearest_points_are_not_broadcast(spark, monkeypatch):
    plans, cut = [], layout.cut
    monkeypatch.setattr(layout, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    pts = spark.range(40).select("id", (F.col("id") * 7 % 40).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert layout.nearest(pts.withColumnRenamed("id", "query"), pts, 0.1).count() == 40
    assert sum("Join" in x for x in plans) > 1 and not any("Broadcast" in x for x in plans)


def test_votes_of_members_past_the_fortieth(spark, tables):
    d = parts(tables, range(1, 201), lambda k: f"B{k % 2}", lambda k: "EARLY ONE" if k <= 20 else f"LATER {k % 2}")
    got = {(x.community, x.category, x.votes, x["rank"]) for x in queries.region_votes(spark, d).collect()}
    assert got == {(f"B{k}", c, n, i) for k in (0, 1) for c, n, i in ((f"LATER {k}", 90, 1), ("EARLY ONE", 10, 2))}
    assert {x.community: x.name for x in queries.region_names(spark, d).collect()} == {"B0": "LATER 0", "B1": "LATER 1"}


def test_whole_tables_are_read(spark, tables):
    from datetime import datetime

    tables("events", [(i, 7, datetime(2024, 1, 1 + i, 12)) for i in range(9)] + [(20, 8, datetime(2024, 1, 3))], "event_id long, user_id long, ts timestamp")
    d = tables("documents", [(1, "a" * 300, "en"), (2, "é" * 100, None), (3, "abc", "de"), (4, None, "en")], "doc_id long, text string, lang string")
    assert {x.player: x.best for x in queries.streaks(spark, d).collect()} == {7: 9, 8: 1}
    assert {x.doc_id: x.n for x in queries.truncate_description(spark, d).collect()} == {1: 160, 2: 80, 3: 3, 4: None}
    parts(tables, range(1, 31), lambda k: "A" if k < 10 else "B" if k < 20 else f"C{k}")
    links(tables, [[1, k] for k in (2, 3, 4, 5, 11, 12, 21)] + [[22, 11], [22, 30]])
    got = {(x.article, x.community): x.n for x in queries.link_grouping(spark, d).collect()}
    assert got == {(1, "A"): 4, (1, "__misc"): 3, (22, "__misc"): 2}


def test_pools_take_all_candidates(spark, tables):
    keys = range(1, 13)
    parts(tables, keys)
    d = links(tables, [[*keys, 1]])
    want = {(a, (a + n - 1) % 12 + 1, n) for a in keys for n in (2, 3, 4, 5)}
    assert {tuple(x) for x in queries.pools_bucket_sample(spark, d).collect()} == want


def test_days_are_those_of_the_rounded_second(spark, tables):
    """The SQL of these queries rounds times to seconds before it takes their day, halves to the even second."""
    import duckdb

    import __spark_entry__ as entry

    times = ["2024-01-01 23:59:59.5", "2024-01-01 23:59:59.499999", "2024-01-02 12:00:00.5", "2024-01-04 23:59:59.999999", "2024-01-05 00:00:00", "1969-12-31 23:59:59.6", "1969-12-30 01:00:00", "1970-01-01 00:00:00"]
    spark.sql(f"SELECT * FROM VALUES {', '.join(f"({i}L, 7L, TIMESTAMP_NTZ '{t}', 'view')" for i, t in enumerate(times))} AS t(event_id, user_id, ts, event_type)").write.parquet(f"{(d := tables('unused', [(1,)], 'a int'))}/events.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    for name in ("game_scalars", "streaks", "daily_numbers"):
        got = sorted(tuple(x) for x in entry.queries()[name](spark, d).collect())
        assert got == sorted(sql.execute(entry.oracle_sql()[name]).fetchall()), name
