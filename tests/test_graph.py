"""Graph operators on the fixtures' small graphs and against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import degrees, iterate, layout, pools, regions
from loomgraph.operators import search_graph as bfs


def edges(spark, e):
    return spark.createDataFrame(list(e), "src long, dst long")


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id long")


def walk(e, s, cap, banned=(), reverse=False):
    near = {}
    for a, b in e:
        near.setdefault(b if reverse else a, []).append(a if reverse else b)
    d, q = {s: 0}, deque([s])
    while q:
        v = q.popleft()
        if d[v] < cap:
            for w in near.get(v, ()):
                if w not in d and w not in banned:
                    d[w] = d[v] + 1
                    q.append(w)
    return d


def count(e, s, t, cap, banned=()):
    if s == t:
        return 0, 1
    level, seen = {s: 1}, {s}
    for k in range(1, cap + 1):
        new = {}
        for a, b in set(e):
            if a in level and b not in seen and (b not in banned or b == t):
                new[b] = new.get(b, 0) + level[a]
        if t in new:
            return k, new[t]
        seen |= set(new)
        level = new
    return None


def random_graphs(n):
    r = random.Random(12)
    for _ in range(n):
        k = r.randrange(8, 20)
        yield k, {(a, b) for a, b in ((r.randrange(k), r.randrange(k)) for _ in range(k * r.randrange(1, 4))) if a != b}


def test_counts_and_paths_equal_plain_search(spark):
    fixed = [(4, {(0, 1), (1, 2), (2, 3)}), (7, {(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6)}), (5, {(0, 1), (1, 3), (0, 2), (2, 4), (4, 3)})]
    for n, e in [fixed[1], *random_graphs(1)]:
        pairs = [(a * n + b, a, b) for a in range(n) for b in range(n)]
        p = spark.createDataFrame(pairs, "pair_id long, src long, dst long")
        for banned, cap in (((), 4), ((1, 2), 5)):
            bad = ids(spark, *banned) if banned else None
            got = {r.pair_id: (r.length, int(r.paths)) for r in bfs.path_counts(edges(spark, e), p, cap, bad).collect()}
            want = {i: c for i, a, b in pairs if (c := count(e, a, b, cap, banned))}
            assert got == want, (n, banned)
            paths = {r.pair_id: r.path for r in bfs.shortest_paths(edges(spark, e), p, cap, bad).collect()}
            assert set(paths) == set(want)
            for i, a, b in pairs:
                if i in paths:
                    x = paths[i]
                    assert x[0] == a and x[-1] == b and len(x) == want[i][0] + 1 and all(h in e for h in zip(x, x[1:])) and not set(x[1:-1]) & set(banned)


def test_distances_and_levels(spark):
    for n, e in random_graphs(1):
        got = bfs.distances(edges(spark, e), ids(spark, 0, 3), 3, ids(spark, 2), reverse=True).collect()
        assert {(r.source, r.id): r.dist for r in got} == {(s, v): d for s in (0, 3) for v, d in walk(e, s, 3, {2}, True).items()}
    line = {(0, 1), (1, 2), (2, 3)}
    assert {r.id: r.dist for r in bfs.distances(edges(spark, line), ids(spark, 3), 1, reverse=True).collect()} == {3: 0, 2: 1}
    star = {(i, 0) for i in range(1, 6)} | {(10 + i, i) for i in range(1, 6)}
    level = lambda cap: {r.id for r in bfs.levels(edges(spark, star), 0, 4, cap).collect()}
    assert level(2) == {1, 2, 3, 4, 5} and len(level(10)) == 10 and len(level(9)) == 5


def test_paths_are_checked_in_order_of_precedence(spark):
    e = {(0, 1), (1, 2), (2, 3)}
    p = [(0, [0, 1, 2, 3]), (1, [0, 9]), (2, [1, 2]), (3, [0, 1]), (4, [0, 2, 3]), (5, [0] * 600), (6, [])]
    df = spark.createDataFrame(p, "run_id long, path array<long>")
    runs = spark.createDataFrame([(i, 0, 3) for i in range(7)], "run_id long, start long, goal long")
    got = lambda bad: {r.run_id: r.verdict for r in bfs.check_paths(df, edges(spark, e), runs, 4, ids(spark, *bad)).collect()}
    want = {0: "ok", 1: "id_out_of_range", 2: "wrong_start", 3: "wrong_goal", 4: "broken_link", 5: "too_long", 6: "wrong_start"}
    assert got([7]) == want and got([0, 3]) == want and got([2]) == want | {0: "banned_article"}


def test_degrees_and_sets(spark):
    n, e = ids(spark, *range(6)), {(0, 1), (1, 0), (1, 2), (3, 1)}
    g = edges(spark, e)
    d = {r.id: (r.in_degree, r.out_degree) for r in degrees.with_degrees(n, g).collect()}
    assert d == {0: (1, 1), 1: (2, 2), 2: (1, 0), 3: (0, 1), 4: (0, 0), 5: (0, 0)}
    assert {tuple(r) for r in degrees.symmetrize(g).collect()} == e | {(b, a) for a, b in e} and degrees.reciprocal(g).count() == 2
    t = degrees.topology(n, g).first()
    assert (t.orphans, t.dead_ends, t.isolated, t.reciprocal, t.reciprocity_pct) == (3, 3, 2, 2, 50.0)
    assert {r.id: r.offset for r in degrees.offsets(n.withColumn("n", F.lit(2)), 2).collect()} == {i: 2 * i for i in range(6)}
    cut = degrees.hub_cut(degrees.with_degrees(n, g), 2).first()
    assert (cut.threshold, cut.excluded) == (1, 1) and degrees.hub_cut(degrees.with_degrees(n, g), 9).first().threshold == 0
    assert {r.id for r in degrees.core(degrees.with_degrees(n, g), "in_degree", 2).collect()} == {0, 1, 2}


def test_pagerank_and_components(spark):
    n, e = ids(spark, *range(5)), {(0, 1), (1, 2), (2, 0), (3, 2)}
    p = {r.id: r.pagerank for r in iterate.pagerank(n, edges(spark, e), iterations=6, tolerance=0.0).collect()}
    x = [0.2] * 5
    for _ in range(6):
        loose = x[4]
        x = [0.03 + 0.85 * (loose / 5 + sum(x[a] / sum(c == a for c, _ in e) for a, b in e if b == v)) for v in range(5)]
    assert sum(p.values()) == pytest.approx(1) and all(p[v] == pytest.approx(x[v], abs=1e-12) for v in range(5))
    long = {(i, i + 1) for i in range(12)} | {(50, 40), (60, 50)}
    c = {r.id: r.component for r in iterate.components(ids(spark, *range(13), 40, 50, 60, 70), edges(spark, long)).collect()}
    assert c == {i: 0 for i in range(13)} | {40: 40, 50: 40, 60: 40, 70: 70}


def test_communities_beat_singletons(spark):
    e = {(a, b) for k in range(3) for a in range(6 * k, 6 * k + 6) for b in range(6 * k, 6 * k + 6) if a != b} | {(5, 6), (6, 5), (11, 12), (12, 11)}
    g = edges(spark, e)
    m = iterate.communities(g, 1.0, 4)
    single = m.select("id", F.col("id").alias("community"))
    assert iterate.modularity(g, m) > 0.3 > iterate.modularity(g, single) and m.count() == 18


def test_pools(spark):
    assert pools.daily_seed(20683, "easy") == 20683 * 0x9E3779B97F4A7C15 % 2**64 and len(set(pools.draws(5, 100))) == 100
    rows = [("easy", 3, i, i + 100, i) for i in range(5)] + [("hard", 4, i, i + 100, i) for i in range(5)] + [("medium", 3, 1, 2, 3)]
    p = spark.createDataFrame(rows, "difficulty string, par int, src long, dst long, routes long")
    h = {(r.difficulty, r.routes) for r in pools.halves(p).collect()}
    assert h == {("easy", 2), ("easy", 3), ("easy", 4), ("hard", 0), ("hard", 1), ("hard", 2), ("medium", 3)}
    a, b = (pools.pick(p, "hard", 77).collect() for _ in range(2))
    assert len(a) == 1 and a == b and a[0].routes <= 2 and pools.pick(p.limit(0), "easy", 1).count() == 0
    recent, ends = spark.createDataFrame([(0, 100), (1, 101)], "src long, dst long"), ids(spark, 2, 103, 4)
    assert sorted(r.src for r in pools.choose(p.where("difficulty = 'easy'"), recent, ends).collect()) != []
    old = pools.choose(p.where("difficulty = 'medium'"), spark.createDataFrame([(1, 2)], "src long, dst long"), ends).collect()
    assert [(r.src, r.dst) for r in old] == [(1, 2)]


def test_regions_and_search(spark):
    n = spark.createDataFrame([(0, "Cat", 2817), (1, "Catholic Church", 93701), (2, "Albert Einstein", 241), (3, "Einstein Bros. Bagels", 1), (4, "The Weinstein Company", 48), (5, "New York City", 9), (6, "CAT", 5)], "id long, title string, degree long")
    a = spark.createDataFrame([(5, "NYC"), (5, "Big Apple"), (2, "Einstein"), (0, "cat")], "id long, alias string")
    e = regions.search_entries(n, a)
    found = lambda q, k=10: [r.owner for r in regions.search(e, q, k).collect()]
    assert found("cat") == [0, 6, 1] and found("einst") == [2, 3, 4] and found("nyc") == [5] and found("  ") == [] and found("zzz") == [] and found("einstein", 1) == [2]
    sizes = spark.createDataFrame([("a", 9), ("b", 5), ("c", 1)], "community string, size long")
    votes = spark.createDataFrame([("a", "X", 9, 1), ("b", "X", 5, 1), ("b", "Y", 4, 2), ("c", "X", 3, 1)], "community string, category string, votes long, rank int")
    assert {r.community: r.name for r in regions.region_names(votes, sizes).collect()} == {"a": "X", "b": "Y"}
    links = spark.createDataFrame([("a",)] * 4 + [("b",), ("c",)], "community string")
    assert {r.community: r.n for r in regions.link_groups(links).collect()} == {"a": 4, "__misc": 2}


def test_layout(spark):
    r = random.Random(5)
    pts = [(i, r.gauss(0, 30), r.gauss(0, 30)) for i in range(300)] + [(999, float("nan"), 1.0)]
    q = [(i, r.gauss(0, 30), r.gauss(0, 30)) for i in range(50)]
    got = {x["query"]: x.id for x in layout.nearest(spark.createDataFrame(q, "query long, x double, y double"), spark.createDataFrame(pts, "id long, x double, y double"), 60.0).collect()}
    for i, x, y in q:
        d = min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in pts[:300])
        assert d[0] > 120**2 or got[i] == d[1]
    b = layout.bounds(spark.createDataFrame(pts, "id long, x double, y double")).first()
    assert b.max_x == max(p[1] for p in pts[:300])
