"""Races against a plain sequential version; references in texts; the review set."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import assembly, pools, puzzles


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(3)
    n = 60
    edges = sorted({(a, b) for a in range(n) for b in r.sample(range(n), 3) if a != b} | {(a, 5) for a in range(0, n, 2) if a != 5})
    indeg = {v: sum(b == v for _, b in edges) for v in range(n)}
    ends = [v for v in range(n) if v % 4 != 1]
    pool = [(d, p, a, b, (a * 7 + b) % 9) for d in ("easy", "medium") for p in (3, 4, 5) for a in range(0, n, 7) for b in range(3, n, 11) if a != b]
    nodes = spark.createDataFrame([(v, indeg[v], v % 3) for v in range(n)], "id long, in_degree long, community long")
    board = puzzles.Board(
        nodes, spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(v,) for v in ends], "id long"),
        spark.createDataFrame(pool, "difficulty string, par int, src long, dst long, routes long"),
    )
    out = {v: [b for a, b in edges if a == v] for v in range(n)}
    return board, out, indeg, ends, pool


def distance(out, indeg, a, b, ban):
    seen, todo = {a: 0}, deque([a])
    while todo:
        v = todo.popleft()
        for w in out[v]:
            if w not in seen and (w == b or ban is None or indeg[w] <= ban):
                seen[w] = seen[v] + 1
                todo.append(w)
    return seen.get(b)


class Numbers:
    def __init__(self, seed):
        self.all, self.at = pools.draws(seed, 2000), 0

    def below(self, n):
        self.at += 1
        return self.all[self.at - 1] % n


def free(world, numbers, ends, ban, least, most):
    _, out, indeg, _, _ = world
    for _ in range(60):
        a, b = ends[numbers.below(len(ends))], ends[numbers.below(len(ends))]
        par = distance(out, indeg, a, b, ban)
        if a != b and par is not None and least <= par <= most:
            return a, b, ban, par
    return None


def rows(df):
    return [(r.src, r.dst, r.ban, r.par) for r in df.collect()]


def test_free_region_and_chosen_races(world):
    board, out, indeg, ends, _ = world
    for seed in (1, 2):
        want = free(world, Numbers(seed), ends, 8, 3, 6)
        assert rows(puzzles.free_race(board, 8, 3, seed)) == ([want] if want else [])
    want = free(world, Numbers(9), [v for v in ends if v % 3 == 1 and indeg[v] <= 1000], 1000, 3, 7)
    assert rows(puzzles.region_race(board, 1, "hard", 9)) == ([want] if want else [])
    assert rows(puzzles.chosen_race(board, 2, 5, 3)) == [(2, 5, 3, distance(out, indeg, 2, 5, 3))]  # a hub as goal is exempt
    assert rows(puzzles.chosen_race(board, 4, 4, None)) == rows(puzzles.chosen_race(board, 4, 400, None)) == []
    assert rows(puzzles.puzzle(board, pair=(2, 5), ban=3)) == rows(puzzles.chosen_race(board, 2, 5, 3))


def test_course_goes_on_where_a_hole_stopped(world):
    board, out, indeg, ends, pool = world
    numbers, want = Numbers(pools.course_seed(20_700, 3)), []
    for k, par in enumerate((3, 3, 4), 1):
        bucket = sorted((x[4], x[2], x[3]) for x in pool if x[0] == "easy" and x[1] == par)
        hole = None
        for _ in range(8):
            _, a, b = bucket[numbers.below(len(bucket))]
            if distance(out, indeg, a, b, None) == par:
                hole = (a, b, None, par)
                break
        want.append((k, *(hole or free(world, numbers, ends, None, 3, 6))))
    assert [(r.hole, r.src, r.dst, r.ban, r.par) for r in puzzles.course(board, 20_700, 3).orderBy("hole").collect()] == want


def test_daily_race_and_its_archive(world):
    board, out, indeg, ends, pool = world
    numbers = Numbers(pools.daily_seed(pools.EPOCH_DAY + 3, "medium"))
    weights, want = {3: 40, 4: 40, 5: 15}, None
    for _ in range(8):
        r = numbers.below(95)
        par = next(p for p in weights if (r := r - weights[p]) < 0)
        bucket = sorted((x[4], x[2], x[3]) for x in pool if x[0] == "medium" and x[1] == par)
        _, a, b = bucket[numbers.below(len(bucket))]
        found = distance(out, indeg, a, b, 5000)
        if found is not None and 3 <= found <= 6:
            want = (a, b, 5000, found)
            break
    want = want or free(world, numbers, ends, 5000, 3, 6)
    assert rows(puzzles.daily_race(board, "medium", 4, pools.EPOCH_DAY + 3)) == [want]
    assert rows(puzzles.daily_race(board, "medium", 5, pools.EPOCH_DAY + 3)) == rows(puzzles.daily_race(board, "easy", 0, 30_000)) == []


def test_further_seeds_wrap():
    s = puzzles.further_seeds(2**64 - 1)
    assert len(s) == 6 and s[1] == ((2**64 - 1) * 6364136223846793005 + 1) % 2**64


def test_references(spark):
    got = spark.range(1).select(T.decode_references(F.lit("a &amp;lt; &#38;&#x2014;&#xD800; &nope; & &; &#128512;")).alias("r")).first().r
    assert (got.text, got.unresolved) == ("a &lt; &—&#xD800; &nope; & &; 😀", 2)


def test_review_has_reasons_in_order(spark):
    races = [("easy", a, a + 1, f"t{a}", f"t{a + 1}", a) for a in range(30)] + [("hard", 7, 90, "t7", "t90", 5)]
    got = assembly.review(spark.createDataFrame(races, "difficulty string, src long, dst long, src_title string, dst_title string, views long"), [("t9", "t10")]).collect()
    why = {(r.difficulty, r.src): r.reason for r in got}
    assert len(got) == 20 and why["easy", 9] == "showcase" and why["easy", 0] == why["easy", 1] == "least familiar" and why["hard", 7] == "least familiar"


def test_a_search_stops_where_its_ends_meet_and_writes_no_edges_again(spark, monkeypatch):
    from loomgraph.operators import search_graph
    from loomgraph.plans import lineage

    written, write = [], lineage.cut
    e = write(spark.createDataFrame([(k, (k + 1) % 40) for k in range(40)], "src long, dst long"))
    monkeypatch.setattr(search_graph, "cut", lambda df: (written.append(df), write(df))[1])
    pairs = spark.createDataFrame([(1, 0, 4), (2, 9, 9), (3, 5, 6)], "pair_id long, src long, dst long")
    bans = spark.createDataFrame([(4,), (30,)], "id long")
    got = {(r.pair_id, r.length, int(r.paths)) for r in search_graph.path_counts(e, pairs, 30, bans).collect()}
    assert got == {(1, 4, 1), (2, 0, 1), (3, 1, 1)}
    assert write(e) is e and sum(set(x.columns) >= {"v", "n"} for x in written) <= 10


def test_large_tables_of_a_search_are_not_broadcast(spark):
    from loomgraph.plans import lineage

    t = spark.range(10)
    plan = lambda n: t.join(lineage.fit(t, n), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(lineage.SMALL) and "Broadcast" not in plan(lineage.SMALL + 1)


def test_review_holds_no_difficulty_in_a_window(spark):
    races = [("easy", a, a + 1, f"t{a}", f"t{a + 1}", a) for a in range(30)] + [("easy", 0, 1, "t0", "t1", 0)] * 2 + [("hard", 7, 90, "t7", "t90", 5)]
    got = assembly.review(spark.createDataFrame(races, "difficulty string, src long, dst long, src_title string, dst_title string, views long"), [("t9", "t10")])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.reason for r in got.where("src = 0").collect() if r.reason != "spot check") == ["least familiar"] * 2


def test_pools_of_several_blocks_keep_few_pairs(spark, monkeypatch):
    import hashlib

    made, write = [], pools.cut
    monkeypatch.setattr(pools, "cut", lambda df: (made.append(out := write(df)), out)[1])
    r, n = random.Random(8), 150
    edges = sorted({(1000 + 3 * a, 1000 + 3 * b) for a in range(n) for b in r.sample(range(n), 3) if a != b})
    out, indeg = {}, {1000 + 3 * a: 0 for a in range(n)}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        indeg[b] += 1
    deg = spark.createDataFrame(list(indeg.items()), "id long, in_degree long")
    got = {tuple(x) for x in pools.generate(spark.createDataFrame(edges, "src long, dst long"), deg, 5, 2, 130, 40).collect()}
    ends, want = sorted((v for v in indeg if indeg[v] <= 5), key=lambda v: (-indeg[v], v))[:130], {k: [] for k in (2, 3, 4, 5)}
    for a in ends:
        seen, todo = {a: 0}, deque([a])
        while todo:
            v = todo.popleft()
            for w in out.get(v, []):
                if w not in seen and indeg[w] <= 5:
                    seen[w] = seen[v] + 1
                    todo.append(w)
        for b in ends:
            if 2 <= seen.get(b, 0) <= 5:
                want[seen[b]].append((hashlib.md5(f"{a}:{b}:0".encode()).hexdigest(), a, b))
    assert got == {(a, b, k) for k, x in want.items() for _, a, b in sorted(x)[:40]} and len(want[4]) > 500
    assert made[-1].columns == ["src", "dst", "par"] and made[-1].count() <= 3 * 4 * 40
