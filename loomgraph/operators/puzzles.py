"""Races: attempts are drawn from a seed, searched all at once, and the first that qualifies is taken.

A draw needs a few dozen numbers and ids, which the driver holds; searching is one batched walk over the edges
for all attempts, so a race costs as many jobs as its depth whatever the number of attempts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.degrees import offsets
from loomgraph.operators.pools import COURSES, EPOCH_DAY, RULES, WEIGHTS, WORD, course_seed, daily_seed, draws
from loomgraph.operators.search_graph import path_counts
from loomgraph.plans.lineage import cut

#: Attempts without a pool and with one, and seeds tried for a daily race. Fixed values.
FREE, POOLED, SEEDS = 60, 8, 6
RACE = "src long, dst long, ban long, par int"


@dataclass
class Board:
    """What races are drawn on: nodes (id, in_degree, community), edges (src, dst), nodes that may be ends (id), and a
    pool of pairs (difficulty, par, src, dst, routes) or None."""

    nodes: DataFrame
    edges: DataFrame
    ends: DataFrame
    pool: DataFrame | None = None

    def banned(self, ban: int | None) -> DataFrame | None:
        return None if ban is None else self.nodes.where(F.col("in_degree") > ban).select("id")


def further_seeds(seed: int) -> list[int]:
    """The seed and those derived from it when it gives no race."""
    out = [seed]
    while len(out) < SEEDS:
        out.append((out[-1] * 6364136223846793005 + 1) % WORD)
    return out


def nth(nodes: DataFrame, places: list[int]) -> dict[int, int]:
    """Ids at the given places (a few dozen) of the nodes by ascending id."""
    if not places:
        return {}
    wanted = nodes.sparkSession.createDataFrame([(p,) for p in sorted(set(places))], "offset long")
    at = offsets(nodes.select("id", F.lit(1).alias("n")))
    return {r["offset"]: r["id"] for r in at.join(F.broadcast(wanted), "offset").select("offset", "id").collect()}


def lengths(board: Board, tries: list[tuple[int, int]], ban: int | None, longest: int) -> list[int | None]:
    """The least number of links of each pair; the bans hold inside a path, not for its ends."""
    if not tries:
        return []
    pairs = board.edges.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(tries)], "pair_id long, src long, dst long")
    found = {r["pair_id"]: r["length"] for r in path_counts(board.edges, pairs, longest, board.banned(ban)).collect()}  # a row a pair
    return [found.get(k) for k in range(len(tries))]


def race(board: Board, src: int, dst: int, ban: int | None, par: int) -> DataFrame:
    return board.edges.sparkSession.createDataFrame([(src, dst, ban, par)], RACE)


def no_race(board: Board) -> DataFrame:
    return board.edges.sparkSession.createDataFrame([], RACE)


def _drawn(board: Board, ends: DataFrame, ban: int | None, least: int, most: int, numbers: list[int]) -> tuple[tuple | None, int]:
    """The first pair of drawn ends at a distance from ``least`` to ``most``, and the numbers used till then."""
    n = ends.count()
    if n < 2:
        return None, 0
    places = [x % n for x in numbers]
    id_of = nth(ends, places)
    tries = [(id_of[a], id_of[b]) for a, b in zip(places[::2], places[1::2], strict=True)]
    for k, ((a, b), par) in enumerate(zip(tries, lengths(board, tries, ban, most), strict=True), 1):
        if a != b and par is not None and least <= par <= most:
            return (a, b, ban, par), 2 * k
    return None, len(numbers)


def free_race(board: Board, ban: int | None, least: int, seed: int) -> DataFrame:
    """A race (src, dst, ban, par) without a pool: par from ``least`` to three more; no row if no attempt qualifies."""
    found, _ = _drawn(board, board.ends, ban, least, least + 3, draws(seed, 2 * FREE))
    return race(board, *found) if found else no_race(board)


def region_race(board: Board, region, difficulty: str, seed: int) -> DataFrame:
    """A race inside one community: its ends are not banned, par may be one less than elsewhere, two at least."""
    ban, least = RULES[difficulty]
    least = max(2, least - 1)
    of = board.nodes.where(F.col("community") == region)
    of = of if ban is None else of.where(F.col("in_degree") <= ban)
    found, _ = _drawn(board, board.ends.join(of.select("id"), "id", "left_semi"), ban, least, least + 4, draws(seed, 2 * FREE))
    return race(board, *found) if found else no_race(board)


def chosen_race(board: Board, src: int, dst: int, ban: int | None, longest: int = 30) -> DataFrame:
    """The race between two articles that a player chose; none if they are one, unknown or not connected."""
    known = board.nodes.where(F.col("id").isin(src, dst)).count()
    par = lengths(board, [(src, dst)], ban, longest)[0] if src != dst and known == 2 else None
    return race(board, src, dst, ban, par) if par is not None else no_race(board)


def _at(pool: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(src, dst) at places (par, ordinal) of a pool of one difficulty, in each par by routes, src, dst."""
    if not wanted:
        return {}
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("par").orderBy("routes", "src", "dst")) - 1
    w = pool.sparkSession.createDataFrame(sorted(set(wanted)), "par int, at int")
    rows = pool.withColumn("at", at).join(F.broadcast(w), ["par", "at"]).collect()
    return {(r["par"], r["at"]): (r["src"], r["dst"]) for r in rows}


def _sizes(pool: DataFrame) -> dict[int, int]:
    return {r["par"]: r["count"] for r in pool.groupBy("par").count().collect()}  # a row a par


def race_at_par(board: Board, difficulty: str, par: int, seed: int) -> DataFrame:
    """A race of one exact par from the pool, searched anew; none if none of a few draws holds."""
    found, _ = _exact(board, difficulty, [par], draws(seed, POOLED))
    return race(board, *found[0]) if found[0] else no_race(board)


def _exact(board: Board, difficulty: str, pars: list[int], numbers: list[int]) -> tuple[list[tuple | None], int]:
    """For each par in turn the first draw that holds; draws go on where the last par stopped. And draws used."""
    ban = RULES[difficulty][0]
    if board.pool is None:
        return [None] * len(pars), 0
    pool = board.pool.where(F.col("difficulty") == difficulty)
    sizes = _sizes(pool)
    of = _at(pool, [(p, x % sizes[p]) for p in set(pars) if sizes.get(p) for x in numbers[: POOLED * len(pars)]])
    tries = sorted(set(of.values()))
    length = dict(zip(tries, lengths(board, tries, ban, max(pars)), strict=True))
    out, used = [], 0
    for p in pars:
        out.append(None)
        for x in numbers[used : used + POOLED] if sizes.get(p) else []:
            used += 1
            a, b = of[p, x % sizes[p]]
            if length[a, b] == p:
                out[-1] = (a, b, ban, p)
                break
    return out, used


def course(board: Board, day: int, holes: int) -> DataFrame:
    """hole, src, dst, ban, par: a round of the designed pars, drawn from one seed.

    A hole without a fitting pair in the pool is drawn freely, and its par is what it is.
    """
    pars = list(COURSES[holes])
    numbers = draws(course_seed(day, holes), (POOLED + 2 * FREE) * holes)
    out, used = [], 0
    while len(out) < holes:
        found, _ = _exact(board, "easy", pars[len(out) :], numbers[used : used + POOLED * (holes - len(out))])
        good = next((k for k, x in enumerate(found) if x is None), len(found))
        if good == len(found):
            out += found
            break
        # the draws up to the hole that failed, then a free one
        done, n = _exact(board, "easy", pars[len(out) : len(out) + good + 1], numbers[used:])
        out += done[:good]
        used += n
        free, n = _drawn(board, board.ends, None, 3, 6, numbers[used : used + 2 * FREE])
        used += n
        if free is None:
            break
        out.append(free)
    return board.edges.sparkSession.createDataFrame([(k + 1, *x) for k, x in enumerate(out)], "hole int, " + RACE)


def pool_race(board: Board, difficulty: str, seed: int) -> DataFrame:
    """A race by the difficulty's rules: pairs of the pool, par by weight, searched anew; then drawn freely."""
    ban, least = RULES[difficulty]
    numbers, used = draws(seed, 2 * POOLED + 2 * FREE), 0
    if board.pool is not None:
        pool = board.pool.where(F.col("difficulty") == difficulty)
        sizes = _sizes(pool)
        weights = {least + k: w for k, w in enumerate(WEIGHTS[difficulty]) if sizes.get(least + k)}
        wanted = []
        for a, b in zip(numbers[: 2 * POOLED : 2], numbers[1 : 2 * POOLED : 2], strict=True):
            r = a % sum(weights.values()) if weights else 0
            for par, w in weights.items():
                if r < w:
                    lo = sizes[par] // 2 if difficulty == "easy" else 0
                    hi = -(-sizes[par] // 2) if difficulty == "hard" else sizes[par]
                    wanted.append((par, lo + b % (hi - lo)))
                    break
                r -= w
        of = _at(pool, wanted)
        tries = [of[x] for x in wanted]
        for (a, b), par in zip(tries, lengths(board, tries, ban, least + 3), strict=True):
            if par is not None and least <= par <= least + 3:
                return race(board, a, b, ban, par)
        used = 2 * len(wanted)
    found, _ = _drawn(board, board.ends, ban, least, least + 3, numbers[used : used + 2 * FREE])
    return race(board, *found) if found else no_race(board)


def daily_race(board: Board, difficulty: str, number: int, today: int) -> DataFrame:
    """The race of a day by its number from 1; none for a number after that of ``today`` (days since 1970)."""
    if not 1 <= number <= today - EPOCH_DAY + 1:
        return no_race(board)
    for seed in further_seeds(daily_seed(EPOCH_DAY + number - 1, difficulty)):
        found = pool_race(board, difficulty, seed)
        if not found.isEmpty():
            return found
    return no_race(board)


def puzzle(board: Board, difficulty: str = "medium", seed: int = 0, pair: tuple[int, int] | None = None, region=None, par: int | None = None, ban: int | None = None) -> DataFrame:
    """What a request asks for, by the first that it names: a pair, a region, a par, a hub ban, or just a difficulty."""
    if pair is not None:
        return chosen_race(board, *pair, ban)
    if region is not None:
        return region_race(board, region, difficulty, seed)
    if par is not None:
        return race_at_par(board, difficulty, par, seed)
    if ban is not None:
        return free_race(board, ban, RULES[difficulty][1], seed)
    return pool_race(board, difficulty, seed)


def rebucketed(board: Board, pairs: DataFrame, ban: int | None, least: int, span: int = 4) -> DataFrame:
    """src, dst, par, routes: distances and numbers of shortest paths of pairs (src, dst), found anew; those out of range
    go, and routes stop at the largest unsigned 32-bit number."""
    p = cut(pairs.select("src", "dst").distinct().select(F.monotonically_increasing_id().alias("pair_id"), "src", "dst"))
    found = path_counts(board.edges, p, least + span, board.banned(ban)).join(p, "pair_id")
    found = found.where(F.col("length").between(least, least + span - 1))
    return found.select("src", "dst", F.col("length").alias("par"), F.least("paths", F.lit(2**32 - 1)).cast("bigint").alias("routes"))
