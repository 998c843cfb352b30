"""Searches over antenna azimuths, for all plans of a network at once.

A plan is up to eight cells. What its cells serve is kept by profile: buildings that the same azimuths of the same cells
reach are one row, with 36 bits a cell. They are summed where they lie (``reached_sums``), so pairs of cells and buildings are
no rows; a plan's profiles then meet in one call, which makes the whole search, so no step is a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.numeric import rounded_array
from meridia.operators.plans import MOST_CELLS, TURN_DEG, TURNS, Reached, by_plan, matrix, reached_sums
from meridia.operators.tables import checked_broadcast, shared_table
from meridia.plans import lens
from meridia.plans.radio import BEAM_DEG
from meridia.plans.registry import query


def plans_of(cells: DataFrame) -> DataFrame:
    """(plan, cell_id, place) of cells (cell_id): eight cells in order of id make a plan."""
    return cells.select(F.floor(F.col("cell_id") / MOST_CELLS).alias("plan"), "cell_id", F.pmod(F.col("cell_id"), F.lit(MOST_CELLS)).cast("int").alias("place"))


def profiles(contrib: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan, masks, demand, n) of (cell_id, building_id, demand, mask), or of a row for each azimuth: which azimuths of which places reach n buildings with this demand in all."""
    if "mask" not in contrib.columns:
        bit = F.expr("shiftleft(1L, cast(azimuth / 10 as int))")
        contrib = contrib.groupBy("cell_id", "building_id").agg(F.bit_or(bit).alias("mask"), F.max("demand").alias("demand"))
    by_cell = contrib.join(checked_broadcast(plans), "cell_id")
    masks = F.array(*(F.coalesce(F.max(F.when(F.col("place") == i, F.col("mask"))), F.lit(0).cast("long")) for i in range(MOST_CELLS)))
    one = by_cell.groupBy("plan", "building_id").agg(masks.alias("masks"), F.max("demand").alias("demand"))
    return shared_table(one.groupBy("plan", "masks").agg(F.sum("demand").alias("demand"), F.count("*").alias("n")), "profiles")


def start_states(plans: DataFrame, starts: Iterable[int]) -> DataFrame:
    """(plan, start, turns): all cells of a plan at one azimuth, in tens of degrees; -1 where a plan has no cell."""
    has = plans.groupBy("plan").agg(F.collect_set("place").alias("has"))
    turns = F.transform(F.sequence(F.lit(0), F.lit(MOST_CELLS - 1)), lambda i: F.when(F.array_contains("has", i.cast("int")), F.floor(F.col("start") / TURN_DEG).cast("int")).otherwise(-1))
    return has.withColumn("start", F.explode(F.array(*map(F.lit, starts)))).select("plan", "start", turns.alias("turns"))


def _best(fits: np.ndarray, score: np.ndarray) -> int:
    """The azimuth to take: of those that fit (of all, if none does) the one with most, then the smallest."""
    of = np.flatnonzero(fits) if fits.any() else np.arange(TURNS)
    return int(of[np.argmax(score[of])])


def _served(found: dict) -> Callable[[list[int], int], tuple[np.ndarray, np.ndarray]]:
    """(demand, overlap) of a plan at each of the 36 azimuths of the cell at a place. Overlap counts buildings that two or more cells serve."""
    reached = Reached(matrix(found["masks"]), [found[c].to_numpy(zero_copy_only=False) for c in ("demand", "n")])

    def tried(turns: list[int], place: int) -> tuple[np.ndarray, np.ndarray]:
        once, twice = reached.tried(turns, place)
        return rounded_array(once[0], 4), np.rint(twice[1]).astype(np.int64)

    return tried


def coordinate_search(found: DataFrame, states: DataFrame, passes: int = 2, most_overlap: int | None = None) -> DataFrame:
    """(plan, start, step, place, azimuth, score, overlap): each cell of a plan in turn takes its best azimuth, ``passes`` times: feasible before
    infeasible ones, then most demand, then the smallest angle."""

    def search(sums: dict, starts: dict) -> Iterator[tuple]:
        tried = _served(sums)
        for start, turns in starts.items():
            for at in range(passes * MOST_CELLS):
                place = at % MOST_CELLS
                if turns[place] >= 0:
                    demand, overlap = tried(turns, place)
                    t = _best(np.full(TURNS, True) if most_overlap is None else overlap <= most_overlap, demand)
                    turns = [*turns[:place], t, *turns[place + 1 :]]
                    yield start, at, place, t * TURN_DEG, demand[t], overlap[t]

    return by_plan(found, states, search, "plan long, start int, step int, place int, azimuth int, score double, overlap long")


def multistart_search(found: DataFrame, states: DataFrame, most_passes: int = 8) -> DataFrame:
    """(plan, start, pass, changed, demand): passes of coordinate search from each start, until one changes nothing."""

    def search(sums: dict, starts: dict) -> Iterator[tuple]:
        tried = _served(sums)
        for start, turns in starts.items():
            for k in range(most_passes):
                before, score = turns, None
                for place in range(MOST_CELLS):
                    if turns[place] >= 0:
                        demand, _ = tried(turns, place)
                        t = _best(np.full(TURNS, True), demand)
                        turns, score = [*turns[:place], t, *turns[place + 1 :]], demand[t]
                changed = sum(a != b for a, b in zip(before, turns))
                yield start, k, changed, score
                if not changed:
                    break

    return by_plan(found, states, search, "plan long, start int, pass int, changed int, demand double")


def _archive(tried: Callable, starts: dict, most_expanded: int, most_rounds: int, most_evaluations: int) -> tuple[dict, str]:
    """The front of a plan, {turns: (demand, overlap)}, and why its search ended."""
    known: dict[tuple[int, ...], tuple[float, int]] = {}
    front: dict[tuple[int, ...], tuple[float, int]] = {}

    def begin() -> Iterator[tuple]:
        for _, turns in sorted(starts.items()):
            place = next(i for i, t in enumerate(turns) if t >= 0)
            demand, overlap = tried(turns, place)
            yield tuple(turns), demand[turns[place]], overlap[turns[place]]

    def around(batch: list[tuple[int, ...]]) -> Iterator[tuple]:
        for p in batch:
            for i in range(MOST_CELLS):
                if p[i] >= 0:
                    demand, overlap = tried(list(p), i)
                    head, tail = p[:i], p[i + 1 :]
                    for t, (d, o) in enumerate(zip(demand.tolist(), overlap.tolist())):
                        yield (*head, t, *tail), d, o

    def take(wanted: Iterator[tuple]) -> tuple[list, bool]:
        nonlocal front
        queue = []
        for p, d, o in wanted:
            if p in known:
                continue
            if len(known) == most_evaluations:
                return queue, True
            known[p] = (d, o)
            if not any(x >= d and y <= o and (x, y) != (d, o) for x, y in front.values()):
                front = {q: v for q, v in front.items() if not (d >= v[0] and o <= v[1] and (d, o) != v)}
                front[p] = (d, o)
                queue.append(p)
        return queue, False

    expanded, cut, wanted = 0, False, begin()
    for k in range(most_rounds + 1):
        queue, full = take(wanted)
        if full:
            return front, "evaluation_budget"
        if cut:
            return front, "max_expanded_states"
        if not queue:
            return front, "archive_exhausted"
        room = most_expanded - expanded
        cut, batch = len(queue) > room, queue[:room]
        expanded, wanted = expanded + len(batch), around(batch)
    return front, "max_rounds"


def archive_search(found: DataFrame, starts: DataFrame, most_expanded: int = 128, most_rounds: int = 16, most_evaluations: int = 5000) -> DataFrame:
    """(plan, turns, demand, overlap, ended): plans that none beats in demand (more) and overlap (less), and why the search ended.

    All neighbours of a round's plans (one cell turned) are taken in order: those that the archive does not beat are expanded in the
    next round. A plan's archive, at most ``most_evaluations`` states, is what one call holds.
    """

    def search(sums: dict, begin: dict) -> Iterator[tuple]:
        front, ended = _archive(_served(sums), begin, most_expanded, most_rounds, most_evaluations)
        for turns, (demand, overlap) in front.items():
            yield list(turns), demand, overlap, ended

    return by_plan(found, starts, search, "plan long, turns array<int>, demand double, overlap long, ended string")


def _network(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cells = lens.cells(spark, sf_dir)
    return reached_sums(lens.buildings(spark, sf_dir), cells, ["demand"], BEAM_DEG), plans_of(cells)


@query("network_search")
def network_search(spark, sf_dir):
    """Two passes of coordinate search for every plan of eight cells, all starting at 0 degrees. Iterative: no SQL twin."""
    found, plans = _network(spark, sf_dir)
    return coordinate_search(found, start_states(plans, (0,)))


@query("network_multistart")
def network_multistart(spark, sf_dir):
    """Four starts for every plan of eight cells, passes until nothing changes. Iterative: no SQL twin."""
    found, plans = _network(spark, sf_dir)
    return multistart_search(found, start_states(plans, (0, 90, 180, 270)))


@query("network_archive")
def network_archive(spark, sf_dir):
    """The front that the archive search finds for every plan of eight cells. Iterative: no SQL twin."""
    found, plans = _network(spark, sf_dir)
    return archive_search(found, start_states(plans, (0, 90, 180, 270)))
