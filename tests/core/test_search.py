"""Searches over all plans against plain searches, on a small network and on the driver's table."""

import pytest
from pyspark.sql import functions as F

from meridia.plans import lens, network, search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def driver(spark):
    """The driver's contributions and plans, as DataFrames and as plain sets: {(cell, azimuth): {building: demand}}."""
    contrib = network.contributions(spark, SF).cache()
    plans = search.plans_of(lens.cells(spark, SF))
    served = {}
    for r in contrib.collect():
        served.setdefault((r.cell_id, r.azimuth), {})[r.building_id] = r.demand
    cells = {}
    for r in sorted(plans.collect()):
        cells.setdefault(r.plan, []).append(r.cell_id)
    return search.profiles(contrib, plans), plans, served, cells


def score(served, cells, azimuths):
    every, n = {}, {}
    for c, a in zip(cells, azimuths):
        for b, d in served.get((c, a), {}).items():
            every[b] = d
            n[b] = n.get(b, 0) + 1
    return round(sum(every.values()), 4), sum(k > 1 for k in n.values())


def plain_pass(served, cells, azimuths, most_overlap=None):
    azimuths, steps = list(azimuths), []
    for i in range(len(cells)):
        tried = [(score(served, cells, [*azimuths[:i], a, *azimuths[i + 1 :]]), a) for a in range(0, 360, 10)]
        (d, o), a = max(tried, key=lambda x: (most_overlap is None or x[0][1] <= most_overlap, x[0][0], -x[1]))
        azimuths[i] = a
        steps.append((i, a, d, o))
    return azimuths, steps


@pytest.mark.parametrize("most_overlap", [None, 0])
def test_coordinate_search(driver, most_overlap):
    found, plans, served, cells = driver
    want = set()
    for plan, ids in cells.items():
        azimuths = [0] * len(ids)
        for k in range(2):
            azimuths, steps = plain_pass(served, ids, azimuths, most_overlap)
            want |= {(plan, 8 * k + i, i, a, round(d, 2), o) for i, a, d, o in steps}
    got = {(r.plan, r.step, r.place, r.azimuth, round(r.score, 2), r.overlap) for r in search.coordinate_search(found, search.start_states(plans, (0,)), 2, most_overlap).collect()}
    assert got == want and len(cells) > 1


def test_multistart(driver):
    found, plans, served, cells = driver
    want = set()
    for plan, ids in cells.items():
        for start in (0, 90):
            azimuths = [start] * len(ids)
            for k in range(8):
                before = azimuths
                azimuths, steps = plain_pass(served, ids, azimuths)
                changed = sum(a != b for a, b in zip(before, azimuths))
                want.add((plan, start, k, changed, round(steps[-1][2], 2)))
                if not changed:
                    break
    got = {(r.plan, r.start, r["pass"], r.changed, round(r.demand, 2)) for r in search.multistart_search(found, search.start_states(plans, (0, 90))).collect()}
    assert got == want


def plain_archive(served, cells, starts, most_expanded, most_rounds, most_evaluations):
    known, front, ended = {}, {}, ""

    def take(wanted):
        nonlocal ended, front
        queue = []
        for p in wanted:
            if p in known:
                continue
            if len(known) == most_evaluations:
                ended = "evaluation_budget"
                break
            d, o = known[p] = score(served, cells, p)
            if not any(x >= d and y <= o and (x, y) != (d, o) for x, y in front.values()):
                front = {q: v for q, v in front.items() if not (d >= v[0] and o <= v[1] and (d, o) != v)}
                front[p] = (d, o)
                queue.append(p)
        return queue

    queue, expanded, rounds = take([(s,) * len(cells) for s in starts]), 0, 0
    while queue and not ended:
        if rounds == most_rounds:
            return front, "max_rounds"
        batch, cut = queue[: most_expanded - expanded], len(queue) > most_expanded - expanded
        expanded, rounds = expanded + len(batch), rounds + 1
        queue = take([(*p[:i], a, *p[i + 1 :]) for p in batch for i in range(len(cells)) for a in range(0, 360, 10)])
        ended = ended or ("max_expanded_states" if cut else "")
    return front, ended or "archive_exhausted"


@pytest.mark.parametrize("limits", [(6, 16, 5000), (128, 1, 5000), (128, 16, 700)])
def test_archive(driver, limits):
    found, plans, served, cells = driver
    got = {}
    for r in search.archive_search(found, search.start_states(plans, (0, 90)), *limits).collect():
        got.setdefault((r.plan, r.ended), set()).add((tuple(10 * t for t in r.turns if t >= 0), round(r.demand, 2), r.overlap))
    want = {}
    for plan, ids in cells.items():
        front, ended = plain_archive(served, ids, (0, 90), *limits)
        want[plan, ended] = {(p, round(d, 2), o) for p, (d, o) in front.items()}
    assert got == want


def test_profiles_keep_demand(driver):
    found, _, served, _ = driver
    every = {b: d for s in served.values() for b, d in s.items()}
    assert found.agg(F.sum("n")).first()[0] >= len(every)


def test_experiments_are_bounded(spark):
    with pytest.raises(ValueError):
        network.experiment(spark, {"a": tuple(range(65))}, {})
