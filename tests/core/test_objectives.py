"""The weighted search against a plain one over the driver's smallest tables: every step's score, where starts end, the budget."""

import math

import pytest
from pyspark.sql import functions as F

from meridia.functions import rf
from meridia.plans import lens, objectives, radio

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    """Two plans of a few cells near each other, so that a plain search stays small: tables, and plain copies of them."""
    cells = lens.cells(spark, SF).withColumn("tech", F.lit("4g")).withColumn("ghz", F.lit(2.6)).withColumn("mhz", F.lit(20.0)).withColumn("channel", F.when(F.col("cell_id") % 3 == 0, "A").otherwise("B")).withColumn("radius_m", F.lit(6000.0))
    cells = cells.where("cell_id < 11")
    plans = objectives.plans_of(cells)
    b = lens.buildings(spark, SF)
    from meridia.functions import geo

    near = b.select("building_id", "lon", "lat", "demand").crossJoin(cells.select("cell_id", F.col("lon").alias("x"), F.col("lat").alias("y")))
    near = near.where(geo.distance_m(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")) <= 6000).withColumn("bearing", geo.bearing_deg(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")))
    contrib = near.withColumn("azimuth", F.explode(F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: i * 10))).where(geo.in_beam(F.col("bearing"), F.col("azimuth"), F.lit(radio.BEAM_DEG))).select("cell_id", "azimuth", "building_id", "demand").cache()
    homes = b.select("building_id", F.col("residential").alias("homes"))
    samples = lens.samples(spark, SF).where("sample_id % 10 = 1")
    found, dom = objectives.worth(contrib, plans, homes), objectives.domain(samples, cells, plans)
    served, home = {}, {r.building_id: r.homes for r in homes.collect()}
    for r in contrib.collect():
        served.setdefault((r.cell_id, r.azimuth), {})[r.building_id] = r.demand
    ids = {}
    for r in sorted(plans.collect()):
        ids.setdefault(r.plan, []).append(r.cell_id)
    links = {}
    for r in dom.collect():
        links.setdefault(r.plan, []).append(r.links)
    return found, dom, plans, served, home, ids, links


def plain_raw(parts, plan, azimuths):
    _, _, _, served, home, ids, links = parts
    n, demand = {}, {}
    for c, a in zip(ids[plan], azimuths):
        for b, d in served.get((c, a), {}).items():
            n[b], demand[b] = n.get(b, 0) + 1, d
    ok, levels = 0, []
    for some in links.get(plan, []):
        here = [x for x in some if x.mask >> (azimuths[ids[plan].index(x.cell_id)] // 10) & 1]
        if here:
            best = max(here, key=lambda x: (x.rsrp, -x.cell_id))
            noise = best.noise + sum(x.scaled for x in here if x.carrier == best.carrier and x.cell_id != best.cell_id)
            sinr = 10 * math.log10(best.mw / noise)
            rsrq = 10 * math.log10(best.rb * best.mw / (12 * best.rb * (best.mw + noise)))
            ok += best.rsrp >= rf.MIN_RSRP and sinr >= rf.MIN_SINR and rsrq >= rf.MIN_RSRQ
            levels.append(math.floor(sinr * 10))
    levels.sort()
    return {"demand": sum(demand.values()), "homes": sum(home[b] for b in n), "covered": len(n), "overlap": sum(k > 1 for k in n.values()), "serviceable": ok, "p10": levels[math.ceil(0.1 * len(levels)) - 1] / 10 if levels else None}


def plain_judged(parts, plan, azimuths, request):
    _, _, _, served, home, ids, links = parts
    reach = {b: d for c in ids[plan] for a in range(0, 360, 10) for b, d in served.get((c, a), {}).items()}
    r = plain_raw(parts, plan, azimuths)
    all_demand, all_homes, all_samples = sum(reach.values()), sum(home[b] for b in reach), len(links.get(plan, []))
    part = lambda x, y: min(1.0, max(0.0, x / y)) if y > 0 else None
    u = {"demand": part(r["demand"], all_demand), "residential": part(r["homes"], all_homes), "overlap": 1 - r["overlap"] / r["covered"] if r["covered"] else None, "radio_quality": part(r["serviceable"], all_samples)}
    w = {k: x for k, x in request.weights.items() if x > 0 and u[k] is not None}
    score = 100 * sum(x * u[k] for k, x in w.items()) / sum(w.values()) if w else 0.0
    fits = True
    if request.most_overlap_ratio is not None:
        fits &= (1 - u["overlap"] if u["overlap"] is not None else 0.0) <= request.most_overlap_ratio
    if request.least_serviceable is not None:
        fits &= (u["radio_quality"] or 0.0) >= request.least_serviceable
    if request.least_p10_sinr is not None:
        fits &= r["p10"] is not None and r["p10"] >= request.least_p10_sinr
    return fits, math.floor(score * 1e4 + 0.5) / 1e4


def plain_multistart(parts, plan, starts, request, most_passes, budget):
    ids, known, out = parts[5][plan], set(), []

    def try_(az):
        if tuple(az) not in known:
            if len(known) == budget:
                return None
            known.add(tuple(az))
        return plain_judged(parts, plan, az, request)

    for start in starts:
        az = [start] * len(ids)
        now = try_(az)
        if now is None:
            out.append((plan, start, 0, "evaluation_budget"))
            break
        seen, ended, used = {tuple(az)}, None, 0
        for k in range(1, most_passes + 1):
            used, moved = k, False
            for i in range(len(ids)):
                best, best_az, full = now, az, False
                for a in range(0, 360, 10):
                    t = [*az[:i], a, *az[i + 1 :]]
                    r = try_(t)
                    if r is None:
                        full = True
                        break
                    if (r[0] and (not best[0] or r[1] > best[1])) or (not best[0] and not r[0] and r[1] > best[1]):
                        best, best_az = r, t
                if full:
                    ended = "evaluation_budget"
                    break
                if best_az != az:
                    now, az, moved = best, best_az, True
                    if tuple(az) in seen:
                        ended = "repeated_state"
                        break
                    seen.add(tuple(az))
            if ended or not moved:
                ended = ended or "coordinate_stable"
                break
        out.append((plan, start, used, ended or "max_passes", *now, tuple(az), len(known)))
        if ended == "evaluation_budget":
            break
    return out


REQUESTS = {
    "weights": objectives.Request(), "overlap": objectives.Request({"demand": 50.0, "radio_quality": 50.0}, most_overlap_ratio=0.3), "p10": objectives.Request({"demand": 100.0}, least_p10_sinr=3.0),
    "floor": objectives.Request({"radio_quality": 10.0, "residential": 5.0}, least_serviceable=0.4),
}


@pytest.mark.parametrize("name, budget", [("weights", 400), ("overlap", 5000), ("p10", 290)])
def test_multistart_is_the_plain_one(parts, name, budget):
    found, dom, plans = parts[:3]
    got = {(r.plan, r.start): r for r in objectives.multistart(found, dom, plans, (0, 90), REQUESTS[name], 2, budget).collect()}
    want = [x for plan in parts[5] for x in plain_multistart(parts, plan, (0, 90), REQUESTS[name], 2, budget)]
    assert got.keys() == {x[:2] for x in want} and len(parts[5]) > 1
    for x in want:
        r = got[x[:2]]
        assert (r.passes, r.ended) == x[2:4]
        if len(x) > 4:
            assert (r.fits, tuple(r.azimuths), r.evaluations) == (x[4], x[6], x[7]) and r.score == pytest.approx(x[5], abs=1e-4)


def test_odd_requests():
    for bad in ({"demand": -1.0}, {"fame": 3.0}, {"demand": 0.0}):
        with pytest.raises(ValueError):
            objectives.Request(bad)
