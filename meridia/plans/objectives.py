"""Searches over antenna azimuths by weighted objectives and constraints, radio quality among them, for all plans at once.

What does not depend on azimuths is prepared once, a grid cell at a time: for buildings the profiles of ``search``, for samples how
many have the same azimuths that reach them and the same outcomes, one for each subset of the plan's cells that reach them (eight at
most). A candidate differs from the present state in one cell, so a sample has two outcomes, with that cell's link and without it: the
second is counted once for all 36 azimuths, and the difference for those that reach the sample. Percentiles come from counts by tenths of
a dB, which add up the same way.

A plan is one call, which searches its starts in order; they share a budget of evaluations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import geo, rf
from meridia.functions.numeric import rounded_array
from meridia.operators.joins import disc_kernel
from meridia.operators.plans import MOST_CELLS, PLACES, TURN_DEG, TURNS, Reached, bits, by_plan, matrix, merged, plans_in, reached_sums
from meridia.operators.tables import checked_broadcast, shared_table
from meridia.plans import lens, radio
from meridia.plans.registry import query
from meridia.plans.search import _best, plans_of, start_states

#: Why a start ended.
STABLE, REPEATED, PASSES, BUDGET = "coordinate_stable", "repeated_state", "max_passes", "evaluation_budget"
MOST_PASSES, MOST_EVALUATIONS = 8, 5000
OBJECTIVES = ("demand", "residential", "overlap", "radio_quality")


@dataclass(frozen=True)
class Request:
    """Weights of objectives (any scale; those that a plan does not have are shared among the others), and limits."""

    weights: dict[str, float] = field(default_factory=lambda: {"demand": 40.0, "residential": 20.0, "overlap": 10.0, "radio_quality": 30.0})
    most_overlap_ratio: float | None = None
    least_demand: float | None = None
    least_serviceable: float | None = None
    least_p10_sinr: float | None = None

    def __post_init__(self):
        if set(self.weights) - set(OBJECTIVES) or any(not 0 <= w <= 100 for w in self.weights.values()) or not sum(self.weights.values()) > 0:
            raise ValueError(f"weights are of {OBJECTIVES}, from 0 to 100, not all 0")


def worth(contrib: DataFrame, plans: DataFrame, homes: DataFrame) -> DataFrame:
    """(plan, masks, demand, homes, n) of (cell_id, building_id, demand, mask), or of a row for each azimuth: which azimuths of which places reach n buildings with this demand and these homes."""
    if "mask" not in contrib.columns:
        bit = F.expr("shiftleft(1L, cast(azimuth / 10 as int))")
        contrib = contrib.groupBy("cell_id", "building_id").agg(F.bit_or(bit).alias("mask"), F.max("demand").alias("demand"))
    by_cell = contrib.join(checked_broadcast(plans), "cell_id")
    masks = F.array(*(F.coalesce(F.max(F.when(F.col("place") == i, F.col("mask"))), F.lit(0).cast("long")) for i in range(MOST_CELLS)))
    one = by_cell.groupBy("plan", "building_id").agg(masks.alias("masks"), F.max("demand").alias("demand")).join(homes, "building_id")
    return shared_table(one.groupBy("plan", "masks").agg(F.sum("demand").alias("demand"), F.sum("homes").alias("homes"), F.count("*").alias("n")), "worth")


def domain(samples: DataFrame, cells: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan, sample_id, links): of every sample in the radius of a cell of the plan, its links in order of place."""
    reach = F.aggregate(F.sequence(F.lit(0), F.lit(TURNS - 1)), F.lit(0).cast("long"), lambda m, t: m + F.when(geo.in_beam(F.col("bearing"), t * TURN_DEG, F.lit(radio.BEAM_DEG)), F.pow(F.lit(2.0), t).cast("long")).otherwise(0))
    mw = rf.milliwatts(F.col("rsrp"))
    noise = rf.milliwatts(rf.thermal_noise(rf.spacing_khz(F.col("tech")) * 1000, F.lit(radio.FIGURE_DB)))
    near = radio.links(samples.select("sample_id", "lon", "lat"), cells).join(plans, "cell_id")
    link = F.struct("place", "cell_id", reach.alias("mask"), "rsrp", mw.alias("mw"), (mw * F.col("load")).alias("scaled"), F.xxhash64("tech", "channel", "ghz", "mhz").alias("carrier"), noise.alias("noise"), "rb")
    return shared_table(near.select("plan", "sample_id", link.alias("link")).groupBy("plan", "sample_id").agg(F.array_sort(F.collect_list("link")).alias("links")), "domain")  # at most MOST_CELLS links


def outcome(links: Column) -> Column:
    """What a sample gets from the links that reach it: (ok, level), level being the SINR in tenths of a dB; null without a link."""
    best = F.array_max(F.transform(links, lambda x: F.struct(x["rsrp"].alias("rsrp"), (-x["cell_id"]).alias("first"), x.alias("x"))))["x"]

    def measured(b: Column) -> Column:
        others = F.aggregate(F.filter(links, lambda x: (x["carrier"] == b["carrier"]) & (x["cell_id"] != b["cell_id"])), F.lit(0.0), lambda s, x: s + x["scaled"])
        every = others + b["noise"]
        sinr = 10 * F.log10(b["mw"] / every)
        rsrq = 10 * F.log10(b["rb"] * b["mw"] / (12 * b["rb"] * (b["mw"] + every)))
        ok = (b["rsrp"] >= rf.MIN_RSRP) & (sinr >= rf.MIN_SINR) & (rsrq >= rf.MIN_RSRQ)
        return F.struct(ok.cast("int").alias("ok"), F.floor(sinr * 10).cast("int").alias("level"))

    return F.when(F.size(links) > 0, F.transform(F.array(best), measured)[0])


#: What a sample without a link has in place of an outcome.
NONE = -(2**31)


def outcomes(samples: DataFrame) -> DataFrame:
    """(plan, masks, outs, n) of ``domain``: which azimuths reach n samples, and what these get from each subset of their links (bit i of
    the subset: the i-th place that reaches them), as 2 * level + ok, or NONE."""
    lit = lambda s: F.filter("links", lambda x, i: F.call_function("shiftright", s, i).bitwiseAND(F.lit(1)) == 1)
    coded = lambda o: F.coalesce(o["level"] * 2 + o["ok"], F.lit(NONE))
    outs = F.transform(F.sequence(F.lit(0), (F.pow(F.lit(2.0), F.size("links")) - 1).cast("int")), lambda s: coded(outcome(lit(s))))
    mask = lambda p: F.coalesce(F.get(F.filter("links", lambda x: x["place"] == p), F.lit(0))["mask"], F.lit(0).cast("long"))
    return samples.select("plan", F.array(*map(mask, range(MOST_CELLS))).alias("masks"), outs.alias("outs"), F.lit(1).cast("long").alias("n"))


def subsets(rsrp: np.ndarray, mw: np.ndarray, scaled: np.ndarray, carrier: np.ndarray, noise: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """The outcomes of samples with the same k links (the first three: a row a link, a column a sample): a row a sample, a column a subset."""
    k, n = rsrp.shape
    out, here = np.full((n, 2**k), NONE), np.arange(n)
    for s in range(1, 2**k):
        on = np.flatnonzero(s >> np.arange(k) & 1)
        best = on[np.argmax(rsrp[on], axis=0)]  # of equal ones the first
        others = np.zeros(n)
        for j in on:
            others += np.where((carrier[j] == carrier[best]) & (best != j), scaled[j], 0.0)
        p, q, every = rsrp[best, here], mw[best, here], others + noise[best]
        sinr, rsrq = 10 * np.log10(q / every), 10 * np.log10(rb[best] * q / (12 * rb[best] * (q + every)))
        ok = (p >= rf.MIN_RSRP) & (sinr >= rf.MIN_SINR) & (rsrq >= rf.MIN_RSRQ)
        out[:, s] = np.floor(sinr * 10).astype(np.int64) * 2 + ok
    return out


def heard_sums(samples: DataFrame, cells: DataFrame, levels: bool) -> DataFrame:
    """(plan, masks, outs, n) as of ``outcomes``, from samples and cells: links are used where they are found and are no rows. A row for each grid
    cell that the samples lie in. Without ``levels`` an outcome is ok alone (level 0), so that many samples have the same."""
    rb, noise = rf.resource_blocks(F.col("tech"), F.col("mhz")), rf.milliwatts(rf.thermal_noise(rf.spacing_khz(F.col("tech")) * 1000, F.lit(radio.FIGURE_DB)))
    more = {"ghz_db": 20 * F.log10("ghz"), "rb": rb.cast("double"), "rb_db": 10 * F.log10(12.0 * rb), "noise": noise, "carrier": F.xxhash64("tech", "channel", "ghz", "mhz")}
    discs = cells.withColumns(more).select("cell_id", "lon", "lat", "radius_m", "load", *more)

    def kernel(here: dict, held: dict) -> dict:
        def link(j: int, d: np.ndarray) -> tuple:
            power = radio.POWER_DBM + radio.GAIN_DBI - (20 * np.log10(np.maximum(np.sqrt(d * d + (radio.TX_M - radio.RX_M) ** 2), 1.0)) + held["ghz_db"][j] + 32.45)
            on = power > rf.SENSITIVITY_DBM
            return on, (power[on] - held["rb_db"][j], j)

        parts = []
        for plan, found in plans_in(here, held, radio.BEAM_DEG, link):
            heard = found[0][1] if len(found) == 1 else np.unique(np.concatenate([f[1] for f in found]))
            n, linked = len(heard), np.zeros(len(heard), np.int64)
            masks, rsrp, of = np.zeros((MOST_CELLS, n), np.int64), np.zeros((MOST_CELLS, n)), np.zeros(MOST_CELLS, np.int64)
            for place, i, mask, r, j in found:
                at = np.searchsorted(heard, i)
                masks[place, at], rsrp[place, at], of[place] = mask, r, j
                linked[at] |= 1 << place
            for pattern in np.unique(linked):
                places, i = np.flatnonzero(pattern >> np.arange(MOST_CELLS) & 1), np.flatnonzero(linked == pattern)
                r, j = rsrp[places][:, i], of[places]
                mw = 10.0 ** (r / 10)
                outs = subsets(r, mw, mw * held["load"][j][:, None], *(held[c][j] for c in ("carrier", "noise", "rb")))
                if not levels:
                    outs = np.where(outs == NONE, NONE, outs & 1)
                first, (count,) = merged([*masks[places][:, i], *outs.T], [np.ones(len(i), np.int64)])
                parts.append((np.full(len(first), plan), *masks[:, i[first]], outs[first].astype(np.int32), count))
        if not parts:
            return {}
        *columns, outs, count = zip(*parts)
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.full(len(o), o.shape[1]) for o in outs]))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, np.concatenate([o.ravel() for o in outs]))
        return {**dict(zip(("plan", *PLACES), map(np.concatenate, columns))), "outs": lists, "n": np.concatenate(count)}

    schema = ", ".join(["plan long", *(f"{m} long" for m in PLACES), "outs array<int>", "n long"])
    return disc_kernel(samples.select("lon", "lat"), discs, kernel, schema).select("plan", F.array(*PLACES).alias("masks"), "outs", "n")


class Heard:
    """Samples of a plan: which azimuths of which places reach them, and what they get from each subset of these."""

    def __init__(self, masks: np.ndarray, outs: pa.Array, n: np.ndarray):
        pattern = ((masks != 0).astype(np.int64) << np.arange(MOST_CELLS)).sum(1)
        starts, values = outs.offsets.to_numpy()[:-1], outs.values.to_numpy(zero_copy_only=False).astype(np.int64)
        self.all, self.parts = int(n.sum()), []
        for p in np.unique(pattern):
            rows, places = np.flatnonzero(pattern == p), np.flatnonzero(p >> np.arange(MOST_CELLS) & 1)
            table = values[starts[rows][:, None] + np.arange(2 ** len(places))]
            first, (count,) = merged([*masks[rows][:, places].T, *table.T], [n[rows]])
            self.parts.append((places, [bits(masks[rows[first], q]) for q in places], table[first], count))

    def tried(self, turns: list[int], place: int, levels: bool) -> tuple[np.ndarray, np.ndarray]:
        """At each azimuth of the cell at ``place``: the serviceable samples, and (with ``levels``) the nearest-rank tenth percentile of the SINR in dB, NaN without a sample."""
        good, counted = np.zeros(TURNS), []
        for places, at, table, n in self.parts:
            lit = sum((a[:, turns[q]].astype(np.int64) << j for j, (q, a) in enumerate(zip(places, at)) if q != place), np.zeros(len(n), np.int64))
            row, own = np.arange(len(n)), np.flatnonzero(places == place)
            off = table[row, lit]
            ok = lambda o: np.where(o == NONE, 0, o & 1)
            good += (n * ok(off)).sum()
            counted.append((off, n, np.ones((len(n), TURNS))))
            if len(own):
                on, a = table[row, lit | 1 << own[0]], at[own[0]]
                good += (n * (ok(on) - ok(off))) @ a
                counted += [(off, -n, a), (on, n, a)]
        return good, _tenth(counted) if levels else np.full(TURNS, np.nan)


def _tenth(counted: list[tuple]) -> np.ndarray:
    """The nearest-rank tenth percentile in dB at each azimuth, of (outcomes, how often, at which azimuths); NaN where there is none."""
    if not counted:
        return np.full(TURNS, np.nan)
    outs, n, at = (np.concatenate(x) for x in zip(*counted))
    some = outs != NONE
    found, of = np.unique(outs[some] >> 1, return_inverse=True)
    counts = np.zeros((len(found), TURNS))
    np.add.at(counts, of, n[some, None] * at[some])
    seen = np.cumsum(counts, axis=0)
    if not len(found):
        return np.full(TURNS, np.nan)
    return np.where(seen[-1] > 0, found[np.argmax(seen >= np.ceil(seen[-1] * 0.1), axis=0)] / 10, np.nan)


def judged(raw: dict, whole: dict, request: Request) -> tuple[np.ndarray, np.ndarray]:
    """(fits, score) of states: whether the limits are kept, and the weighted utilities that exist, 0 to 100 to four digits."""
    part = lambda a, b: np.clip(raw[a] / whole[b], 0.0, 1.0) if whole[b] > 0 else np.full(TURNS, np.nan)
    covered = raw["covered"]
    overlap = np.where(covered > 0, 1 - np.clip(raw["overlap"] / np.maximum(covered, 1), 0.0, 1.0), np.nan)
    u = {"demand": part("demand", "all_demand"), "residential": part("homes", "all_homes"), "overlap": overlap, "radio_quality": part("serviceable", "all_samples")}
    there, value = np.zeros(TURNS), np.zeros(TURNS)
    for k, w in request.weights.items():
        there += np.where(np.isnan(u[k]), 0.0, w)
        value += w * np.nan_to_num(u[k])
    score = rounded_array(np.divide(100 * value, there, out=np.zeros(TURNS), where=there > 0), 4)
    fits = np.full(TURNS, True)
    if request.most_overlap_ratio is not None:
        fits &= np.nan_to_num(1 - u["overlap"]) <= request.most_overlap_ratio
    if request.least_demand is not None:
        fits &= np.nan_to_num(u["demand"]) >= request.least_demand
    if request.least_serviceable is not None:
        fits &= np.nan_to_num(u["radio_quality"]) >= request.least_serviceable
    if request.least_p10_sinr is not None:
        fits &= raw["p10"] >= request.least_p10_sinr  # not where it is NaN
    return fits, score


def _judge(sums: dict, request: Request) -> Callable[[list[int], int], tuple[np.ndarray, np.ndarray]]:
    """(fits, score) of a plan at each of the 36 azimuths of the cell at a place."""
    masks = matrix(sums["masks"])
    of = lambda c, rows: sums[c].to_numpy(zero_copy_only=False)[rows]
    houses = sums["outs"].is_null().to_numpy(zero_copy_only=False)
    reached = Reached(masks[houses], [of(c, houses) for c in ("demand", "homes", "n")])
    heard = Heard(masks[~houses], sums["outs"].filter(pa.array(~houses)), of("n", ~houses))
    whole = dict(zip(("all_demand", "all_homes"), reached.sums.sum(1)), all_samples=heard.all)

    def tried(turns: list[int], place: int) -> tuple[np.ndarray, np.ndarray]:
        once, twice = reached.tried(turns, place)
        serviceable, p10 = heard.tried(turns, place, request.least_p10_sinr is not None)
        return judged({"demand": once[0], "homes": once[1], "covered": np.rint(once[2]), "overlap": np.rint(twice[2]), "serviceable": serviceable, "p10": p10}, whole, request)

    return tried


def _starts(tried: Callable, starts: list[tuple[int, list[int]]], most_passes: int, most_evaluations: int) -> Iterator[tuple]:
    """The rows of ``multistart`` of a plan."""
    known: set[tuple[int, ...]] = set()
    for start, turns in starts:
        now, seen, ended = None, {tuple(turns)}, ""
        for k in range(1, most_passes + 1):
            moved = False
            for place in (i for i, t in enumerate(turns) if t >= 0):
                fits, score = tried(turns, place)
                now = now or (bool(fits[turns[place]]), float(score[turns[place]]))
                turned = [(*turns[:place], t, *turns[place + 1 :]) for t in range(TURNS)]
                begun = len(known) < most_evaluations or tuple(turns) in known
                wanted = known.union(turned)  # the present state is one of them
                if len(wanted) > most_evaluations:
                    yield start, k if begun else 0, BUDGET, *now, [t * TURN_DEG for t in turns if t >= 0], most_evaluations
                    return
                known = wanted
                t = _best(fits, score)
                best = bool(fits[t]), float(score[t])
                if best > now:  # one that fits before others, then the score
                    now, turns, moved = best, list(turned[t]), True
                    if tuple(turns) in seen:
                        ended = REPEATED
                        break
                    seen.add(tuple(turns))
            ended = ended or (STABLE if not moved else PASSES if k == most_passes else "")
            if ended:
                break
        yield start, k, ended, *now, [t * TURN_DEG for t in turns if t >= 0], len(known)


def multistart(found: DataFrame, samples: DataFrame, plans: DataFrame, starts: tuple[int, ...], request: Request, most_passes: int = MOST_PASSES, most_evaluations: int = MOST_EVALUATIONS) -> DataFrame:
    """(plan, start, passes, ended, fits, score, azimuths, evaluations): starts in order; a start that would try more than
    ``most_evaluations`` different states of the plan in all ends where it stands, and no later one begins. ``samples`` are those of ``domain`` or
    ``heard_sums``."""
    heard = outcomes(samples) if "links" in samples.columns else samples
    sums = found.select("plan", "masks", "demand", "homes", "n").unionByName(heard, allowMissingColumns=True)

    def search(sums: dict, begin: dict) -> Iterator[tuple]:
        return _starts(_judge(sums, request), [(s, begin[s]) for s in starts], most_passes, most_evaluations)

    return by_plan(sums, start_states(plans, starts), search, "plan long, start int, passes int, ended string, fits boolean, score double, azimuths array<int>, evaluations int")


def network(spark, sf_dir, levels: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = lens.cells(spark, sf_dir)
    b = lens.buildings(spark, sf_dir).withColumnRenamed("residential", "homes")
    return reached_sums(b, cells, ["demand", "homes"], radio.BEAM_DEG), heard_sums(lens.samples(spark, sf_dir), cells, levels), plans_of(cells)


@query("objective_multistart")
def objective_multistart(spark, sf_dir):
    """Every plan of eight cells by demand, homes, overlap and radio quality from two starts, with a limit on overlap and a floor under the
    served demand. Iterative: no SQL twin."""
    return multistart(*network(spark, sf_dir), (0, 180), Request(most_overlap_ratio=0.6, least_demand=0.2))
