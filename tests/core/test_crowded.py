"""Steps on crowded tables: ties that only rounding noise decides, and pairs that must not be shuffled or written down."""

import pytest

from meridia.operators.joins import held
from meridia.plans import audits, catalogue, lens, radio

duckdb = pytest.importorskip("duckdb")


def test_places_of_equal_clearance_are_ties(spark, tmp_path):
    """Links over terrain whose least clearance is met more than once: the first place counts, here and in the SQL."""
    cells = [8054, 18086, 33765, 43086, 48375]
    d = duckdb.connect()
    d.execute(f"CREATE TABLE supplier AS SELECT (k + i)::BIGINT AS s_suppkey, ((k + i) % 1000 * 7 % 25)::BIGINT AS s_nationkey FROM (SELECT unnest({cells}) AS k), range(2) r(i)")
    d.execute("CREATE TABLE part AS SELECT range::BIGINT AS p_partkey FROM range(3000)")
    for t in ("supplier", "part"):
        d.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    mine = {r.cell_id: r.at_share for r in catalogue.QUERIES["terrain_clearance"](spark, str(tmp_path)).collect()}
    theirs = dict(d.execute(f"SELECT cell_id, at_share FROM ({catalogue.ORACLE['terrain_clearance']})").fetchall())
    assert mine == theirs
    assert (mine[8054], mine[48375]) == (0.2, 0.2)


SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crowd(spark):
    """Five points at one spot, one out of reach, and thirty cells around; cells 7 and 3 are twins and the nearest."""
    points = spark.createDataFrame([(i, 32.9, 40.0) for i in range(5)] + [(5, 32.99, 40.09)], "sample_id long, lon double, lat double")
    cells = [(k, 32.9, 40.0 + (0.0001 if k in (3, 7) else 0.002 + k / 1e5), 180.0, "5g", 28.0, 100.0, 400.0, "CH-1", 0.5) for k in range(30)]
    return points, spark.createDataFrame(cells, "cell_id long, lon double, lat double, azimuth double, tech string, ghz double, mhz double, radius_m double, channel string, load double")


def test_signals_are_summed_where_they_are_found(spark):
    points, cells = crowd(spark)
    q = radio.quality(points, cells)
    assert "Window" not in plan_of(q)  # which would shuffle and sort every pair
    rows = q.collect()
    assert sorted(r.sample_id for r in rows) == list(range(5)) and {(r.cell_id, r.n_signals, r.n_same) for r in rows} == {(3, 30, 30)}
    pairs = radio.signals(points, cells).where("sample_id = 0").collect()
    others = sum(10 ** (r.rsrp / 10) * r.load for r in pairs if r.cell_id != 3)
    assert all(abs(r.i_mw / others - 1) < 1e-9 and abs(r.rsrp - max(p.rsrp for p in pairs)) < 1e-9 for r in rows)


def test_points_in_discs_come_once(spark):
    points, cells = crowd(spark)
    assert sorted(r.sample_id for r in held(points, "sample_id", cells).collect()) == list(range(5))


@pytest.mark.parametrize("name", ["network_coverage", "coverage_gaps", "plan_compare", "building_entry", "objective_scores", "demand_interference"])
def test_pairs_of_cells_and_buildings_are_no_rows(name, spark):
    assert "FlatMapCoGroupsInArrow" in plan_of(catalogue.QUERIES[name](spark, SF))


def test_only_footprints_without_a_corner_in_a_disc_meet_discs(spark, monkeypatch):
    met = []
    real = audits.overlap_join
    monkeypatch.setattr(audits, "overlap_join", lambda left, *a, **k: met.append(left.count()) or real(left, *a, **k))
    every, n = lens.buildings(spark, "/root/testdata/sf0.01").count(), catalogue.QUERIES["footprints_in_reach"](spark, "/root/testdata/sf0.01").count()
    assert 0 < every - met[0] <= n
