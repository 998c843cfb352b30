"""Transmitters by id, attributes or place: each rule and each reason, ties, and map entries by network."""

from meridia.operators import matching

OBS = "id long, transmitter_id string, serving_id string, pci long, channel string, ghz double, lon double, lat double"
CELLS = [("b", "B", 1, "x", 2.6, 32.0, 40.0), ("a", None, 1, "x", 2.6, 32.0, 40.002), ("c", "C", 2, "x", 28.0, 32.1, 40.0), ("d", "C", 2, None, 28.0, 32.1, 40.0), ("e", None, None, "y", None, 33.0, 40.0)]


def test_rules_in_order(spark):
    t = spark.createDataFrame(CELLS, "cell_id string, mapping_id string, pci long, channel string, ghz double, lon double, lat double")
    cases = [
        ((None, "b", 9, "z", None, None, None), ("b", matching.BY_ID, None)), (("C", "b", None, None, None, None, None), ("c", matching.BY_ID, None)), ((" ", "no", 1, "x", 2.6, 32.0, 40.0), (None, None, matching.NOT_FOUND)),
        ((None, None, None, "y", None, None, None), ("e", matching.BY_CELL, None)), ((None, "", 2, "x", 28.0000000004, None, None), ("c", matching.BY_CELL, None)), ((None, None, 3, None, None, 32.0, 40.0), (None, None, matching.NO_PLACE)),
        ((None, None, 1, None, None, None, 40.0), (None, None, matching.NO_PLACE)), ((None, None, 1, None, 2.6, 32.0, 40.0005), ("b", matching.BY_PLACE, None)), ((None, None, 1, "x", None, 32.0, 40.0019), ("a", matching.BY_PLACE, None)),
        ((None, None, 1, None, None, 32.0, 40.01), (None, None, matching.NOT_NEAR)), ((None, None, 2, None, 28.0, 32.1, 40.001), (None, None, matching.TIE)), ((None, None, None, None, None, 32.0, 40.0001), ("b", matching.BY_PLACE, None)),
    ]
    o = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], OBS)
    got = {r.id: (r.matched, r.method, r.reason) for r in matching.resolved(o, t).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}
    strict = {r.id: r.reason for r in matching.resolved(o, t, geographic=False).collect()}
    assert strict[5] == matching.NONE and strict[7] == matching.MANY and strict[3] is None
    assert matching.resolved(o.where("false"), t).count() == 0 and {r.reason for r in matching.resolved(o.where("id = 7"), t.where("false")).collect()} == {matching.NO_PLACE}


def test_map_entries_by_network(spark):
    e = spark.createDataFrame([(0, "1", "28602", "late"), (1, "1", " ", "any"), (2, "1", "28601", "never"), (3, "2", "28601", "own")], "place long, observed string, plmn string, cell_id string")
    o = spark.createDataFrame([(1, "1", "28601"), (2, "1", "28602"), (3, "2", "28602"), (4, "2", " 28601 "), (5, None, "28601"), (6, "1", None)], "id long, cell string, plmn string")
    assert {r.id: r.cell_id for r in matching.mapped(o, e).collect()} == {1: "any", 2: "late", 3: None, 4: "own", 5: None, 6: "any"}


def test_observations_meet_two_entries_at_most(spark, monkeypatch):
    """Many entries of one cell: only the first of each network is joined, and the answer is that of the plain rule."""
    met = []
    real = matching.shared_table
    monkeypatch.setattr(matching, "shared_table", lambda df, name: met.append(df.count()) or real(df, name), raising=False)
    entries = [(i, "o1", ("28601", " ", "28602", None)[i * 7 % 4], 1000 - i) for i in range(5, 400)] + [(3, "o2", "28602", 7), (None, "o2", "28601", 8)]
    observed = [(1, "o1", "28601"), (2, "o1", "28603"), (3, "o2", "28602"), (4, "o2", "28601"), (5, None, "28601"), (6, "o3", "28601"), (7, "o1", None), (8, " ", "28601")]
    e, o = spark.createDataFrame(entries, "place long, observed string, plmn string, cell_id long"), spark.createDataFrame(observed, "id long, cell string, plmn string")

    def plain(cell, plmn):
        fits = [(p, c) for p, at, net, c in entries if p is not None and at == cell and ((net or "").strip() in ("", plmn))]
        return min(fits)[1] if fits and (cell or "").strip() else None

    assert {r.id: r.cell_id for r in matching.mapped(o, e).collect()} == {i: plain(c, n) for i, c, n in observed}
    assert met and met[0] <= 4  # three networks of o1 and one of o2
