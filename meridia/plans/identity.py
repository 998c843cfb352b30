"""Identifiers and fingerprints of stored things, retention, lists inside requests, fixed capability tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.functions import canonical, identity
from meridia.functions.numeric import rounded, rounded_sql
from meridia.plans import lens
from meridia.plans.registry import query

_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(TEXT, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


@query("scenario_fingerprints", f"""WITH {lens.CELLS}, t AS (SELECT cell_id, 'azimuth=:' || (azimuth::BIGINT) || chr(10) || 'cell_id=:' || cell_id || chr(10) || 'channel=:' || channel || chr(10) || 'tech=:' || tech AS said, channel || '/' || cell_id AS short FROM lens_cells)
 SELECT cell_id, left(sha256(said), 16) AS fingerprint, 'domain-v1-' || lpad(lower(to_hex({_FNV.replace('TEXT', 'short')})), 8, '0') AS content_id, ({_FNV.replace('TEXT', 'short')} % 1200)::BIGINT AS offset_ms FROM t""")
def scenario_fingerprints(spark, sf_dir):
    """Ids of a cell's settings, whatever the order in which they were given, and the offset of its simulated events."""
    c = lens.cells(spark, sf_dir)
    short = F.concat("channel", F.lit("/"), F.col("cell_id").cast("string"))
    settings = {"cell_id": F.col("cell_id"), "tech": F.col("tech"), "channel": F.col("channel"), "azimuth": F.col("azimuth").cast("long")}
    return c.select("cell_id", identity.fingerprint(settings).alias("fingerprint"), identity.content_fingerprint(short).alias("content_id"), (identity.fnv1a(short) % 1200).alias("offset_ms"))


_JSON = """'{"antenna":{"azimuth":' || azimuth::BIGINT || ',"tech":"' || tech || '"},"bands":[' || regexp_replace(ghz::VARCHAR, '\\.0$', '') || ',' || regexp_replace((mhz / 1000)::VARCHAR, '\\.0$', '') || '],"id":' || cell_id || ',"note":' || CASE WHEN cell_id % 3 = 0 THEN 'null' ELSE '"a \\"' || channel || '\\"\\n"' END || '}'"""


@query("canonical_scenarios", f"""WITH {lens.CELLS}, t AS (SELECT cell_id, {_JSON} AS said FROM lens_cells) SELECT cell_id, said, 'domain-v1-' || lpad(lower(to_hex({_FNV.replace('TEXT', 'said')})), 8, '0') AS content_id, 'network-' || left(sha256(said), 32) AS fingerprint FROM t""")
def canonical_scenarios(spark, sf_dir):
    """Nested settings as canonical JSON (sorted names, numbers as a browser writes them) and their two fingerprints; what only a screen needs is left out."""
    note = F.when(F.col("cell_id") % 3 != 0, F.concat(F.lit('a "'), F.col("channel"), F.lit('"\n')))
    scenario = F.struct(note.alias("note"), F.array("ghz", F.col("mhz") / 1000).alias("bands"), F.struct("tech", F.col("azimuth").cast("long").alias("azimuth"), F.lit(True).alias("selected")).alias("antenna"), F.col("cell_id").alias("id"), F.lit(1.5).alias("selected"))
    c = lens.cells(spark, sf_dir).select("cell_id", scenario.alias("s"))
    kind, screen = c.schema["s"].dataType, frozenset({"selected"})
    said = canonical.serialised(F.col("s"), kind, screen)
    return c.select("cell_id", said.alias("said")).select("cell_id", "said", identity.content_fingerprint(F.col("said")).alias("content_id"), F.concat(F.lit("network-"), F.substring(F.sha2("said", 256), 1, 32)).alias("fingerprint"))


@query("bounded_identifiers", "SELECT p_partkey AS id, CASE WHEN strlen(t) <= 40 THEN t ELSE left(t, 27) || '-' || left(sha256(t), 12) END AS code FROM (SELECT *, repeat(p_name || ' ', (1 + p_partkey % 6)::INTEGER) AS t FROM part)")
def bounded_identifiers(spark, sf_dir):
    text = F.repeat(F.concat("p_name", F.lit(" ")), (1 + F.col("p_partkey") % 6).cast("int"))
    return lens.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), identity.bounded(text, 40).alias("code"))


_FORMS = "CASE p_partkey % 6 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_partkey || '.0' WHEN 2 THEN '-' || p_partkey WHEN 3 THEN p_partkey || '.5' WHEN 4 THEN 'x' || p_partkey ELSE ' ' || p_partkey || ' ' END"


@query("positive_ids", f"WITH t AS (SELECT p_partkey AS id, trim({_FORMS}) AS said FROM part), n AS (SELECT *, try_cast(said AS DECIMAL(38, 9)) AS n FROM t) SELECT id, CASE WHEN n > 0 AND n = floor(n) THEN n END::BIGINT AS number FROM n")
def positive_ids(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    form = F.expr("p_partkey % 6")
    said = F.when(form == 0, k).when(form == 1, F.concat(k, F.lit(".0"))).when(form == 2, F.concat(F.lit("-"), k)).when(form == 3, F.concat(k, F.lit(".5"))).when(form == 4, F.concat(F.lit("x"), k)).otherwise(F.concat(F.lit(" "), k, F.lit(" ")))
    return lens.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), identity.positive_integer(said).alias("number"))


@query("run_retention", f"WITH {lens.LOG} SELECT session, line, place::INTEGER AS place FROM (SELECT session, line, row_number() OVER (PARTITION BY session ORDER BY ts DESC, line DESC) AS place FROM lens_log) WHERE place <= 16")
def run_retention(spark, sf_dir):
    """Of each session the 16 newest entries stay (a cache's size)."""
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("line")))
    return lens.log(spark, sf_dir).select("session", "line", place.alias("place")).where("place <= 16")


@query("deletable_runs", f"WITH {lens.LOG} SELECT line, session FROM lens_log WHERE line NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)")
def deletable_runs(spark, sf_dir):
    """Runs that nothing refers to: only these may be deleted."""
    used = lens.table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("line"))
    return lens.log(spark, sf_dir).select("line", "session").join(used, "line", "left_anti")


def in_scope(rays, scope: str, selected=None, default=None, cell: str = "cell_id"):
    """Rays to show: all, none (``hidden``), or those of the selected cell; rays without a cell belong to the default one."""
    if scope == "hidden":
        return rays.limit(0)
    if scope != "selected":
        return rays
    wanted = default if selected in (None, "") else selected
    if wanted in (None, ""):
        return rays.limit(0)
    own = F.coalesce(F.col(cell).cast("string"), F.lit("")) == str(wanted)
    orphan = F.coalesce(F.col(cell).cast("string"), F.lit("")) == ""
    return rays.where(own | orphan if default is not None and str(default) == str(wanted) else own)


@query("ray_scope", f"WITH {lens.SAMPLES}, r AS (SELECT sample_id, CASE WHEN sample_id % 5 <> 0 THEN cell_id END AS cell_id FROM lens_samples) SELECT sample_id, cell_id FROM r WHERE cell_id = 7 OR cell_id IS NULL")
def ray_scope(spark, sf_dir):
    r = lens.samples(spark, sf_dir).select("sample_id", F.when(F.col("sample_id") % 5 != 0, F.col("cell_id")).alias("cell_id"))
    return in_scope(r, "selected", None, 7)


_AXES = ("azimuth", "ghz", "load", "radius_m")


@query("axis_spread", f"WITH {lens.CELLS}, s AS ({' UNION ALL '.join(f'SELECT {i} AS i, {a!r} AS axis, max({a}) - min({a}) AS spread FROM lens_cells' for i, a in enumerate(_AXES))}) SELECT axis, {rounded_sql('spread', 4)} AS spread, row_number() OVER (ORDER BY spread DESC, i)::INTEGER AS place FROM s")
def axis_spread(spark, sf_dir):
    """Objectives by the width of their values; the first two make the axes of a chart. One aggregation, unpivoted."""
    s = lens.cells(spark, sf_dir).agg(*((F.max(a) - F.min(a)).alias(a) for a in _AXES))
    rows = s.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("axis"), F.col(a).alias("spread")) for i, a in enumerate(_AXES)))).alias("x")).select("x.*")
    place = F.row_number().over(Window.orderBy(F.desc("spread"), "i"))  # one row an axis
    return rows.select("axis", rounded(F.col("spread"), 4).alias("spread"), place.alias("place"))


@query("tower_lists", f"""WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN repeat('a,', 65) WHEN c_custkey % 9 = 1 THEN repeat('b', 129) ELSE ' T' || c_custkey % 3 || ', T' || c_custkey % 2 || ',, T0 ' END AS said FROM customer),
 p AS (SELECT id, list_filter(list_transform(string_split(said, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM t), q AS (SELECT id, p, CASE WHEN len(p) > 64 THEN 'too_many' WHEN len(list_filter(p, lambda x: strlen(x) > 128)) > 0 THEN 'id_too_long' END AS problem FROM p),
 d AS (SELECT id, problem, list_filter(p, lambda x, i: list_position(p, x) = i) AS ids FROM q)
 SELECT id, problem, CASE WHEN problem IS NULL THEN array_to_string(ids, '|') END AS towers, CASE WHEN problem IS NULL THEN len(list_filter(ids, lambda x: x IN ('T0', 'T2')))::BIGINT END AS placed FROM d""")
def tower_lists(spark, sf_dir):
    """Tower lists of requests, and how many of them have a place in ``id:lon:lat`` lists."""
    k = F.col("c_custkey")
    said = F.when(k % 9 == 0, F.repeat(F.lit("a,"), F.lit(65))).when(k % 9 == 1, F.repeat(F.lit("b"), F.lit(129))).otherwise(F.concat(F.lit(" T"), (k % 3).cast("string"), F.lit(", T"), (k % 2).cast("string"), F.lit(",, T0 ")))
    c = lens.table(spark, sf_dir, "customer").select(k.alias("id"), identity.tower_ids(said).alias("t"))
    placed = identity.tower_locations(F.lit("T0:32.8:39.9;T1:x:1;T2:32.9:40; T9:1:1;bad"), F.col("t.ids"))
    return c.select("id", "t.problem", F.array_join("t.ids", "|").alias("towers"), F.when(F.col("t.problem").isNull(), F.size(placed).cast("long")).alias("placed"))


_BOX = "CASE c_custkey % 5 WHEN 0 THEN '32.8,39.9,32.9' WHEN 1 THEN '32.8,x,32.9,40' WHEN 2 THEN '32.9,39.9,32.8,40' WHEN 3 THEN '30,35,35,40' ELSE ' 32.8, 39.9,32.' || (81 + c_custkey % 9) || ',39.95' END"


@query("bounding_boxes", f"SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'four_numbers_required' WHEN 1 THEN 'invalid_coordinate' WHEN 2 THEN 'invalid_bounds' WHEN 3 THEN 'too_wide' END AS problem, CASE WHEN c_custkey % 5 = 4 THEN ('32.' || (81 + c_custkey % 9))::DOUBLE END AS max_lon FROM customer")
def bounding_boxes(spark, sf_dir):
    said = F.expr(_BOX.replace("'32.' || (81 + c_custkey % 9)", "'32.' || cast(81 + c_custkey % 9 as string)").replace("32.' || (81 + c_custkey % 9) ||", "32.' || cast(81 + c_custkey % 9 as string) ||"))
    return lens.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), identity.bounding_box(said).alias("b")).select("id", "b.problem", "b.max_lon")


#: The services of the engine, and those that leave the research carrier out.
SERVICES = ("analyze-sector", "simulate", "coverage-surface", "optimize-azimuth", "optimize-network", "evaluate-network", "coverage-gaps", "explain-network-cell", "recommend-sites", "path-profile", "interference", "measurements/evaluate")
NO_RESEARCH, RESEARCH_ONLY = ("interference", "measurements/evaluate", "recommend-sites"), ("path-profile",)
CARRIERS = {"4g": 2.6, "5g": 28.0, "6g": 140.0}


@query("capability_matrix", f"SELECT s AS service, t AS tech, CASE t WHEN '4g' THEN 2.6::DOUBLE WHEN '5g' THEN 28.0::DOUBLE ELSE 140.0::DOUBLE END AS ghz, CASE WHEN t = '6g' AND s IN {NO_RESEARCH} THEN 'unsupported' WHEN t = '6g' AND s = 'path-profile' THEN 'research_only' ELSE 'supported' END AS status FROM unnest({list(SERVICES)}) a(s), unnest(['4g', '5g', '6g']) b(t)")
def capability_matrix(spark, sf_dir):
    """Which service takes which technology (a fixed table)."""
    rows = [(s, t, g, "unsupported" if t == "6g" and s in NO_RESEARCH else "research_only" if t == "6g" and s in RESEARCH_ONLY else "supported") for s in SERVICES for t, g in CARRIERS.items()]
    return spark.createDataFrame(rows, "service string, tech string, ghz double, status string")


#: Functions of the core, and what a scenario does to one.
FUNCTIONS = ("NRF", "AMF", "SMF", "UPF", "UDM", "UDR", "AUSF", "PCF", "NSSF")
HURT = {"upf_degraded": ("UPF", "degraded"), "udm_outage": ("UDM", "down"), "pcf_policy_degraded": ("PCF", "degraded")}


@query("core_status", f"WITH s AS (SELECT p_partkey AS run, ['normal', 'upf_degraded', 'udm_outage', 'pcf_policy_degraded'][p_partkey % 4 + 1] AS scenario, p_partkey % 10 = 0 AS off FROM part) SELECT run, f AS name, CASE WHEN off THEN 'unknown' WHEN (scenario, f) IN (('upf_degraded', 'UPF'), ('pcf_policy_degraded', 'PCF')) THEN 'degraded' WHEN (scenario, f) = ('udm_outage', 'UDM') THEN 'down' ELSE 'active' END AS status, CASE WHEN off THEN 0 ELSE 8 + 3 * i END::INTEGER AS latency_ms, CASE WHEN off THEN 'disconnected' WHEN scenario <> 'normal' THEN 'scenario_running' ELSE 'connected' END AS lab FROM s, (SELECT unnest({list(FUNCTIONS)}) AS f, unnest(range({len(FUNCTIONS)})) AS i)")
def core_status(spark, sf_dir):
    """State of each core function in each lab run: a scenario hurts one of them, without endpoints all are unknown."""
    k = F.col("p_partkey")
    runs = lens.table(spark, sf_dir, "part").select(k.alias("run"), lens._pick(("normal", *HURT), k).alias("scenario"), (k % 10 == 0).alias("off"))
    e = runs.withColumn("f", F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.lit(i).alias("i")) for i, f in enumerate(FUNCTIONS)))))
    status = F.when(F.col("off"), "unknown")
    for scenario, (name, state) in HURT.items():
        status = status.when((F.col("scenario") == scenario) & (F.col("f.name") == name), state)
    return e.select("run", "f.name", status.otherwise("active").alias("status"), F.when(F.col("off"), 0).otherwise(8 + 3 * F.col("f.i")).alias("latency_ms"), F.when(F.col("off"), "disconnected").when(F.col("scenario") != "normal", "scenario_running").otherwise("connected").alias("lab"))


@query("component_status", f"WITH {lens.SAMPLES}, r AS (SELECT sample_id, CASE WHEN sample_id % 6 = 0 THEN 240.0 ELSE ghz END AS ghz, sample_id % 2 = 0 AS gas, sample_id % 3 = 0 AS rain, sample_id % 4 <> 0 AS fog FROM lens_samples) SELECT sample_id, 'included' AS free_space, CASE WHEN gas THEN 'included' ELSE 'disabled' END AS gas, CASE WHEN rain THEN 'included' ELSE 'disabled' END AS rain, CASE WHEN NOT fog THEN 'disabled' WHEN ghz <= 200 THEN 'included' ELSE 'out_of_scope' END AS fog FROM r")
def component_status(spark, sf_dir):
    """Which parts of an atmospheric reference a request takes: fog only up to 200 GHz."""
    k = F.col("sample_id")
    ghz = F.when(k % 6 == 0, 240.0).otherwise(F.col("ghz"))
    on = lambda x: F.when(x, "included").otherwise("disabled")
    return lens.samples(spark, sf_dir).select("sample_id", F.lit("included").alias("free_space"), on(k % 2 == 0).alias("gas"), on(k % 3 == 0).alias("rain"), F.when(k % 4 == 0, "disabled").when(ghz <= 200, "included").otherwise("out_of_scope").alias("fog"))
