"""Collector logs and inventories: state carried along a log, clock checks, windows, sampling, search, scenario differences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.functions.numeric import rounded, rounded_sql
from meridia.operators import folds
from meridia.operators.joins import carried, top_rows
from meridia.operators.ordered import followed, running
from meridia.plans import lens
from meridia.plans.registry import query

_L = f"WITH {lens.LOG}"
POINT_S = 3600


@query("locf_position", f"{_L} SELECT line, session, {rounded_sql('last_value(fix_lon IGNORE NULLS) OVER (PARTITION BY session ORDER BY line ROWS UNBOUNDED PRECEDING)', 7)} AS lon FROM lens_log")
def locf_position(spark, sf_dir):
    d = carried(lens.log(spark, sf_dir), ["session"], ["line"], "fix_lon", "at")
    return d.select("line", "session", rounded(F.col("at"), 7).alias("lon"))


@query("interval_point_state", f"""{_L}, p AS (SELECT line, session, epoch_ms, last_value(CASE WHEN point IS NOT NULL THEN {{'p': point, 't': epoch_ms}} END IGNORE NULLS) OVER (PARTITION BY session ORDER BY line ROWS UNBOUNDED PRECEDING) AS s FROM lens_log)
 SELECT line, session, CASE WHEN epoch_ms <= s.t + {POINT_S * 1000} THEN s.p END AS point FROM p""")
def interval_point_state(spark, sf_dir):
    """The survey point that is active at each row: the latest one announced, for an hour."""
    d = lens.log(spark, sf_dir).withColumn("said", F.when(F.col("point").isNotNull(), F.struct(F.col("point").alias("p"), F.col("epoch_ms").alias("t"))))
    d = carried(d, ["session"], ["line"], "said", "s")
    return d.select("line", "session", F.when(F.col("epoch_ms") <= F.col("s.t") + POINT_S * 1000, F.col("s.p")).alias("point"))


@query("clock_regression", f"{_L}, c AS (SELECT session, line, elapsed_ns, lag(elapsed_ns) OVER (PARTITION BY session ORDER BY line) AS before FROM lens_log) SELECT session, count(*)::BIGINT AS n, min(line) AS first_line FROM c WHERE elapsed_ns < before GROUP BY session")
def clock_regression(spark, sf_dir):
    before = F.lag("elapsed_ns").over(Window.partitionBy("session").orderBy("line"))
    return lens.log(spark, sf_dir).withColumn("before", before).where("elapsed_ns < before").groupBy("session").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query("collector_quality", f"{_L} SELECT point, count(*)::BIGINT AS n, count(DISTINCT session)::BIGINT AS sessions, count(*) FILTER (fix_lon IS NULL)::BIGINT AS without_fix, count(DISTINCT source) > 1 AS ambiguous FROM lens_log WHERE point IS NOT NULL GROUP BY point")
def collector_quality(spark, sf_dir):
    p = lens.log(spark, sf_dir).where("point IS NOT NULL")
    return p.groupBy("point").agg(F.count("*").alias("n"), F.count_distinct("session").alias("sessions"), F.count_if(F.col("fix_lon").isNull()).alias("without_fix"), (F.count_distinct("source") > 1).alias("ambiguous"))


@query("tumbling_budget", f"{_L} SELECT session, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*)::BIGINT AS n, count(*) > 2 AS over_budget FROM lens_log GROUP BY ALL")
def tumbling_budget(spark, sf_dir):
    w = lens.log(spark, sf_dir).groupBy("session", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select("session", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", (F.col("n") > 2).alias("over_budget"))


@query("sliding_activity", f"{_L}, h AS (SELECT source, time_bucket(INTERVAL 1 HOUR, ts) AS h, value FROM lens_log), e AS (SELECT source, h - INTERVAL (o) HOUR AS window_start, value FROM h, range(3) r(o)) SELECT source, window_start, count(*)::BIGINT AS n, {rounded_sql('sum(value)', 3)} AS total FROM e GROUP BY ALL")
def sliding_activity(spark, sf_dir):
    w = lens.log(spark, sf_dir).groupBy("source", F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), rounded(F.sum("value"), 3).alias("total"))
    return w.select("source", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query("session_followups", f"""{_L}, g AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY session ORDER BY ts, line) + INTERVAL 2 HOUR, true) AS fresh FROM lens_log), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY session ORDER BY ts, line ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT session, min(ts) AS began, max(ts) + INTERVAL 2 HOUR AS ended, count(*)::BIGINT AS n FROM s GROUP BY session, k""")
def session_followups(spark, sf_dir):
    w = lens.log(spark, sf_dir).groupBy("session", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("session", F.col("w.start").cast("timestamp_ntz").alias("began"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "n")


@query("newest_result", f"{_L} SELECT session, source, max(line) AS line, arg_max(value, line) AS value FROM lens_log GROUP BY session, source")
def newest_result(spark, sf_dir):
    return lens.log(spark, sf_dir).groupBy("session", "source").agg(F.max("line").alias("line"), F.max_by("value", "line").alias("value"))


@query("newest_events", f"{_L} SELECT line, session, source FROM lens_log ORDER BY ts DESC, line DESC LIMIT 80")
def newest_events(spark, sf_dir):
    """The 80 newest events (a top-k report)."""
    return lens.log(spark, sf_dir).orderBy(F.desc("ts"), F.desc("line")).limit(80).select("line", "session", "source")


@query("inventory_search", """SELECT p_partkey AS id, p_name AS name, level::INTEGER AS level, row_number() OVER (ORDER BY level, p_name, p_partkey)::INTEGER AS place FROM (SELECT *, CASE WHEN lower(p_name) = 'red bolt' OR p_partkey::VARCHAR = 'red bolt' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1 WHEN starts_with(p_partkey::VARCHAR, 'red') THEN 2 WHEN contains(lower(p_name), 'bolt') THEN 3 WHEN contains(p_partkey::VARCHAR, 'bolt') THEN 4 END AS level FROM part) WHERE level IS NOT NULL""")
def inventory_search(spark, sf_dir):
    """Five levels of relevance: equal, name begins, id begins, name holds, id holds; all hits are ranked."""
    name, key = F.lower("p_name"), F.col("p_partkey").cast("string")
    level = F.when((name == "red bolt") | (key == "red bolt"), 0).when(name.startswith("red"), 1).when(key.startswith("red"), 2).when(name.contains("bolt"), 3).when(key.contains("bolt"), 4)
    hits = lens.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), level.alias("level")).where("level IS NOT NULL")
    return running(hits, ["level", "name", "id"], "place").select("id", "name", "level", F.col("place").cast("int").alias("place"))


@query("stratified_sample", f"""WITH {lens.SAMPLES}, c AS (SELECT class, count(*) AS n FROM lens_samples GROUP BY class), a AS (SELECT class, n, 1000.0::DOUBLE * n / sum(n) OVER () AS want FROM c), q AS (SELECT *, (1000 - sum(floor(want)) OVER ())::BIGINT AS spare, row_number() OVER (ORDER BY want - floor(want) DESC, class) AS k FROM a),
 f AS (SELECT class, n, (floor(want) + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM q), r AS (SELECT s.sample_id, s.class, n, quota, row_number() OVER (PARTITION BY s.class ORDER BY sample_id) - 1 AS i FROM lens_samples s JOIN f USING (class))
 SELECT sample_id, class FROM r WHERE i * quota // n <> (i - 1) * quota // n OR i = 0""")
def stratified_sample(spark, sf_dir):
    """A thousand samples, shared out to classes by largest remainder, evenly spaced in each (a sampling operator)."""
    s = lens.samples(spark, sf_dir).select("sample_id", "class")
    everything = Window.partitionBy()
    c = s.groupBy("class").agg(F.count("*").alias("n")).withColumn("want", 1000.0 * F.col("n") / F.sum("n").over(everything))
    spare = 1000 - F.sum(F.floor("want")).over(everything)
    k = F.row_number().over(Window.orderBy(F.desc(F.col("want") - F.floor("want")), "class"))
    quota = c.withColumn("quota", F.floor("want") + F.when(k <= spare, 1).otherwise(0)).select("class", "n", "quota")
    ranked = running(s, ["class", "sample_id"], "place")  # in the order of classes: a class starts after those before it
    start = quota.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = ranked.join(start, "class").withColumn("i", F.col("place") - 1 - F.col("start"))
    step = lambda x: F.floor(x * F.col("quota") / F.col("n"))
    return r.where((F.col("i") == 0) | (step(F.col("i")) != step(F.col("i") - 1))).select("sample_id", "class")


@query("scenario_diff", f"WITH {lens.CELLS}, b AS (SELECT cell_id + 5 AS cell_id, CASE WHEN cell_id % 4 = 0 THEN azimuth ELSE azimuth + 1 END AS azimuth FROM lens_cells) SELECT cell_id, CASE WHEN a.azimuth IS NULL THEN 'added' WHEN b.azimuth IS NULL THEN 'removed' WHEN a.azimuth = b.azimuth THEN 'same' ELSE 'changed' END AS change FROM lens_cells a FULL JOIN b USING (cell_id)")
def scenario_diff(spark, sf_dir):
    a = lens.cells(spark, sf_dir).select("cell_id", F.col("azimuth").alias("a"))
    b = a.select((F.col("cell_id") + 5).alias("cell_id"), F.when(F.col("cell_id") % 4 == 0, F.col("a")).otherwise(F.col("a") + 1).alias("b"))
    return a.join(b, "cell_id", "full_outer").select("cell_id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("change"))


@query("unique_suffix", "SELECT p_partkey AS id, p_name || CASE WHEN k = 1 THEN '' ELSE '-' || k END AS code FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def unique_suffix(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    p = lens.table(spark, sf_dir, "part").withColumn("k", k)
    return p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("k") == 1, "").otherwise(F.concat(F.lit("-"), F.col("k").cast("string")))).alias("code"))


@query("neighbour_topology", f"""WITH {lens.CELLS}, n AS (SELECT cell_id, lead(cell_id) OVER w AS next_id, lon, lat, lead(lon) OVER w AS lon_b, lead(lat) OVER w AS lat_b FROM lens_cells WINDOW w AS (ORDER BY cell_id)), d AS (SELECT cell_id, next_id, sqrt(pow((lon_b - lon) * 111320.0 * cos(radians(lat)), 2) + pow((lat_b - lat) * 111320.0, 2)) AS d FROM n WHERE next_id IS NOT NULL)
 SELECT cell_id, next_id, {rounded_sql('d', 2)} AS metres, CASE WHEN d > 1200 THEN 'core' ELSE 'direct' END AS route FROM d""")
def neighbour_topology(spark, sf_dir):
    """Links of cells that follow each other by id; far ones go by the core."""
    from meridia.functions import geo

    c = lens.cells(spark, sf_dir).select("cell_id", "lon", "lat")
    n = followed(c, ["cell_id"], ["cell_id", "lon", "lat"]).where("next IS NOT NULL").select("cell_id", "lon", "lat", F.col("next.cell_id").alias("next_id"), F.col("next.lon").alias("lon_b"), F.col("next.lat").alias("lat_b"))
    d = geo.distance_m(F.col("lon"), F.col("lat"), F.col("lon_b"), F.col("lat_b"))
    return n.select("cell_id", "next_id", rounded(d, 2).alias("metres"), F.when(d > 1200, "core").otherwise("direct").alias("route"))


@query("duplicate_catalogue", "SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name HAVING count(*) = 1")
def duplicate_catalogue(spark, sf_dir):
    """Entries whose name occurs once; of doubled names none is trusted."""
    return lens.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")


_CHAIN = """WITH RECURSIVE LOG, o AS (SELECT session, line, epoch_us(ts) AS us, row_number() OVER (PARTITION BY session ORDER BY ts, line) AS k FROM lens_log),
 f AS (SELECT session, line, us, k, us AS began, us AS last, 1::BIGINT AS n FROM o WHERE k = 1
 UNION ALL SELECT o.session, o.line, o.us, o.k, CASE WHEN FRESH THEN o.us ELSE f.began END, o.us, CASE WHEN FRESH THEN 1 ELSE f.n + 1 END FROM f JOIN o ON o.session = f.session AND o.k = f.k + 1)"""
WIDTH_US, IDLE_US, WHOLE_US = 86_400_000_000, 43_200_000_000, 172_800_000_000


def _timed(spark, sf_dir):
    """(session, line, us): microseconds since 1970."""
    return lens.log(spark, sf_dir).select("session", "line", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("us"))


@query("anchored_budget", _CHAIN.replace("LOG", lens.LOG).replace("FRESH", f"o.us >= f.began + {WIDTH_US}") + " SELECT session, line, began, n, n > 2 AS refused FROM f")
def anchored_budget(spark, sf_dir):
    """Requests of a client in windows that begin with its first request after the last window; the third in a window is refused."""
    d = _timed(spark, sf_dir)
    f = folds.folded(d, ["session"], ["us", "line"], *folds.anchored_windows(WIDTH_US, "us"), "began long, n long")
    return f.select("session", "line", "began", "n", (F.col("n") > 2).alias("refused"))


@query("workflow_expiry", _CHAIN.replace("LOG", lens.LOG).replace("FRESH", f"(o.us >= f.last + {IDLE_US} OR o.us >= f.began + {WHOLE_US})") + f" SELECT session, began, least(max(us) + {IDLE_US}, began + {WHOLE_US}) AS ends, count(*)::BIGINT AS n FROM f GROUP BY session, began")
def workflow_expiry(spark, sf_dir):
    """Workflows that expire when idle, or for good some time after they began."""
    d = _timed(spark, sf_dir)
    f = folds.folded(d, ["session"], ["us", "line"], *folds.workflows(IDLE_US, WHOLE_US, "us"), "began long, place long")
    return f.groupBy("session", "began").agg(F.least(F.max("us") + IDLE_US, F.col("began") + WHOLE_US).alias("ends"), F.count("*").alias("n"))


_ENDS = "e AS (SELECT line, session, epoch_us(ts) AS t, 1 AS move FROM lens_log UNION ALL SELECT line, session, epoch_us(ts) + 60000000 * (1 + line % 240), -1 FROM lens_log)"


@query("concurrency_replay", f"{_L}, {_ENDS}, r AS (SELECT line, session, move, sum(move) OVER (PARTITION BY session ORDER BY t, move, line ROWS UNBOUNDED PRECEDING) AS own, sum(move) OVER (ORDER BY t, move, session, line ROWS UNBOUNDED PRECEDING) AS every FROM e) SELECT line, session, own::BIGINT AS own, every::BIGINT AS every, own > 1 OR every > 2 AS refused FROM r WHERE move = 1")
def concurrency_replay(spark, sf_dir):
    """Requests running at the start of each, of its client and of all: one more at a start, one less at an end, ends first."""
    d = _timed(spark, sf_dir)
    moves = F.array(F.struct(F.col("us").alias("t"), F.lit(1).alias("move")), F.struct((F.col("us") + 60000000 * (1 + F.col("line") % 240)).alias("t"), F.lit(-1).alias("move")))
    e = running(d.withColumn("m", F.explode(moves)).select("line", "session", "m.t", "m.move"), ["t", "move", "session", "line"], "every", F.col("move").cast("long"))
    own = F.sum("move").over(Window.partitionBy("session").orderBy("t", "move", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return e.withColumn("own", own).where("move = 1").select("line", "session", "own", "every", ((F.col("own") > 1) | (F.col("every") > 2)).alias("refused"))


_JOB = "line // 10"
_STATE = "CASE source WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'logout' THEN 'dismissed' WHEN 'click' THEN 'running' ELSE 'accepted' END"


@query("job_states", f"{_L}, s AS (SELECT {_JOB} AS job, line, {_STATE} AS state FROM lens_log), t AS (SELECT job, min(line) AS at, arg_min(state, line) AS state FROM s WHERE state IN ('succeeded', 'failed', 'dismissed') GROUP BY job) SELECT s.job, coalesce(any_value(t.state), CASE WHEN count(*) FILTER (s.state = 'running') > 0 THEN 'running' ELSE 'accepted' END) AS state, count(*) FILTER (s.state = 'running' AND (t.at IS NULL OR s.line < t.at))::BIGINT AS progress FROM s LEFT JOIN t USING (job) GROUP BY s.job")
def job_states(spark, sf_dir):
    """The state of each job: its first final event ends it, later events count for nothing; progress is the running events before.

    One aggregation: events are kept as a sorted set per job (a job has a few events)."""
    state = F.when(F.col("source") == "purchase", "succeeded").when(F.col("source") == "error", "failed").when(F.col("source") == "logout", "dismissed").when(F.col("source") == "click", "running").otherwise("accepted")
    s = lens.log(spark, sf_dir).select(F.floor(F.col("line") / 10).alias("job"), "line", state.alias("state"))
    final = F.col("state").isin("succeeded", "failed", "dismissed")
    g = s.groupBy("job").agg(F.min(F.when(final, F.struct("line", "state"))).alias("end"), F.collect_list(F.when(F.col("state") == "running", F.col("line"))).alias("ran"))
    progress = F.size(F.filter("ran", lambda x: F.col("end").isNull() | (x < F.col("end.line")))).cast("long")
    return g.select("job", F.coalesce("end.state", F.when(F.size("ran") > 0, "running").otherwise("accepted")).alias("state"), progress.alias("progress"))
