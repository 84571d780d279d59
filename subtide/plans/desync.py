"""Timing queries. An hour of events stands for ten seconds of a track: purchases for speech, each other type of event for a candidate's cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.operators import timing as T
from subtide.plans.registry import query
from subtide.session import table

#: Milliseconds: the step of the grid; steps: the farthest lag (two minutes) and how far a second peak lies (one second).
STEP, MOST, APART = 20, 6000, 50
_MS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 360000"


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").select("user_id", "event_type", F.expr(_MS).alias("start"), F.expr("cast(round(value * 100) AS BIGINT) * 8").alias("n"))
    return t.select("user_id", "event_type", "start", (F.col("start") + F.col("n")).alias("end"))


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = _spans(spark, sf)
    speech = T.on_grid(s.where("event_type = 'purchase'"), ["user_id"], STEP)
    return speech, T.on_grid(s.where("event_type <> 'purchase'"), ["user_id", "event_type"], STEP)


_RAW = """t AS (SELECT user_id, event_type, epoch_us(ts) // 360000 AS a, epoch_us(ts) // 360000 + round(value * 100)::BIGINT * 8 AS b FROM events)"""
_SIDES = f"""{_RAW},
g AS (SELECT user_id, event_type, a // {STEP} AS a, (b - 1) // {STEP} + 1 AS b FROM t WHERE b > a),
fr AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY user_id, event_type ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM g),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM fr),
m AS (SELECT user_id, event_type, min(a) AS a, max(b) AS b FROM isl GROUP BY user_id, event_type, i),
sp AS (SELECT user_id, a, b FROM m WHERE event_type = 'purchase'), cu AS (SELECT * FROM m WHERE event_type <> 'purchase')"""


def _cover(lags: str, cues: str, whole: str) -> str:
    """The overlap at each of ``lags``, pair by pair."""
    return f"""SELECT {whole}, k.lag, sum(greatest(0, least(s.b, c.b + k.lag) - greatest(s.a, c.a + k.lag)))::BIGINT AS matched
        FROM {lags} k JOIN {cues} c USING ({whole}) JOIN sp s USING (user_id) GROUP BY ALL"""


def _best(cues: str, whole: str, name: str) -> str:
    meets = ", ".join(f"s.{x} - c.{y}" for x in "ab" for y in "ab")
    return f"""{name}k AS (SELECT DISTINCT {whole}, lag FROM (SELECT {whole}, unnest([{meets}]) AS lag FROM {cues} c JOIN sp s USING (user_id)) WHERE abs(lag) <= {MOST}
        UNION SELECT DISTINCT {whole}, unnest([{-MOST}, 0, {MOST}])::BIGINT FROM {cues} c),
    {name}f AS ({_cover(f'{name}k', cues, whole)}),
    {name}b AS (SELECT * FROM {name}f QUALIFY row_number() OVER (PARTITION BY {whole} ORDER BY matched DESC, abs(lag), lag) = 1)"""


_WHOLE = "user_id, event_type"


@query(
    "x01_desync_best_lag",
    f"""WITH {_SIDES}, {_best('cu', _WHOLE, '')},
    k2 AS (SELECT user_id, event_type, k.lag FROM k JOIN b USING (user_id, event_type) WHERE abs(k.lag - b.lag) >= {APART}
           UNION SELECT user_id, event_type, x FROM (SELECT user_id, event_type, unnest([lag - {APART}, lag + {APART}]) AS x FROM b) WHERE abs(x) <= {MOST}),
    se AS (SELECT user_id, event_type, max(matched) AS second FROM ({_cover('k2', 'cu', _WHOLE)}) GROUP BY ALL),
    cn AS (SELECT user_id, event_type, sum(b - a)::BIGINT AS n FROM cu GROUP BY ALL), sn AS (SELECT user_id, sum(b - a)::BIGINT AS n FROM sp GROUP BY ALL)
    SELECT cn.user_id, cn.event_type, CASE WHEN b.matched > 0 THEN b.lag END AS lag, coalesce(b.matched, 0) AS matched, coalesce(se.second, 0) AS second,
           cn.n - coalesce(b.matched, 0) AS cues_unmatched, coalesce(sn.n, 0) - coalesce(b.matched, 0) AS speech_unmatched
    FROM cn LEFT JOIN b USING (user_id, event_type) LEFT JOIN se USING (user_id, event_type) LEFT JOIN sn USING (user_id)""",
)
def best_lag(spark: SparkSession, sf: str) -> DataFrame:
    speech, cues = _sides(spark, sf)
    return T.best_lags(speech, cues, ["user_id"], ["event_type"], MOST, APART)


WIDTH, DRIFT = 24_000, 500.0


@query(
    "x02_desync_local_fit",
    f"""WITH {_SIDES},
    cw AS (SELECT user_id, event_type, w AS part, greatest(a, w * {WIDTH // 2}) AS a, least(b, w * {WIDTH // 2} + {WIDTH}) AS b
           FROM (SELECT *, unnest(range((a - {WIDTH}) // {WIDTH // 2} + 1, (b - 1) // {WIDTH // 2} + 1)) AS w FROM cu)),
    {_best('cw', 'user_id, event_type, part', 'w')},
    n AS (SELECT user_id, event_type, part, sum(b - a)::BIGINT AS n FROM cw GROUP BY ALL),
    u AS (SELECT n.*, CASE WHEN matched > 0 AND 2 * matched >= n THEN lag END AS lag FROM n LEFT JOIN wb USING (user_id, event_type, part)),
    f AS (SELECT user_id, event_type, count(*) AS windows, count(lag) AS usable, coalesce(sum(lag), 0) AS total,
                 CASE WHEN count(lag) > 1 THEN round(regr_slope(lag::DOUBLE, part::DOUBLE), 4) + 0.0 END AS slope FROM u GROUP BY ALL)
    SELECT user_id, event_type, windows, usable, slope,
           CASE WHEN usable = 0 THEN 'bad_candidate' WHEN usable * 2 < windows THEN 'weak_match' WHEN abs(slope) >= {DRIFT} THEN 'possible_drift'
                WHEN abs(total) < usable THEN 'good_match' ELSE 'constant_offset' END AS verdict
    FROM f""",
)
def local_fit(spark: SparkSession, sf: str) -> DataFrame:
    speech, cues = _sides(spark, sf)
    return T.local_fit(speech, cues, ["user_id"], ["event_type"], MOST, WIDTH, DRIFT)


LAYERS = ("click", "error", "purchase", "signup", "view")
_BIT = " ".join(f"WHEN '{n}' THEN {1 << i}" for i, n in enumerate(LAYERS))


@query(
    "x03_layer_occupancy",
    f"""WITH {_RAW}, s AS (SELECT user_id, CASE event_type {_BIT} ELSE 0 END AS bit, a, b FROM t WHERE b > a AND bit > 0),
    p AS (SELECT user_id, a AS p FROM s UNION SELECT user_id, b FROM s),
    seg AS (SELECT user_id, p AS a, lead(p) OVER (PARTITION BY user_id ORDER BY p) AS b FROM p),
    mk AS (SELECT seg.user_id, seg.a, seg.b, coalesce(bit_or(s.bit), 0) AS mask FROM seg LEFT JOIN s ON s.user_id = seg.user_id AND s.a <= seg.a AND s.b >= seg.b
           WHERE seg.b IS NOT NULL GROUP BY ALL),
    ch AS (SELECT *, (mask <> coalesce(lag(mask) OVER (PARTITION BY user_id ORDER BY a), -1))::INT AS fresh FROM mk),
    gr AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS i FROM ch)
    SELECT user_id, min(a) AS start, max(b) AS "end", any_value(mask)::BIGINT AS mask FROM gr WHERE mask > 0 GROUP BY user_id, i""",
)
def layer_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return T.occupancy(_spans(spark, sf), ["user_id"], "event_type", LAYERS)


@query(
    "x06_speech_without_cue",
    f"""WITH {_RAW}, s AS (SELECT DISTINCT user_id, event_type = 'purchase' AS spoken, a, b FROM t WHERE b > a),
    p AS (SELECT user_id, a AS p FROM s UNION SELECT user_id, b FROM s),
    seg AS (SELECT user_id, p AS a, lead(p) OVER (PARTITION BY user_id ORDER BY p) AS b FROM p),
    st AS (SELECT seg.user_id, seg.a, seg.b, bool_or(s.spoken) AS spoken, bool_or(NOT s.spoken) AS cued FROM seg JOIN s ON s.user_id = seg.user_id AND s.a <= seg.a AND s.b >= seg.b GROUP BY ALL)
    SELECT user_id, sum(CASE WHEN spoken AND cued THEN b - a ELSE 0 END)::BIGINT AS both, sum(CASE WHEN spoken AND NOT cued THEN b - a ELSE 0 END)::BIGINT AS speech_only,
           sum(CASE WHEN NOT spoken THEN b - a ELSE 0 END)::BIGINT AS cues_only FROM st GROUP BY user_id""",
)
def speech_without_cue(spark: SparkSession, sf: str) -> DataFrame:
    whole = T.occupancy(_spans(spark, sf), ["user_id"], "event_type", LAYERS).withColumn("n", F.col("end") - F.col("start"))
    spoken, rest = T.speech_share(F.col("mask"), LAYERS.index("purchase")), F.col("mask") != 1 << LAYERS.index("purchase")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    return whole.groupBy("user_id").agg(total(spoken & rest).alias("both"), total(spoken & ~rest).alias("speech_only"), total(~spoken).alias("cues_only"))


#: Milliseconds: the residual of a sound cue, the shift of a good candidate, and how far its slope may carry it.
LEAST, OFFSET, CARRY = 200.0, 300.0, 5000.0
_X = "epoch_us(ts) // 1000 - 1704067200000"
_POINTS = f"""pt AS (SELECT event_id, user_id, {_X} AS x, CASE WHEN event_id % 11 <> 0 THEN
    {_X} + (user_id % 4) * 900 + ({_X}) * (user_id % 3) // 100000 + event_id * 7919 % 41 - 20 + CASE WHEN value > 150 THEN 4000 ELSE 0 END END AS y FROM events)"""


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Cues with the time that an aligner would have given them: shifted and stretched by user, with noise, misses and wild ones."""
    x = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000 - 1704067200000")
    t = table(spark, sf, "events").select("event_id", "user_id", "value", x.alias("x"))
    y = F.expr("x + (user_id % 4) * 900 + (x * (user_id % 3)) div 100000 + event_id * 7919 % 41 - 20 + if(value > 150, 4000, 0)")
    return t.select("event_id", "user_id", "x", F.when(F.col("event_id") % 11 != 0, y).alias("y"))


_LINE = f"""{_POINTS},
rk AS (SELECT user_id, x::DOUBLE AS x, y::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY x, y) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM pt WHERE y IS NOT NULL),
st AS (SELECT user_id, i, x, y, unnest(list_distinct([greatest(1, ceil(j * n / 8.0))::BIGINT FOR j IN range(1, 8)])) AS k FROM rk),
sl AS (SELECT r.user_id, median((r.y - st.y) / (r.x - st.x)) AS slope FROM rk r JOIN st ON st.user_id = r.user_id AND r.i = st.i + st.k WHERE r.x > st.x GROUP BY ALL),
ln AS (SELECT rk.user_id, any_value(coalesce(slope, 1)) AS slope, median(rk.y - coalesce(slope, 1) * rk.x) AS icept FROM rk LEFT JOIN sl USING (user_id) GROUP BY ALL),
rs AS (SELECT pt.*, pt.y::DOUBLE - (slope * pt.x::DOUBLE + icept) AS res FROM pt LEFT JOIN ln USING (user_id)),
md AS (SELECT user_id, median(abs(res)) AS mid FROM rs GROUP BY ALL),
su AS (SELECT rs.* FROM rs JOIN md USING (user_id) WHERE abs(res) > greatest({LEAST}, mid * 4.4478))"""


@query(
    "x04_timing_grade",
    f"""WITH {_LINE},
    bk AS (SELECT user_id, sum((y < before)::INT) AS backward, min(x) AS x0, max(x) AS x1 FROM (SELECT user_id, x, y, max(y) OVER (PARTITION BY user_id ORDER BY x, y
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pt WHERE y IS NOT NULL) GROUP BY ALL),
    q AS (SELECT user_id, count(*) AS cues, count(res) AS aligned, median(abs(res)) AS p50, quantile_cont(abs(res), 0.9) AS p90 FROM rs GROUP BY ALL),
    a AS (SELECT q.*, coalesce(bk.backward, 0)::BIGINT AS backward, ln.slope, ln.icept + (ln.slope - 1) * bk.x0 AS off, (ln.slope - 1) * (bk.x1 - bk.x0) AS drift,
                 coalesce(c.n, 0) AS suspicious FROM q LEFT JOIN ln USING (user_id) LEFT JOIN bk USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM su GROUP BY ALL) c USING (user_id))
    SELECT user_id, cues, aligned, backward, round(slope, 7) AS slope, round(off, 1) AS "offset", round(drift, 1) AS drift, round(p50, 2) AS p50, round(p90, 2) AS p90, suspicious,
           CASE WHEN aligned = 0 THEN 'unaligned' WHEN aligned < 0.8 * cues OR suspicious * 5 >= aligned THEN 'poor' WHEN abs(drift) > {CARRY} THEN 'drift'
                WHEN abs(off) > {OFFSET} THEN 'offset' ELSE 'good' END AS grade FROM a""",
)
def timing_grade(spark: SparkSession, sf: str) -> DataFrame:
    g = T.timing_grade(_points(spark, sf), ["user_id"], "x", "y", least=LEAST, offset=OFFSET, drift=CARRY)
    return g.select(
        "user_id", "cues", "aligned", F.col("backward").cast("long").alias("backward"), F.round("slope", 7).alias("slope"), F.round("offset", 1).alias("offset"),
        F.round("drift", 1).alias("drift"), F.round("p50", 2).alias("p50"), F.round("p90", 2).alias("p90"), "suspicious", "grade",
    )


@query("x05_suspicious_cues", f"WITH {_LINE} SELECT user_id, event_id, round(res, 1) AS residual FROM su")
def suspicious_cues(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    line = T.robust_line(points, ["user_id"], "x", "y")
    return T.suspicious_cues(points, line, ["user_id"], "x", "y", LEAST).select("user_id", "event_id", F.round("residual", 1).alias("residual"))
