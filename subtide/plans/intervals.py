"""Interval queries: an event spans from its time for thirty seconds per hundredth of its value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subtide.operators import intervals as I
from subtide.plans.registry import query
from subtide.session import table

MINUTE = 60_000_000
_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def spans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.expr(_US).alias("start"),
        F.expr(f"{_US} + cast(round(value * 100) AS BIGINT) * 30000000").alias("end"), "ts",
    )


_SPANS = "s AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS start, epoch_us(ts) + round(value * 100)::BIGINT * 30000000 AS \"end\", ts FROM events)"
_DAY = 86_400_000_000
_LO, _HI = 1704067200000000, 1704067200000000 + 20 * _DAY


def _merged(gap: int, pad: int, least: int) -> str:
    return f"""{_SPANS},
c AS (SELECT user_id, start AS os, "end" AS oe, greatest({_LO}, start - {pad}) AS a, least({_HI}, "end" + {pad}) AS e FROM s),
k AS (SELECT * FROM c WHERE e > a),
f AS (SELECT *, coalesce(a > max(e) OVER (PARTITION BY user_id ORDER BY os, oe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}, true)::INT AS fresh FROM k),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY os, oe ROWS UNBOUNDED PRECEDING) AS isl FROM f),
m AS (SELECT user_id, min(a) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY user_id, isl HAVING max(e) - min(a) >= {least})"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return I.merge_spans(spans(spark, sf), ["user_id"], "start", "end", lo=F.lit(_LO), hi=F.lit(_HI), gap=5 * MINUTE, pad=MINUTE, least=10 * MINUTE)


@query("g02_merge_islands", f'WITH {_merged(5 * MINUTE, MINUTE, 10 * MINUTE)} SELECT user_id, start, "end", n FROM m')
def merge_islands(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf)


_GAPS = f"""{_merged(5 * MINUTE, MINUTE, 10 * MINUTE)},
u AS (SELECT user_id, start AS a, "end" AS e FROM m UNION ALL SELECT DISTINCT user_id, {_HI}, {_HI} FROM m),
q AS (SELECT user_id, a, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {_LO}) AS c FROM u),
g AS (SELECT DISTINCT user_id, c AS start, a AS "end" FROM q WHERE a - c >= {60 * MINUTE})"""


@query("g03_gaps_in_bounds", f'WITH {_GAPS} SELECT user_id, start, "end" FROM g')
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    m = merged(spark, sf).withColumn("lo", F.lit(_LO)).withColumn("hi", F.lit(_HI))
    return I.gaps(m, ["user_id"], "start", "end", "lo", "hi", 60 * MINUTE)


_RUNS = """d AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS day FROM events),
r AS (SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d) GROUP BY user_id, g)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").select("user_id", F.expr(f"{_US} div 86400000000").alias("day"))
    return I.consecutive_runs(days, ["user_id"], "day")


@query("g04_consecutive_runs", f"WITH {_RUNS} SELECT user_id, first, last, n FROM r")
def consecutive(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf)


@query("g05_longest_run", f"WITH {_RUNS} SELECT user_id, first, last, n FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1")
def longest(spark: SparkSession, sf: str) -> DataFrame:
    return I.longest_run(runs(spark, sf), ["user_id"])


@query(
    "g06_overlap_validation",
    f'WITH {_SPANS} SELECT event_id, previous_end FROM (SELECT *, lag("end") OVER (PARTITION BY user_id ORDER BY event_id) AS previous_end FROM s) WHERE start < previous_end',
)
def overlap_faults(spark: SparkSession, sf: str) -> DataFrame:
    return I.monotonic_faults(spans(spark, sf), ["user_id"], "start", "end", "event_id").select("event_id", "previous_end")


@query(
    "g07_running_start_diagnostics",
    f"""WITH {_SPANS} SELECT event_id, running_max FROM (SELECT *, coalesce(max("end") OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS running_max FROM s)
        WHERE start < running_max - {30 * MINUTE}""",
)
def running_faults(spark: SparkSession, sf: str) -> DataFrame:
    return I.running_faults(spans(spark, sf), ["user_id"], "start", "event_id", 30 * MINUTE, of="end").select("event_id", "running_max")


@query(
    "g09_adjacent_pairs",
    """SELECT user_id, index, start, "end" FROM (SELECT user_id, row_number() OVER w - 1 AS index, day AS start, lead(day) OVER w AS "end"
       FROM (SELECT user_id, epoch_us(ts) // 86400000000 AS day FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY day)) WHERE "end" > start""",
)
def adjacent(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").select("user_id", F.expr(f"{_US} div 86400000000").alias("day"))
    pairs = I.adjacent_pairs(days, ["user_id"], "day")
    return pairs.withColumn("index", F.col("index").cast("long"))


@query(
    "g10_pair_timestamps",
    """WITH o AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
       SELECT user_id, i // 2 AS pair, min(t) AS start, max(t) AS "end" FROM o GROUP BY user_id, i // 2 HAVING count(*) = 2""",
)
def pair_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    o = table(spark, sf, "events").select("user_id", F.expr(_US).alias("t"), F.expr("1").alias("one"), i.cast("long").alias("i"))
    p = o.groupBy("user_id", F.expr("i div 2").alias("pair")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.sum("one").alias("n"))
    return p.where("n = 2").drop("n")


@query(
    "g11_even_sample",
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), k AS (SELECT user_id, n, unnest(range(0, 7)) AS i FROM c)
       SELECT DISTINCT user_id, CASE WHEN n <= 7 THEN i ELSE round_even(i * (n - 1) / 6.0, 0)::BIGINT END AS place FROM k WHERE n > 7 OR i < n""",
)
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return c.select("user_id", F.explode(I.even_sample(F.col("n"), 7)).alias("place")).withColumn("place", F.col("place").cast("long"))


_TARGETS = f"t AS (SELECT user_id, {_LO} + k * {7 * 3600 * 1_000_000} AS target FROM (SELECT DISTINCT user_id FROM m), (SELECT unnest(range(1, 20)) AS k)), b AS (SELECT *, target - {120 * MINUTE} AS f, target + {120 * MINUTE} AS u FROM t)"


def targets(users: DataFrame) -> DataFrame:
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(19).cast("long"))).alias("k")
    t = users.select("user_id", k).select("user_id", (F.lit(_LO) + F.col("k") * (7 * 3600 * 1_000_000)).alias("target"))
    return t.withColumn("f", F.col("target") - 120 * MINUTE).withColumn("u", F.col("target") + 120 * MINUTE)


@query(
    "k02_nearest_gap_cut",
    f"""WITH {_GAPS}, {_TARGETS},
    j AS (SELECT b.user_id, b.target, b.f, b.u, CASE WHEN g.start IS NOT NULL THEN greatest(g.start, f) END AS gs, CASE WHEN g.start IS NOT NULL THEN least(g."end", u) END AS ge FROM b LEFT JOIN g ON g.user_id = b.user_id AND g.start < u AND g."end" > f),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, target ORDER BY CASE WHEN gs IS NULL THEN 0 WHEN target < gs THEN gs - target WHEN target > ge THEN target - ge ELSE 0 END, gs - ge, gs) AS rn FROM j)
    SELECT user_id, target, CASE WHEN gs IS NULL THEN target ELSE least(ge, greatest(gs, target)) END AS cut, gs IS NULL AS fallback FROM r WHERE rn = 1""",
)
def nearest_gap(spark: SparkSession, sf: str) -> DataFrame:
    m = merged(spark, sf)
    g = gaps(spark, sf)
    cuts = I.nearest_gap_cut(targets(m.select("user_id").distinct()), g, ["user_id"], "target", "f", "u")
    return cuts.select("user_id", "target", "cut", "fallback")


@query(
    "k03_split_targets",
    """WITH u AS (SELECT user_id, 0.0::DOUBLE AS lo, sum(round(value * 100))::DOUBLE / 100 AS hi FROM events GROUP BY user_id),
       t AS (SELECT user_id, hi, unnest(range(1, (ceil(hi / 500) + 1)::BIGINT)) AS k FROM u)
       SELECT user_id, (k - 1)::INT AS index, k * 500.0::DOUBLE AS target, greatest(0.0::DOUBLE, k * 500.0::DOUBLE - 60) AS "from", round(least(hi, k * 500.0::DOUBLE + 60), 2) AS "to" FROM t WHERE k * 500.0 < hi""",
)
def split_targets(spark: SparkSession, sf: str) -> DataFrame:
    total = F.sum(F.expr("cast(round(value * 100) AS BIGINT)")).cast("double") / 100
    u = table(spark, sf, "events").groupBy("user_id").agg(F.lit(0.0).alias("lo"), total.alias("hi"))
    return I.split_targets(u, ["user_id"], "lo", "hi", 500.0, 60.0).withColumn("to", F.round("to", 2))


@query("k01_shift_clamp", "SELECT event_id, greatest(0e0, value - 5e0) AS start, greatest(greatest(0e0, value - 5e0), value + 2e0 - 5e0) AS \"end\", CASE WHEN value - 5e0 >= 0 THEN value - 5e0 END AS strict FROM events")
def shift_clamp(spark: SparkSession, sf: str) -> DataFrame:
    s, e = I.shift(F.col("value"), F.col("value") + 2, -5.0)
    strict, _ = I.shift(F.col("value"), F.col("value") + 2, -5.0, clamp=False)
    return table(spark, sf, "events").select("event_id", s.alias("start"), e.alias("end"), strict.alias("strict"))


@query(
    "e18_asof_first_end",
    f"""WITH {_SPANS}, p AS (SELECT o_orderkey, o_custkey % 150 AS user_id, {_LO} + (o_orderkey * 7919 % 2592000) * 1000000 AS at FROM orders),
    e AS (SELECT user_id, "end", max(event_id) AS event_id, min(event_id) AS first_id FROM s GROUP BY ALL),
    l AS (SELECT user_id, max(struct_pack(e := "end", v := event_id)).v AS last_id FROM s GROUP BY user_id)
    SELECT p.o_orderkey, coalesce((SELECT min(struct_pack(e := s."end", v := s.event_id)).e FROM s WHERE s.user_id = p.user_id AND s."end" >= p.at), l_end) AS span_end
    FROM p JOIN (SELECT user_id, max("end") AS l_end FROM s GROUP BY user_id) m ON m.user_id = p.user_id""",
)
def asof(spark: SparkSession, sf: str) -> DataFrame:
    s = spans(spark, sf).select("user_id", "end", F.col("end").alias("span_end"))
    p = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), (F.lit(_LO) + (F.col("o_orderkey") * 7919 % 2592000) * 1000000).alias("at"))
    return I.asof_first_end(p, s, ["user_id"], "at", "end", "span_end").where("span_end IS NOT NULL").select("o_orderkey", "span_end")


@query(
    "e19_max_overlap_cell",
    f"""WITH {_SPANS}, u AS (SELECT DISTINCT user_id FROM s), c AS (SELECT user_id, k AS cell, {_LO} + k * {_DAY} AS start, {_LO} + (k + 1) * {_DAY} AS "end" FROM u, (SELECT unnest(range(0, 10)) AS k)),
    j AS (SELECT c.user_id, c.cell, s.event_id, CASE WHEN s.event_id IS NOT NULL THEN least(c."end", s."end") - greatest(c.start, s.start) END AS overlap FROM c LEFT JOIN s ON s.user_id = c.user_id AND s.start < c."end" AND c.start < s."end")
    SELECT user_id, cell, event_id, overlap FROM j QUALIFY row_number() OVER (PARTITION BY user_id, cell ORDER BY overlap DESC, event_id) = 1""",
)
def overlap_cell(spark: SparkSession, sf: str) -> DataFrame:
    s = spans(spark, sf).select("user_id", "event_id", "start", "end")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("cell")
    c = s.select("user_id").distinct().select("user_id", k).select("user_id", "cell", (F.lit(_LO) + F.col("cell") * _DAY).alias("start"), (F.lit(_LO) + (F.col("cell") + 1) * _DAY).alias("end"))
    return I.max_overlap(c, s, ["user_id"], "event_id").select("user_id", "cell", "event_id", "overlap")


@query(
    "m01_session_debounce",
    """WITH f AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, true)::INT AS fresh FROM events),
       g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
       SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM g GROUP BY user_id, k""",
)
def debounce(spark: SparkSession, sf: str) -> DataFrame:
    b = I.debounce(table(spark, sf, "events"), "user_id", "ts", "6 hours")
    us = lambda c: F.expr(_US.replace("ts)", f"{c})"))
    return b.select("user_id", us("first").alias("first"), us("last").alias("last"), "n")


@query("d16_span_overlap_test", f'WITH {_SPANS} SELECT user_id, count(*) AS n FROM s WHERE start < {_LO + 5 * _DAY} AND "end" > {_LO + 4 * _DAY} GROUP BY user_id')
def overlap_test(spark: SparkSession, sf: str) -> DataFrame:
    kept = spans(spark, sf).where((F.col("start") < _LO + 5 * _DAY) & (F.col("end") > _LO + 4 * _DAY))
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("f16_active_duration", f'WITH {_SPANS} SELECT user_id, sum(greatest(0, "end" - start))::BIGINT AS active, max("end") AS last_end FROM s GROUP BY user_id')
def active_duration(spark: SparkSession, sf: str) -> DataFrame:
    return spans(spark, sf).groupBy("user_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start"))).alias("active"), F.coalesce(F.max("end"), F.lit(0)).alias("last_end"))


@query("f17_group_timing", f'WITH {_SPANS} SELECT user_id, event_type, min(start) AS start, max("end") AS "end", count(*) AS n, string_agg(event_id::VARCHAR, \',\' ORDER BY event_id) AS ids FROM s GROUP BY ALL')
def group_timing(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return spans(spark, sf).groupBy("user_id", "event_type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), ids.alias("ids"))


@query("j28_frame_index", "SELECT event_id, round_even(value * 24, 0)::BIGINT AS frame FROM events")
def frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.bround(F.col("value") * 24).cast("long").alias("frame"))


@query("j40_clamp_distance", "SELECT event_id, least(100.0, greatest(10.0, value)) AS clamped, round(CASE WHEN value < 10 THEN 10 - value WHEN value > 100 THEN value - 100 ELSE 0 END, 6) AS distance FROM events")
def clamp(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    distance = F.round(F.when(v < 10, 10 - v).when(v > 100, v - 100).otherwise(0.0), 6)
    return table(spark, sf, "events").select("event_id", F.least(F.lit(100.0), F.greatest(F.lit(10.0), v)).alias("clamped"), distance.alias("distance"))
