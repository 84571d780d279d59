"""Timing of cues against speech: lag search, layered occupancy, robust fits and grades.

Spans are half open; times are whole numbers of any unit. Rows without length or with a
null time take no part. Work follows the number of edges, never the length of a track or the
fineness of its clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide.operators.intervals import merge_spans
from subtide.operators.ranges import near_join, overlap_join


def on_grid(spans: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """(keys, start, end): the steps of ``step`` units that spans touch, as disjoint spans in steps."""
    s = spans.where(F.col("end") > F.col("start")).select(
        *keys, F.floor(F.col("start") / step).alias("start"), (F.floor((F.col("end") - 1) / step) + 1).alias("end")
    )
    return merge_spans(s, keys, "start", "end").select(*keys, "start", "end")


def _edges(spans: DataFrame, keys: Sequence[str], place: str, sign: str) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("s")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("s"))))
    return spans.select(*keys, both.alias("e")).select(*keys, F.col("e.p").alias(place), F.col("e.s").alias(sign))


def overlap_by_lag(speech: DataFrame, cues: DataFrame, keys: Sequence[str], candidate: Sequence[str], most: int) -> DataFrame:
    """(keys, candidate, lag, matched, slope, next_lag): the steps of speech that cues cover, as a function of their shift.

    Both sides are disjoint spans in steps. The function is linear between lags at which an
    edge of a cue meets an edge of speech: there its slope changes by one, up
    where a start meets an end, down where equal edges meet. So its rows are those lags, the bounds and
    0, and two running sums give it everywhere within ``most`` steps.
    """
    whole = [*keys, *candidate]
    met = near_join(_edges(speech, keys, "_p", "_s"), _edges(cues, whole, "_q", "_t"), keys, "_p", "_q", most)
    turns = met.groupBy(*whole, (F.col("_p") - F.col("_q")).alias("lag")).agg(F.sum(-F.col("_s") * F.col("_t")).alias("turn"))
    low = cues.select(*whole, (F.col("start") - most - 1).alias("_c"), (F.col("end") - most).alias("_d"))
    first = overlap_join(speech.select(*keys, "start", "end"), low, keys, ("start", "end"), ("_c", "_d")).select(
        *whole, _shared(F.col("_c") + 1, F.col("_d")).alias("at"), _shared(F.col("_c"), F.col("_d") - 1).alias("before")
    ).groupBy(*whole).agg(F.sum("at").alias("jump"), (F.sum("at") - F.sum("before")).alias("turn"))
    zero = F.lit(0).cast("long")
    marks = cues.select(*whole).distinct().select(*whole, F.explode(F.array(*[F.lit(x).cast("long") for x in sorted({-most, 0, most})])).alias("lag"))
    rows = turns.withColumn("jump", zero).unionByName(first.withColumn("lag", F.lit(-most).cast("long"))).unionByName(
        marks.withColumn("turn", zero).withColumn("jump", zero)
    ).groupBy(*whole, "lag").agg(F.sum("turn").alias("turn"), F.sum("jump").alias("jump"))
    return _curve(rows, whole).select(*whole, "lag", "matched", "slope", "next_lag")


def _shared(c: Column, d: Column) -> Column:
    """The steps that a span of speech shares with [c, d)."""
    return F.greatest(F.least("end", d) - F.greatest("start", c), F.lit(0))


def _curve(rows: DataFrame, whole: Sequence[str]) -> DataFrame:
    """``rows`` (whole, lag, turn, jump), one a lag, with the value, the slope and the next lag.

    What is shared at the lowest lag, and one step before it, gives the value and the slope to begin with.
    """
    w = Window.partitionBy(*whole).orderBy("lag")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sloped = rows.withColumn("slope", F.sum("turn").over(upto)).withColumn("_last", F.lag("lag").over(w))
    rise = F.coalesce((F.col("slope") - F.col("turn")) * (F.col("lag") - F.col("_last")), F.lit(0)) + F.col("jump")
    return sloped.withColumn("matched", F.sum(rise).over(upto)).withColumn("next_lag", F.lead("lag").over(w))


def best_lags(speech: DataFrame, cues: DataFrame, keys: Sequence[str], candidate: Sequence[str], most: int, apart: int) -> DataFrame:
    """Per (keys, candidate) the lag within ``most`` steps at which its cues cover the most speech.

    Ties go to the smallest shift, then to the earlier one; without any cover the lag is null. ``second`` is the best cover at lags ``apart``
    steps away or farther: a peak far above it is sharp. ``speech`` and ``cues`` are disjoint spans in steps (``on_grid``).
    """
    whole = [*keys, *candidate]
    curve = overlap_by_lag(speech, cues, keys, candidate, most)
    best = F.max(F.struct("matched", (-F.abs("lag")).alias("near"), (-F.col("lag")).alias("early"))).over(Window.partitionBy(*whole))
    curve = curve.withColumn("_best", best).withColumn("_at", -F.col("_best.early"))
    value = lambda x: F.when((F.col("lag") <= x) & (x <= F.coalesce("next_lag", "lag")), F.col("matched") + F.col("slope") * (x - F.col("lag")))
    away = F.greatest(F.when(F.abs(F.col("lag") - F.col("_at")) >= apart, F.col("matched")), value(F.col("_at") - apart), value(F.col("_at") + apart))
    found = curve.groupBy(*whole).agg(F.first("_at").alias("lag"), F.first("_best.matched").alias("matched"), F.coalesce(F.max(away), F.lit(0)).alias("second"))
    size = lambda df, by, name: df.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias(name))
    sized = found.join(size(cues, whole, "_cues"), whole).join(size(speech, keys, "_speech"), list(keys), "left")
    return sized.select(
        *whole, F.when(F.col("matched") > 0, F.col("lag")).alias("lag"), "matched", "second", (F.col("_cues") - F.col("matched")).alias("cues_unmatched"),
        (F.coalesce("_speech", F.lit(0)) - F.col("matched")).alias("speech_unmatched"),
    )


def windowed(cues: DataFrame, width: int, hop: int) -> DataFrame:
    """Cues cut by windows of ``width`` steps that start every ``hop``, with the window's number ``window``."""
    first, last = F.floor((F.col("start") - width) / hop) + 1, F.floor((F.col("end") - 1) / hop)
    cut = cues.withColumn("window", F.explode(F.sequence(first, last)))
    return cut.withColumn("start", F.greatest("start", F.col("window") * hop)).withColumn("end", F.least("end", F.col("window") * hop + width))


def _window_lags(speech: DataFrame, cues: DataFrame, keys: Sequence[str], candidate: Sequence[str], most: int, width: int, hop: int) -> DataFrame:
    """(keys, candidate, window, lag, matched, cues_unmatched): ``best_lags`` of windows of the cues.

    Speech is dealt to the windows that it can reach, so that a window's cues and speech meet in one shuffle by
    key and window. Its pairs, curve and best lag come from there as they lie: no pair, edge or lag is shuffled. Rows
    of one lag are not added up first: between them the curve does not rise, and what it jumps by is never negative.
    A bound is a row only where something is shared there, as a lag without cover is none.
    """
    place = [*keys, "window"]
    whole = [*place, *candidate]
    reached = F.sequence(F.ceil((F.col("start") - width - most) / hop), F.floor((F.col("end") + most + 1) / hop))
    spoken = speech.select(*keys, "start", "end", F.explode(reached).alias("window"))
    cut = windowed(cues, width, hop).select(*whole, F.col("start").alias("_c"), F.col("end").alias("_d")).repartition(*place)
    w = Window.partitionBy(*whole)
    cut = cut.withColumn("_cues", F.sum(F.col("_d") - F.col("_c")).over(w)).withColumn("_lead", F.row_number().over(w.orderBy("_c")) == 1)
    near = (F.col("start") <= F.col("_d") + most + 1) & (F.col("end") >= F.col("_c") - most - 1)
    same = [F.col(f"c.{k}") == F.col(f"s.{k}") for k in place]
    met = cut.alias("c").join(spoken.alias("s"), [*same, near], "left").select(*[F.col(f"c.{k}") for k in whole], "_c", "_d", "_cues", "_lead", "start", "end")
    zero, lit = F.lit(0).cast("long"), lambda x: F.lit(x).cast("long")
    row = lambda lag, turn, jump: F.struct(lag.alias("lag"), turn.alias("turn"), jump.alias("jump"))
    meets = [
        row(F.when(F.abs(F.col(p) - F.col(q)) <= most, F.col(p) - F.col(q)), lit(-s * t), zero)
        for p, s in (("start", 1), ("end", -1)) for q, t in (("_c", 1), ("_d", -1))
    ]
    spoke = F.col("start").isNotNull()
    at, before = _shared(F.col("_c") - most, F.col("_d") - most), _shared(F.col("_c") - most - 1, F.col("_d") - most - 1)
    bounds = [
        row(F.when(spoke & (at + before > 0), lit(-most)), at - before, at),
        row(F.when(spoke & (_shared(F.col("_c") + most, F.col("_d") + most) > 0), lit(most)), zero, zero),
    ]
    still = row(F.when(F.col("_lead"), zero), zero, zero)
    rows = met.select(*whole, "_cues", F.explode(F.array(*meets, *bounds, still)).alias("e")).where(F.col("e.lag").isNotNull()).select(*whole, "_cues", "e.*")
    best = F.max(F.struct("matched", (-F.abs("lag")).alias("near"), (-F.col("lag")).alias("early"))).alias("_best")
    found = _curve(rows, whole).groupBy(*whole).agg(best, F.max("_cues").alias("_cues"))
    matched = F.col("_best.matched")
    return found.select(*whole, F.when(matched > 0, -F.col("_best.early")).alias("lag"), matched.alias("matched"), (F.col("_cues") - matched).alias("cues_unmatched"))


def local_fit(speech: DataFrame, cues: DataFrame, keys: Sequence[str], candidate: Sequence[str], most: int, width: int, drift: float) -> DataFrame:
    """Per (keys, candidate) the line through the best lags of windows of ``width`` steps that start every half width, and a verdict.

    A window counts where speech covers half of its cues or more. The slope is
    in steps per window, to four digits; it is null where fewer than two windows count. Windows are summed in
    their order, as the slope's last digit would else hang on the order of rows.
    """
    lags = _window_lags(speech, cues, keys, candidate, most, width, width // 2)
    whole = [*keys, *candidate]
    usable = (F.col("matched") > 0) & (F.col("matched") >= F.col("cues_unmatched"))
    ordered = lags.select(*whole, "window", F.when(usable, F.col("lag")).alias("lag")).repartition(*whole).sortWithinPartitions(*whole, "window")
    per = ordered.groupBy(*whole).agg(
        F.count(F.lit(1)).alias("windows"), F.count("lag").alias("usable"), F.coalesce(F.sum("lag"), F.lit(0)).alias("total"),
        F.round(F.regr_slope(F.col("lag").cast("double"), F.col("window").cast("double")), 4).alias("slope"),
    )
    verdict = (
        F.when(F.col("usable") == 0, "bad_candidate").when(F.col("usable") * 2 < F.col("windows"), "weak_match")
        .when(F.abs("slope") >= drift, "possible_drift").when(F.abs("total") < F.col("usable"), "good_match").otherwise("constant_offset")
    )
    return per.select(*keys, *candidate, "windows", "usable", F.when(F.col("usable") > 1, F.col("slope") + 0.0).alias("slope"), verdict.alias("verdict"))


def occupancy(spans: DataFrame, keys: Sequence[str], layer: str, layers: Sequence[str]) -> DataFrame:
    """(keys, start, end, mask): the longest stretches over which the same layers are active; bit i of ``mask`` is ``layers[i]``.

    A sweep over the edges of all layers at once: spans of one layer may overlap
    or touch, other layers are ignored, stretches without any layer are left out.
    """
    kept = spans.where(F.col(layer).isin(*layers) & (F.col("end") > F.col("start")))
    change = lambda name: F.sum(F.when(F.col(layer) == name, F.col("_s")).otherwise(0))
    points = _edges(kept, [*keys, layer], "_p", "_s").groupBy(*keys, "_p").agg(*[change(n).alias(f"_{i}") for i, n in enumerate(layers)])
    w = Window.partitionBy(*keys).orderBy("_p")
    active = [F.sum(f"_{i}").over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0 for i in range(len(layers))]
    mask = sum((F.when(a, 1 << i).otherwise(0) for i, a in enumerate(active)), F.lit(0)).cast("long")
    masked = points.select(*keys, "_p", mask.alias("mask"))
    turned = masked.withColumn("_was", F.lag("mask", 1, 0).over(w)).where("mask <> _was")
    return turned.withColumn("_next", F.lead("_p").over(w)).where("mask <> 0").select(*keys, F.col("_p").alias("start"), F.col("_next").alias("end"), "mask")


#: Pairs of a track's cues for the slope lie these eighths of its cues apart.
STRIDES = (1, 2, 3, 4, 5, 6, 7)


def robust_line(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, slope, intercept): the median slope of pairs of points, and the median of what it leaves.

    Pairs lie one to seven eighths of the track's points apart by rank of ``x``, so
    there are some three and a half a point and a quarter of wrong points moves the
    median little. Points of equal ``x`` make no pair; a track without a pair has slope 1.
    """
    good = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    w = Window.partitionBy(*keys)
    ranked = good.withColumn("i", F.row_number().over(w.orderBy("x", "y"))).withColumn("n", F.count(F.lit(1)).over(w))
    apart = F.array_distinct(F.transform(F.array(*map(F.lit, STRIDES)), lambda k: F.greatest(F.ceil(k * F.col("n") / 8).cast("int"), F.lit(1))))
    later = ranked.select(*keys, F.explode(apart).alias("k"), "i", "x", "y").select(*keys, (F.col("i") + F.col("k")).alias("i"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    slopes = ranked.join(later, [*keys, "i"]).where("x > x0").groupBy(*keys).agg(F.median((F.col("y") - F.col("y0")) / (F.col("x") - F.col("x0"))).alias("slope"))
    sloped = ranked.join(slopes, list(keys), "left").withColumn("slope", F.coalesce("slope", F.lit(1.0)))
    return sloped.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("slope").alias("slope"), F.median(F.col("y") - F.col("slope") * F.col("x")).alias("intercept"))


def residuals(points: DataFrame, line: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Points with ``residual``: how far ``y`` lies from the track's line; null where a time is null."""
    return points.join(line.select(*keys, "slope", "intercept"), list(keys), "left").withColumn(
        "residual", F.col(y).cast("double") - (F.col("slope") * F.col(x).cast("double") + F.col("intercept"))
    ).drop("slope", "intercept")


def suspicious_cues(points: DataFrame, line: DataFrame, keys: Sequence[str], x: str, y: str, least: float, times: float = 4.4478) -> DataFrame:
    """Points whose residual is over ``least`` and over ``times`` the track's median absolute residual (three deviations).

    A point without an aligned time is no suspicious cue: it counts against the cover.
    """
    r = residuals(points, line, keys, x, y)
    middle = r.groupBy(*keys).agg(F.median(F.abs("residual")).alias("_m"))
    return r.join(middle, list(keys)).where(F.abs("residual") > F.greatest(F.lit(least), F.col("_m") * times)).drop("_m")


def timing_grade(points: DataFrame, keys: Sequence[str], x: str, y: str, *, least: float, offset: float, drift: float, cover: float = 0.8) -> DataFrame:
    """One row a track: cover, backward steps, line, residual quantiles, suspicious cues and a grade.

    ``drift`` bounds how far the line's slope may carry over the track's length, ``offset`` the shift at its first point,
    ``least`` the residual of a sound cue, all in the unit of ``x``. Grades, the first that holds: ``unaligned`` (no point has both
    times), ``poor`` (fewer than ``cover`` of the cues have one, or a fifth are suspicious), ``drift``, ``offset``, ``good``.
    """
    line = robust_line(points, keys, x, y)
    order = Window.partitionBy(*keys).orderBy(x, y)
    last = F.max(y).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_back", (F.col(y) < last).cast("int")).groupBy(*keys).agg(
        F.coalesce(F.sum("_back"), F.lit(0)).alias("backward"), F.min(F.col(x).cast("double")).alias("_x0"), F.max(F.col(x).cast("double")).alias("_x1")
    )
    r = residuals(points, line, keys, x, y)
    size = F.abs("residual")
    spread = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cues"), F.count("residual").alias("aligned"), F.median(size).alias("p50"), F.percentile(size, 0.9).alias("p90"),
    )
    flagged = suspicious_cues(points, line, keys, x, y, least).groupBy(*keys).agg(F.count(F.lit(1)).alias("suspicious"))
    t = spread.join(line.select(*keys, "slope", "intercept"), list(keys), "left").join(back, list(keys), "left").join(flagged, list(keys), "left")
    shift = F.col("intercept") + (F.col("slope") - 1) * F.col("_x0")
    carried = (F.col("slope") - 1) * (F.col("_x1") - F.col("_x0"))
    t = t.withColumn("suspicious", F.coalesce("suspicious", F.lit(0))).withColumn("backward", F.coalesce("backward", F.lit(0))).withColumn("offset", shift).withColumn("drift", carried)
    grade = (
        F.when(F.col("aligned") == 0, "unaligned").when((F.col("aligned") < cover * F.col("cues")) | (F.col("suspicious") * 5 >= F.col("aligned")), "poor")
        .when(F.abs("drift") > drift, "drift").when(F.abs("offset") > offset, "offset").otherwise("good")
    )
    return t.select(*keys, "cues", "aligned", "backward", "slope", "offset", "drift", "p50", "p90", "suspicious", grade.alias("grade"))


def speech_share(mask: Column, bit: int) -> Column:
    """Whether layer ``bit`` is active in a mask of ``occupancy``."""
    return F.shiftright(mask, bit).bitwiseAND(F.lit(1).cast("long")) == 1
