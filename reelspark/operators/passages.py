"""Passages: smoothing, standard scores, the maximum subarray and the choice of what a search shows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import observation_order

#: Spacing of doubles at one, and tolerances of sums that count as equal; fixed values.
EPSILON = 2.220446049250313e-16
TOLERANCE = 1e-12


def moving_average(value: Column, width: int, keys: Sequence[str], order: str = "timestamp_us") -> Column:
    """Centred mean over an odd number of rows, of those there are at the edges."""
    if width < 1 or width % 2 == 0:
        raise ValueError("width must be a positive odd number")
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width // 2))


def z_score(value: Column, keys: Sequence[str]) -> Column:
    """Population standard score in its group; null where the group is flat to rounding."""
    own = Window.partitionBy(*keys)
    mean, spread, top = F.avg(value).over(own), F.stddev_pop(value).over(own), F.max(F.abs(value)).over(own)
    flat = spread <= 32 * EPSILON * F.greatest(F.lit(1.0), top)
    return F.when(~flat, (value - mean) / spread)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value made once however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def array_z_scores(values: Column) -> Column:
    """The same over an array; null if it is flat."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    top = F.aggregate(values, F.lit(1.0), lambda s, x: F.greatest(s, F.abs(x)))

    def scored(t: Column) -> Column:
        squares = F.aggregate(t["v"], F.lit(0.0), lambda s, x: s + (x - t["m"]) * (x - t["m"]))
        return _let(F.sqrt(squares / n), lambda spread: F.when(spread > 32 * EPSILON * t["top"], F.transform(t["v"], lambda x: (x - t["m"]) / spread)))

    return _let(F.struct(values.alias("v"), mean.alias("m"), top.alias("top")), scored)


def array_moving_average(values: Column, width: int) -> Column:
    half = width // 2
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)
    return F.transform(values, lambda _, i: total(F.slice(values, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half, F.size(values) - 1) - F.greatest(i - half, F.lit(0)) + 1)))


def maximum_subarray(values: Column) -> Column:
    """First and last index of the run of the largest positive sum, as a struct; null if there is none.

    Of equal sums the shorter run counts, then the earlier. A run starts anew where its sum so far isn't positive.
    """
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0).alias("from"), none.alias("best"))

    def step(a: Column, x: Column) -> Column:
        anew = a["sum"] <= 0
        now = F.struct(F.when(anew, x).otherwise(a["sum"] + x).alias("sum"), F.when(anew, a["i"]).otherwise(a["from"]).alias("first"), a["i"].alias("last"))
        return _let(now, lambda n: F.struct((n["last"] + 1).alias("i"), n["sum"].alias("sum"), n["first"].alias("from"), F.when(_better(n, a["best"]), n).otherwise(a["best"]).alias("best")))

    def _better(n: Column, old: Column) -> Column:
        within = F.greatest(TOLERANCE * F.greatest(F.abs(n["sum"]), F.abs(old["sum"])), F.lit(TOLERANCE))
        shape = lambda r: F.struct((r["last"] - r["first"]).alias("long"), r["first"].alias("first"))
        return (n["sum"] > 0) & ((old["first"] < 0) | F.when(F.abs(n["sum"] - old["sum"]) <= within, shape(n) < shape(old)).otherwise(n["sum"] > old["sum"]))

    return F.aggregate(values, zero, step, lambda a: F.when(a["best"]["first"] >= 0, F.struct(a["best"]["first"].alias("first"), a["best"]["last"].alias("last"))))


def signal_runs(series: DataFrame, values: str, frames: int) -> DataFrame:
    """series with run, the maximum subarray of the smoothed and standardised array of values.

    Each array is a column of its own before the next step reads it: referred to in a lambda, an expression would be made anew for each item.
    """
    smooth = series.withColumn("_smooth", array_moving_average(F.col(values), frames))
    return smooth.withColumn("_z", array_z_scores(F.col("_smooth"))).withColumn("run", maximum_subarray(F.col("_z"))).drop("_smooth", "_z")


def select_passages(observations: DataFrame, keys: Sequence[str], frames: int = 3) -> DataFrame:
    """Of each group of observations (timestamp_us, score, ...) the passage to show: keys, start_us, end_us, representative (a struct).

    Fewer than three observations, a flat signal, or one without a positive run give the instant of the best observation. Otherwise
    scores are smoothed and standardised, the run of the largest sum is the passage, and its best raw observation
    represents it. A group is bounded by the length of a window, so its scores fit into an array.
    """
    columns = [c for c in observations.columns if c not in keys]
    rest = [c for c in columns if c != "timestamp_us"]
    series = observations.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("timestamp_us", *rest))).alias("rows"))
    series = signal_runs(series.withColumn("_scores", F.transform("rows", lambda r: r["score"])), "_scores", frames)
    series = series.withColumn("run", F.when(F.size("rows") >= 3, F.col("run")))
    chosen = F.when(F.col("run").isNotNull(), F.slice("rows", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + 1)).otherwise(F.col("rows"))
    series = series.withColumn("chosen", chosen)

    def key(r: Column) -> Column:
        box = r["region"]
        return F.struct((-r["score"]).alias("a"), r["timestamp_us"].alias("b"), r["source_path"].alias("c"), r["region_kind"].alias("d"), box["x"].alias("e"), box["y"].alias("f"), box["width"].alias("g"), box["height"].alias("h"))

    best = F.array_min(F.transform("chosen", lambda r, i: F.struct(key(r).alias("k"), i.alias("i"))))["i"]
    series = series.withColumn("representative", F.element_at("chosen", best + 1))
    alone = F.col("run").isNull()
    return series.select(
        *keys,
        F.when(alone, F.col("representative.timestamp_us")).otherwise(F.element_at("chosen", 1)["timestamp_us"]).alias("start_us"),
        F.when(alone, F.col("representative.timestamp_us")).otherwise(F.element_at("chosen", -1)["timestamp_us"]).alias("end_us"),
        "representative",
    )


def best_observation(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    from .ranking import first_of

    return first_of(observations, keys, observation_order())
