"""Exact quantiles by distributed selection of order statistics.

A quantile needs two neighbouring values in the order of its group. Groups of up
to ``small`` rows are taken whole. In larger ones a grid of approximate quantiles,
whose error of rank is bounded, gives a range that both values lie in; rows are
counted below it and those inside go on, until a range holds few enough. Then
counts of its distinct values settle the ranks. So no task gathers a group, and
no state grows with one: a group of any size needs a few scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studygrid.scratch import written

#: Rows of a range that are settled by their values; cells of the grid; inverse error of its ranks.
SMALL = 100_000
GRID = 1024
ACCURACY = 20_000


def _same(keys: list[str], other: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, other, strict=True)), F.lit(True))


def _met(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside the ranges of their group, as ``r``; ranges are broadcast if they are counted to be few."""
    own = [f"_r{k}" for k in keys]
    side = ranges.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), "r")
    if side.count() <= 10_000:
        side = F.broadcast(side)
    return rows.join(side, _same(keys, own)).drop(*own)


def _inside(r: Column, x: Column) -> Column:
    """Between the bounds, which are values that are settled already; a null bound is open."""
    return (r["low"].isNull() | (x > r["low"])) & (r["high"].isNull() | (x < r["high"]))


def _refined(rows: DataFrame, ranges: DataFrame, keys: list[str], ranks: int, small: int) -> DataFrame:
    """Ranges that hold more than ``small`` rows, narrowed by one scan for a grid and one for counts."""
    x, points = F.col("x"), F.array(*(F.lit(k / GRID) for k in range(GRID + 1)))
    at = lambda i: F.col("r")[i]
    wide = lambda i: at(i)["value"].isNull() & (at(i)["size"] > small)
    met = _met(rows, ranges, keys)
    grids = met.groupBy(*keys).agg(F.first("r").alias("r"), *(F.percentile_approx(F.when(wide(i) & _inside(at(i), x), x), points, F.lit(ACCURACY)).alias(f"g{i}") for i in range(ranks)))

    def ends(i: int) -> Column:
        # The grid's ranks are off by up to size / ACCURACY; two cells more are taken at each end.
        share, off, g = (at(i)["rank"] - at(i)["below"]) / at(i)["size"] * GRID, 2 + GRID / ACCURACY, F.col(f"g{i}")
        first, last = F.floor(share - off).cast("int"), F.ceil(share + off).cast("int")
        return F.when(wide(i), F.struct(F.get(g, F.greatest(first, F.lit(0))).alias("a"), F.get(g, F.least(last, F.lit(GRID))).alias("b")))

    cut = grids.select(*keys, F.struct("r", F.array(*(ends(i) for i in range(ranks))).alias("e")).alias("r"))
    met = _met(rows, cut, keys).select(*keys, "x", "r.r", "r.e")
    count = lambda test, name, i: F.count_if(_inside(at(i), x) & test).alias(f"{name}{i}")
    counts = met.groupBy(*keys).agg(
        F.first("r").alias("r"),
        F.first("e").alias("e"),
        *(c for i in range(ranks) for c in (count(x < F.col("e")[i]["a"], "under", i), count(x == F.col("e")[i]["a"], "first", i), count((x > F.col("e")[i]["a"]) & (x < F.col("e")[i]["b"]), "within", i), count(x == F.col("e")[i]["b"], "last", i))),
    )

    def narrowed(i: int) -> Column:
        r, a, b = at(i), F.col("e")[i]["a"], F.col("e")[i]["b"]
        under, first, within, last = (F.col(f"{x}{i}") for x in ("under", "first", "within", "last"))
        left = r["rank"] - r["below"]
        new = lambda value, low, high, below, size: F.struct(r["rank"].alias("rank"), value.cast("double").alias("value"), low.alias("low"), high.alias("high"), below.alias("below"), size.alias("size"))
        same = a == b
        upto = under + first + F.when(same, 0).otherwise(within)
        return (
            F.when(~wide(i), r)
            .when(left < under, new(F.lit(None), r["low"], a, r["below"], under))
            .when(left < under + first, new(a, a, a, r["below"], r["size"]))
            .when(left < upto, new(F.lit(None), a, b, r["below"] + under + first, within))
            .when(~same & (left < upto + last), new(b, b, b, r["below"], r["size"]))
            .otherwise(new(F.lit(None), b, r["high"], r["below"] + upto + F.when(same, 0).otherwise(last), r["size"] - upto - F.when(same, 0).otherwise(last)))
        )

    return written(counts.select(*keys, F.array(*(narrowed(i) for i in range(ranks))).alias("r")), "ranges")


def exact_quantiles(df: DataFrame, value: str | Column, probs: list[float], by: tuple[str, ...] | list[str] = (), small: int = SMALL) -> DataFrame:
    """``(by..., q0, q1, ..., n)``: quantiles by linear interpolation, null and NaN values left out.

    A row for each group that has a row, null quantiles where it has no value;
    without groups one row, of an empty table too. A null group is a group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    every = df.select(*(F.col(k).alias(o) for k, o in zip(by, keys, strict=True)), F.nanvl(x, F.lit(None).cast("double")).alias("x"))
    rows = every.where(F.col("x").isNotNull())
    sizes = written(every.groupBy(*keys).agg(F.count("x").alias("n")), "sizes")
    spot = lambda p: F.col("n").cast("double") * p - p
    none = F.lit(None).cast("double")
    # Two ranks a quantile: that of the value at or below its place, and the next.
    wanted = [F.least(F.floor(spot(p)).cast("long") + more, F.col("n") - 1) for p in probs for more in (0, 1)]
    start = [F.struct(w.alias("rank"), none.alias("value"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("size")) for w in wanted]
    ranges = sizes.where("n > 0").select(*keys, F.array(*start).alias("r"))
    large = F.exists("r", lambda r: r["value"].isNull() & (r["size"] > small))
    while ranges.where(large).limit(1).count():
        ranges = _refined(rows, ranges, keys, len(wanted), small)
    met = _met(rows, ranges, keys)
    sought = lambda r: r["value"].isNull() & _inside(r, F.col("x"))
    counts = met.where(F.exists("r", sought)).groupBy(*keys, "x").agg(F.count("*").alias("c"), F.first("r").alias("r"))
    order = Window.partitionBy(*keys).orderBy("x")
    at = [F.col("r")[i] for i in range(len(wanted))]
    upto = counts.select("*", *((r["below"] + F.sum(F.when(sought(r), F.col("c")).otherwise(0)).over(order)).alias(f"u{i}") for i, r in enumerate(at)))
    ends = upto.groupBy(*keys).agg(*(F.min(F.when(sought(r) & (F.col(f"u{i}") > r["rank"]), F.col("x"))).alias(f"v{i}") for i, r in enumerate(at)))
    for side, name, frame in (("_t", "r", ranges), ("_s", "n", sizes)):
        own = [f"{side}{i}" for i in range(len(by))]
        ends = frame.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), name).join(ends, _same(own, keys), "left").drop(*keys)
        ends = ends.withColumnsRenamed(dict(zip(own, keys, strict=True)))
    value_of = [F.coalesce(r["value"], F.col(f"v{i}")) for i, r in enumerate(at)]

    def between(i: int, p: float) -> Column:
        share, low, high = spot(p) - F.floor(spot(p)), value_of[2 * i], value_of[2 * i + 1]
        return low + F.when(share > 0, share * (high - low)).otherwise(0.0)

    return ends.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), *(between(i, p).alias(f"q{i}") for i, p in enumerate(probs)), "n")
