"""Exact per-key sequences and medians that never put a whole key in one task.

A time series is cut into slices; windows run inside (key, slice) and what one
slice needs from others is either replicated at its border or added from one
summary row per slice. Medians are selected by counting value bins instead of
gathering the values.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY_US = 86_400_000_000


def slice_of(micros: Column, width_us: int) -> Column:
    return F.floor(micros / F.lit(width_us)).cast("long")


def neighbours(df: DataFrame, keys: list[str], micros: str, reach_days: float,
               columns: list[str], slice_days: float = 60.0,
               after: bool = False, tie: list[str] = ()) -> DataFrame:
    """Add ``prev`` (and ``next``) structs of the adjacent row of the same key.

    Only neighbours within ``reach_days`` are guaranteed; a farther one may
    come out as NULL. Rows near a slice border are replicated into the
    adjacent slice, so one shuffle on (key, slice) is enough.
    """
    reach = int(reach_days * DAY_US)
    width = max(int(slice_days * DAY_US), reach)
    t = F.col(micros)
    home = slice_of(t, width)
    first = slice_of(t - reach, width) if after else home
    placed = df.withColumn("_home", home).withColumn(
        "_slice", F.explode(F.sequence(first, slice_of(t + reach, width))))
    w = Window.partitionBy(*keys, "_slice").orderBy(micros, *tie)
    body = F.struct(*columns)
    out = placed.withColumn("prev", F.lag(body).over(w))
    if after:
        out = out.withColumn("next", F.lead(body).over(w))
    return out.where(F.col("_slice") == F.col("_home")).drop("_slice", "_home")


def even_blocks(df: DataFrame, value: Column, blocks: int, key: str) -> DataFrame:
    """Add ``block``, 0 to ``blocks`` - 1: ranges of ``value`` with about as many rows each.

    Rows with one value that fills several ranges are dealt among these by ``key``. The ranges are
    approximate quantiles, fetched at once; land an input that is expensive to derive.
    """
    placed = df.withColumn("_value", value.cast("double"))
    cuts = placed.approxQuantile("_value", [k / blocks for k in range(1, blocks)],
                                 0.2 / blocks) if blocks > 1 else []
    passed = lambda test: reduce(lambda x, y: x + y, [test(F.lit(c)).cast("int") for c in cuts], F.lit(0))
    before = passed(lambda c: F.col("_value") > c)
    return placed.withColumn("block", before + F.pmod(F.xxhash64(key), passed(
        lambda c: F.col("_value") >= c) - before + 1).cast("int")).drop("_value")


def running_sum(df: DataFrame, keys: list[str], slice_col: str, order: list,
                amount: Column, out: str) -> DataFrame:
    """Exact inclusive running sum per key, computed slice by slice.

    ``slice_col`` must not decrease along ``order``.
    """
    part = [*keys, slice_col]
    marked = df.withColumn("_amount", amount)
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*part).agg(F.sum("_amount").alias("_total"))
        .select(*part, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        marked.withColumn("_local", F.sum("_amount").over(local))
        .join(offsets, part)
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_amount", "_local", "_offset")
    )


#: half widths, in shares of a key's rows, of the bracket around its middle
_WIDTHS = (0.0001, 0.001, 0.01, 0.1)


def _brackets(rows: DataFrame, keys: list[str], accuracy: int) -> DataFrame:
    """(keys, n, lo, hi): between lo and hi lie the middle ranks of ``x`` and few others."""
    error = 3.0 / accuracy
    widths = [w for w in _WIDTHS if w >= 2 * error]
    sides = F.percentile_approx("x", [0.5 - w for w in widths] + [0.5 + w for w in widths], accuracy)
    sketched = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        *([sides.alias("_q")] if widths else []))
    # the narrowest bracket that holds two ranks more on either side than the sketch may be off
    lo, hi = F.col("lo"), F.col("hi")
    for i, w in reversed(list(enumerate(widths))):
        wide = F.col("n") * (w - error) >= 2
        lo = F.when(wide, F.col("_q")[i]).otherwise(lo)
        hi = F.when(wide, F.col("_q")[i + len(widths)]).otherwise(hi)
    return sketched.select(*keys, "n", lo.alias("lo"), hi.alias("hi"))


def _median(rows: DataFrame, keys: list[str], accuracy: int) -> DataFrame:
    """(keys, n, median) of ``rows`` (keys, x).

    Equal values on the bracket's ends are counted; what lies between them is listed, which is a
    share of a key's rows that the bracket's width bounds, repeated values included.
    """
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    found = rows.join(_brackets(rows, keys, accuracy), keys).groupBy(*keys, "n", "lo", "hi").agg(
        F.count_if(x < lo).alias("_below"), F.count_if(x == lo).alias("_low"),
        F.count_if(x == hi).alias("_high"),
        F.array_sort(F.collect_list(F.when((x > lo) & (x < hi), x))).alias("_between"))
    lost = F.raise_error(F.lit("a quantile sketch was off by more than its error"))
    between = F.col("_below") + F.col("_low")
    above = between + F.size("_between")

    def at(rank: Column) -> Column:
        return F.when(rank < F.col("_below"), lost.cast("double")).when(rank < between, lo).when(
            rank < above, F.get("_between", (rank - between).cast("int"))).when(
                rank < above + F.col("_high"), hi).otherwise(lost.cast("double"))

    middle = (at(F.expr("(n - 1) div 2")) + at(F.expr("n div 2"))) / 2
    return found.select(*keys, "n", middle.alias("median"))


def robust_stats(df: DataFrame, keys: list[str], value: Column, accuracy: int = 100_000,
                 spread_accuracy: int = 100_000) -> DataFrame:
    """(keys, n, median, mad), exact at any number of values per key, in one lazy plan.

    A mergeable quantile sketch gives every key a narrow bracket around its middle ranks; a second
    pass counts what lies below and lists only what lies inside; the same twice more for the
    deviations. So the keys and the value are read four times, but only sketches, counts and the
    insides of brackets are shuffled, as long as one row a key is small enough to be sent to all
    tasks; else rows meet their bracket by key, and adaptive execution splits a hot key. Land an
    input that is expensive to derive. Null values, NaN and rows with a null key are left out.
    """
    rows = df.select(*keys, value.cast("double").alias("x")).dropna()
    centre = _median(rows, keys, accuracy)
    off = rows.join(centre.drop("n"), keys).select(*keys, F.when(
        F.col("x") == F.col("median"), 0.0).otherwise(F.abs(F.col("x") - F.col("median"))).alias("x"))
    spread = _median(off, keys, spread_accuracy).select(*keys, F.col("median").alias("mad"))
    return centre.join(spread, keys)


def _middle(array: str) -> str:
    return f"(get({array}, (size({array}) - 1) div 2) + get({array}, size({array}) div 2)) / 2"


def array_stats(df: DataFrame, values: Column, n: str, median: str, mad: str) -> DataFrame:
    """Add number, median and median absolute deviation of an array; null and NaN are left out."""
    sized = df.withColumn("_vs", F.array_sort(F.filter(
        F.transform(values, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))))
    centred = sized.selectExpr("*", "CAST(size(_vs) AS BIGINT) AS " + n, f"{_middle('_vs')} AS {median}")
    return centred.selectExpr("*", f"array_sort(transform(_vs, x -> abs(x - {median}))) AS _ds").selectExpr(
        "*", f"{_middle('_ds')} AS {mad}").drop("_vs", "_ds")


def daily_stats(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, n, median, mad) like :func:`robust_stats`, for at most one value per key and day.

    That bounds a key by the days of its history, so its values are one sorted array.
    """
    lists = df.select(*keys, value.cast("double").alias("v")).dropna().groupBy(*keys).agg(
        F.collect_list("v").alias("_all"))
    return array_stats(lists, F.col("_all"), "n", "median", "mad").drop("_all")
