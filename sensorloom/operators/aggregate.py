"""Aggregates of the mixed value column: numbers, state changes, and their combination.

Grouping drops rows whose key is null. Every aggregate here has a partial (map-side) phase,
so a hot key costs one small row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.values import bool_value, minute_of_time, numeric_value, value_type
from sensorloom.schemas import STATS
from sensorloom.scratch import cut_lineage

# Aggregate names to functions; all are mergeable, so none gathers a group in one task.
AGGREGATES = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "nunique": F.count_distinct,
    "size": lambda c: F.count(F.lit(1)),
}
# Aggregates that depend on the order of rows.
ORDERED_AGGREGATES = {"first": F.min_by, "last": F.max_by}


def _names(how: str | Sequence[str]) -> list[str]:
    names = list(STATS) if how == "all" else [how] if isinstance(how, str) else list(how)
    unknown = [n for n in names if n not in AGGREGATES and n not in ORDERED_AGGREGATES]
    if unknown:
        raise ValueError(f"unknown aggregate {unknown}; known: {sorted([*AGGREGATES, *ORDERED_AGGREGATES])}")
    return [n for n in names if n != "count"]


def _aggregate(name: str, c: Column, order: Column | None) -> Column:
    if name in ORDERED_AGGREGATES:
        if order is None:
            raise ValueError(f"{name!r} needs an order column")
        # A null is skipped, as only rows with a value have an order here.
        return ORDERED_AGGREGATES[name](c, F.when(c.isNotNull(), order))
    return AGGREGATES[name](c)


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def agg_numeric(
    df: DataFrame, keys: Sequence[str], how: str | Sequence[str] = "all", value: str = "value", order: str = "datetime"
) -> DataFrame:
    """Aggregates of the numeric values per key, and their count; missing results are 0.

    A median is not mergeable, so it is found by ``agg_median`` and joined to the others.
    """
    if how == "median" or (not isinstance(how, str) and "median" in how):
        others = [n for n in ([how] if isinstance(how, str) else how) if n != "median"]
        rest = agg_numeric(df, keys, others, value, order)
        medians = agg_median(df, keys, value).drop("count")
        return rest.join(medians, list(keys), "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    number = F.nanvl(F.col("_x"), F.lit(None).cast("double"))
    names = _names(how)
    rows = with_keys(df, keys).filter(value_type(value) == "num").withColumn("_x", numeric_value(value))
    when = F.col(order) if order in df.columns else None
    out = rows.groupBy(*keys).agg(
        *[F.coalesce(_aggregate(n, number, when), F.lit(0)).alias(n) for n in names], F.count(number).alias("count")
    )
    return out


def state_changes(
    df: DataFrame,
    keys: Sequence[str],
    kinds: Sequence[str] = ("bool",),
    value: str = "value",
    order: Sequence[str] = ("datetime", "seq"),
) -> DataFrame:
    """State changes and readings per key, value kind and hour of the day.

    A reading is a change when it differs from the one before it in its group; the first is
    none. The sequence of a group is cut into minutes: changes inside a minute come from a
    window over that minute alone, and changes across minutes from a second window over one
    row per minute. No task ever orders a whole group, however hot its key.
    """
    order = [c for c in order if c in df.columns]
    ts = order[0]
    state = F.when(value_type(value) == "bool", bool_value(value).cast("string")).otherwise(F.col(value))
    rows = (
        with_keys(df, keys)
        .withColumns({"kind": value_type(value), "_s": state, "_m": minute_of_time(ts), "_h": F.hour(ts).cast("string")})
        .filter(F.col("kind").isin(*kinds))
    )
    group = [*keys, "kind"]
    inside = Window.partitionBy(*group, "_h", "_m").orderBy(*order)
    changed = (F.row_number().over(inside) > 1) & ~F.col("_s").eqNullSafe(F.lag("_s").over(inside))
    at = F.struct(*order)
    minutes = (
        rows.withColumn("_c", F.when(changed, 1).otherwise(0))
        .groupBy(*group, "_h", "_m")
        .agg(
            F.sum("_c").alias("_c"),
            F.count(F.lit(1)).alias("_n"),
            F.min_by(F.struct("_s"), at).alias("_first"),
            F.max_by(F.struct("_s"), at).alias("_last"),
        )
    )
    across = Window.partitionBy(*group).orderBy("_m")
    crossed = (F.row_number().over(across) > 1) & ~F.col("_first._s").eqNullSafe(F.lag("_last").over(across)["_s"])
    return (
        minutes.withColumn("_c", F.col("_c") + F.when(crossed, 1).otherwise(0))
        .groupBy(*group, F.col("_h").alias("change_hour"))
        .agg(F.sum("_c").alias("changes"), F.sum("_n").alias("count"))
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], column: str, order: Sequence[str] = ("datetime", "seq"), out: str = "previous"
) -> DataFrame:
    """Readings with the value before them in time order of their group; the first has none.

    As for state changes, the order is taken minute by minute: only the first reading of a
    minute looks up the last one of the minute before.
    """
    rows = with_keys(df, keys).withColumn("_m", minute_of_time(order[0]))
    inside = Window.partitionBy(*keys, "_m").orderBy(*order)
    last = rows.groupBy(*keys, "_m").agg(F.max_by(F.struct(column), F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_m")
    before = last.select(*keys, "_m", F.lag("_last").over(across)[column].alias("_before"))
    first = F.row_number().over(inside) == 1
    return (
        rows.withColumns({"_first": first, "_lag": F.lag(column).over(inside)})
        .join(before, [*keys, "_m"])
        .withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")))
        .select(*df.columns, out)
    )


# Slices a group's range is cut into per pass of the median search.
MEDIAN_SLICES = 1024


# Distinct values of a group that one task orders in the end.
MEDIAN_ROWS = 10_000


def agg_median(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Exact median of the numeric values per key, and their count.

    No group is gathered: each pass counts the values of a group in equal slices of its
    range and goes on with the one or two slices that hold the middle ranks, until no group has
    more than ``MEDIAN_ROWS`` distinct values left. Those are ordered with their counts. A pass
    that an outlier makes useless still drops the outlier.
    """
    keys = list(keys)
    x = F.nanvl(F.col("_x"), F.lit(None).cast("double"))
    numbers = with_keys(df, keys).filter(value_type(value) == "num").withColumn("_x", numeric_value(value))
    counted = numbers.select(*keys, x.alias("_x")).filter("_x is not null").groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    # Every pass reads the remaining values three times, so they are stored.
    rest = cut_lineage(counted, "median")
    n = F.col("count")
    ranks = rest.groupBy(*keys).agg(F.sum("_n").alias("count")).select(
        *keys, "count", F.floor((n + 1) / 2).alias("_r1"), (F.floor(n / 2) + 1).alias("_r2"), F.lit(0).cast("long").alias("_cut")
    )
    while (rest.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > MEDIAN_ROWS:
        span = rest.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        part = F.floor(F.try_divide((F.col("_x") - F.col("_lo")) * MEDIAN_SLICES, F.col("_hi") - F.col("_lo")))
        sliced = rest.join(span, keys).withColumn("_s", F.coalesce(part, F.lit(0))).drop("_lo", "_hi")
        # One row per group and slice from here on.
        up = Window.partitionBy(*keys).orderBy("_s")
        sizes = sliced.groupBy(*keys, "_s").agg(F.sum("_n").alias("_sn")).withColumn("_below", F.sum("_sn").over(up) - F.col("_sn"))
        below = F.col("_below") + F.col("_cut")
        held = sizes.join(ranks, keys).filter((below < F.col("_r2")) & (below + F.col("_sn") >= F.col("_r1")))
        held = cut_lineage(held.select(*keys, "_s", "count", "_r1", "_r2", below.alias("_b")), "median")
        rest = cut_lineage(sliced.join(held.select(*keys, "_s"), [*keys, "_s"]).drop("_s"), "median")
        ranks = held.groupBy(*keys, "count", "_r1", "_r2").agg(F.min("_b").alias("_cut"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_x"))
    ranked = rest.withColumn("_u", upto).join(ranks, keys)

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("_u") + F.col("_cut") >= F.col(rank), F.col("_x")))

    return ranked.groupBy(*keys).agg(((at("_r1") + at("_r2")) / 2).alias("median"), F.first("count").alias("count"))


def _fold_hours(hours: DataFrame, keys: Sequence[str], how: str | Sequence[str]) -> DataFrame:
    names = _names(how)
    c = F.col("changes").cast("double")
    order = F.col("change_hour").cast("int")
    return hours.groupBy(*keys).agg(
        *[F.coalesce(_aggregate(n, c, order), F.lit(0)).alias(n) for n in names], F.sum("count").alias("count")
    )


def agg_bool(df: DataFrame, keys: Sequence[str], how: str | Sequence[str] = "all", **options) -> DataFrame:
    """Aggregates of the hourly change counts of True/False values, and the count of values."""
    return _fold_hours(state_changes(df, keys, ["bool"], **options), keys, how)


def agg_categorical(df: DataFrame, keys: Sequence[str], how: str | Sequence[str] = "all", **options) -> DataFrame:
    """The same for text values."""
    return _fold_hours(state_changes(df, keys, ["str"], **options), keys, how)


def combine_mixed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: counts, sums and sizes add up, max and min are true, mean and std count-weighted.

    Other aggregates of a part say nothing about the whole and are refused.
    """
    n = F.col("count")
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * n), F.sum(n)), F.lit(0.0))
    rules = {"max": F.max, "min": F.min, "sum": F.sum, "size": F.sum, "mean": weighted, "std": weighted}
    stats = [c for c in df.columns if c not in (*keys, "count")]
    unknown = [c for c in stats if c not in rules]
    if unknown:
        raise ValueError(f"{unknown} of parts cannot be combined; known: {sorted(rules)}")

    def combined(c: str) -> Column:
        return rules[c](c)

    return df.groupBy(*keys).agg(*[combined(c).alias(c) for c in stats], F.sum(n).alias("count"))


def union_all_types(
    df: DataFrame, keys: Sequence[str], how: str | Sequence[str] = "all", **options
) -> DataFrame:
    """Aggregates of each value kind, one row per key and kind."""
    numbers = agg_numeric(df, keys, how, value=options.get("value", "value"))
    changes = _fold_hours(state_changes(df, keys, ["bool", "str"], **options), [*keys, "kind"], how)
    return numbers.withColumn("kind", F.lit("num")).unionByName(changes)


def agg_all(df: DataFrame, keys: Sequence[str], how: str | Sequence[str] = "all", **options) -> DataFrame:
    """Aggregates of all value kinds, one row per key."""
    return combine_mixed(union_all_types(df, keys, how, **options).drop("kind"), keys)


def changes_per_sensor_then_sum(df: DataFrame, keys: Sequence[str], sensor: Sequence[str], **options) -> DataFrame:
    """Hourly changes of a group as the sum over its sensors, each with its own sequence."""
    inner = [*keys, *[s for s in sensor if s not in keys]]
    return (
        state_changes(df, inner, ["bool", "str"], **options)
        .groupBy(*keys, "kind", "change_hour")
        .agg(F.sum("changes").alias("changes"), F.sum("count").alias("count"))
    )


def pivot_last(agg: DataFrame, keys: Sequence[str], values: Sequence, fill: float = 0.0) -> DataFrame:
    """The last key becomes columns ``{stat}_{value}``; counts of all values add up."""
    *rest, last = keys
    stats = [c for c in agg.columns if c not in (*keys, "count")]
    wide = agg.groupBy(*rest).agg(
        *[
            F.coalesce(F.max(F.when(F.col(last) == v, F.col(s))), F.lit(fill)).alias(f"{s}_{v}")
            for v in values
            for s in stats
        ],
        F.sum("count").alias("count"),
    )
    return wide


def append_agg(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold two partial results the lossy way: counts add, all other columns are count-weighted means."""
    return fold_weighted(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [first, second]), keys)


def fold_weighted(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same fold over any number of partial results in one aggregate.

    A count-weighted mean of count-weighted means does not depend on the order of folding,
    so a day loop is not needed.
    """
    n = F.coalesce(F.col("count"), F.lit(0))
    stats = [c for c in parts.columns if c not in (*keys, "count")]
    return parts.groupBy(*keys).agg(
        *[
            F.coalesce(F.try_divide(F.sum(F.coalesce(F.col(c), F.lit(0)) * n), F.sum(n)), F.lit(0.0)).alias(c)
            for c in stats
        ],
        F.sum(n).alias("count"),
    )


def join_full_fold(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lossy fold of two partial results written as a full outer join."""
    stats = [c for c in first.columns if c not in (*keys, "count")]
    a = first.select(*keys, *[F.col(c).alias(f"{c}_1") for c in [*stats, "count"]])
    b = second.select(*keys, *[F.col(c).alias(f"{c}_2") for c in [*stats, "count"]])
    both = a.join(b, list(keys), "full_outer").na.fill(0)
    n = F.col("count_1") + F.col("count_2")
    return both.select(
        *keys,
        *[
            F.coalesce(
                F.try_divide(F.col(f"{c}_1") * F.col("count_1") + F.col(f"{c}_2") * F.col("count_2"), n), F.lit(0.0)
            ).alias(c)
            for c in stats
        ],
        n.alias("count"),
    )


def numeric_partials(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mergeable partial results: count, mean, squared deviations, max, min."""
    x = F.nanvl(F.col("_x"), F.lit(None).cast("double"))
    rows = with_keys(df, keys).filter(value_type(value) == "num").withColumn("_x", numeric_value(value))
    return rows.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"),
        F.max(x).alias("max"),
        F.min(x).alias("min"),
    )


def merge_partials(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial results of ``numeric_partials`` merged into partial results, one row per key."""
    n = F.sum("n")
    totals = parts.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("mean")), n), F.lit(0.0)).alias("_mu"))
    m2 = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mu")) * (F.col("mean") - F.col("_mu"))
    return (
        parts.join(totals, list(keys))
        .groupBy(*keys)
        .agg(n.alias("n"), F.first("_mu").alias("mean"), F.sum(m2).alias("m2"), F.max("max").alias("max"), F.min("min").alias("min"))
    )


def append_agg_exact(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge partial results exactly, as if all their rows had been aggregated at once.

    Deviations are merged around the total mean, which keeps large counters with a small
    spread accurate; sums of squares would cancel. The total mean is a first, small
    aggregate joined back, so a key with many partials is still merged map-side.
    """
    totals = parts.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")), F.lit(0.0)).alias("_mu")
    )
    spread = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mu")) * (F.col("mean") - F.col("_mu"))
    return (
        parts.join(totals, list(keys))
        .groupBy(*keys)
        .agg(
            F.first("_mu").alias("mean"),
            F.sqrt(F.greatest(F.coalesce(F.try_divide(F.sum(spread), F.sum("n") - 1), F.lit(0.0)), F.lit(0.0))).alias(
                "std"
            ),
            F.coalesce(F.max("max"), F.lit(0.0)).alias("max"),
            F.coalesce(F.min("min"), F.lit(0.0)).alias("min"),
            F.sum("n").alias("count"),
        )
    )


def daily_fold(df: DataFrame, keys: Sequence[str], exact: bool = False, **options) -> DataFrame:
    """Aggregate each day, then fold the days into one row per key.

    ``df`` carries ``date``. Exact folding covers the numeric values; the lossy fold covers
    all kinds and averages every statistic over the days by count.
    """
    daily = ["date", *keys]
    if exact:
        return append_agg_exact(numeric_partials(df, daily).drop("date"), keys)
    return fold_weighted(agg_all(df, daily, **options).drop("date"), keys)


def days_of(df: DataFrame, date: str = "date") -> DataFrame:
    """Number of days with readings, as one row."""
    return df.agg(F.count_distinct(date).alias("days"))


def update_rate_nc(agg: DataFrame, days: Column | int, extra_days: int = 1) -> DataFrame:
    """Readings per day; the divisor is one more than the number of days."""
    return agg.withColumn("update_rate", F.col("count") / (_days(days) + extra_days)).drop("count")


def update_rate_ec(agg: DataFrame, days: Column | int, extra_days: int = 1) -> DataFrame:
    """Readings per hour, with the same divisor times 24."""
    return agg.withColumn("update_rate", F.col("count") / ((_days(days) + extra_days) * 24)).drop("count")


def _days(days: Column | int) -> Column:
    return F.lit(days) if isinstance(days, int) else days


def ec_hourly_mean(df: DataFrame) -> DataFrame:
    """Mean and count per meter, date, hour and unit."""
    return agg_numeric(df, ["uniqueId", "date", "hour", "unit"], "mean").withColumnRenamed("mean", "EC_mean_value")


def ec_sensor_stats(df: DataFrame) -> DataFrame:
    """All aggregates per meter and unit."""
    return agg_numeric(df, ["uniqueId", "unit"], "all")
