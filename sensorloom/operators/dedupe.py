"""Keep-one and flag operators as partial aggregates, so a hot key never fills one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _pick(df: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; a null order sorts last and so wins.

    Ties go to the greatest row, which makes the result independent of the partitioning.
    """
    rest = [c for c in df.columns if c not in (*keys, order)]
    rank = F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("o"), F.struct(*rest).alias("r"))
    return _pick(df, keys, F.max_by(F.struct(*df.columns), rank))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order; null keys equal each other.

    The least value of the first order column is an aggregate of fixed width; joined back, it
    leaves the ties to pick from, so no task sorts all rows.
    """
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    least = df.groupBy(*named).agg(F.min(order[0]).alias("_least"))
    same = df[order[0]].eqNullSafe(least["_least"])
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(least[f"_k{i}"])
    return _pick(df.join(least, same, "left_semi"), keys, F.min_by(F.struct(*df.columns), F.struct(*order)))


def flag_duplicates(df: DataFrame, keys: list[str], flag: str = "duplicated") -> DataFrame:
    """Mark every row whose key occurs more than once; null keys equal each other.

    The keys that repeat are found by a partial count and joined back as a left join,
    whose hot partitions adaptive execution splits.
    """
    tagged = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    many = df.groupBy(*tagged).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n").withColumn("_hit", F.lit(True))
    same = None
    for i, k in enumerate(keys):
        c = df[k].eqNullSafe(many[f"_k{i}"])
        same = c if same is None else same & c
    return (
        df.join(many, same, "left")
        .withColumn(flag, F.coalesce("_hit", F.lit(False)))
        .select(*df.columns, flag)
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()
