"""Scaling, encoding and splitting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.values import numeric_value, value_type
from sensorloom.scratch import cut_lineage

# Spark's own limit on pivot columns bounds what one-hot encoding may widen a table to.
MAX_CATEGORIES = 10_000

# Categories that one task ranks.
CODE_ROWS = 100_000


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) per column; a constant column becomes 0, nulls stay.

    The bounds are one aggregate used as a scalar subquery, so no window ever covers the
    whole table.
    """
    bounds = df.agg(
        F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"c{i}") for i, c in enumerate(columns)]).alias("b")
    ).scalar()
    out = df.withColumn("_b", bounds)

    def scaled(i: int, c: str) -> Column:
        lo, hi = F.col(f"_b.c{i}.lo"), F.col(f"_b.c{i}.hi")
        return F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - lo, (hi - lo).cast("double")), F.lit(0.0)))

    return out.withColumns({c: scaled(i, c) for i, c in enumerate(columns)}).drop("_b")


def standard_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population std, both taken from ``train``; a constant column is only centred."""
    bounds = train.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"c{i}") for i, c in enumerate(columns)]).alias("b")
    ).scalar()
    out = df.withColumn("_b", bounds)
    return out.withColumns(
        {
            c: (F.col(c) - F.col(f"_b.c{i}.m")) / F.when(F.col(f"_b.c{i}.s") == 0, 1.0).otherwise(F.col(f"_b.c{i}.s"))
            for i, c in enumerate(columns)
        }
    ).drop("_b")


def categories(df: DataFrame, column: str) -> list[str | None]:
    """Distinct values in sorted order, refused beyond the limit on columns."""
    rows = df.select(column).distinct().orderBy(F.col(column).asc_nulls_first()).limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories to encode as columns")
    return [x[0] for x in rows]


def first_appearance_code(df: DataFrame, column: str, order: Sequence[str] = ("datetime", "seq")) -> DataFrame:
    """Every category with its code 0, 1, 2 ... by first appearance.

    The first appearances are one aggregate, cut into ranges of about ``CODE_ROWS``. A code is
    the place in its range plus the sizes of the ranges before; so no task ranks all categories,
    also when all of them appear in the first minute.
    """
    firsts = cut_lineage(df.groupBy(column).agg(F.min(F.struct(*order)).alias("at")), "firsts")
    parts = max(1, math.ceil(firsts.count() / CODE_ROWS))
    ranged = cut_lineage(firsts.repartitionByRange(parts, "at").withColumn("_p", F.spark_partition_id()), "firsts")
    # One row per range.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    offsets = sizes.select(F.col("_p").alias("_o"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("at"))
    numbered = ranged.withColumn("_r", rank).join(offsets, F.col("_p") == F.col("_o"))
    return numbered.select(column, (F.col("offset") + F.col("_r") - 1).alias("code"))


def one_hot_sparse(df: DataFrame, column: str, order: Sequence[str] = ("datetime", "seq")) -> DataFrame:
    """The same encoding for any number of categories: the code of the 1, and the width."""
    codes = cut_lineage(first_appearance_code(df, column, order), "codes")
    width = codes.agg(F.count("*").alias("n")).scalar()
    named = codes.withColumnRenamed(column, "_category")
    joined = df.join(named, F.col(column).eqNullSafe(F.col("_category"))).drop("_category")
    return joined.withColumn("width", width)


def one_hot(df: DataFrame, column: str, order: Sequence[str] = ("datetime", "seq"), prefix: str | None = None) -> DataFrame:
    """One 0/1 column per category, numbered by first appearance; ``one_hot_sparse`` has no limit on them."""
    codes = first_appearance_code(df, column, order).orderBy("code").limit(MAX_CATEGORIES + 1).collect()
    if len(codes) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories to encode as columns")
    prefix = f"{column}_" if prefix is None else prefix
    return df.withColumns(
        {f"{prefix}{row['code']}": F.col(column).eqNullSafe(F.lit(row[column])).cast("int") for row in codes}
    )


def encode_units(df: DataFrame, order: Sequence[str] = ("datetime", "seq")) -> DataFrame:
    """``unit_0``, ``unit_1`` ... for the units in order of appearance; ``encode_units_sparse`` has no limit on them."""
    return one_hot(df, "unit", order, "unit_")


def encode_units_sparse(df: DataFrame, order: Sequence[str] = ("datetime", "seq")) -> DataFrame:
    """The same encoding for any number of units: the code of the 1 as ``unit_code``, and ``unit_width``."""
    return one_hot_sparse(df, "unit", order).withColumnsRenamed({"code": "unit_code", "width": "unit_width"})


def encode_and_scale_values_sparse(
    df: DataFrame, order: Sequence[str] = ("datetime", "seq"), value: str = "value"
) -> DataFrame:
    """Numbers scaled into ``sc_0``; of other values the code of the 1 as ``cv_code``, null for numbers, and ``cv_width``.

    Free text in the values may have any number of categories; a null is one of them. Numbers do not take part in the
    join: they are the bulk of the rows and have no code.
    """
    rows = df.withColumns({"_kind": value_type(value), "sc_0": numeric_value(value)})
    other = F.coalesce(F.col("_kind") != "num", F.lit(False))
    codes = cut_lineage(first_appearance_code(df.filter(value_type(value) != "num"), value, order), "codes")
    width = codes.agg(F.count("*").alias("n")).scalar()
    named = codes.select(F.col(value).alias("_category"), F.col("code").alias("cv_code"))
    scaled = min_max_scale(rows, ["sc_0"]).withColumn("sc_0", F.coalesce("sc_0", F.lit(0.0)))
    coded = scaled.filter(other).join(named, F.col(value).eqNullSafe(F.col("_category")), "left").drop("_category")
    plain = scaled.filter(~other).withColumn("cv_code", F.lit(None).cast("long"))
    return coded.unionByName(plain).withColumn("cv_width", width).drop("_kind")


def encode_and_scale_values(df: DataFrame, order: Sequence[str] = ("datetime", "seq"), value: str = "value") -> DataFrame:
    """Numbers scaled into ``sc_0``, other values one-hot as ``cv_i``; what does not apply is 0.

    ``encode_and_scale_values_sparse`` has no limit on the other values.
    """
    kind = value_type(value)
    cats = one_hot(df.filter(kind != "num"), value, order, "cv_").select(*df.columns, F.col("*"))
    names = [c for c in cats.columns if c.startswith("cv_")]
    typed = df.withColumns({"sc_0": numeric_value(value)})
    scaled = min_max_scale(typed, ["sc_0"])
    codes = first_appearance_code(df.filter(kind != "num"), value, order)
    return (
        scaled.join(codes, value, "left")
        .withColumns(
            {
                **{n: F.coalesce((F.col("code") == int(n[3:])).cast("int"), F.lit(0)) for n in names},
                "sc_0": F.coalesce("sc_0", F.lit(0.0)),
            }
        )
        .drop("code")
    )


def label_encode(df: DataFrame, column: str, out: str = "label_index") -> DataFrame:
    """Index of each label in sorted order; labels are the classes of a model, so few."""
    names = [n for n in categories(df, column) if n is not None]
    index = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)).cast("int") - 1
    return df.withColumn(out, index)


def uniform_hash(key: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends only on the key and the seed."""
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    head = F.substring(F.md5(F.concat(k, F.lit(f":{seed}"))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Random split that the partitioning cannot change: a hash of the key decides."""
    u = uniform_hash(key, seed)
    return df.filter(u >= test_size), df.filter(u < test_size)


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 2, slices: int = 256, out: str = "fold") -> DataFrame:
    """Folds that keep the class proportions: rows of a class are dealt to the folds in turn.

    A class is cut into slices by a hash of the key. The rank within a slice plus the sizes
    of the slices before it is the rank within the class, without one task for a hot class.
    """
    cut = F.floor(uniform_hash(key) * slices).cast("int")
    rows = df.withColumn("_slice", cut)
    sizes = rows.groupBy(label, "_slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(label).alias("_l"), F.col("_slice").alias("_sl"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o")
    )
    inside = F.row_number().over(Window.partitionBy(label, "_slice").orderBy(key))
    return (
        rows.withColumn("_r", inside)
        .join(offsets, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_slice") == F.col("_sl")))
        .withColumn(out, ((F.col("_o") + F.col("_r") - 1) % k).cast("int"))
        .select(*df.columns, out)
    )
