"""Tables, ranks and components shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sensorloom.scratch import cut_lineage

#: Rows that one task numbers at a time.
SLICE_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Named columns of one of the given tables; further columns, of whatever name, are not read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str, rows: int | None = None) -> DataFrame:
    """Number the rows of each key from 0 without a gap.

    ``df`` must be a written table, as it is read twice. Every key is cut into slices by a hash
    of the order columns; counts of the slices give each slice its base, and only a slice of
    about ``SLICE_ROWS`` rows is sorted in one place. Rows that agree in the order columns get
    numbers next to each other, in any order.
    """
    rows = df.count() if rows is None else rows
    n = max(1, -(-rows // SLICE_ROWS))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(n)) if n > 1 else F.lit(0).cast("bigint"))
    part = W.partitionBy(*keys, "_slice").orderBy(*order)
    if n == 1:
        return cut.withColumn(rank, F.row_number().over(part).cast("bigint") - 1).drop("_slice")
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        cut.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"))
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_slice").alias("_s"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        )
    )
    same: Column = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = cut.withColumn("_row", F.row_number().over(part).cast("bigint") - 1).join(bases, same)
    return numbered.select(*df.columns, (F.col("_base") + F.col("_row")).alias(rank))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table with 64-bit hashed node numbers: ``(node, root)``.

    Each round replaces every node by the least number in its neighbourhood and keeps the edges
    that are left; as the numbers are hashes, the expected share of nodes that remain is
    constant, so the rounds grow with the logarithm of the longest path. Nothing is gathered
    per node, only minima, and each round is written.
    """
    live = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    roots = None
    while True:
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        least = cut_lineage(least, "hook")
        if roots is None:
            roots = least.select("node", F.col("to").alias("root"))
        else:
            hop = least.select(F.col("node").alias("root"), "to")
            roots = roots.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = cut_lineage(roots, "roots")
        left = least.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = least.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        live = live.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        live = cut_lineage(live.filter("a <> b").distinct(), "edges")
        if live.isEmpty():
            return roots
