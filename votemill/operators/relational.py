"""Reusable table operators: keyed dedupe, top-n, shares, ratings, zero-filled grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from votemill.runtime import global_rank, materialize


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by the order columns, as a combinable aggregate (a hot key shrinks map-side)."""
    rest = [c for c in df.columns if c not in keys]
    front = order + [c for c in rest if c not in order]
    return (df.groupBy(*keys).agg(F.min(F.struct(*front)).alias("_r"))
            .select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns))


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], count_as: str | None = None) -> DataFrame:
    """Row with the smallest order struct per key, and optionally the number of rows of the key."""
    rest = [c for c in df.columns if c not in keys]
    aggs = [F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    return df.groupBy(*keys).agg(*aggs).select(*keys, "_r.*", *([count_as] if count_as else []))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark cuts each task to ``n`` per key before the exchange."""
    return (df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .where(F.col(rank) <= n))


def share_of_total(df: DataFrame, group: str, count: str, out: str, digits: int = 1) -> DataFrame:
    """Percentage of each row's count within its group; an empty group counts as one."""
    total = F.sum(count).over(W.partitionBy(group))
    return df.withColumn(out, F.bround(100 * F.col(count) / F.when(total == 0, 1).otherwise(total), digits))


def percentile_ratings(df: DataFrame, id_col: str, value_cols: list[str]) -> DataFrame:
    """Each value to 1..99 by its sorted place among non-null values; ties by id; a single value gives 50."""
    df = materialize(df.select(id_col, *[F.col(c).cast("double").alias(c) for c in value_cols]), "rated")
    long = (df.unpivot(id_col, value_cols, "metric", "value").where(F.col("value").isNotNull()))
    ranked = global_rank(long, "metric", "value", id_col)
    rating = F.when(F.col("total") > 1, F.bround(1 + 98 * F.col("rank0") / (F.col("total") - 1), 0)).otherwise(50.0)
    wide = (ranked.select(id_col, "metric", rating.cast("int").alias("r"))
            .groupBy(id_col).pivot("metric", value_cols).agg(F.first("r")))
    return df.select(id_col).join(wide, id_col, "left")


def zero_grid(rows: DataFrame, axis: str, values: list, counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Complete ``rows`` x ``values`` grid with zero where ``counts`` has no row."""
    grid = rows.withColumn(axis, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(counts, keys, "left").na.fill(0, [count])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], last_wins: bool = True) -> DataFrame:
    """Merge by key: the new row replaces the old one, or is ignored where the key exists."""
    if last_wins:
        return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new)
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def fold_updates(log: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Current state from an update log: per column the latest value that is not null."""
    return log.groupBy(key).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])
