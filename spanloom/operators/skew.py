"""Joins and running counts that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# A key is hot when it holds more than this share of the rows, so at most 1/HOT_SHARE keys are.
HOT_SHARE = 0.001
MIN_HOT_ROWS = 10_000  # fewer rows than this fit any task
SALTS = 64


def hot_keys(counts: DataFrame, key: str, rows: str = "n") -> DataFrame:
    """Keys above HOT_SHARE of all rows, from a frame of (key, rows); at most 1/HOT_SHARE of them."""
    total = counts.agg(F.sum(rows).alias("total")).scalar()
    return counts.where(F.col(rows) > F.greatest(total * F.lit(HOT_SHARE), F.lit(MIN_HOT_ROWS))).select(key)


def salted_lookup(many: DataFrame, unique: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """``many`` left-joined to ``unique`` (one row per key), hot keys spread over SALTS tasks.

    ``hot`` has at most 1/HOT_SHARE rows by construction, which makes it safe to broadcast.
    ``spread`` decides the task of a hot row; it must vary between rows of the same key.
    """
    hot = hot.select(key, F.lit(True).alias("_hot"))
    left = many.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = unique.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def earlier_counts(
    rows: DataFrame, keys: list[str], order: list[str], block: list[Column], weights: list[str],
) -> DataFrame:
    """Adds, per weight w: ``earlier_w``, its sum over earlier rows of the same keys, and ``total_w``.

    ``block`` cuts the order into consecutive ranges of limited size. Each (keys, block) is one
    window, so a hot key is spread over its blocks; what earlier blocks add comes from one small
    row per (keys, block).
    """
    names = [f"_block{i}" for i in range(len(block))]
    rows = rows.withColumns(dict(zip(names, block)))
    inside = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    zero = F.lit(0)
    sums = rows.groupBy(*keys, *names).agg(*[F.sum(w).alias(f"_sum_{w}") for w in weights])
    totals = sums.select(
        *keys, *names,
        *[F.coalesce(F.sum(f"_sum_{w}").over(ahead), zero).alias(f"_ahead_{w}") for w in weights],
        *[F.sum(f"_sum_{w}").over(whole).alias(f"total_{w}") for w in weights],
    )
    local = rows.withColumns({
        f"_inside_{w}": F.coalesce(F.sum(w).over(inside), zero) for w in weights
    })
    joined = local.join(totals, [*keys, *names])
    return joined.withColumns({
        f"earlier_{w}": F.col(f"_inside_{w}") + F.col(f"_ahead_{w}") for w in weights
    }).drop(*names, *[f"_inside_{w}" for w in weights], *[f"_ahead_{w}" for w in weights])
