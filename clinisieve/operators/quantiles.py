"""Exact quantiles without gathering a column in one place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinisieve.operators.joins import lookup_join

# Up to this many rows Spark's own exact percentile is used: its state is one entry per distinct
# value, and that state ends up in a single task.
SMALL = 1_000_000
ACCURACY = 10_000
# A bracket's values are ranked in so many tasks, by equal steps from its low end to its high end.
BLOCKS = 256


def _ranked(tallied: DataFrame, keys: list[str], value: str, count: str, low: Column, high: Column) -> DataFrame:
    """Add ``_before``, the rows of the group under a value: summed up per block first, and then within blocks."""
    place = F.floor((F.col(value) - low) / (high - low) * BLOCKS)
    block = F.when(high > low, F.least(F.lit(BLOCKS - 1), F.greatest(F.lit(0), place)))
    marked = tallied.withColumn("_block", F.coalesce(block, F.lit(0)).cast("int"))
    sizes = marked.groupBy(*keys, "_block").agg(F.sum(count).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.join(offsets, [*keys, "_block"])
    before = F.col("_offset") + F.coalesce(F.sum(count).over(inside), F.lit(0))
    return placed.withColumn("_before", before).drop("_block", "_offset")


def exact_quantiles(df: DataFrame, columns: list[str], q: float, *, small: int = SMALL,
                    accuracy: int = ACCURACY) -> dict[str, float | None]:
    """The q-quantile of each column, linear between neighbours; None for a column of nulls.

    For many rows a sketch first names a narrow bracket that must hold the quantile.  Then only
    the values inside the bracket (a few rows in ``accuracy``) are counted, exactly.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    if max(counts) <= max(small, 4 * accuracy):
        row = df.agg(*[F.percentile(c, F.lit(q)).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}

    # A sketch rank is off by at most n/accuracy, so two steps to either side are enough.
    sides = [max(q - 2.0 / accuracy, 0.0), min(q + 2.0 / accuracy, 1.0)]
    bracket = df.agg(*[F.percentile_approx(c, sides, accuracy).alias(c) for c in columns],
                     *[F.struct(F.min(c), F.max(c)).alias(f"{c}_ends") for c in columns]).first()
    long_counts = {c: counts[c] for c in columns if counts[c] > 4 * accuracy}
    rest = [c for c in columns if c not in long_counts]
    out: dict[str, float | None] = exact_quantiles(df, rest, q) if rest else {}

    below = df.agg(*[
        F.count_if(F.col(c) < (bracket[c][0] if sides[0] > 0 else -math.inf)).alias(c) for c in long_counts
    ]).first()
    inside = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"),
                 F.when(F.col(c).between(bracket[c][0] if sides[0] > 0 else -math.inf,
                                         bracket[c][1] if sides[1] < 1 else math.inf),
                        F.col(c).cast("double")).alias("value"))
        for c in long_counts])).alias("x")).select("x.*").filter("value IS NOT NULL")
    tallied = inside.groupBy("name", "value").count()
    def end(side: int, whole: bool) -> Column:
        ends = F.lit(None).cast("double")
        for c in long_counts:
            at = bracket[f"{c}_ends"][side] if whole else bracket[c][side]
            ends = F.when(F.col("name") == c, F.lit(float(at))).otherwise(ends)
        return ends
    ranked = _ranked(tallied, ["name"], "value", "count", end(0, sides[0] <= 0), end(1, sides[1] >= 1)).withColumnRenamed("_before", "before")

    position = {c: (n - 1) * q for c, n in long_counts.items()}
    wanted = F.lit(False)
    for c, p in position.items():
        for rank in {math.floor(p), math.ceil(p)}:
            at = rank - below[c]
            wanted = wanted | ((F.col("name") == c) & (F.col("before") <= at)
                               & (F.col("before") + F.col("count") > at))
    found = ranked.filter(wanted).collect()  # at most two rows per column
    for c, p in position.items():
        def value_at(rank: int) -> float:
            at = rank - below[c]
            return next(r["value"] for r in found
                        if r["name"] == c and r["before"] <= at < r["before"] + r["count"])
        low, high = value_at(math.floor(p)), value_at(math.ceil(p))
        out[c] = low + (high - low) * (p - math.floor(p))
    return out


def grouped_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str, *,
                     accuracy: int = ACCURACY) -> DataFrame:
    """The exact q-quantile of ``value`` per group, however large a single group is.

    A sketch per group (summed before the shuffle) names the bracket that must hold the quantile.
    Values outside the bracket are only counted, equal values are counted as one, so a group that
    holds most of the rows reaches one task as a few tallies.
    """
    step = 2.0 / accuracy
    sides = F.percentile_approx(value, [max(q - step, 0.0), min(q + step, 1.0)], accuracy)
    groups = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        sides.alias("_sides"), F.count(F.lit(1)).alias("_n"))
    # Small groups are taken whole: a sketch of few values leaves no room on either side.
    whole = F.col("_n") <= 4 * accuracy
    groups = groups.select(
        *keys, ((F.col("_n") - 1) * q).alias("_at"),
        F.when(~whole & F.lit(q > step), F.col("_sides")[0].cast("double")).alias("_low"),
        F.when(~whole & F.lit(q < 1 - step), F.col("_sides")[1].cast("double")).alias("_high"))
    rows = lookup_join(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")),
                       groups, keys, "inner")
    # Everything under the bracket is tallied as one value, everything above it is dropped.
    kept = rows.filter(F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))
    tallied = kept.withColumn("_v", F.when(F.col("_v") < F.col("_low"), F.lit(-math.inf)).otherwise(F.col("_v"))) \
        .groupBy(*keys, "_at", "_low", "_high", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = _ranked(tallied, keys, "_v", "_c", F.col("_low"), F.col("_high"))
    begin = F.col("_before")
    ranked = ranked.withColumn("_end", begin + F.col("_c"))
    floor, ceil = F.floor("_at"), F.ceil("_at")
    picked = ranked.groupBy(*keys, "_at").agg(
        F.max(F.when((begin <= floor) & (floor < F.col("_end")), F.col("_v"))).alias("_lo"),
        F.max(F.when((begin <= ceil) & (ceil < F.col("_end")), F.col("_v"))).alias("_hi"))
    return picked.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo"))
                                 * (F.col("_at") - F.floor("_at"))).alias(name))
