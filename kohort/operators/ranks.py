"""Exact order statistics without a global sort.

A window without partitions would put every row into one task, and a window
per group would do so for a group holding a third of the rows. Here a
mergeable sketch first locates each wanted rank inside a narrow band of
values; a second aggregate counts what lies below the band and the distinct
values inside it. Both aggregates combine map-side, so only sketches and bands
are shuffled and the rows themselves never move.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import settle

GRID = 1000
ACCURACY = 20 * GRID
BAND_ROWS = 1_000_000
MAX_ROUNDS = 6


def quantile_marks(value: str, grid: int, accuracy: int) -> Column:
    """Sketch of ``grid + 1`` evenly spaced quantiles (written as SQL text: one call instead of one per mark)."""
    marks = ", ".join(f"{i / grid!r}D" for i in range(grid + 1))
    return F.expr(f"percentile_approx({value}, array({marks}), {accuracy})")


def attach(rows: DataFrame, small: DataFrame, by: list[str], name: str, how: str = "inner") -> DataFrame:
    """Add column ``name`` of ``small`` (one row per ``by`` group) to every row.

    The rows themselves are not shuffled: a grouped table is settled, so Spark can broadcast
    it, and an ungrouped one is a scalar subquery.
    """
    if by:
        return rows.join(settle(small.select(*by, name)), by, how)
    return rows.withColumn(name, small.select(name).scalar())


def band_literal(bands: list[Row]) -> Column:
    """A few bands as one constant array."""

    def number(v: float) -> str:
        return f"{v!r}D" if math.isfinite(v) else f"double('{v}')"

    parts = [
        f"named_struct('rank', {b['rank']}L, 'low', {number(b['low'])}, 'high', {number(b['high'])})" for b in bands
    ]
    return F.expr(f"array({', '.join(parts)})")


def order_statistics(
    rows: DataFrame,
    value: str,
    targets: Callable[[Column], Column],
    by: list[str] | None = None,
    tie: str | None = None,
    grid: int = GRID,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """Values at given 0-based ranks, per group.

    ``targets(n)`` maps the row count of a group to an array of ranks (bigint). The
    result has one row per (``by``, ``rank``) with ``n``, ``value`` and, if asked for,
    ``tie``, which orders equal values. Bands are narrowed, each round to about 5/grid of
    the rows before, until none holds more than ``band_rows``.
    """
    by = by or []
    rows = rows.select(*by, F.col(value).cast("double").alias("_v"), *([F.col(tie).alias("_t")] if tie else []))
    rows = rows.where("_v IS NOT NULL")
    accuracy = ACCURACY * grid // GRID

    def band(rank: Column, base: Column, n: Column, marks: Column) -> Column:
        """Grid marks that surely enclose row ``rank - base`` of ``n``."""
        at = (rank - base) / n * grid
        low = F.greatest(F.floor(at).cast("int") - 2, F.lit(0))
        high = F.least(F.ceil(at + grid / n).cast("int") + 2, F.lit(grid))
        return F.struct(
            rank.alias("rank"),
            F.get(marks, low).alias("low"),
            F.get(marks, high).alias("high"),
            ((high - low) * n / grid).alias("width"),
        )

    # per-group bands are written once and joined; those of a single group become constants
    def hold(bands: DataFrame) -> DataFrame | Row | None:
        return settle(bands) if by else bands.first()

    def too_wide(bands: DataFrame | Row) -> bool:
        if not by:
            return any(b["low"] < b["high"] and b["width"] > band_rows for b in bands["w"])
        widths = F.transform("w", lambda b: F.when(b["low"] < b["high"], b["width"]))
        return not bands.where(F.array_max(widths) > band_rows).isEmpty()

    def inside(bands: DataFrame | Row) -> DataFrame:
        """One row per input row and target that does not lie above the target's band."""
        if by:
            found = rows.join(bands, by)
        else:
            found = rows.withColumns({"n": F.lit(bands["n"]).cast("bigint"), "w": band_literal(bands["w"])})
        found = found.withColumn("w", F.explode("w"))
        columns = [c for c in ("_v", "_t") if c in rows.columns]
        return found.select(*by, "n", "w.rank", "w.low", "w.high", *columns).where("_v <= high")

    sized = rows.groupBy(*by).agg(F.count("*").alias("n"), quantile_marks("_v", grid, accuracy).alias("marks"))
    ranks = F.filter(F.array_distinct(targets(F.col("n"))), lambda r: (r >= 0) & (r < F.col("n")))
    w = F.transform(ranks, lambda r: band(r, F.lit(0), F.col("n"), F.col("marks")))
    bands = hold(sized.select(*by, "n", w.alias("w")))
    if not by and not bands["w"]:
        fields = ["n bigint", "rank bigint", "value double"]
        kind = [f"tie {rows.schema['_t'].dataType.simpleString()}"] if tie else []
        return rows.sparkSession.createDataFrame([], ", ".join(fields + kind))
    for _ in range(MAX_ROUNDS):
        if not too_wide(bands):
            break
        inner = inside(bands).withColumn("_in", F.when(F.col("_v") >= F.col("low"), F.col("_v")))
        inner = inner.groupBy(*by, "n", "rank").agg(
            F.count_if(F.col("_in").isNull()).alias("base"),
            F.count("_in").alias("m"),
            quantile_marks("_in", grid, accuracy).alias("marks"),
        )
        narrow = band(F.col("rank"), F.col("base"), F.col("m"), F.col("marks"))
        bands = hold(inner.groupBy(*by, "n").agg(F.collect_list(narrow).alias("w")))

    below = F.col("_v") < F.col("low")
    keys = [F.when(~below, F.col("_v")).alias("value")]
    if tie:
        keys.append(F.when(~below, F.col("_t")).alias("tie"))
    counted = inside(bands).groupBy(*by, "n", "rank", *keys).agg(F.count("*").alias("c"))
    # one window partition per wanted rank, holding the distinct values of its band
    order = [F.col("value").asc_nulls_first()] + ([F.col("tie").asc_nulls_first()] if tie else [])
    line = Window.partitionBy(*by, "rank").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("c").over(line))
    hit = placed.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    return hit.select(*by, "n", "rank", "value", *(["tie"] if tie else []))


def exact_quantiles(
    rows: DataFrame, value: str, probs: list[float], by: list[str] | None = None, **options
) -> DataFrame:
    """Quantiles with linear interpolation between order statistics: one row per group, array ``q``."""
    by = by or []

    def position(p: float, n: Column) -> Column:
        return F.lit(p) * (n - 1)

    def targets(n: Column) -> Column:
        ranks = []
        for p in probs:
            ranks += [F.floor(position(p, n)), F.ceil(position(p, n))]
        return F.array(*[r.cast("bigint") for r in ranks])

    stats = order_statistics(rows, value, targets, by, **options)
    lookup = F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")
    stats = stats.groupBy(*by, "n").agg(lookup)
    quantiles = []
    for p in probs:
        spot = position(p, F.col("n"))
        low, high = F.floor(spot).cast("bigint"), F.ceil(spot).cast("bigint")
        quantiles.append(F.col("at")[low] + (F.col("at")[high] - F.col("at")[low]) * (spot - low))
    return stats.select(*by, "n", F.array(*quantiles).alias("q"))


def rank_table(rows: DataFrame, value: str, rank: str, buckets: int = 256) -> DataFrame:
    """(value, rank): the 1-based average rank of every distinct value (ties share their mean rank).

    NULL and NaN have no rank.

    Quantile marks split the value axis into ``buckets``; each bucket is cumulated on its own
    and shifted by the total below it. A value held by a third of the rows is a single
    counted row here.
    """
    values = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("_v"))
    # a sketch over the rows merges map-side, without the shuffle that counting needs
    marks = values.select(quantile_marks("_v", buckets, 10 * buckets).alias("m")).first()["m"] or []
    counted = values.groupBy("_v").agg(F.count("*").alias("_c"))
    splits = [float("-inf"), *sorted({m for m in marks if np.isfinite(m)}), float("inf")]
    marked = Bucketizer(splits=splits, inputCol="_v", outputCol="_b").transform(counted)
    totals = marked.groupBy("_b").agg(F.sum("_c").alias("_s"))
    # at most ``buckets`` rows
    offsets = totals.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_o"))
    w = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = marked.join(offsets, "_b").withColumn("_u", F.col("_o") + F.sum("_c").over(w))
    return ranked.select(F.col("_v").alias(value), (F.col("_u") - (F.col("_c") - 1) / 2.0).alias(rank))


def average_ranks(rows: DataFrame, value: str, rank: str, buckets: int = 256) -> DataFrame:
    """Add the average rank of ``value``; rows without a value drop out."""
    return rows.join(rank_table(rows, value, rank, buckets), value)
