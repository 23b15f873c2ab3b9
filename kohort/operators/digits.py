"""Exact quantiles of every column of an array at once, by counting leading digits.

A double is read as an integer in the same order. A pass counts the rows of each group, column and digit: the first
12 bits (sign and exponent), then 10 more bits a pass, and only of values whose digits so far hold a wanted rank. A task
adds up whole batches and sends one row per digit it met with the count, the smallest and the largest value, so rows
are neither exploded nor shuffled, and what is shuffled does not grow with the rows. A rank is found once its digit
holds one value or the rank is that digit's first or last row, which bounds the passes by six whatever the values are; a value that a third of the
rows share costs no more than any other.

Sets of groups, such as all folds but one, are sums of the counts of their groups: a cross-validation reads every row
once a pass, not once for each training set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import matrix, vector

#: bits known after each pass
BITS = (12, 22, 32, 42, 52, 64)
#: rows of counts a task holds before it sends them
TABLE = 1 << 20
FOUND = "col int, s int, place int, n long, rank long, prefix long, value double, done boolean"


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def doubles(keys: np.ndarray) -> np.ndarray:
    """The inverse of ``ordered``."""
    return np.where(keys < 0, keys ^ np.int64((1 << 63) - 1), keys).view(np.float64)


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (group, column, digits; count, smallest, largest) as columns of one table, one row per key."""
    t = np.concatenate(parts, axis=1)
    t = t[:, np.lexsort((t[2], t[1], t[0]))]
    if t.shape[1] == 0:
        return t
    first = np.flatnonzero(np.r_[True, (t[:3, 1:] != t[:3, :-1]).any(axis=0)])
    sums = (np.add.reduceat(t[3], first), np.minimum.reduceat(t[4], first), np.maximum.reduceat(t[5], first))
    return np.vstack([t[:3, first], *sums])


def counted(x: np.ndarray, group: np.ndarray, wanted: tuple[np.ndarray, np.ndarray] | None, before: int, after: int) -> np.ndarray:
    """The table of one batch; ``wanted`` are (column, digits so far) pairs, None takes all."""
    n, d = x.shape
    column, group, x = np.tile(np.arange(d), n), np.repeat(group, d), x.ravel()
    keep = ~np.isnan(x)
    column, group, keys = column[keep], group[keep], ordered(x[keep])
    if wanted is not None:
        # pairs as single sorted numbers, digits by their place among all digits in use
        digits = np.unique(wanted[1])
        pairs = np.unique(wanted[0] * len(digits) + np.searchsorted(digits, wanted[1]))
        own = keys >> np.int64(64 - before)
        place = np.minimum(np.searchsorted(digits, own), len(digits) - 1)
        pair = column * len(digits) + place
        keep = (digits[place] == own) & (pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair)
        column, group, keys = column[keep], group[keep], keys[keep]
    return merged([np.vstack([group, column, keys >> np.int64(64 - after), np.ones_like(keys), keys, keys])])


def count_digits(df: DataFrame, x: str, wanted, before: int, after: int) -> DataFrame:
    """(g, col, digits, c, low, high) of the rows (g, x), one row per task, group, column and digits."""
    names = ["g", "col", "digits", "c", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                held = merged([held, counted(matrix(batch, x), vector(batch, "g", np.int64), wanted, before, after)])
            if held.shape[1] > TABLE:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)
                held = held[:, :0]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)

    rows = df.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return rows.groupBy("g", "col", "digits").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))


def narrowed(part: pd.DataFrame, member: np.ndarray, probs: list[float], asked: pd.DataFrame | None, shift: int) -> pd.DataFrame:
    """One step for the ranks of one column: each moves to the digit that holds it, or is found there.

    ``member`` tells for each set (row) which groups it has; ``asked`` are the column's open ranks, None starts with those of ``probs``.
    """
    digits, at = np.unique(part["digits"].to_numpy(), return_inverse=True)
    shape = (member.shape[1], len(digits))
    count = np.zeros(shape, np.int64)
    low, high = np.full(shape, np.iinfo(np.int64).max), np.full(shape, np.iinfo(np.int64).min)
    where = (part["g"].to_numpy(), at)
    count[where], low[where], high[where] = part["c"].to_numpy(), part["low"].to_numpy(), part["high"].to_numpy()
    column, out = int(part["col"].iloc[0]), []
    for s, groups in enumerate(member):
        own, least, most = count[groups].sum(axis=0), low[groups].min(axis=0), high[groups].max(axis=0)
        if asked is None:
            n = int(own.sum())
            spots = [p * (n - 1) for p in probs] if n else []
            open_ranks = [(2 * i + up, n, int((np.floor, np.ceil)[up](v)), None) for i, v in enumerate(spots) for up in (0, 1)]
        else:
            mine = asked[asked["s"] == s]
            open_ranks = list(zip(mine["place"], mine["n"], mine["rank"], mine["prefix"], strict=True))
        for place, n, rank, prefix in open_ranks:
            inside = np.flatnonzero(digits >> np.int64(shift) == prefix) if prefix is not None else np.arange(len(digits))
            upto = np.cumsum(own[inside])
            b = int(np.searchsorted(upto, rank, side="right"))
            hit, left = inside[b], rank - int(upto[b] - own[inside[b]])
            value = least[hit] if left == 0 else most[hit]
            done = least[hit] == most[hit] or left in (0, own[hit] - 1)
            out.append((column, s, place, n, left, digits[hit], float(doubles(np.array([value]))[0]), bool(done)))
    return pd.DataFrame(out, columns=["col", "s", "place", "n", "rank", "prefix", "value", "done"])


def step(member: np.ndarray, probs: list[float], asked: pd.DataFrame | None, shift: int):
    """``narrowed`` as a function of one column's counts."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return narrowed(part, member, probs, None if asked is None else asked[asked["col"] == part["col"].iloc[0]], shift)

    return run


def column_quantiles(
    df: DataFrame, probs: list[float], x: str = "x", group: str | None = None, sets: list[list[int]] | None = None
) -> np.ndarray:
    """Quantiles with linear interpolation, an array sets x columns x ``probs``; NaN for a column without values.

    ``group`` is a column of numbers from 0, ``sets`` lists the groups of each set (one set of all rows by default). NaN and
    NULL entries count as missing, rows without an array drop out; arrays of different lengths raise. The driver holds a few numbers per set,
    column and quantile.
    """
    sets = sets or [[0]]
    member = np.zeros((len(sets), 1 + max(max(s, default=0) for s in sets)), bool)
    for i, groups in enumerate(sets):
        member[i, groups] = True
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    rows = df.select(g.alias("g"), F.col(x).cast("array<double>").alias("x")).where("x IS NOT NULL")
    rows = rows.where(F.col("g").isin(sorted({g for s in sets for g in s})))
    width = rows.select(F.size("x")).first()
    out = np.full((len(sets), width[0] if width else 0, len(probs)), np.nan)
    sizes, ends = {}, {}
    asked, before = None, 0
    for after in BITS:
        wanted = None if asked is None else (asked["col"].to_numpy(np.int64), asked["prefix"].to_numpy(np.int64))
        table = count_digits(rows, "x", wanted, before, after)

        found = table.groupBy("col").applyInPandas(step(member, probs, asked, after - before), FOUND).toPandas()
        for r in found[found["done"]].itertuples():
            sizes[r.s, r.col], ends[r.s, r.col, r.place] = r.n, r.value
        asked, before = found[~found["done"]], after
        if asked.empty:
            break
    for (s, column), n in sizes.items():
        for i, p in enumerate(probs):
            low, high, spot = ends[s, column, 2 * i], ends[s, column, 2 * i + 1], p * (n - 1)
            # two equal infinities have no difference
            out[s, column, i] = low if low == high else low + (high - low) * (spot - np.floor(spot))
    return out
