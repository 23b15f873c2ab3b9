"""Scalar expressions on cohort tables; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAE_GATE = 7.0
LARGEST_DOUBLE = 1.7976931348623157e308
LARGEST_FLOAT = 3.4028234663852886e38


def strip_key_suffix(key: Column, suffix: str = "_raw/") -> Column:
    return F.replace(key, F.lit(suffix), F.lit(""))


def id_from_path(path: Column) -> Column:
    """File stem up to its first underscore."""
    name = F.regexp_extract(path, "([^/]+)$", 1)
    return F.regexp_extract(name, r"^([^_]+?)(_.*|\.[^.]*)?$", 1)


def strip_characters(text: Column, characters: str) -> Column:
    """Remove any of ``characters`` from both ends, as Python's ``str.strip`` does."""
    return F.btrim(text, F.lit(characters))


def clip_to_range(value: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high]; NULL when the range or the value is missing."""
    clipped = F.least(F.greatest(value, low), high)
    return F.when(value.isNotNull() & low.isNotNull() & high.isNotNull(), clipped)


def abs_error(truth: Column, prediction: Column) -> Column:
    return F.abs(truth - prediction)


def weight_from_mae(mae: Column, gate: float | None = MAE_GATE) -> Column:
    """(7 - mae)^2; NULL at or above ``gate``. ``gate=None`` keeps every model."""
    weight = (F.lit(MAE_GATE) - mae) * (F.lit(MAE_GATE) - mae)
    return weight if gate is None else F.when(mae < gate, weight)


def round_half_even(value: Column) -> Column:
    return F.rint(value).cast("int")


def int_label(age: Column) -> Column:
    """Age as an integer class, truncated toward zero."""
    return age.cast("int")


def as_float32(values: Column) -> Column:
    """Round every element to single precision, then widen again."""
    return F.transform(F.transform(values, lambda v: v.cast("float")), lambda v: v.cast("double"))


def fill_nonfinite(values: Column, largest: float = LARGEST_DOUBLE) -> Column:
    """NaN and NULL become 0, infinities the ``largest`` finite value of their sign."""
    return F.transform(
        values,
        lambda v: F.when(v.isNull() | F.isnan(v), F.lit(0.0))
        .when(v == F.lit(float("inf")), F.lit(largest))
        .when(v == F.lit(float("-inf")), F.lit(-largest))
        .otherwise(v),
    )


def select_positions(values: Column, positions: list[int]) -> Column:
    """Masked positions of an array, in order; the position list travels once with the plan."""
    return F.transform(F.lit(positions), lambda p: values[p])


def onehot(value: Column, levels: list[int], weight: float = 10000.0) -> Column:
    return F.transform(F.lit(levels), lambda s: F.when(s == value, F.lit(weight)).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def report_line(subject: Column, **numbers: Column) -> Column:
    """Fixed-width report text: upper-case id, then ``name value`` pairs at width 7, 3 decimals."""
    parts = [F.rpad(F.upper(subject), 12, " ")]
    parts += [F.format_string(f"{name} %7.3f", F.floor(value * 1000 + 0.5) / 1000) for name, value in numbers.items()]
    return F.concat_ws(" ", *parts)
