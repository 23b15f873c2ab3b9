"""One linear model per site, for any number of sites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..session import settle
from .linear import ridge
from .moments import Moments, first_row_shift, moment_sums


def per_site_models(df: DataFrame, alpha: float = 1.0, site: str = "site", x: str = "x", y: str = "age") -> DataFrame:
    """(site, intercept, coef): site sums are reduced first, each row of sums is then solved where it lies."""
    shift = first_row_shift(df, x, y)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fits = [ridge(Moments.from_sums(np.asarray(s), *shift), alpha) for s in part["s"]]
            yield pd.DataFrame({site: part[site], "intercept": [b for b, _ in fits], "coef": [w for _, w in fits]})

    kind = df.schema[site].dataType.simpleString()
    return moment_sums(df, [site], x, y, shift).mapInPandas(solve, f"{site} {kind}, intercept double, coef array<double>")


def per_site_ridge(df: DataFrame, alpha: float = 1.0, site: str = "site", x: str = "x", y: str = "age") -> DataFrame:
    """Rows with the prediction of their own site's model, NULL where the site has none."""
    models = settle(per_site_models(df, alpha, site, x, y))
    scored = df.join(models, site, "left").withColumn("prediction", dot(F.col(x), F.col("coef")) + F.col("intercept"))
    return scored.drop("intercept", "coef")
