import math

import numpy as np
import pytest

from kohort.operators import digits, stats

AWKWARD = [0.0, -0.0, 5e-324, -5e-324, 1.0, np.nextafter(1.0, 2), -1e308, 1e308, math.inf, -math.inf]


def frame(spark, x, groups):
    rows = [(int(g), [None if v is None else float(v) for v in r]) for g, r in zip(groups, x, strict=True)]
    return spark.createDataFrame(rows, "g int, x array<double>")


def test_keys_keep_the_order_of_doubles():
    x = np.sort(np.array(AWKWARD))
    keys = digits.ordered(x)
    assert (np.diff(keys) >= 0).all() and (np.diff(keys) == 0).sum() == 1
    assert (digits.doubles(keys) == x).all()


@pytest.mark.parametrize("table", [16, 1 << 20])
def test_quantiles_of_training_sets(spark, monkeypatch, table):
    monkeypatch.setattr(digits, "TABLE", table)
    rng = np.random.default_rng(0)
    n = 900
    x = np.stack(
        [
            rng.normal(size=n),
            np.where(rng.random(n) < 0.6, 7.25, rng.lognormal(0, 20, n)),  # a value of most rows
            rng.choice([v for v in AWKWARD if math.isfinite(v)], n),
            1.0 + rng.integers(0, 40, n) * 2.0**-52,  # told apart by the last bits only
            np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n)),
            np.full(n, np.nan),
        ],
        axis=1,
    )
    groups = rng.integers(0, 4, n)
    sets = [[g for g in range(4) if g != f] for f in range(4)] + [[0, 1, 2, 3], [2]]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = digits.column_quantiles(frame(spark, x, groups).repartition(5), probs, "x", "g", sets)
    for s, own in enumerate(sets):
        rows = x[np.isin(groups, own)]
        for c in range(5):
            want = np.quantile(rows[~np.isnan(rows[:, c]), c], probs)
            assert np.allclose(found[s, c], want, rtol=1e-12, atol=0), (s, c)
        assert np.isnan(found[s, 5]).all()


def test_missing_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, None]), (0, None), (1, [3.0, math.inf]), (None, [9.0, 9.0])], "g int, x array<double>")
    assert digits.column_quantiles(df.where("g IS NOT NULL"), [0.5])[0].tolist() == [[2.0], [math.inf]]
    one = digits.column_quantiles(df, [0.5], "x", "g", [[0], [1], [5]])
    assert one[0, 0, 0] == 1.0 and one[1, 0, 0] == 3.0 and np.isnan(one[2]).all() and np.isnan(one[0, 1, 0])
    assert digits.column_quantiles(df.limit(0), [0.5]).shape == (1, 0, 1)
    with pytest.raises(Exception, match="different lengths"):
        digits.column_quantiles(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>").coalesce(1), [0.5])


def test_describe_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, None), (math.nan, None), (4.0, None), (None, None)], "a double, `b.c` double")
    (row,) = stats.describe_all(df, ["a", "b.c"]).collect()
    assert row.asDict() == {"column": "a", "count": 2, "mean": 2.5, "sd": pytest.approx(4.5**0.5), "min": 1.0, "max": 4.0, "q25": 1.75, "q50": 2.5, "q75": 3.25}
    assert stats.describe_all(df.limit(0), ["a"]).collect() == []


def test_rows_are_not_exploded(spark):
    df = frame(spark, [[1.0, 2.0]] * 3, [0, 1, 2])
    plan = digits.count_digits(df, "x", None, 0, 12)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan
