import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

from kohort.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("4", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """Sixty subjects, five features, three sites."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) + np.array([0, 1, 2, 3, 4])
    y = 50 + x @ np.array([3.0, -2.0, 0.5, 0.0, 1.0]) + rng.normal(size=60)
    frame = pd.DataFrame(
        {
            "subject_id": [f"s{i:03d}" for i in range(60)],
            "position": np.arange(60),
            "site": np.where(np.arange(60) < 35, 0, np.where(np.arange(60) < 55, 1, 2)),
            "x": list(x),
            "age": y,
        }
    )
    df = spark.createDataFrame(frame, "subject_id string, position long, site int, x array<double>, age double")
    return df.repartition(3), x, y, frame
