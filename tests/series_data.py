"""Irregular series for the window tests."""

import numpy as np
import pandas as pd

SCHEMA = "city string, ingestion_timestamp timestamp, aqi double, pm25 double, wind_speed double"


def series(seed: int = 7, sizes=(900, 150, 60, 5, 1)) -> pd.DataFrame:
    """Stations of very different length, with gaps of 1 to 30 hours and missing values."""
    rng = np.random.default_rng(seed)
    frames = []
    for i, n in enumerate(sizes):
        hours = np.cumsum(rng.choice([1, 1, 1, 2, 6, 30], n))
        frames.append(pd.DataFrame({
            "city": f"s{i}", "ingestion_timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, "h"),
            "aqi": np.where(rng.random(n) < 0.1, np.nan, rng.normal(80, 20, n)),
            "pm25": np.where(rng.random(n) < 0.6, np.nan, rng.normal(20, 5, n)),
            "wind_speed": rng.normal(4, 1, n)}))
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, frame: pd.DataFrame, schema: str = SCHEMA):
    rows = [[None if v != v else v for v in r] for r in frame.astype(object).itertuples(index=False)]
    rows = [[v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r] for r in rows]
    return spark.createDataFrame(rows, schema)


def to_pandas(df, order=("city", "ingestion_timestamp")) -> pd.DataFrame:
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)
