import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from tapeline.session import build_session

    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def walk():
    """Seeded bars: symbol A is three times as long as B and C together."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    frames = []
    for symbol, n in (("A", 900), ("B", 200), ("C", 60)):
        close = 100 + np.cumsum(rng.integers(-3, 4, n)).astype(float)
        open_ = np.concatenate([[100.0], close[:-1]])
        high = np.maximum(open_, close) + rng.integers(0, 3, n)
        low = np.minimum(open_, close) - rng.integers(0, 3, n)
        gaps = np.cumsum(rng.integers(1, 3, n)) * 300
        frames.append(pd.DataFrame({
            "symbol": symbol, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(gaps, unit="s"), "bar_idx": np.arange(n), "n_bars": n,
            "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1, 50, n).astype(float),
        }))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def walk_df(spark, walk):
    return spark.createDataFrame(walk).cache()
