import os
import sys

import numpy as np
import pandas as pd
import pytest
from panels import long
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def wide_returns():
    """Two common factors, a drift and own noise per name."""
    rng = np.random.default_rng(7)
    days, names = 230, [f"N{i:02d}" for i in range(18)]
    factors = rng.standard_t(5, (days, 2)) * [0.008, 0.004]
    loads = np.column_stack([np.linspace(0.4, 1.6, len(names)), np.tile([-1.0, 0.0, 1.0], len(names) // 3)])
    own = rng.normal(0, np.linspace(0.006, 0.02, len(names)), (days, len(names)))
    return pd.DataFrame(0.0003 + factors @ loads.T + own, index=pd.bdate_range("2021-06-01", periods=days), columns=names)


@pytest.fixture(scope="session")
def returns(spark, wide_returns):
    return spark.createDataFrame(long(wide_returns), "date date, ticker string, r double").cache()
