import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canon(frame):
    """Rows as sorted lists of strings, columns by name."""
    import pandas as pd

    def text(x):
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return str([text(y) for y in x])
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return ""
        if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f":
            return f"{float(x):.9g}"
        if isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind == "b":
            return str(bool(x))
        return str(int(x)) if hasattr(x, "dtype") and x.dtype.kind in "iu" else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(["|".join(map(text, row)) for row in frame.itertuples(index=False)])
