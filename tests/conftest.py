import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in sorted(os.listdir(SMALL)):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return con


@pytest.fixture(scope="session")
def agrees(spark, duck):
    """Compares a query with its SQL on the smallest tables."""
    import numpy as np
    import pandas as pd

    def plain(frame, columns):
        value = lambda x: x if isinstance(x, (list, np.ndarray)) else None if pd.isna(x) else x.item() if hasattr(x, "item") else x
        return sorted(repr(tuple(map(value, row))) for row in frame[columns].astype(object).itertuples(index=False))

    def check(query, sql):
        ours, theirs = query(spark, SMALL).toPandas(), duck.sql(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        assert plain(ours, columns) == plain(theirs, columns)

    return check
