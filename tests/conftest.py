import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
            "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL and compares rows as multisets by column name."""
    import glob
    import math

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(map(norm, v))
        return round(float(v), 6) if type(v).__name__ == "Decimal" else v

    def run(query, sql):
        df = query(spark, SF)
        r = con.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        mine = sorted((tuple(norm(x[c]) for c in order) for x in df.collect()), key=repr)
        theirs = sorted((tuple(norm(x[names.index(c)]) for c in order) for x in r.fetchall()), key=repr)
        assert mine == theirs

    return run
