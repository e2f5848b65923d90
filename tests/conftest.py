from pathlib import Path

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same_rows(spark):
    """Compares a query with its SQL over the smallest tables: columns by name, rows in any order, numbers to six places."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")

    def plain(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)

    def check(query, sql):
        got = query(spark, folder)
        columns = sorted(got.columns)
        found = con.execute(sql)
        at = [d[0] for d in found.description]
        assert sorted(at) == columns
        want = plain(tuple(r[at.index(c)] for c in columns) for r in found.fetchall())
        assert plain(tuple(r) for r in got.select(*columns).collect()) == want

    return check
