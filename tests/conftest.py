from __future__ import annotations

import json
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    out = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    out.sparkContext.setLogLevel("OFF")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def duck():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return out


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a VARIANT collection from dicts (type defaults to ``task``)."""
    from mangrove.operators.collections import Collection

    def make(docs, name="task", **how):
        rows = [(d.get("type", name), d["id"], json.dumps(d)) for d in docs]
        df = spark.createDataFrame(rows, "type string, id string, j string").select("type", "id", F.parse_json("j").alias("doc"))
        return Collection(name, df, **how)

    return make


def _cell(x):
    return repr(round(x, 8)) if isinstance(x, float) else repr(x)


def same_rows(df, sql, duck):
    """Compares a DataFrame and a DuckDB query as bags of rows with columns by name."""
    rows, found = df.collect(), duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    places = [found.columns.index(c) for c in columns]
    got = sorted(tuple(_cell(r[c]) for c in columns) for r in rows)
    want = sorted(tuple(_cell(r[i]) for i in places) for r in found.fetchall())
    assert got == want
