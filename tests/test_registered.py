"""Every registered query of the document engine against its DuckDB equivalent."""

import pytest

import __spark_entry__
from mangrove import queries as registered
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_against_duckdb(name, spark, duck):
    same_rows(registered.queries()[name](spark, SMALL), registered.oracle_sql()[name], duck)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registered.queries()) <= set(__spark_entry__.queries())


def test_sizes_from_one_mebibyte_on(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(i, "x" * n) for i, n in enumerate((0, 1023, 1536, 1 << 20, 3 << 19))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = registered.queries()["format_bytes_all"](spark, str(tmp_path))
    assert {r.doc_id: r.size for r in found.collect()}[4] == "1.5 MB"
    same_rows(found, registered.oracle_sql()["format_bytes_all"], own)
