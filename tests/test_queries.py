"""Registered queries against their SQL on rows that the given tables lack."""

import duckdb
import pytest

import __spark_entry__


def both(spark, path, name):
    """A query's rows and those of its SQL, sorted."""
    df = __spark_entry__.queries()[name](spark, str(path))
    con = duckdb.connect()
    for table in path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}/*.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    return sorted(map(tuple, df.select(*columns).collect()), key=str), sorted(found.fetchall(), key=str)


@pytest.mark.parametrize("name", ["keyword_select", "expand_queries"])
def test_keywords_as_sql_lowers_queries(spark, tmp_path, name):
    rows = [(1, 0, "user", "Große Füße"), (1, 1, "assistant", "gross GROSS rest"), (2, 0, "user", None), (2, 1, "assistant", "rest word"), (2, 2, "user", "a word")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = both(spark, tmp_path, name)
    assert got == want and len(want) > 1
