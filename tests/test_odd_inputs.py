"""Plans on nulls and on large groups, held against their own SQL."""

import duckdb

from millrace import registry


def both(spark, folder, name, tables):
    """(Spark's rows, the SQL's rows) of a query over tables {name: (rows, schema)}, in order."""
    queries, sql = registry.load()
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"create view {table} as select * from '{path}/*.parquet'")
    order = lambda found: sorted(map(tuple, found), key=str)
    return order(queries[name](spark, str(folder)).collect()), order(con.execute(sql[name]).fetchall())


def test_array_merge_ci_with_nulls(spark, tmp_path):
    lines = [(1, 5, 1, "R", "F"), (None, 5, 2, "A", "O"), (1, 5, None, "N", "f"), (2, 6, 2, None, None), (3, 7, 3, None, "F"), (3, 7, 2, "r", "r "), (3, 7, 1, "R", "F"), (4, None, 2, "R", "F")]
    lines += [(None, 8, 3, "Q", "x"), (9, 8, 1, "q", "x"), (9, 8, None, "q", "Z"), (9, 8, 2, "q", "z")]
    got, want = both(spark, tmp_path, "array_merge_ci", {"lineitem": (lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string, l_linestatus string")})
    assert got == want
