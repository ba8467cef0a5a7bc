"""Runs a registered query and its SQL in DuckDB, and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    names = sorted(table.column_names)
    columns = [table[c].to_pylist() for c in names]

    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6) + 0.0
        return v

    return names, sorted((tuple(plain(v) for v in r) for r in zip(*columns, strict=True)), key=repr)


def assert_same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = rows(query(spark, sf_dir).toArrow()), rows(con.sql(sql).to_arrow_table())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)
