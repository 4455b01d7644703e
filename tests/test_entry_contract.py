import __spark_entry__ as E
from locusforge.plans import catalog


def test_every_query_has_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = catalog.queries()
    assert set(own) == set(catalog.oracle_sql()) and set(own) <= set(q)
    assert len(own) >= 108


def test_sql_is_duckdb_parsable():
    import duckdb
    con = duckdb.connect()
    for t in ["part", "lineitem", "orders", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in E.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")
