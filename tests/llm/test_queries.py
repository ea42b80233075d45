"""Every registered operator query runs over its whole tables; those with SQL equal it."""
import duckdb
import pytest

from lagsleuth.llm.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


def norm(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    rows = df.collect()
    if "doc_id" in df.columns:
        ids = [r.doc_id for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id").collect()]
        assert sorted(r.doc_id for r in rows) == sorted(ids)
    if name in SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
        cur = con.execute(SQL[name])
        cols = sorted(df.columns)
        at = [[c[0] for c in cur.description].index(c) for c in cols]
        assert norm(tuple(r[c] for c in cols) for r in rows) == norm(tuple(r[i] for i in at) for r in cur.fetchall())


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
