"""Every query with SQL gives the rows of that SQL; the others run and give rows."""

import os

import duckdb
import pytest

from ambulo.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cells(frame, columns):
    def show(v):
        if hasattr(v, "year"):
            return str(v)[:10]
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v) + 0.0:.5f}".replace("-0.00000", "0.00000")
        return str(v)

    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return sorted(tuple("" if v is None else show(v) for v in row) for row in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_rows_equal_the_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = cells(got, columns), cells(want, columns)
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    # Decimal digits may round apart where a value lies at the middle.
    for x, y in off:
        assert all(p == q or abs(float(p) - float(q)) <= 2e-5 for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"nested_cv", "nested_cv_line"}))
def test_kernel_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_module_lists_the_catalog():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert os.path.exists(e.__file__)
