"""Every query of the library against the same question in SQL, on the smallest driver tables."""

import duckdb
import pytest

from geovelo.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _rows(table, columns):
    value = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(value(v) for v in r) for r in table[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert _rows(got, columns) == _rows(want, columns)


def test_shallow_boreholes_have_no_vs30(spark, tmp_path):
    db = duckdb.connect()
    short = "SELECT * FROM '{0}/lineitem.parquet' QUALIFY l_partkey % 3 > 0 OR row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) <= 6"
    for t, sql in (("lineitem", short), ("part", "FROM '{0}/part.parquet'")):
        db.execute(f"COPY ({sql.format(SF)}) TO '{tmp_path}/{t}.parquet'")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = QUERIES["borehole_pipeline"](spark, str(tmp_path)).toPandas(), db.execute(ORACLE_SQL["borehole_pipeline"]).df()
    assert want["vs30"].isna().any() and want["vs30"].notna().any()
    assert _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))
