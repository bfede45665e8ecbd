"""Every registered query against its SQL, on the smallest tables."""

import pytest

from atlasmill.plans import ORACLE_SQL, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, tmp_path):
    df = QUERIES[name](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    if name not in ORACLE_SQL:
        assert spark.read.parquet(str(tmp_path / "out")).count() >= 0
        return
    sql = ORACLE_SQL[name]
    columns = sorted(duck.sql(sql).columns)
    assert sorted(df.columns) == columns
    chosen = ", ".join(f'"{c}"' for c in columns)
    want = sorted(map(repr, duck.sql(f"select {chosen} from ({sql})").fetchall()))
    got = sorted(map(repr, duck.sql(f"select {chosen} from '{tmp_path}/out/*.parquet'").fetchall()))
    assert got == want
