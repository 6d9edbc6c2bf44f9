"""The registered queries against their SQL where there is some, and their names."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, digest
from tunedata.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = entry.queries()
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.ORACLES[name])
    cols, rows = [d[0] for d in res.description], res.fetchall()
    assert digest(df.columns, df.collect())[0] == digest(cols, rows)[0]
