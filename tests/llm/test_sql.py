"""Registered queries against their SQL, and the registry itself."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from skyraster.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)

    def rows(columns, values):
        return sorted(repr([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in (r[columns.index(c)] for c in names)]) for r in values)

    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_operator_is_registered():
    found = __spark_entry__.queries()
    assert {int(k[2:].split("_")[0]) for k in found if k.startswith("op")} == set(range(1, 14))
    assert found["pipeline"] is corpus_pipeline.run and [f.__name__ for _, f in corpus_pipeline.STAGES] == ["rules", "near_duplicates", "benchmark_passages", "mixture", "token_ids"]
