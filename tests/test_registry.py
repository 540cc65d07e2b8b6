"""The correctness gate, locally: every registered query against its DuckDB SQL."""

import pytest

from paths import SF001
from riskline.plans.catalog import queries
from riskline.plans.oracle import oracle_sql
from riskline.plans.oracle_check import run


def test_oracle_keys_are_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["doc_id", "risk_score", "risk_band"]
    assert df.count() == 200


def test_all_oracles_match_sf0001(spark):
    names = list(oracle_sql())
    res = run(spark, SF001, names, verbose=False)
    bad = {k: v for k, v in res.items() if not (v.get("hash_match") and v.get("cols_match"))}
    assert not bad, bad
