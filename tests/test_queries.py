"""Every registered query against its SQL text on DuckDB."""

import os

import pytest
import sqlcheck

import __spark_entry__ as entry
from showcase import sqltext
from showcase.bindings import ORDERS
from showcase.oracles import best_of_all

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return sqlcheck.connect(SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_matches_sql(spark, con, name):
    assert sqlcheck.compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"fit_orders"}))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_search_ends_near_the_best_of_all_rules(spark, con):
    """Counts of the mined rules are true, and none of a class's rules would have been much better."""
    best = {r[0]: r[2:] for r in con.execute(best_of_all(ORDERS)).fetchall()}
    found = QUERIES["fit_orders"](spark, SF).collect()
    assert {r["cls"] for r in found} == set(best)
    gain = lambda tp, fp, tn, fn: tp / (tp + fn) - fp / (fp + tn)
    for cls, counts in best.items():
        assert max(gain(*tuple(r)[2:]) for r in found if r["cls"] == cls) >= 0.7 * gain(*counts)
    rows = {tuple(r) for r in found}
    shown = ", ".join(f"('{r['cls']}', {r['masks']})" for r in found)
    rules = f"SELECT row_number() OVER () AS rule_id, * FROM (VALUES {shown}) t(cls, r0, r1)"
    parts = [*sqltext.enc_ctes(ORDERS), sqltext.sig_cte(ORDERS), ("rules", rules), *sqltext.norm_ctes(ORDERS), *sqltext.count_ctes(ORDERS)]
    again = con.execute(sqltext.cte(*parts) + "SELECT cls, r0 || ',' || r1, tp, fp, tn, fn FROM ct").fetchall()
    assert set(again) == rows


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
