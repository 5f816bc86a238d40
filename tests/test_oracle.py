"""Every registered query against its independent statement, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from courtlake.plans import catalog
from oracle import statements
from tests.compare import differences, oracle_connection

ORACLE = statements()
ROWS_ONLY = {"predict_game", "predict_player", "predict_matchups", "model_metrics", "game_training_legs"}


@pytest.fixture(scope="module")
def con(folder):
    return oracle_connection(folder)


def test_each_query_has_a_statement():
    assert set(catalog.registered()) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(catalog.registered())
    assert set(catalog.registered()) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_statement(spark, folder, con, name):
    got = entry.queries()[name](spark, folder).toPandas()
    assert differences(got, con.execute(ORACLE[name]).df()) is None


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
