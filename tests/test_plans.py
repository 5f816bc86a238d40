"""The shape of physical plans: what is shuffled, pushed down and kept off Python."""

import re

import pytest

import __spark_entry__ as entry
from courtlake.plans import features, impact, marts, staging
from courtlake.sources import driver_tables as tables
from courtlake.sources.tables import Tables

MODELS = {"predict_game", "predict_player"}


@pytest.fixture(autouse=True)
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lake(spark, folder, tmp_path):
    """The box scores as their own Parquet table, as in use."""
    store = Tables(spark, str(tmp_path))
    store.replace(tables.player_games(spark, folder), "public", "player_statistics")
    return store.read("public", "player_statistics")


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - MODELS))
def test_no_cross_join_and_no_python(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def test_rolling_features_need_one_shuffle(spark, folder, tmp_path):
    box = lake(spark, folder, tmp_path)
    build = features.player_rolling(box, tables.PLAYER_GAME_ORDER)
    assert len(re.findall(r"Exchange hashpartitioning", plan(build))) == 1
    assert len(re.findall(r"\bSort \[", plan(build))) == 1


def test_all_player_windows_need_one_shuffle(spark, folder, tmp_path):
    box = lake(spark, folder, tmp_path)
    text = plan(features.player_features(box, tables.PLAYER_GAME_ORDER))
    reduced = r"Exchange hashpartitioning[^\n]*\n[^\n]*HashAggregate"  # the small averages per opponent and player
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 + len(re.findall(reduced, text))
    assert len(re.findall(r"Window \[", text)) == 1
    assert len(re.findall(r"\bSort \[", text)) == 1


def test_season_stats_reduce_before_the_joins(spark, folder, tmp_path):
    box = staging.stg_player_games(lake(spark, folder, tmp_path))
    stats = marts.player_season_stats(
        box, staging.stg_players(tables.players(spark, folder)), staging.stg_teams(tables.teams(spark, folder))
    )
    text = plan(stats)
    assert text.index("BroadcastHashJoin") < text.index("HashAggregate")  # plans print the root first
    assert "birthdate" not in text and "plus_minus_points" in text


def test_rating_reads_only_its_columns(spark, folder, tmp_path):
    box = staging.stg_player_games(lake(spark, folder, tmp_path))
    text = plan(impact.season_efficiency(box))
    read = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert "three_pointers" not in read and "blocks" in read
    assert "PushedFilters: [IsNotNull(num_minutes), GreaterThan(num_minutes,0.0)]" in text


def test_no_window_by_season_alone(spark, folder):
    assert "Window" not in plan(entry.queries()["player_impact_rating"](spark, folder))


def test_date_filter_reaches_the_scan(spark, folder):
    text = plan(entry.queries()["games_on_date"](spark, folder))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", text)


@pytest.mark.parametrize("name", ["league_leaders", "impact_leaders", "search_page", "player_log_page", "teams_page"])
def test_pages_do_not_sort_everything(spark, folder, name):
    assert "TakeOrderedAndProject" in plan(entry.queries()[name](spark, folder))


@pytest.mark.parametrize("name", ["team_form", "player_form", "latest_per_key"])
def test_top_rows_are_limited_before_the_shuffle(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder))
    assert re.search(r"WindowGroupLimit .*Final(.|\n)*Exchange(.|\n)*WindowGroupLimit .*Partial", text)
