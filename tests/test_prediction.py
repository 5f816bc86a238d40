"""Scaling stage and models: bounds, determinism, save and load."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.operators.windows import top_per_key
from courtlake.plans import features, prediction, refresh
from courtlake.plans.linear import LinearTargets, LinearTargetsModel
from courtlake.plans.scaling import ColumnScaler, ColumnScalerModel
from courtlake.session import cut_lineage
from courtlake.sources import driver_tables as tables
from courtlake.sources.tables import Tables

ORDER = tables.PLAYER_GAME_ORDER


def test_scaler_uses_population_deviation(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "x double, y double")
    model = ColumnScaler(inputCols=["x", "y"]).fit(df)
    got = model.transform(df).toPandas()
    x = np.array([1.0, 2.0, 6.0])
    assert sorted(got["x"]) == pytest.approx(sorted((x - x.mean()) / x.std()))
    assert set(got["y"]) == {0.0}
    model.write().overwrite().save(str(tmp_path / "m"))
    again = ColumnScalerModel.load(str(tmp_path / "m")).transform(df).toPandas()
    assert again.equals(got)


def test_split_is_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    marked = lambda d: {r["k"] for r in d.filter(prediction.in_training("k")).collect()}
    first = marked(df)
    assert first == marked(df.repartition(7)) and 0.77 < len(first) / 5000 < 0.83


@pytest.fixture(scope="module")
def game_matrix(spark, folder):
    games = tables.games(spark, folder).select(
        "game_id", "game_date", "home_team_id", "away_team_id", "home_score", "away_score"
    )
    return cut_lineage(features.prior_game_features(games, tables.team_games(spark, folder)))


def test_game_model(spark, folder, game_matrix, tmp_path):
    model = prediction.fit_game_model(game_matrix, max_iter=5, trees=2)
    got = prediction.predict_games(model, game_matrix)
    assert got.count() == game_matrix.count()
    bad = got.filter(
        "home_win_probability not between 0 and 1 or confidence_score not between 0 and 1 "
        "or abs(home_win_probability + away_win_probability - 1) > 1e-9 or predicted_home_score is null"
    )
    assert bad.isEmpty()
    matchups = spark.createDataFrame([(1, 3, 4), (2, 4, 3)], "game_id long, home_team_id long, away_team_id long")
    ahead = prediction.predict_matchups(model, matchups, tables.team_games(spark, folder)).collect()
    assert {(r["game_id"], r["home_team_id"], r["away_team_id"]) for r in ahead} == {(1, 3, 4), (2, 4, 3)}
    prediction.save(model, str(tmp_path / "game"))
    loaded = prediction.predict_games(prediction.load(str(tmp_path / "game")), game_matrix)
    assert loaded.exceptAll(got).isEmpty()


def test_player_model(spark, folder):
    rows = tables.player_games(spark, folder)
    targets = {f"target_{t}": F.coalesce(F.col(t), F.lit(0)).cast("double") for t in features.PLAYER_TARGETS}
    past = cut_lineage(features.player_features(rows.withColumns(targets), ORDER, leak_free=True, carry=tuple(targets)))
    model = prediction.fit_player_model(past, ["person_id", *ORDER])
    form = features.player_form(rows, ORDER)
    got = prediction.project_players(model, features.player_features(rows, ORDER), form, ORDER).collect()
    assert len(got) == rows.select("person_id").distinct().count()
    for row in got:
        assert set(row["projections"]) == set(features.PLAYER_TARGETS)
        assert min(row["projections"].values()) >= 0 and 0 <= row["confidence_score"] <= 1
    strength = features.opponent_strength(rows).filter("opponent_team_id = 3").select("opp_def_rating")
    chosen = strength.withColumn("person_id", F.lit(1).cast("bigint"))
    current = features.player_features(rows, ORDER)
    against = prediction.project_players(model, current, form, ORDER, opponents=chosen).collect()
    assert [r["person_id"] for r in against] == [1]


@pytest.mark.parametrize("penalty", [0.0, 0.01, 2.0])
def test_one_matrix_gives_the_coefficients_of_single_fits(spark, penalty, tmp_path):
    x, y = [f"x{n}" for n in range(5)], ["a", "b", "c"]
    draw = np.random.default_rng(1)
    values = draw.normal(size=(400, 4)) * [1, 10, 0.1, 3] + [0, 5, -2, 100]
    rows = [(*map(float, v), 7.0, float(v @ [1, 2, 3, 4] + e), float(v[0] * v[1]), 3.0) for v, e in zip(values, draw.normal(size=400), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in x + y)).repartition(5)
    model = LinearTargets(inputCols=x, targetCols=y, outputCols=["pa", "pb", "pc"], regParam=penalty).fit(df)
    # the last feature never varies: the single fits would leave the exact solver for an iterative one
    assembled = VectorAssembler(inputCols=x[:4], outputCol="v").transform(df)
    for n, target in enumerate(y[:2]):
        single = LinearRegression(labelCol=target, featuresCol="v", solver="normal", regParam=penalty).fit(assembled)
        assert model.matrix()[n][:4] == pytest.approx(single.coefficients.toArray(), rel=1e-8, abs=1e-9) and model.matrix()[n][4] == 0
        assert model.getOrDefault("intercepts")[n] == pytest.approx(single.intercept, rel=1e-6, abs=1e-5)
    assert model.matrix()[2].tolist() == [0.0] * 5 and model.getOrDefault("intercepts")[2] == pytest.approx(3.0)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = LinearTargetsModel.load(str(tmp_path / "m")).transform(df).toPandas()
    np.testing.assert_allclose(again["pa"], again[x].to_numpy() @ model.matrix()[0] + model.getOrDefault("intercepts")[0], rtol=1e-9)
    with pytest.raises(ValueError, match="no rows"):
        LinearTargets(inputCols=x, targetCols=y, outputCols=["pa", "pb", "pc"]).fit(df.limit(0))


def test_the_game_model_s_fit_stops(spark):
    draw = np.random.default_rng(2)
    shown = draw.normal(size=(300, len(features.GAME_FEATURES)))
    rows = [(n, 1, 2, *map(float, v), int(100 + 9 * v[1]), 100) for n, v in enumerate(shown)]
    names = [("game_id", "bigint"), ("home_team_id", "bigint"), ("away_team_id", "bigint"), *[(c, "double") for c in features.GAME_FEATURES], ("home_score", "int"), ("away_score", "int")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in names))
    model, legs = prediction.fit_best_game_model(df, leg_iterations=5, most_legs=6, trees=1)
    losses = [leg.held_out_loss for leg in legs]
    assert [leg.iterations for leg in legs] == [5 * (n + 1) for n in range(len(legs))] and 1 < len(legs) <= 6
    assert legs[0].best and losses[1] < losses[0]  # the second leg goes on from the first
    assert all(b < a for a, b in zip(losses, losses[1:-1], strict=False)) and (len(legs) == 6 or losses[-1] >= losses[-2])
    measured = prediction.game_model_metrics(model, df).filter("metric = 'log_loss'").first()
    assert measured["value"] == pytest.approx(min(losses)) and measured["value"] < measured["baseline"]


def test_a_fit_s_passes_are_spread_over_tasks(spark, game_matrix, monkeypatch):
    """One file of many rows would be one task in every pass of the fit."""
    seen, fit = [], MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda self, df: (seen.append((df.rdd.getNumPartitions(), df.count())), fit(self, df))[1])
    monkeypatch.setattr(prediction, "ROWS_PER_TASK", 20, raising=False)
    one = cut_lineage(game_matrix.coalesce(1))
    training = one.dropna(subset=["home_score", "away_score"]).filter(prediction.in_training("game_id")).count()
    model = prediction.fit_game_model(one, max_iter=1, trees=1)
    prediction.fit_best_game_model(one, leg_iterations=1, most_legs=1, trees=1)
    assert training > 40 and [n for _, n in seen] == [training] * 2 and min(parts for parts, _ in seen) > 1
    assert prediction.predict_games(model, one).count() == one.count()


def test_train_saves_both_models(spark, folder, tmp_path):
    lake = Tables(spark, str(tmp_path / "lake"))
    for name, df in {"games": tables.games(spark, folder), "team_statistics": tables.team_games(spark, folder), "player_statistics": tables.player_games(spark, folder)}.items():
        rows = schemas.conform(df, schemas.SOURCE_TABLES[name]).filter("game_id % 3 = 0")
        lake.replace(rows.withColumn(schemas.SEASON, F.year("game_date")), "public", name, [schemas.SEASON])
    lake.replace(tables.players(spark, folder), "public", "players")
    legs = refresh.train(lake, dt.date(1999, 1, 1), str(tmp_path / "models"), leg_iterations=2, most_legs=2, trees=1)
    assert 1 <= len(legs) <= 2
    games = features.prior_game_features(lake.read("public", "games"), lake.read("public", "team_statistics"))
    assert prediction.predict_games(prediction.load(str(tmp_path / "models/game")), games).filter("home_win_probability is null").isEmpty()
    stage = prediction.load(str(tmp_path / "models/player")).stages[-1]
    assert isinstance(stage, LinearTargetsModel) and stage.matrix().shape == (len(features.PLAYER_TARGETS), len(features.PLAYER_FEATURES))


def test_boosted_regressor_is_available():
    assert prediction.boosted("target_points", "_points").getMaxDepth() == 3


def test_latest_row_per_player(spark, folder):
    rows = tables.player_games(spark, folder)
    latest = top_per_key(rows, ["person_id"], [F.col(c).desc() for c in ORDER], 1)
    assert latest.count() == rows.select("person_id").distinct().count()
