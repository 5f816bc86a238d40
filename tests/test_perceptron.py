"""The perceptron's fit by passes over matrix blocks, beside Spark ML's own."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from courtlake.plans import catalog, features, perceptron, prediction
from courtlake.session import cut_lineage


def telling_games(spark, n=600):
    draw = np.random.default_rng(3)
    shown = draw.normal(size=(n, len(features.GAME_FEATURES)))
    rows = [(i, 1, 2, *map(float, v), int(100 + 9 * v[1]), 100) for i, v in enumerate(shown)]
    names = [("game_id", "bigint"), ("home_team_id", "bigint"), ("away_team_id", "bigint"), *[(c, "double") for c in features.GAME_FEATURES], ("home_score", "int"), ("away_score", "int")]
    return cut_lineage(spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in names)))


def test_gradient_is_that_of_the_loss():
    sizes, draw = [3, 4, 2], np.random.default_rng(5)
    x, y, w = draw.normal(size=(7, 3)), np.array([0, 1, 1, 0, 1, 0, 1]), draw.normal(size=26)

    def loss(w, into):
        return perceptron.add_block(x, y, perceptron._layers(w, sizes), perceptron._layers(into, sizes))

    gradient, unused = np.zeros(26), np.zeros(26)
    loss(w, gradient)
    slopes = [(loss(w + h, unused) - loss(w - h, unused)) / 2e-6 for h in np.eye(26) * 1e-6]
    assert gradient == pytest.approx(slopes, rel=1e-5, abs=1e-7)


def test_blocks_take_the_steps_of_spark_ml(spark):
    """One block of rows, so that Spark ML's mean over blocks is a mean over rows."""
    draw = np.random.default_rng(4)
    rows = [(Vectors.dense(v), float(v[0] + v[1] * v[2] > 0)) for v in draw.normal(size=(120, 4))]
    df = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    for most in (0, 1, 8):
        fit = MultilayerPerceptronClassifier(layers=[4, 6, 3, 2], maxIter=most, seed=7)
        blocks = perceptron.Blocks(fit, df)
        got, expected = perceptron.fit(fit, df, blocks), fit.fit(df)
        blocks.drop()
        assert got.weights.toArray() == pytest.approx(expected.weights.toArray(), rel=1e-3, abs=1e-3)
        assert got.getLayers() == [4, 6, 3, 2] and got.transform(df).count() == 120


def test_every_row_counts_in_a_pass(spark):
    """Also over several blocks, uneven parts and a part without rows."""
    draw = np.random.default_rng(6)
    shown, won = draw.normal(size=(2500, 4)), draw.integers(0, 2, 2500)
    rows = [(Vectors.dense(v), float(y)) for v, y in zip(shown, won, strict=True)]
    df = spark.createDataFrame(rows, ["features", "label"])
    df = df.coalesce(1).union(df.filter("label > 5"))
    blocks = perceptron.Blocks(MultilayerPerceptronClassifier(layers=[4, 5, 2]), df)
    weights, gradient = draw.normal(size=37), np.zeros(37)
    total = perceptron.add_block(shown, won, perceptron._layers(weights, [4, 5, 2]), perceptron._layers(gradient, [4, 5, 2]))
    loss, found = blocks.mean_loss(weights)
    blocks.drop()
    assert loss == pytest.approx(total / 2500, rel=1e-5) and found == pytest.approx(gradient / 2500, rel=1e-3, abs=1e-5)


def test_large_tables_are_fitted_in_blocks(spark, monkeypatch):
    """Spark ML's passes, several times as dear, see one row; the model is as good, and legs go on from each other."""
    df, seen, fit = telling_games(spark), [], MultilayerPerceptronClassifier._fit
    plain = prediction.game_model_metrics(prediction.fit_game_model(df, max_iter=8, trees=1), df).filter("metric = 'log_loss'").first()
    monkeypatch.setattr(prediction, "BLOCK_FIT_ROWS", 100, raising=False)
    monkeypatch.setattr(prediction, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda self, rows: (seen.append(rows.count()), fit(self, rows))[1])
    model = prediction.fit_game_model(df, max_iter=8, trees=1)
    assert max(seen) == 1
    found = prediction.game_model_metrics(model, df).filter("metric = 'log_loss'").first()
    assert found["n"] == plain["n"] and found["value"] == pytest.approx(plain["value"], rel=0.1) and found["value"] < found["baseline"]
    legs = prediction.fit_best_game_model(df, leg_iterations=5, most_legs=2, trees=1)[1]
    assert legs[1].held_out_loss < legs[0].held_out_loss < found["baseline"] and max(seen) == 1


def test_parts_are_bounded_by_the_cores(spark, monkeypatch):
    """Every part sends a gradient in each pass."""
    monkeypatch.setattr(prediction, "ROWS_PER_TASK", 1)
    stored = prediction.dealt_out(spark.range(1000))
    cores = spark.sparkContext.defaultParallelism
    assert stored.count() == 1000 and cores < len(stored.inputFiles()) <= 8 * cores


def test_a_fit_without_a_step_down_ends():
    nowhere = lambda w: (float("nan"), np.ones(2))
    weights, values = perceptron.minimized(nowhere, np.ones(2), 5, 1e-6)
    assert weights.tolist() == [1, 1] and len(values) == 1
    weights, values = perceptron.minimized(lambda w: (float(w @ w), 2 * w), np.array([3.0, 4.0]), 50, 1e-9)
    assert weights == pytest.approx([0, 0], abs=1e-6) and all(b < a for a, b in zip(values, values[1:], strict=False))


def test_player_rows_are_stored_without_their_key(spark, folder):
    """The split that the key gave is stored in its place, and model and errors are those of the rows with a key."""
    i, key = catalog.Inputs(spark, folder), ["person_id", *catalog.ORDER]
    stored = catalog._player_matrix(i)
    assert not set(key) & set(stored.columns)
    targets = {f"target_{t}": F.coalesce(F.col(t), F.lit(0)).cast("double") for t in features.PLAYER_TARGETS}
    rows = features.player_features(i.player_games.withColumns(targets), catalog.ORDER, leak_free=True, carry=tuple(targets))
    assert stored.filter(prediction.IN_TRAINING).count() == rows.filter(prediction.in_training(*key)).count() < stored.count() == rows.count()
    errors = [prediction.player_model_metrics(prediction.fit_player_model(d, key), d, key).orderBy("target").collect() for d in (stored, cut_lineage(rows))]
    assert [r["n"] for r in errors[0]] == [r["n"] for r in errors[1]]
    assert [r["value"] for r in errors[0]] == pytest.approx([r["value"] for r in errors[1]])
