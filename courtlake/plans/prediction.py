"""Game and player models as Spark ML pipelines, trained and applied on whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake.functions.boxscore import prediction_confidence
from courtlake.operators.windows import top_per_key
from courtlake.plans import perceptron
from courtlake.plans.features import GAME_FEATURES, PLAYER_FEATURES, PLAYER_TARGETS, game_features
from courtlake.plans.linear import LinearTargets
from courtlake.plans.scaling import ColumnScaler
from courtlake.session import cut_lineage

SEED = 42
TRAIN_PERCENT = 80
PENALTY = 0.01  # of the linear player models
HIDDEN_LAYERS = [128, 64, 32]  # fixed value: widths of the game model
ROWS_PER_TASK = 10_000  # rows of a part in an iterative fit, which passes over them again and again
PARTS_PER_CORE = 8  # parts of such rows at most, as each sends a gradient in every pass
MOST_ROWS_PER_TASK = 1_000_000
BLOCK_FIT_ROWS = 200_000  # from here on matrix blocks save more than the Python tasks of a pass cost


def in_training(*key: str, percent: int = TRAIN_PERCENT) -> Column:
    """A split by md5 of the key: the same rows on every run, for any partitioning and in any engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key], F.lit(str(SEED)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100 < percent


IN_TRAINING = "in_training"


def _split(features: DataFrame, key: list[str]) -> Column:
    """The split as stored with the rows, which then need no key, or made from their key."""
    return F.col(IN_TRAINING) if IN_TRAINING in features.columns else in_training(*key)


def _inputs(columns: list[str]) -> list:
    """Scaled copies of the features, assembled to one vector. The originals stay untouched."""
    return [ColumnScaler(inputCols=columns), VectorAssembler(inputCols=columns, outputCol="features")]


def dealt_out(rows: DataFrame) -> DataFrame:
    """``rows`` stored in even parts, so that every core takes its share of an iterative fit.

    A table of few bytes lies in few files and row groups, and a pass over it would keep as few tasks busy. Up to
    ``ROWS_PER_TASK`` rows stay as they are.
    """
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    parts = max(min(-(-n // ROWS_PER_TASK), PARTS_PER_CORE * cores), -(-n // MOST_ROWS_PER_TASK))
    return cut_lineage(rows.repartition(parts)) if parts > 1 else rows


@contextmanager
def _perceptron_fit(training: DataFrame) -> Iterator[Callable[[MultilayerPerceptronClassifier], MultilayerPerceptronClassificationModel]]:
    """How to fit a perceptron on ``training``: by Spark ML's passes, on large tables by passes over matrix blocks."""
    if training.count() < BLOCK_FIT_ROWS:
        yield lambda winner: winner.fit(training)
        return
    blocks = perceptron.Blocks(_winner(0), training)
    try:
        yield lambda winner: perceptron.fit(winner, training, blocks)
    finally:
        blocks.drop()


def fit_game_model(features: DataFrame, max_iter: int = 60, trees: int = 10) -> PipelineModel:
    """Winner and both scores from 24 team averages.

    ``features`` has the game features, both scores, and a key column ``game_id``. Games
    without a score are left out.
    """
    training = _labelled(features).filter(in_training("game_id"))
    inputs = Pipeline(stages=_inputs(GAME_FEATURES)).fit(training)
    ready = dealt_out(inputs.transform(training).select("home_win", "features", "home_score", "away_score"))
    with _perceptron_fit(ready) as fitted:
        winner = fitted(_winner(max_iter))
    scores = [_score(side, trees).fit(ready) for side in ("home", "away")]
    return PipelineModel(stages=[*inputs.stages, winner, *scores])


def _winner(max_iter: int) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        layers=[len(GAME_FEATURES), *HIDDEN_LAYERS, 2], labelCol="home_win", featuresCol="features",
        predictionCol="_winner", probabilityCol="_chances", rawPredictionCol="_raw", maxIter=max_iter, seed=SEED,
    )


def _score(side: str, trees: int) -> GBTRegressor:
    return GBTRegressor(
        labelCol=f"{side}_score", featuresCol="features", predictionCol=f"predicted_{side}_score",
        maxIter=trees, maxDepth=4, seed=SEED,
    )


def predict_games(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Win chances, scores and confidence for every game."""
    home = vector_to_array("_chances")[1]
    scored = model.transform(features).withColumn("home_win_probability", home)
    return scored.select(
        "game_id", "home_team_id", "away_team_id", "home_win_probability",
        (1 - F.col("home_win_probability")).alias("away_win_probability"),
        "predicted_home_score", "predicted_away_score",
        prediction_confidence(F.col("home_win_probability")).alias("confidence_score"),
    )


def _with_mean(training: DataFrame, held_out: DataFrame, columns: list[str]) -> DataFrame:
    """``held_out`` with the training mean of each column as ``_mean_<column>``: what a model must beat."""
    means = training.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns]).first()
    return held_out.withColumns({f"_mean_{c}": F.lit(means[f"_mean_{c}"]).cast("double") for c in columns})


def _root_mean_square(target: str, guess: str) -> Column:
    return F.sqrt(F.avg((F.col(target) - F.col(guess)) ** 2))


def _metric(rows: DataFrame, model: str, measures: dict[str, tuple[str, Column, Column]]) -> DataFrame:
    """Rows (model, target, metric, value, baseline) from aggregates over ``rows``."""
    aggregates = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[c.alias(f"{kind}_{t}") for t, (_, v, b) in measures.items() for kind, c in (("value", v), ("baseline", b))],
    )
    lines = [
        F.struct(
            F.lit(model).alias("model"), F.lit(t).alias("target"), F.lit(name).alias("metric"), "n",
            F.col(f"value_{t}").alias("value"), F.col(f"baseline_{t}").alias("baseline"),
        )
        for t, (name, _, _) in measures.items()
    ]
    return aggregates.select(F.inline(F.array(*lines)))


def _log_loss(chance: Column) -> Column:
    sure = F.least(F.greatest(chance, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.avg(F.when(F.col("home_win") == 1, -F.log(sure)).otherwise(-F.log(1 - sure)))


def game_model_metrics(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Log loss and root mean square errors on the games held out of training, beside those of the mean."""
    won = F.when(F.col("home_score") > F.col("away_score"), 1.0).otherwise(0.0)
    played = features.dropna(subset=["home_score", "away_score"]).withColumn("home_win", won)
    train, held = played.filter(in_training("game_id")), played.filter(~in_training("game_id"))
    names = ["home_win", "home_score", "away_score"]
    scored = model.transform(_with_mean(train, held, names))
    scores = {
        f"{side}_score": ("rmse", _root_mean_square(f"{side}_score", f"predicted_{side}_score"), _root_mean_square(f"{side}_score", f"_mean_{side}_score"))
        for side in ("home", "away")
    }
    chances = vector_to_array("_chances")[1]
    return _metric(scored, "game", {"home_win": ("log_loss", _log_loss(chances), _log_loss(F.col("_mean_home_win")))} | scores)


def player_model_metrics(model: PipelineModel, features: DataFrame, key: list[str]) -> DataFrame:
    """Root mean square error of each statistic on the rows held out of training, beside that of the mean."""
    names = [f"target_{t}" for t in PLAYER_TARGETS]
    split = _split(features, key)
    train, held = features.filter(split), features.filter(~split)
    scored = model.transform(_with_mean(train, held, names))
    measures = {t: ("rmse", _root_mean_square(f"target_{t}", f"_{t}"), _root_mean_square(f"target_{t}", f"_mean_target_{t}")) for t in PLAYER_TARGETS}
    return _metric(scored, "player", measures)


@dataclass(frozen=True)
class Leg:
    """One leg of a fit: iterations so far, held-out log loss, and whether it is the best so far."""

    leg: int
    iterations: int
    held_out_loss: float
    best: bool


def _labelled(features: DataFrame) -> DataFrame:
    played = features.dropna(subset=["home_score", "away_score"])
    return played.withColumn("home_win", F.when(F.col("home_score") > F.col("away_score"), 1.0).otherwise(0.0))


def fit_best_game_model(
    features: DataFrame, leg_iterations: int = 20, most_legs: int = 10, patience: int = 1, trees: int = 10
) -> tuple[PipelineModel, list[Leg]]:
    """The game model, its perceptron trained in legs until the loss on held-out games no longer falls.

    Every leg goes on from the weights of the one before. After ``patience`` legs in a row without a lower
    log loss the fit ends, and the weights of the best leg stay. The inputs are scaled and stored once.
    """
    played = _labelled(features)
    inputs = Pipeline(stages=_inputs(GAME_FEATURES)).fit(played.filter(in_training("game_id")))
    ready = cut_lineage(inputs.transform(played).select("game_id", "home_win", "features", "home_score", "away_score"))
    training, held = dealt_out(ready.filter(in_training("game_id"))), dealt_out(ready.filter(~in_training("game_id")))
    weights, best, worse, legs = None, None, 0, []
    with _perceptron_fit(training) as fitted:
        while len(legs) < most_legs and worse < patience:
            fit = _winner(leg_iterations)
            if weights is not None:
                fit.setInitialWeights(weights)
            model = fitted(fit)
            weights = model.weights
            loss = model.transform(held).agg(_log_loss(vector_to_array("_chances")[1])).first()[0]
            loss = float("inf") if loss is None else loss
            better = best is None or loss < best[0]
            worse = 0 if better else worse + 1
            best = (loss, model) if better else best
            legs.append(Leg(len(legs) + 1, leg_iterations * (len(legs) + 1), loss, better))
    scores = [_score(side, trees).fit(training) for side in ("home", "away")]
    return PipelineModel(stages=[*inputs.stages, best[1], *scores]), legs


def predict_matchups(model: PipelineModel, matchups: DataFrame, team_games: DataFrame) -> DataFrame:
    """Predictions for games to come, given ``game_id`` and both team ids."""
    return predict_games(model, game_features(matchups, team_games, carry=("home_team_id", "away_team_id")))


def linear(target: str, output: str) -> Estimator:
    """One pass for this target alone; ``LinearTargets`` fits all in one."""
    return LinearRegression(labelCol=target, featuresCol="features", predictionCol=output, solver="normal", regParam=PENALTY)


def boosted(target: str, output: str) -> Estimator:
    """Shallow boosted trees, where a linear fit is not enough."""
    return GBTRegressor(labelCol=target, featuresCol="features", predictionCol=output, maxIter=10, maxDepth=3, seed=SEED)


def fit_player_model(
    features: DataFrame, key: list[str], regressor: Callable[[str, str], Estimator] | None = None
) -> PipelineModel:
    """Linear regressions of all predicted statistics on 33 features, from one pass over the rows.

    ``features`` carries the targets under the name ``target_<statistic>``, and the key or the split of each row. With ``regressor`` (``linear``,
    ``boosted``) each statistic is fitted by itself, on a shared vector.
    """
    training = features.filter(_split(features, key))
    if regressor is None:
        targets, outputs = [f"target_{t}" for t in PLAYER_TARGETS], [f"_{t}" for t in PLAYER_TARGETS]
        together = LinearTargets(inputCols=PLAYER_FEATURES, targetCols=targets, outputCols=outputs, regParam=PENALTY)
        return Pipeline(stages=[ColumnScaler(inputCols=PLAYER_FEATURES), together]).fit(training)
    outputs = [regressor(f"target_{t}", f"_{t}") for t in PLAYER_TARGETS]
    return Pipeline(stages=[*_inputs(PLAYER_FEATURES), *outputs]).fit(training)


def project_players(
    model: PipelineModel, features: DataFrame, form: DataFrame, order: list[str], opponents: DataFrame | None = None
) -> DataFrame:
    """Next-game projection per player, from features up to and including the latest game.

    ``form`` supplies the confidence and leaves out players with too few games. Negative
    predictions become 0. ``opponents`` names the next opponent by ``person_id`` and
    ``opp_def_rating``, one row per player; without it the latest opponent is assumed.
    """
    newest = [F.col(c).desc() for c in order]
    latest = top_per_key(features, ["person_id"], newest, 1)
    if opponents is not None:
        latest = latest.drop("opp_def_rating").join(opponents.select("person_id", "opp_def_rating"), "person_id")
    predicted = model.transform(latest)
    projections = F.map_from_arrays(
        F.array(*[F.lit(t) for t in PLAYER_TARGETS]),
        F.array(*[F.greatest(F.lit(0.0), F.col(f"_{t}")) for t in PLAYER_TARGETS]),
    )
    scored = predicted.select("person_id", projections.alias("projections"))
    return scored.join(form.select("person_id", "confidence_score"), "person_id")


def save(model: PipelineModel, path: str) -> None:
    """Model, scaler and column lists in one folder."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
