"""Column expressions on hand-computed cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from courtlake.functions import boxscore, calendar, casting, numbers, strings


def value(spark, column, **row):
    kinds = {bool: "boolean", int: "int", float: "double", str: "string", dt.datetime: "timestamp_ntz"}
    cells = []
    for name, v in row.items():
        kind = "int" if v is None else kinds[type(v)]
        cells.append((F.lit(v) if v is None else F.lit(v)).cast(kind).alias(name))
    return spark.range(1).select(*cells, F.lit(0).alias("_any")).select(column.alias("v")).first()["v"]


BOX = dict(
    points=30, rebounds_total=10, assists=5, steals=2, blocks=1, field_goals_attempted=20, field_goals_made=11,
    free_throws_attempted=5, free_throws_made=4, turnovers=3, num_minutes=36.0,
)


def test_true_shooting(spark):
    assert value(spark, boxscore.true_shooting(), **BOX) == pytest.approx(30 / 44.4)
    assert value(spark, boxscore.true_shooting(), points=3, field_goals_attempted=0, free_throws_attempted=0) == 0


def test_impact(spark):
    per_minute = boxscore.weighted_impact() / F.col("num_minutes")
    assert value(spark, per_minute, **BOX) == pytest.approx(34.1 / 36)
    assert value(spark, boxscore.plain_impact_per_36(), **BOX) == pytest.approx(35.0)
    assert value(spark, boxscore.plain_impact_per_36(), **(BOX | {"num_minutes": 0.0})) == 0
    assert value(spark, boxscore.plain_impact_per_36(), **(BOX | {"num_minutes": None})) == 0


@pytest.mark.parametrize(
    ("text", "expected"),
    [("2003.0", 2003), ("", None), ("abc", None), (" 7 ", 7), ("-3", -3), ("1d", None), ("NaN", None), ("1e3", 1000)],
)
def test_whole(spark, text, expected):
    assert value(spark, casting.whole(F.col("c")), c=text) == expected


@pytest.mark.parametrize(("text", "expected"), [("1.5", 1.5), ("abc", 0.0), ("NaN", 0.0), ("2f", 0.0)])
def test_number_or_zero(spark, text, expected):
    assert value(spark, casting.number_or_zero(F.col("c")), c=text) == expected


def test_number_or_zero_of_null(spark):
    assert value(spark, casting.number_or_zero(F.col("c").cast("string")), c=None) == 0.0


def test_identifier_keeps_large_ids(spark):
    assert value(spark, casting.identifier(F.col("c")), c="9007199254740993") == 9007199254740993
    assert value(spark, casting.identifier(F.col("c")), c="0022400001") == 22400001
    assert value(spark, casting.identifier(F.col("c")), c="12.0") == 12


@pytest.mark.parametrize(
    ("text", "missing", "expected"),
    [("1", None, True), ("0.0", None, False), ("True", None, True), ("false", None, False), ("x", None, None), ("", False, False)],
)
def test_flag(spark, text, missing, expected):
    assert value(spark, casting.flag(F.col("c"), missing), c=text) is expected


def test_timestamp(spark):
    expected = dt.datetime(2024, 1, 2, 3, 4, 5)
    for text in ("2024-01-02T03:04:05", "2024-01-02 03:04:05"):
        assert value(spark, casting.timestamp(F.col("c")), c=text) == expected
    assert value(spark, casting.timestamp(F.col("c")), c="1/2/2024") == dt.datetime(2024, 1, 2)
    assert value(spark, casting.timestamp(F.col("c")), c="soon") is None


def test_only_date_formats_with_the_separators_of_a_text_are_tried(spark):
    def tried(text):
        return [f for f in casting.DATE_FORMATS if value(spark, casting.may_fit(F.col("c"), f), c=text)]

    assert tried("2024-01-05") == tried("someday") == tried("2024-01-05 19:30:00") == []
    assert tried("1/5/2024") == ["M/d/yyyy"] and tried("Jan 5, 2024") == ["MMM d, yyyy"]
    assert tried("1/5/2024 19:30") == ["M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm a"]
    night = dt.datetime(2024, 1, 5, 19, 30)
    for text in (" 1/5/2024 19:30", "1/5/2024 7:30 PM", "1/5/2024 19:30:00", "Jan 5, 2024 19:30", "+2024-01-05 19:30", "2024-01-05 19:30:00 America/Lima"):
        assert value(spark, casting.timestamp(F.col("c")), c=text) == night
    for text in ("T19:30", "19:30", "1/5/24", "13/5/2024", "2024/01/05", "/", "A"):
        assert value(spark, casting.timestamp(F.col("c")), c=text) is None


def test_missing_text(spark):
    assert value(spark, casting.text(F.col("c")), c="N/A") is None
    assert value(spark, casting.text(F.col("c")), c="Nashville") == "Nashville"


def test_names(spark):
    first = F.col("a").cast("string")
    assert value(spark, strings.joined_name(first, F.col("b")), a=None, b="X") == " X"
    assert value(spark, strings.strict_name(first, F.col("b")), a=None, b="X") is None


def test_contains_ignoring_case(spark):
    hit = lambda needle, **kw: value(spark, strings.contains_ignoring_case(F.col("c"), needle, **kw), c="LeBron James")
    assert hit("lebron") and hit("N J") and not hit("curry")
    assert not hit("%") and not hit("Le_ron")
    assert hit("Le_ron", wildcards=True)


def test_calendar(spark):
    sunday = dt.datetime(2024, 1, 7)
    assert value(spark, calendar.day_of_week(F.col("d")), d=sunday) == 0
    assert value(spark, calendar.season_year(F.col("d")), d=sunday) == 2024
    assert value(spark, calendar.season_year(F.col("d"), 10), d=sunday) == 2023
    assert value(spark, calendar.season_year(F.col("d"), 10), d=dt.datetime(2023, 10, 1)) == 2023
    late, early = dt.datetime(2024, 1, 3, 1), dt.datetime(2024, 1, 1, 23)
    assert value(spark, calendar.whole_days_between(F.col("b"), F.col("a")), a=early, b=late) == 1
    on = calendar.on_day(F.col("d"), dt.date(2024, 1, 7))
    assert value(spark, on, d=dt.datetime(2024, 1, 7, 23, 59)) and not value(spark, on, d=dt.datetime(2024, 1, 8))


def test_whole_days_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # The clocks go forward on 2024-03-10: the elapsed wall time is still 24 hours.
        days = calendar.whole_days_between(F.col("b"), F.col("a"))
        assert value(spark, days, a=dt.datetime(2024, 3, 9, 12), b=dt.datetime(2024, 3, 10, 12)) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ratios(spark):
    assert value(spark, numbers.ratio_or_zero(F.col("a"), F.col("b")), a=1, b=0) == 0
    assert value(spark, numbers.ratio_or_null(F.col("a"), F.col("b")), a=1, b=0) is None
    assert value(spark, numbers.ratio_or_null(F.col("a"), F.col("b")), a=1, b=3) == pytest.approx(1 / 3)


@pytest.mark.parametrize(
    ("flags", "expected"),
    [((True, True, False), "Guard"), ((False, True, True), "Forward"), ((None, None, True), "Center"), ((None, None, None), "Unknown")],
)
def test_position(spark, flags, expected):
    row = dict(zip(("guard", "forward", "center"), flags, strict=True))
    frame = spark.createDataFrame([row], "guard boolean, forward boolean, center boolean")
    assert frame.select(boxscore.primary_position()).first()[0] == expected


@pytest.mark.parametrize(
    ("scores", "strict", "expected"),
    [((100, 90), False, (1, 2)), ((100, 100), False, (2, 1)), ((None, None), False, (2, 1)), ((None, None), True, (None, None))],
)
def test_winner(spark, scores, strict, expected):
    frame = spark.createDataFrame([(1, 2, *scores)], "home_team_id long, away_team_id long, home_score int, away_score int")
    assert tuple(frame.select(*boxscore.winner_and_loser(strict)).first()) == expected


def test_confidence(spark):
    assert value(spark, boxscore.prediction_confidence(F.col("p")), p=0.75) == 0.5
    got = [value(spark, boxscore.projection_confidence(F.col("s")), s=s) for s in (0.0, 7.5, 20.0)]
    assert got == [1.0, 0.5, 0.0]
