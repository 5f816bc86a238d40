"""Lines of the historical file: what is typed, what is rejected, and why."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.sources import rejects
from courtlake.sources.backfill import PLAYER_STATISTICS, CsvTable
from courtlake.functions import casting as cast

TEAMS = [("Old Town", "Owls", 10), ("Bay", "Bats", 11)]


def line(**changes):
    plain = dict.fromkeys(PLAYER_STATISTICS.columns, "1") | {
        "playerteamCity": "Old Town", "playerteamName": "Owls", "opponentteamCity": "Bay", "opponentteamName": "Bats",
        "personId": "7.0", "gameId": "0000000042", "gameDate": "2024-01-05 19:30:00", "numMinutes": "33.5",
    }
    return ",".join(str((plain | changes)[h]) for h in PLAYER_STATISTICS.columns)


@pytest.fixture
def sorted_out(spark):
    def run(lines):
        lookup = spark.createDataFrame(TEAMS, "team_city string, team_name string, team_id bigint")
        usable, rejected = rejects.player_rows(spark.createDataFrame([(x,) for x in lines], "line string"), lookup)
        return usable, {(r.line, tuple(r.reasons)) for r in rejected.collect()}

    return run


def test_values_are_typed_or_zero(sorted_out):
    usable, rejected = sorted_out([line(points="abc", win="", home="True", assists="3.0", gameDate="1/5/2024 19:30", playerteamCity='"Old Town"')])
    row = usable.first()
    assert not rejected and dict(usable.dtypes) == schemas.PLAYER_STATISTICS
    assert (row.person_id, row.game_id, row.points, row.assists, row.win, row.home) == (7, 42, 0, 3, None, True)
    assert row.game_date == dt.datetime(2024, 1, 5, 19, 30) and (row.team_id, row.opponent_team_id) == (10, 11)


def test_each_rejected_line_names_its_reasons(sorted_out):
    short, long_ = ",".join(line().split(",")[:10]), line() + ",1"
    bad_date, nobody = line(gameDate="someday"), line(personId="", gameDate="")
    lost = line(playerteamName="Elks")
    usable, rejected = sorted_out([line(), short, long_, bad_date, nobody, lost, "", line(opponentteamCity="NA", gameId="x")])
    assert usable.count() == 1
    assert rejected == {
        (short, ("malformed line",)), (long_, ("malformed line",)), (bad_date, ("no game_date",)),
        (nobody, ("no person_id", "no game_date")), (lost, ("unknown team",)), ("", ("malformed line",)),
        (line(opponentteamCity="NA", gameId="x"), ("no game_id", "unknown team")),
    }


def test_no_line_is_lost_and_reasons_are_counted(spark, sorted_out):
    lines = [line()] * 3 + [line(personId="", gameDate="")] * 2 + ["x"]
    usable, rejected = sorted_out(lines)
    lookup = spark.createDataFrame(TEAMS, "team_city string, team_name string, team_id bigint")
    counts = rejects.reason_counts(rejects.player_rows(spark.createDataFrame([(x,) for x in lines], "line string"), lookup)[1])
    assert usable.count() == 3 and {r.reason: r.n for r in counts.collect()} == {"no person_id": 2, "no game_date": 2, "malformed line": 1}


def test_any_table_can_be_parsed(spark):
    table = CsvTable("t.csv", {"someId": cast.identifier, "note": cast.text}, {})
    rows = rejects.parsed_lines(spark.createDataFrame([('1,"a, b"',), ("2",)], "line string"), table)
    assert {(r.some_id, r.note, r.malformed) for r in rows.collect()} == {(1, "a, b", False), (2, None, True)}
    marked = rejects.with_reasons(rows, {"odd": F.col("some_id") % 2 == 1, "never": F.lit(None).cast("boolean")})
    assert {r.some_id: list(r.reasons) for r in marked.collect()} == {1: ["odd"], 2: []}
