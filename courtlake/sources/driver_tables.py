"""The order/line-item test tables seen as box-score tables.

Each function reads only the columns it needs; nothing is synthesised. The line-item rows have no
unique key but the whole row, so ``PLAYER_GAME_ORDER`` gives windows a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.functions.numbers import ratio_or_zero
from courtlake.sources.backfill import PLAYER_STATISTICS, snake

TIE_BREAKERS = ["k_line", "k_part", "k_price", "k_qty", "k_disc", "k_tax"]
PLAYER_GAME_ORDER = ["game_date", "game_id", *TIE_BREAKERS]


SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
        l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,
        l_shipdate TIMESTAMP_NTZ""",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _int(c: Column) -> Column:
    return c.cast("int")


def teams(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    shaped = joined.select(
        key.cast("bigint").alias("team_id"),
        F.col("r_name").alias("team_city"),
        F.col("n_name").alias("team_name"),
        F.concat(F.lit("T"), key.cast("string")).alias("team_abbrev"),
        (1946 + key).alias("season_founded"),
        (1995 + key % 7).alias("season_active_till"),
        F.when(F.col("n_regionkey") < 4, "NBA").otherwise("ABA").alias("league"),
    )
    return schemas.conform(shaped, schemas.TEAMS)


def players(spark: SparkSession, folder: str) -> DataFrame:
    key, drafted = F.col("s_suppkey"), F.col("s_suppkey") % 5 != 0
    shaped = table(spark, folder, "supplier").select(
        key.alias("person_id"),
        F.split_part("s_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("s_name", F.lit("#"), F.lit(2)).alias("last_name"),
        (180 + key % 40).cast("double").alias("height"),
        (70 + key % 60).cast("double").alias("body_weight"),
        F.col("s_nationkey").cast("string").alias("country"),
        (key % 4 == 0).alias("guard"),
        (key % 4 <= 1).alias("forward"),
        (key % 4 == 2).alias("center"),
        F.when(drafted, _int(1980 + key % 15)).alias("draft_year"),
        F.when(drafted, _int(1 + key % 2)).alias("draft_round"),
        F.when(drafted, _int(1 + key % 30)).alias("draft_number"),
    )
    return schemas.conform(shaped, schemas.PLAYERS)


def games(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    played = F.col("o_orderstatus") != "P"
    shaped = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .filter(F.col("c_nationkey") != F.col("o_orderkey") % 25)
        .select(
            F.col("o_orderkey").alias("game_id"),
            F.col("o_orderdate").alias("game_date"),
            F.col("c_nationkey").cast("bigint").alias("home_team_id"),
            (F.col("o_orderkey") % 25).alias("away_team_id"),
            F.when(played, _int(80 + F.col("o_custkey") % 50)).alias("home_score"),
            F.when(played, _int(80 + F.col("o_orderkey") % 47)).alias("away_score"),
        )
    )
    return schemas.conform(shaped, schemas.GAMES)


def player_game_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Player and date of every line item: a cheap superset of ``player_games``, for skew checks."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("person_id"), F.col("l_shipdate").alias("game_date")
    )


def player_games(spark: SparkSession, folder: str) -> DataFrame:
    line, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    hosts = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").cast("bigint").alias("opponent_team_id")
    )
    sides = supplier.select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("team_id"))
    # The player join comes last: where it shuffles, what follows finds the rows already by player.
    joined = line.join(hosts, F.col("l_orderkey") == F.col("o_orderkey")).join(
        sides, F.col("l_suppkey") == F.col("s_suppkey")
    )
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    defensive, offensive = _int(F.round(F.col("l_tax") * 100)), _int(part % 6)
    tries = {"field_goals": _int(order % 20), "three_pointers": _int(part % 8), "free_throws": _int(order % 7)}
    hits = {
        "field_goals": _int(F.floor(order % 20 / 2)),
        "three_pointers": _int(F.floor(part % 8 / 3)),
        "free_throws": _int(F.floor(order % 7 * 0.75)),
    }
    shots: list[Column] = []
    for kind, attempted in tries.items():
        shots += [
            attempted.alias(f"{kind}_attempted"),
            hits[kind].alias(f"{kind}_made"),
            ratio_or_zero(hits[kind], attempted).alias(f"{kind}_percentage"),
        ]
    shaped = joined.select(
        F.col("l_suppkey").alias("person_id"),
        order.alias("game_id"),
        F.col("l_shipdate").alias("game_date"),
        "team_id",
        "opponent_team_id",
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("win"),
        (F.col("l_linestatus") == "O").alias("home"),
        (F.col("l_quantity") - 1).alias("num_minutes"),
        _int(F.floor(F.col("l_extendedprice") / 2500)).alias("points"),
        F.col("l_linenumber").alias("assists"),
        _int(part % 3).alias("blocks"),
        _int(part % 4).alias("steals"),
        *shots,
        defensive.alias("rebounds_defensive"),
        offensive.alias("rebounds_offensive"),
        (defensive + offensive).alias("rebounds_total"),
        _int(order % 6).alias("fouls_personal"),
        _int(part % 5).alias("turnovers"),
        (_int(order % 41) - 20).alias("plus_minus_points"),
        F.col("l_linenumber").alias("k_line"),
        F.col("l_partkey").alias("k_part"),
        F.col("l_extendedprice").alias("k_price"),
        F.col("l_quantity").alias("k_qty"),
        F.col("l_discount").alias("k_disc"),
        F.col("l_tax").alias("k_tax"),
    )
    return schemas.conform(shaped, schemas.PLAYER_STATISTICS, keep=tuple(TIE_BREAKERS))


def team_games(spark: SparkSession, folder: str) -> DataFrame:
    """Two rows per game, from one read of the games."""

    def side(us: str, them: str) -> Column:
        return F.struct(
            F.col(f"{us}_team_id").alias("team_id"),
            F.col(f"{them}_team_id").alias("opponent_team_id"),
            F.lit(us == "home").alias("home"),
            F.col(f"{us}_score").alias("team_score"),
            F.col(f"{them}_score").alias("opponent_score"),
        )

    sides = games(spark, folder).select(
        "game_id", "game_date", F.inline(F.array(side("home", "away"), side("away", "home")))
    )
    seed = F.col("game_id") + F.col("team_id")
    shaped = sides.select(
        "*",
        (F.col("team_score") > F.col("opponent_score")).alias("win"),
        _int(seed % 30).alias("assists"),
        _int(seed % 9).alias("blocks"),
        _int(seed % 11).alias("steals"),
        _int(seed % 50).alias("rebounds_total"),
        _int(seed % 17).alias("turnovers"),
        ((30 + seed % 20).cast("double") / 90).alias("field_goals_percentage"),
        ((seed % 15).cast("double") / 30).alias("three_pointers_percentage"),
        ((10 + seed % 15).cast("double") / 25).alias("free_throws_percentage"),
    )
    return schemas.conform(shaped, schemas.TEAM_STATISTICS)


# --- the same rows as raw input ------------------------------------------------------------------


def _day_text(day: Column, form: Column) -> Column:
    """A date in one of the forms that documents use, by ``form``: ISO, month/day/year, or with the month's name."""
    return (
        F.when(form == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(form == 1, F.date_format(day, "M/d/yyyy"))
        .otherwise(F.date_format(day, "MMM d, yyyy"))
    )


def daily_documents(spark: SparkSession, folder: str, per_day: int = 4) -> DataFrame:
    """Games with their box scores as daily documents: arrays of structs within arrays of structs.

    A document has the games of a day whose id has one remainder by ``per_day``. Dates are text in three
    forms and now and then unreadable, ids are text with leading zeros. Some games have no box score,
    some box scores lack the players' part or the teams' part, some documents lack all box scores.
    """
    played, lines = games(spark, folder), player_games(spark, folder)
    game = F.col("game_id")
    codes = {
        "PTS": F.when(game % 9 != 0, F.col("points")), "AST": "assists", "REB": "rebounds_total", "STL": "steals", "BLK": "blocks",
        "FGM": "field_goals_made", "FGA": "field_goals_attempted", "FG3M": "three_pointers_made", "FG3A": "three_pointers_attempted",
        "FTM": "free_throws_made", "FTA": "free_throws_attempted", "PF": "fouls_personal", "TO": "turnovers", "PLUS_MINUS": "plus_minus_points",
    }
    stats = [(F.col(c) if isinstance(c, str) else c).cast("double").alias(code) for code, c in codes.items()]
    people = F.struct(F.col("person_id").cast("string").alias("PLAYER_ID"), F.col("team_id").cast("string").alias("TEAM_ID"), *stats)
    rows = lines.groupBy("game_id").agg(F.collect_list(people).alias("people"))

    def side(name: str) -> Column:
        return F.struct(F.col(f"{name}_team_id").cast("string").alias("TEAM_ID"), F.col(f"{name}_score").cast("double").alias("PTS"))

    text_id = F.lpad(game.cast("string"), 10, "0")
    shown = F.struct(
        text_id.alias("GAME_ID"),
        F.when(game % 11 == 0, "to be announced").otherwise(_day_text(F.col("game_date"), game % 3)).alias("GAME_DATE_EST"),
        F.col("home_team_id").cast("string").alias("HOME_TEAM_ID"), F.col("away_team_id").cast("string").alias("VISITOR_TEAM_ID"),
        F.col("home_score").cast("double").alias("PTS_HOME"), F.col("away_score").cast("double").alias("PTS_AWAY"),
    )
    parts = F.struct(F.when(game % 5 != 0, F.col("people")).alias("PlayerStats"), F.when(game % 6 != 0, F.array(side("home"), side("away"))).alias("TeamStats"))
    box = F.struct(text_id.alias("game_id"), F.to_date("game_date").cast("string").alias("extraction_date"), F.when(game % 7 != 0, parts).alias("boxscore"))
    day = played.join(rows, "game_id", "left").groupBy(F.to_date("game_date").alias("day"), (game % per_day).alias("file"))
    documents = day.agg(F.collect_list(shown).alias("recent_games"), F.collect_list(box).alias("boxscores"))
    boxes = F.when((F.col("file") != 3) | (F.dayofmonth("day") > 3), F.col("boxscores"))
    return documents.select("recent_games", boxes.alias("boxscores"), F.col("day").cast("string").alias("extraction_timestamp"))


def player_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The player rows as lines of the historical CSV file (column ``line``), with what such files get wrong.

    By a mark made from the row's keys: counts that are no numbers, flags as numbers or words or missing, dates
    in two forms or unreadable, missing ids, unknown teams, and lines cut short.
    """
    names = teams(spark, folder).select("team_id", "team_city", "team_name")
    rows = player_games(spark, folder).withColumn("mark", F.col("game_id") + 7 * F.col("person_id") + F.col("k_line"))
    for side in ("team", "opponent_team"):
        rows = rows.join(names.toDF(f"{side}_id", f"{side}_city", f"{side}_label"), f"{side}_id")
    mark = F.col("mark")

    def flag(name: str) -> Column:
        known = F.when(mark % 2 == 0, F.when(F.col(name), "1.0").otherwise("0.0")).otherwise(F.when(F.col(name), "True").otherwise("False"))
        return F.when(F.col(name).isNotNull(), known).otherwise("")

    shown = {
        "playerteamCity": F.when(mark % 41 == 0, "Nowhere").otherwise(F.col("team_city")), "playerteamName": F.col("team_label"),
        "opponentteamCity": F.col("opponent_team_city"), "opponentteamName": F.col("opponent_team_label"),
        "personId": F.when(mark % 37 == 0, "").otherwise(F.col("person_id").cast("string")), "gameId": F.col("game_id").cast("string"),
        "gameDate": F.when(mark % 29 == 0, "someday").when(mark % 19 == 0, F.date_format("game_date", "M/d/yyyy H:mm")).otherwise(F.date_format("game_date", "yyyy-MM-dd HH:mm:ss")),
        "win": flag("win"), "home": flag("home"), "numMinutes": F.col("num_minutes"),
        "points": F.when(mark % 23 == 0, "abc").otherwise(F.concat(F.col("points").cast("string"), F.lit(".0"))),
    }
    fields = [shown[h] if h in shown else F.col(snake(h)) for h in PLAYER_STATISTICS.columns]
    whole = F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in fields])
    return rows.select(F.when(mark % 31 == 0, F.substring_index(whole, ",", 10)).otherwise(whole).alias("line"))
