"""Common table expressions of the oracle: the box-score views over the driver tables."""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["teams"] = """
SELECT CAST(n_nationkey AS BIGINT) AS team_id, r_name AS team_city, n_name AS team_name,
       concat('T', CAST(n_nationkey AS VARCHAR)) AS team_abbrev,
       1946 + n_nationkey AS season_founded, 1995 + n_nationkey % 7 AS season_active_till,
       CASE WHEN n_regionkey < 4 THEN 'NBA' ELSE 'ABA' END AS league
FROM nation JOIN region ON n_regionkey = r_regionkey"""

VIEWS["players"] = """
SELECT s_suppkey AS person_id, split_part(s_name, '#', 1) AS first_name, split_part(s_name, '#', 2) AS last_name,
       CAST(180 + s_suppkey % 40 AS DOUBLE) AS height, CAST(70 + s_suppkey % 60 AS DOUBLE) AS body_weight,
       CAST(s_nationkey AS VARCHAR) AS country,
       s_suppkey % 4 = 0 AS guard, s_suppkey % 4 <= 1 AS forward, s_suppkey % 4 = 2 AS center,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(1980 + s_suppkey % 15 AS INT) END AS draft_year,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(1 + s_suppkey % 2 AS INT) END AS draft_round,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(1 + s_suppkey % 30 AS INT) END AS draft_number
FROM supplier"""

VIEWS["games"] = """
SELECT o_orderkey AS game_id, o_orderdate AS game_date,
       CAST(c_nationkey AS BIGINT) AS home_team_id, o_orderkey % 25 AS away_team_id,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(80 + o_custkey % 50 AS INT) END AS home_score,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(80 + o_orderkey % 47 AS INT) END AS away_score
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_nationkey <> o_orderkey % 25"""

VIEWS["raw_player_games"] = """
SELECT l_suppkey AS person_id, l_orderkey AS game_id, l_shipdate AS game_date,
       CAST(s_nationkey AS BIGINT) AS team_id, CAST(c_nationkey AS BIGINT) AS opponent_team_id,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag = 'R' END AS win, l_linestatus = 'O' AS home,
       l_quantity - 1 AS num_minutes, CAST(floor(l_extendedprice / 2500) AS INT) AS points,
       l_linenumber AS assists, CAST(l_partkey % 3 AS INT) AS blocks, CAST(l_partkey % 4 AS INT) AS steals,
       CAST(l_orderkey % 20 AS INT) AS field_goals_attempted,
       CAST(floor((l_orderkey % 20) / 2e0) AS INT) AS field_goals_made,
       CAST(l_partkey % 8 AS INT) AS three_pointers_attempted,
       CAST(floor((l_partkey % 8) / 3e0) AS INT) AS three_pointers_made,
       CAST(l_orderkey % 7 AS INT) AS free_throws_attempted,
       CAST(floor((l_orderkey % 7) * 0.75e0) AS INT) AS free_throws_made,
       CAST(round(l_tax * 100) AS INT) AS rebounds_defensive, CAST(l_partkey % 6 AS INT) AS rebounds_offensive,
       CAST(round(l_tax * 100) AS INT) + CAST(l_partkey % 6 AS INT) AS rebounds_total,
       CAST(l_orderkey % 6 AS INT) AS fouls_personal, CAST(l_partkey % 5 AS INT) AS turnovers,
       CAST(l_orderkey % 41 AS INT) - 20 AS plus_minus_points,
       l_linenumber AS k_line, l_partkey AS k_part, l_extendedprice AS k_price, l_quantity AS k_qty,
       l_discount AS k_disc, l_tax AS k_tax
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""

VIEWS["player_games"] = """
SELECT *,
       CASE WHEN field_goals_attempted > 0 THEN field_goals_made::DOUBLE / field_goals_attempted ELSE 0e0 END
           AS field_goals_percentage,
       CASE WHEN three_pointers_attempted > 0 THEN three_pointers_made::DOUBLE / three_pointers_attempted ELSE 0e0 END
           AS three_pointers_percentage,
       CASE WHEN free_throws_attempted > 0 THEN free_throws_made::DOUBLE / free_throws_attempted ELSE 0e0 END
           AS free_throws_percentage
FROM raw_player_games"""

VIEWS["team_games"] = """
SELECT game_id, game_date, team_id, opponent_team_id, home, team_score, opponent_score,
       team_score > opponent_score AS win,
       CAST((game_id + team_id) % 30 AS INT) AS assists, CAST((game_id + team_id) % 9 AS INT) AS blocks,
       CAST((game_id + team_id) % 11 AS INT) AS steals, CAST((game_id + team_id) % 50 AS INT) AS rebounds_total,
       CAST((game_id + team_id) % 17 AS INT) AS turnovers,
       CAST(30 + (game_id + team_id) % 20 AS DOUBLE) / 90e0 AS field_goals_percentage,
       CAST((game_id + team_id) % 15 AS DOUBLE) / 30e0 AS three_pointers_percentage,
       CAST(10 + (game_id + team_id) % 15 AS DOUBLE) / 25e0 AS free_throws_percentage
FROM (SELECT game_id, game_date, home_team_id AS team_id, away_team_id AS opponent_team_id, TRUE AS home,
             home_score AS team_score, away_score AS opponent_score FROM games
      UNION ALL
      SELECT game_id, game_date, away_team_id, home_team_id, FALSE, away_score, home_score FROM games) g"""

VIEWS["document_games"] = """
SELECT *, NOT (game_id % 4 = 3 AND day(game_date) <= 3) AS boxed FROM games"""

VIEWS["marked_lines"] = "SELECT *, game_id + 7 * person_id + k_line AS mark FROM player_games"

VIEWS["stg_games"] = """
SELECT *, CAST(year(game_date) AS INT) AS season_year, CAST(month(game_date) AS INT) AS game_month,
       CAST(dayofweek(game_date) AS INT) AS day_of_week,
       CASE WHEN home_score > away_score THEN home_team_id ELSE away_team_id END AS winning_team_id,
       CASE WHEN home_score > away_score THEN away_team_id ELSE home_team_id END AS losing_team_id,
       abs(home_score - away_score) AS point_differential
FROM games"""

VIEWS["stg_player_games"] = """
SELECT *, CAST(year(game_date) AS INT) AS season_year,
       field_goals_percentage AS fg_percentage_calculated,
       three_pointers_percentage AS three_pt_percentage_calculated,
       free_throws_percentage AS ft_percentage_calculated,
       CASE WHEN num_minutes > 0 THEN
           (points + rebounds_total + assists + steals + blocks - (field_goals_attempted - field_goals_made)
            - (free_throws_attempted - free_throws_made) - turnovers) / num_minutes * 36
       ELSE 0e0 END AS impact_rating_per_36_min
FROM player_games"""

VIEWS["stg_team_games"] = "SELECT *, CAST(year(game_date) AS INT) AS season_year FROM team_games"

VIEWS["stg_players"] = """
SELECT *, concat(first_name, ' ', last_name) AS full_name,
       CASE WHEN guard THEN 'Guard' WHEN forward THEN 'Forward' WHEN center THEN 'Center' ELSE 'Unknown' END
           AS primary_position
FROM players"""

VIEWS["stg_teams"] = "SELECT *, concat(team_city, ' ', team_name) AS full_name FROM teams"

VIEWS["season_efficiency"] = """
SELECT person_id, season_year,
       avg((points + rebounds_total * 0.8e0 + assists * 1.2e0 + steals * 1.5e0 + blocks * 1.1e0
            - (field_goals_attempted - field_goals_made) - (free_throws_attempted - free_throws_made) * 0.5e0
            - turnovers * 1.5e0) / num_minutes) AS avg_impact_per_min,
       avg(CASE WHEN field_goals_attempted + 0.44e0 * free_throws_attempted > 0
           THEN points / (2 * (field_goals_attempted + 0.44e0 * free_throws_attempted)) ELSE 0e0 END)
           AS avg_ts_percentage,
       avg(plus_minus_points) AS avg_plus_minus,
       sum(points) / sum(num_minutes) * 36 AS points_per_36,
       sum(assists) / sum(num_minutes) * 36 AS assists_per_36,
       sum(rebounds_total) / sum(num_minutes) * 36 AS rebounds_per_36
FROM stg_player_games WHERE num_minutes > 0 GROUP BY person_id, season_year"""


def _z(metric: str) -> str:
    w = "OVER (PARTITION BY season_year)"
    return (
        f"coalesce(CASE WHEN stddev_samp({metric}) {w} = 0 THEN 0e0 "
        f"ELSE ({metric} - avg({metric}) {w}) / stddev_samp({metric}) {w} END, 0e0) AS {metric}_z"
    )


VIEWS["season_scores"] = (
    f"SELECT *, {_z('avg_impact_per_min')}, {_z('avg_ts_percentage')}, {_z('avg_plus_minus')} FROM season_efficiency"
)

VIEWS["rating"] = """
SELECT person_id, season_year,
       avg_impact_per_min_z * 0.5e0 + avg_ts_percentage_z * 0.3e0 + avg_plus_minus_z * 0.2e0 AS player_impact_rating,
       points_per_36, rebounds_per_36, assists_per_36, avg_ts_percentage
FROM season_scores"""

VIEWS["player_season_stats"] = """
SELECT g.person_id, p.full_name, g.season_year, g.team_id, t.full_name AS team_name, count(*) AS games_played,
       avg(num_minutes) AS avg_minutes, avg(points) AS avg_points, avg(assists) AS avg_assists,
       avg(rebounds_total) AS avg_rebounds, avg(steals) AS avg_steals, avg(blocks) AS avg_blocks,
       sum(field_goals_made)::DOUBLE / nullif(sum(field_goals_attempted)::DOUBLE, 0) AS season_fg_percentage,
       sum(three_pointers_made)::DOUBLE / nullif(sum(three_pointers_attempted)::DOUBLE, 0) AS season_3p_percentage,
       sum(free_throws_made)::DOUBLE / nullif(sum(free_throws_attempted)::DOUBLE, 0) AS season_ft_percentage,
       avg(turnovers) AS avg_turnovers, avg(plus_minus_points) AS avg_plus_minus,
       avg(impact_rating_per_36_min) AS avg_impact_rating,
       CAST(sum(points) AS BIGINT) AS total_points, CAST(sum(assists) AS BIGINT) AS total_assists,
       CAST(sum(rebounds_total) AS BIGINT) AS total_rebounds, CAST(sum(steals) AS BIGINT) AS total_steals,
       CAST(sum(blocks) AS BIGINT) AS total_blocks
FROM stg_player_games g JOIN stg_players p ON g.person_id = p.person_id JOIN stg_teams t ON g.team_id = t.team_id
GROUP BY ALL"""

VIEWS["head_to_head"] = """
SELECT least(home_team_id, away_team_id) AS team_1_id, greatest(home_team_id, away_team_id) AS team_2_id,
       count(*) FILTER (winning_team_id = least(home_team_id, away_team_id)) AS team_1_wins,
       count(*) FILTER (winning_team_id = greatest(home_team_id, away_team_id)) AS team_2_wins,
       count(*) AS total_games, avg(point_differential) AS avg_margin, max(game_date) AS last_meeting
FROM stg_games WHERE winning_team_id IS NOT NULL GROUP BY 1, 2"""

TEAM_STATS = [
    "team_score", "opponent_score", "win", "field_goals_percentage", "three_pointers_percentage",
    "free_throws_percentage", "rebounds_total", "assists", "turnovers", "steals", "blocks",
]

VIEWS["team_averages"] = (
    "SELECT team_id, " + ", ".join(f"avg({c}::INT) AS {c}" if c == "win" else f"avg({c}) AS {c}" for c in TEAM_STATS)
    + " FROM team_games GROUP BY team_id"
)

VIEWS["game_features"] = (
    "SELECT g.game_id, "
    + ", ".join(
        f"{side[0]}.{c} AS {c}_{side}" if c == "team_id" else f"coalesce({side[0]}.{c}, 0e0) AS {c}_{side}"
        for side in ("home", "away")
        for c in ["team_id", *TEAM_STATS]
    )
    + """ FROM games g JOIN team_averages h ON g.home_team_id = h.team_id
    JOIN team_averages a ON g.away_team_id = a.team_id"""
)
