"""One DuckDB statement per registered query."""

from __future__ import annotations

import re

from oracle.views import TEAM_STATS, VIEWS

ORDER = ["game_date", "game_id", "k_line", "k_part", "k_price", "k_qty", "k_disc", "k_tax"]
KEY = ", ".join(["person_id", *ORDER])
LINE = f"PARTITION BY person_id ORDER BY {', '.join(ORDER)}"
ROLLED = [
    "points", "assists", "rebounds_total", "steals", "blocks", "field_goals_percentage",
    "three_pointers_percentage", "free_throws_percentage", "turnovers", "num_minutes",
]
TARGETS = [
    "points", "assists", "rebounds_total", "steals", "blocks", "field_goals_made", "field_goals_attempted",
    "three_pointers_made", "three_pointers_attempted", "free_throws_made", "free_throws_attempted", "turnovers",
    "fouls_personal", "num_minutes", "plus_minus_points",
]
PLAYER_CARD = "height, body_weight, country, draft_year, draft_round, draft_number"


def r(expr: str, name: str | None = None) -> str:
    """Rounded to six places; the addition turns a negative zero into zero."""
    return f"round({expr}, 6) + 0e0 AS {name or expr.rsplit('.', 1)[-1]}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def _with_views(body: str) -> str:
    """Prefix the statement with the views it uses, directly or not, in order of definition."""
    wanted: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name, sql in VIEWS.items():
            if name not in wanted and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                wanted.add(name)
                pending.append(sql)
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in VIEWS.items() if name in wanted)
    return f"WITH {ctes}\n{body}" if ctes else body


def _frame(rows: int) -> str:
    return f"({LINE} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def _earlier(rows: int) -> str:
    return f"({LINE} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


def _mean(c: str, rows: int, frame=_frame) -> str:
    return f"avg({c}) OVER {frame(rows)}"


def _slope(c: str, rows: int = 5, frame=_frame) -> str:
    w = frame(rows)
    return f"CASE WHEN count(*) OVER {w} < 2 THEN NULL ELSE regr_slope({c}, step) OVER {w} END"


REST = (
    f"coalesce(CAST(floor((epoch_us(game_date) - epoch_us(lag(game_date) OVER ({LINE}))) / 86400000000e0) AS INT), 2)"
)
STEPPED = f"(SELECT *, row_number() OVER ({LINE}) AS step FROM player_games)"

FORM_LATEST = ", ".join(f"{c} DESC" for c in ORDER)


def statements() -> dict[str, str]:
    q: dict[str, str] = {}

    q["player_impact_rating"] = f"""SELECT person_id, season_year, {rs('player_impact_rating', 'points_per_36',
        'rebounds_per_36', 'assists_per_36', 'avg_ts_percentage')} FROM rating"""
    q["zscore_by_season"] = f"""SELECT person_id, season_year, {rs('avg_impact_per_min', 'avg_ts_percentage',
        'avg_plus_minus', 'avg_impact_per_min_z', 'avg_ts_percentage_z', 'avg_plus_minus_z')} FROM season_scores"""

    q["stg_games"] = """SELECT game_id, game_date, season_year, game_month, day_of_week, home_team_id, away_team_id,
        home_score, away_score, winning_team_id, losing_team_id, point_differential FROM stg_games"""
    q["stg_player_games"] = f"""SELECT {KEY}, season_year, team_id, opponent_team_id, win, home, num_minutes, points,
        assists, blocks, steals, field_goals_attempted, field_goals_made, three_pointers_attempted,
        three_pointers_made, free_throws_attempted, free_throws_made, rebounds_defensive, rebounds_offensive,
        rebounds_total, fouls_personal, turnovers, plus_minus_points,
        {rs('fg_percentage_calculated', 'three_pt_percentage_calculated', 'ft_percentage_calculated',
            'impact_rating_per_36_min')} FROM stg_player_games"""
    q["stg_team_games"] = f"""SELECT game_id, game_date, season_year, team_id, opponent_team_id, home, win, team_score,
        opponent_score, assists, blocks, steals, rebounds_total, turnovers,
        {rs('field_goals_percentage', 'three_pointers_percentage', 'free_throws_percentage')} FROM stg_team_games"""
    q["stg_players"] = f"SELECT person_id, first_name, last_name, full_name, primary_position, {PLAYER_CARD} FROM stg_players"
    q["stg_teams"] = """SELECT team_id, team_city, team_name, full_name, team_abbrev, season_founded,
        season_active_till, league FROM stg_teams"""

    stats = [f"avg_{c}" for c in "minutes points assists rebounds steals blocks turnovers plus_minus impact_rating".split()]
    stats += [f"season_{c}_percentage" for c in ("fg", "3p", "ft")]
    totals = ", ".join(f"total_{c}" for c in "points assists rebounds steals blocks".split())
    q["player_season_stats"] = f"""SELECT person_id, full_name, season_year, team_id, team_name, games_played,
        {rs(*stats)}, {totals} FROM player_season_stats"""
    q["team_season_stats"] = f"""SELECT team_id, season_year, count(*) AS games_played,
        count(*) FILTER (win) AS wins, count(*) FILTER (NOT win) AS losses,
        {r('count(*) FILTER (win) / count(*)::DOUBLE', 'win_percentage')},
        {r('avg(team_score)', 'avg_points_scored')}, {r('avg(opponent_score)', 'avg_points_allowed')},
        {r('avg(team_score - opponent_score)', 'avg_point_differential')},
        {r('avg(assists)', 'avg_assists')}, {r('avg(rebounds_total)', 'avg_rebounds')},
        {r('avg(steals)', 'avg_steals')}, {r('avg(blocks)', 'avg_blocks')}, {r('avg(turnovers)', 'avg_turnovers')}
        FROM stg_team_games GROUP BY team_id, season_year"""
    q["head_to_head"] = f"""SELECT team_1_id, team_2_id, team_1_wins, team_2_wins, total_games, {r('avg_margin')},
        last_meeting FROM head_to_head"""
    q["recent_performance"] = f"""SELECT g.*, p.full_name FROM (SELECT {KEY}, team_id, points, assists, rebounds_total,
        steals, blocks, {rs('fg_percentage_calculated', 'three_pt_percentage_calculated')},
        {r(_mean('points', 10), 'points_10_game_avg')}, {r(_mean('assists', 10), 'assists_10_game_avg')},
        {r(_mean('rebounds_total', 10), 'rebounds_10_game_avg')},
        row_number() OVER (PARTITION BY person_id ORDER BY {FORM_LATEST}) AS recency_rank
        FROM stg_player_games WHERE game_date >= TIMESTAMP '2001-06-01' - INTERVAL 30 DAY) g
        JOIN stg_players p ON g.person_id = p.person_id"""
    q["player_value"] = f"""SELECT p.person_id, p.full_name, p.primary_position, p.draft_year, p.draft_number,
        season_year, {rs('player_impact_rating', 'points_per_36', 'rebounds_per_36', 'assists_per_36',
        'avg_ts_percentage')} FROM stg_players p JOIN rating i ON p.person_id = i.person_id"""
    q["unified_player"] = f"""SELECT s.person_id, s.season_year, s.full_name, s.team_name, {rs('s.avg_points',
        's.avg_rebounds', 's.avg_assists')}, {r('i.player_impact_rating', 'impact_score')}
        FROM player_season_stats s LEFT JOIN rating i ON s.person_id = i.person_id AND s.season_year = i.season_year"""

    rolled = ", ".join(r(_mean(c, n), f"{c}_{n}_game_avg") for n in (5, 10) for c in ROLLED)
    trends = ", ".join(r(_slope(c), f"{c}_trend") for c in ROLLED)
    q["player_rolling"] = f"SELECT {KEY}, {rolled} FROM player_games"
    q["player_trend"] = f"SELECT {KEY}, {trends} FROM {STEPPED} s"
    q["player_rest_days"] = f"SELECT {KEY}, {REST} AS rest_days FROM player_games"
    filled = ", ".join(
        r(f"coalesce({e}, 0e0)", n)
        for c in ROLLED
        for e, n in ((_mean(c, 5), f"{c}_5_game_avg"), (_mean(c, 10), f"{c}_10_game_avg"), (_slope(c), f"{c}_trend"))
    )
    q["player_features"] = f"""SELECT f.* EXCLUDE (opponent_team_id),
        {r('coalesce(o.rating, 0e0)', 'opp_def_rating')}, {r('coalesce(d.edge, 0e0)', 'home_away_diff')}
        FROM (SELECT {KEY}, opponent_team_id, {filled}, {REST}::DOUBLE AS rest_days FROM {STEPPED} s) f
        LEFT JOIN (SELECT opponent_team_id, avg(points) AS rating FROM player_games GROUP BY 1) o
            ON f.opponent_team_id = o.opponent_team_id
        LEFT JOIN (SELECT person_id, avg(points) FILTER (home) - avg(points) FILTER (NOT home) AS edge
                   FROM player_games GROUP BY 1) d ON f.person_id = d.person_id"""
    prior = ", ".join(
        r(f"coalesce({e}, 0e0)", n)
        for c in ROLLED
        for e, n in (
            (_mean(c, 5, _earlier), f"{c}_5_game_avg"), (_mean(c, 10, _earlier), f"{c}_10_game_avg"),
            (_slope(c, 5, _earlier), f"{c}_trend"),
        )
    )
    running = "ORDER BY CAST(game_date AS DATE) RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"
    rating = f"avg(points) OVER (PARTITION BY opponent_team_id {running})"
    edge = " - ".join(
        f"avg(CASE WHEN {side} THEN points END) OVER (PARTITION BY person_id {running})" for side in ("home", "NOT home")
    )
    q["player_features_prior"] = f"""SELECT {KEY}, {prior}, {r(f'coalesce({rating}, 0e0)', 'opp_def_rating')},
        {REST}::DOUBLE AS rest_days, {r(f'coalesce({edge}, 0e0)', 'home_away_diff')} FROM {STEPPED} s"""
    q["latest_player_features"] = f"""SELECT * FROM ({q['player_features']}) f
        QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY {FORM_LATEST}) = 1"""
    q["train_split"] = """SELECT game_id, game_date,
        ('0x' || substring(md5(game_id || '|42'), 1, 8))::BIGINT % 100 < 80 AS in_training FROM games"""
    columns = [f"{c}_{side}" for side in ("home", "away") for c in TEAM_STATS]
    q["game_features"] = f"SELECT game_id, team_id_home, team_id_away, {rs(*columns)} FROM game_features"
    q["game_labels"] = """SELECT game_id, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS home_win,
        home_score, away_score FROM games"""
    q["player_targets"] = f"SELECT {KEY}, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in TARGETS) + " FROM player_games"

    ids = ["team_id_home", "team_id_away"]
    scaled = ", ".join(
        r(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1e0 ELSE stddev_pop({c}) OVER () END", c)
        for c in [*ids, *columns]
    )
    q["feature_scaling"] = f"SELECT game_id, {scaled} FROM game_features"

    q["team_form"] = f"""SELECT team_id, {r('avg(team_score)', 'avg_points_scored')},
        {r('avg(opponent_score)', 'avg_points_allowed')}, {r('avg(CASE WHEN win THEN 1 ELSE 0 END)', 'win_rate')},
        {r('avg(field_goals_percentage)', 'avg_fg_percentage')}, {r('avg(rebounds_total)', 'avg_rebounds')},
        {r('avg(assists)', 'avg_assists')}, {r('avg(turnovers)', 'avg_turnovers')}
        FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS rank
              FROM team_games) g WHERE rank <= 10 GROUP BY team_id"""
    q["player_form"] = f"""SELECT person_id, count(*) AS games, {r('avg(points)', 'avg_points')},
        {r('avg(assists)', 'avg_assists')}, {r('avg(rebounds_total)', 'avg_rebounds')},
        {r('avg(num_minutes)', 'avg_minutes')}, {r('avg(field_goals_percentage)', 'fg_percentage')},
        {r('stddev_samp(points)', 'points_spread')}, {r('avg(points) FILTER (rank <= 5)', 'latest_5_avg')},
        {r('avg(points) FILTER (rank > n - 5)', 'recent_form')},
        {r('greatest(0e0, 1 - stddev_samp(points) / 15)', 'confidence_score')}
        FROM (SELECT *, count(*) OVER (PARTITION BY person_id) AS n FROM
              (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY {FORM_LATEST}) AS rank FROM player_games) a
              WHERE rank <= 15) g GROUP BY person_id HAVING count(*) >= 5"""

    q["league_leaders"] = f"""SELECT s.person_id, s.team_id, p.full_name AS player_name, p.primary_position,
        t.full_name AS team_name, t.team_abbrev, games_played, {rs('avg_points', 'avg_assists', 'avg_rebounds')}
        FROM (SELECT * FROM player_season_stats WHERE season_year = 1998 AND games_played > 20
              ORDER BY avg_points DESC, person_id, team_id LIMIT 20) s
        LEFT JOIN stg_players p ON s.person_id = p.person_id LEFT JOIN stg_teams t ON s.team_id = t.team_id"""
    q["impact_leaders"] = f"""SELECT p.person_id, p.full_name, season_year, p.primary_position,
        {rs('player_impact_rating', 'avg_ts_percentage')} FROM stg_players p JOIN rating i ON p.person_id = i.person_id
        WHERE season_year = 1998 ORDER BY i.player_impact_rating DESC, p.person_id LIMIT 25"""
    q["search_page"] = f"""SELECT person_id, first_name || ' ' || last_name AS full_name, {PLAYER_CARD},
        (SELECT count(*) FROM players WHERE first_name || ' ' || last_name ILIKE '%LIER 0000%') AS total
        FROM players WHERE first_name || ' ' || last_name ILIKE '%LIER 0000%' ORDER BY person_id LIMIT 10 OFFSET 5"""
    q["player_log_page"] = f"""SELECT {', '.join(ORDER)}, points, assists, rebounds_total, steals, blocks, turnovers,
        plus_minus_points, (SELECT count(*) FROM player_games WHERE person_id = 7) AS total
        FROM player_games WHERE person_id = 7 ORDER BY {FORM_LATEST} LIMIT 10 OFFSET 10"""
    q["teams_page"] = """SELECT team_id, full_name, team_abbrev, team_city, team_name,
        (SELECT count(*) FROM stg_teams) AS total FROM stg_teams ORDER BY team_id LIMIT 10 OFFSET 10"""
    q["team_roster"] = f"""SELECT DISTINCT g.team_id, g.season_year, p.person_id, full_name, primary_position, {PLAYER_CARD}
        FROM stg_player_games g JOIN (SELECT team_id, max(season_year) AS season_year FROM stg_player_games GROUP BY 1) l
        ON g.team_id = l.team_id AND g.season_year = l.season_year JOIN stg_players p ON g.person_id = p.person_id"""
    q["player_profile"] = f"SELECT person_id, full_name, primary_position, {PLAYER_CARD} FROM stg_players WHERE person_id = 7"

    games = """SELECT game_id, game_date, home_team_id, away_team_id, home_score, away_score, h.full_name AS home_name,
        h.team_abbrev AS home_abbrev, a.full_name AS away_name, a.team_abbrev AS away_abbrev
        FROM games g LEFT JOIN stg_teams h ON home_team_id = h.team_id LEFT JOIN stg_teams a ON away_team_id = a.team_id"""
    q["games_with_teams"] = games
    q["game_by_id"] = games + " WHERE game_id = 321"
    q["games_on_date"] = games + " WHERE CAST(game_date AS DATE) = DATE '1998-03-05'"
    named = f"""SELECT team_1_id, team_2_id, a.full_name AS team_1_name, b.full_name AS team_2_name, team_1_wins,
        team_2_wins, total_games, {r('avg_margin')}, last_meeting FROM head_to_head h
        LEFT JOIN stg_teams a ON team_1_id = a.team_id LEFT JOIN stg_teams b ON team_2_id = b.team_id"""
    q["head_to_head_named"] = named
    q["head_to_head_of"] = named + " WHERE team_1_id = 3 AND team_2_id = 11"

    q["train_team_frame"] = f"""SELECT t.game_id, t.team_id, t.game_date, t.team_score, t.opponent_score, t.win,
        {r('t.field_goals_percentage')}, g.home_team_id, g.away_team_id, g.home_score, g.away_score
        FROM team_games t JOIN games g ON t.game_id = g.game_id WHERE t.game_date >= DATE '1998-01-01'"""
    q["train_player_frame"] = f"""SELECT g.person_id, {', '.join('g.' + c for c in ORDER)}, g.points, g.num_minutes,
        p.first_name, p.last_name FROM player_games g JOIN players p ON g.person_id = p.person_id
        WHERE g.game_date >= DATE '1998-01-01'"""

    q["latest_per_key"] = """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER
        (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) o WHERE rank = 1"""
    q["active_filter"] = """SELECT team_id, team_city, team_name, team_abbrev, season_founded, season_active_till, league
        FROM teams WHERE league = 'NBA' AND season_active_till >= 1998"""
    q["lookup_build"] = "SELECT team_city, team_name, max(team_id) AS team_id FROM teams GROUP BY ALL"
    q["lookup_join"] = f"""SELECT {KEY}, a.team_id AS team_id, b.team_id AS opponent_team_id FROM player_games g
        JOIN teams x ON g.team_id = x.team_id JOIN teams y ON g.opponent_team_id = y.team_id
        JOIN (SELECT * FROM teams WHERE league = 'NBA') a ON x.team_city = a.team_city AND x.team_name = a.team_name
        JOIN (SELECT * FROM teams WHERE league = 'NBA') b ON y.team_city = b.team_city AND y.team_name = b.team_name"""
    q["cast_nullable"] = """SELECT o_orderkey,
        CAST(TRY_CAST(substring(o_orderpriority, 1, 1) || '.0' AS DOUBLE) AS INT) AS rank,
        CAST(TRY_CAST(o_orderpriority AS DOUBLE) AS INT) AS unparsable FROM orders"""
    q["cast_coerce_zero"] = """SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority
        ELSE substring(o_orderpriority, 1, 1) END AS DOUBLE), 0e0) AS rank FROM orders"""

    q["insert_if_absent_games"] = """SELECT game_id, game_date, home_team_id, away_team_id, home_score, away_score
        FROM games WHERE game_date >= TIMESTAMP '2000-01-01'"""
    q["insert_if_absent_players"] = f"""SELECT {KEY}, points FROM (SELECT *, row_number() OVER
        (PARTITION BY g.game_id, g.person_id ORDER BY {', '.join(ORDER)}) AS rank FROM player_games g) g
        WHERE rank = 1 AND NOT EXISTS (SELECT 1 FROM player_games e WHERE e.game_date < TIMESTAMP '2000-01-01'
        AND e.game_id = g.game_id AND e.person_id = g.person_id)"""
    q["insert_if_absent_by_filter"] = q["insert_if_absent_players"]
    q["insert_if_absent_teams"] = """SELECT game_id, team_id, game_date, team_score, opponent_score, win FROM team_games
        WHERE game_date >= TIMESTAMP '2000-01-01'"""
    q["ingest_json"] = """SELECT event_id, ts AS game_date, user_id AS person_id, event_type,
        coalesce(CAST(json_extract(props, '$.k') AS INT), 0) AS points,
        coalesce(CAST(json_extract(props, '$.absent') AS INT), 0) AS assists FROM events"""

    q["ingest_document_games"] = """SELECT game_id, CASE WHEN game_id % 11 <> 0 THEN game_date END AS game_date, home_team_id,
        away_team_id, home_score, away_score, 'Regular Season' AS game_type FROM document_games"""
    stats = """assists, rebounds_total, steals, blocks, field_goals_made, field_goals_attempted, three_pointers_made,
        three_pointers_attempted, free_throws_made, free_throws_attempted, fouls_personal, turnovers"""
    q["ingest_document_players"] = f"""SELECT g.game_id, person_id, team_id, CASE WHEN g.game_id % 11 <> 0 THEN
        CASE team_id WHEN home_team_id THEN away_team_id WHEN away_team_id THEN home_team_id END END AS opponent_team_id,
        CASE WHEN g.game_id % 11 <> 0 THEN g.game_date ELSE TIMESTAMP '2002-03-04 05:06:07' END AS game_date,
        TIMESTAMP '2002-03-04 05:06:07' AS created_at, CASE WHEN g.game_id % 9 = 0 THEN 0 ELSE points END AS points,
        plus_minus_points, {stats} FROM document_games g JOIN player_games p ON g.game_id = p.game_id
        WHERE boxed AND g.game_id % 7 <> 0 AND g.game_id % 5 <> 0"""
    q["ingest_document_teams"] = f"""SELECT g.game_id, t.team_id, CASE WHEN g.game_id % 11 <> 0 THEN opponent_team_id END AS opponent_team_id,
        CASE WHEN g.game_id % 11 <> 0 THEN g.game_date ELSE TIMESTAMP '2002-03-04 05:06:07' END AS game_date,
        TIMESTAMP '2002-03-04 05:06:07' AS created_at, coalesce(team_score, 0) AS team_score,
        {', '.join(f'CAST(0 AS INT) AS {c.strip()}' for c in stats.split(','))}
        FROM document_games g JOIN team_games t ON g.game_id = t.game_id WHERE boxed AND g.game_id % 7 <> 0 AND g.game_id % 6 <> 0"""

    shares = "field_goals_percentage three_pointers_percentage free_throws_percentage".split()
    whole = """assists blocks steals field_goals_attempted field_goals_made three_pointers_attempted three_pointers_made
        free_throws_attempted free_throws_made rebounds_defensive rebounds_offensive rebounds_total fouls_personal turnovers
        plus_minus_points""".split()
    q["typed_player_rows"] = f"""SELECT person_id, game_id, CASE WHEN mark % 19 = 0 THEN date_trunc('minute', game_date)
        ELSE date_trunc('second', game_date) END AS game_date, team_id, opponent_team_id, win, home, {rs('num_minutes', *shares)},
        CASE WHEN mark % 23 = 0 THEN 0 ELSE points END AS points, {', '.join(whole)} FROM marked_lines
        WHERE mark % 31 <> 0 AND mark % 37 <> 0 AND mark % 29 <> 0 AND mark % 41 <> 0"""
    reasons = """CASE WHEN mark % 31 = 0 THEN 'malformed line' ELSE concat_ws('; ', CASE WHEN mark % 37 = 0 THEN 'no person_id' END,
        CASE WHEN mark % 29 = 0 THEN 'no game_date' END, CASE WHEN mark % 41 = 0 THEN 'unknown team' END) END"""
    q["reject_reasons"] = f"""SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({reasons}, '; ')) AS reason
        FROM marked_lines) r WHERE reason <> '' GROUP BY reason"""

    q["rejected_rows"] = f"""SELECT * FROM (SELECT CASE WHEN mark % 41 = 0 THEN 'Nowhere' ELSE a.team_city END AS team_city, a.team_name,
        b.team_city AS opponent_city, b.team_name AS opponent_name, CASE WHEN mark % 37 = 0 THEN '' ELSE CAST(person_id AS VARCHAR) END AS person,
        CAST(game_id AS VARCHAR) AS game, CASE WHEN mark % 29 = 0 THEN 'someday' WHEN mark % 19 = 0 THEN strftime(game_date, '%-m/%-d/%Y %-H:%M')
        ELSE strftime(game_date, '%Y-%m-%d %H:%M:%S') END AS played, CASE WHEN mark % 31 = 0 THEN 10 ELSE 29 END AS n_fields, {reasons} AS reasons
        FROM marked_lines m JOIN teams a ON m.team_id = a.team_id JOIN teams b ON m.opponent_team_id = b.team_id) r WHERE reasons <> ''"""

    q["dq_not_null"] = "SELECT game_id, home_team_id, away_team_id, game_date FROM games WHERE home_score IS NULL"
    q["dq_unique"] = "SELECT game_id, count(*) AS n_records FROM player_games GROUP BY game_id HAVING count(*) > 1"
    q["dq_relationships"] = """SELECT person_id, count(*) AS n_records FROM player_games WHERE person_id NOT IN
        (SELECT person_id FROM players WHERE draft_year IS NOT NULL) GROUP BY person_id"""
    q["dq_report"] = """SELECT check_name, failures, failures = 0 AS passed FROM (
        SELECT 'games.game_id is set' AS check_name, count(*) AS failures FROM stg_games WHERE game_id IS NULL
        UNION ALL SELECT 'games.home_score is set', count(*) FROM stg_games WHERE home_score IS NULL
        UNION ALL SELECT 'games.game_id is unique', count(*) FROM
            (SELECT game_id FROM stg_games GROUP BY 1 HAVING count(*) > 1) d
        UNION ALL SELECT 'player_games.game_id is unique', count(*) FROM
            (SELECT game_id FROM player_games GROUP BY 1 HAVING count(*) > 1) d
        UNION ALL SELECT 'rating.person_id is set', count(*) FROM rating WHERE person_id IS NULL
        UNION ALL SELECT 'rating.season_year is set', count(*) FROM rating WHERE season_year IS NULL
        UNION ALL SELECT 'rating.person_id is a player', count(*) FROM rating WHERE person_id NOT IN
            (SELECT person_id FROM stg_players)
        UNION ALL SELECT 'player_games.person_id was drafted', count(*) FROM player_games WHERE person_id NOT IN
            (SELECT person_id FROM players WHERE draft_year IS NOT NULL)) c"""

    q["search_by_grams"] = q["search_page"]
    q["search_by_pair"] = """SELECT person_id, first_name || ' ' || last_name AS full_name FROM players
        WHERE (first_name || ' ' || last_name) ILIKE '%07%'"""
    deep = f"""SELECT {KEY}, points, assists, (SELECT count(*) FROM player_games) AS total FROM player_games
        ORDER BY {FORM_LATEST}, person_id DESC"""
    q["deep_page"] = f"{deep} LIMIT 40 OFFSET 4980"
    q["last_page"] = f"{deep} LIMIT 500 OFFSET 5700"
    q["next_log_page"] = f"""SELECT {', '.join(ORDER)}, points, assists FROM player_games
        WHERE person_id = 7 AND game_date < TIMESTAMP '1998-06-01' ORDER BY {FORM_LATEST} LIMIT 10"""
    q["target_lines"] = " UNION ALL ".join(
        f"SELECT '{t}' AS target, {r(f'regr_slope({t}, num_minutes)', 'slope')}, {r(f'regr_intercept({t}, num_minutes)', 'start')} FROM player_games"
        for t in TARGETS if t != "num_minutes"
    )
    for name, full in {
        "player_season_by_loads": "player_season_stats", "team_season_by_loads": "team_season_stats",
        "head_to_head_by_loads": "head_to_head", "impact_rating_by_loads": "player_impact_rating",
    }.items():
        q[name] = q[full]  # states after some loads are those of a full rebuild

    return {name: _with_views(body) for name, body in q.items()}
