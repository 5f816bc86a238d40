"""Times the registered queries end to end and prints one JSON line.

Each query is built and written to Spark's no-op sink, so every row is computed and nothing is
collected. ``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores.
"""

from __future__ import annotations

import json
import os
import time

from courtlake.plans import catalog
from courtlake.session import local_session

HEADLINE = [
    "player_impact_rating", "zscore_by_season", "player_season_stats", "team_season_stats", "head_to_head",
    "recent_performance", "player_value", "unified_player", "player_rolling", "player_trend", "player_rest_days",
    "player_features", "game_features", "team_form", "player_form", "league_leaders", "team_roster",
    "insert_if_absent_games", "insert_if_absent_players", "lookup_join", "feature_scaling", "dq_report",
]


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    catalog.registered()[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session("courtlake-bench", cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    run(spark, folder, "stg_teams")  # starts the engine; not timed
    times = {name: run(spark, folder, name) for name in names}
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
