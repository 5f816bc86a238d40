"""Load of daily documents: append what is not there yet."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.operators.key_filter import FILTER, KEYS_PER_BLOCK, block_count, built, filter_rows, filter_sizes, possible_seasons, season_sizes
from courtlake.operators.keyed import insert_if_absent
from courtlake.operators.quality import split_required
from courtlake.session import cut_lineage
from courtlake.sources import daily
from courtlake.sources.tables import Tables


def load_documents(documents: DataFrame, tables: Tables, load_ts: dt.datetime) -> dict[str, DataFrame]:
    """Append new games, then new player and team rows; returns the rows appended, per table.

    Rows are identified by key, so loading the same documents again, or after a failure half
    way, adds only what is missing. Where the documents repeat a key, the copy that sorts highest
    stays (one with a score before one without), whatever the order of the files. Rows without a
    required value are appended to the table's counterpart in layer ``rejects``; a repeated load
    lists them again.

    A row may come again with another date, so it may be stored under any season. A filter of the stored
    keys per season (layer ``keys``) tells which seasons to open; the search there is exact.
    """
    documents = documents.persist()  # parsed once for three tables; lost parts are parsed again
    try:
        fresh = {"games": _append_absent(daily.daily_games(documents), "games", tables)}
        games = tables.read("public", "games", schemas.GAMES)
        fresh["player_statistics"] = _append_absent(daily.daily_player_rows(documents, games, load_ts), "player_statistics", tables)
        fresh["team_statistics"] = _append_absent(daily.daily_team_rows(documents, games, load_ts), "team_statistics", tables)
    finally:
        documents.unpersist()
    return fresh


def _append_absent(batch: DataFrame, name: str, tables: Tables) -> DataFrame:
    usable, rejected = split_required(batch, schemas.REQUIRED[name])
    if not rejected.isEmpty():
        tables.append(rejected, "rejects", name)
    key = schemas.KEYS[name]
    if usable.isEmpty():
        return batch.sparkSession.createDataFrame([], schemas.as_ddl(schemas.SOURCE_TABLES[name])).withColumn(schemas.SEASON, F.year("game_date"))
    filters = key_filters(tables, name)
    sizes = filter_sizes(filters)
    existing = tables.read("public", name, schemas.SOURCE_TABLES[name], seasons=possible_seasons(usable, filters, key, sizes))
    order = [F.col(c).desc() for c in batch.columns if c not in key]
    fresh = cut_lineage(insert_if_absent(usable, existing, key, order).withColumn(schemas.SEASON, F.year("game_date")))
    # the filter first: a key that it knows too early costs a search, one that it lacks a second row
    _extend_filters(tables, name, fresh, filters, sizes)
    tables.append(fresh, "public", name, [schemas.SEASON])
    return fresh


def key_filters(tables: Tables, name: str) -> DataFrame:
    """The filters of a fact table; built from its keys where there are none yet."""
    if not tables.exists("keys", name):
        tables.append(built(_keys(tables, name), schemas.KEYS[name]), "keys", name)
    return tables.read("keys", name, FILTER)


def _keys(tables: Tables, name: str, seasons: list[int] | None = None) -> DataFrame:
    key = schemas.KEYS[name]
    if not tables.exists("public", name):
        return tables.read("public", name, schemas.SOURCE_TABLES[name]).select(*key, F.lit(0).alias(schemas.SEASON))
    df = tables.read("public", name, seasons=seasons)
    return df.select(*key, (F.col(schemas.SEASON) if schemas.SEASON in df.columns else F.year("game_date")).alias(schemas.SEASON))


def _extend_filters(tables: Tables, name: str, fresh: DataFrame, filters: DataFrame, now: dict[int, tuple[int, int]]) -> None:
    """Set the new keys. A season that outgrows its filter gets a larger one, from its own keys and the new ones."""
    key, new = schemas.KEYS[name], season_sizes(fresh)
    if not new:
        return
    crowded = [s for s, n in new.items() if s in now and now[s][1] + n > KEYS_PER_BLOCK * now[s][0]]
    if crowded:
        keys = _keys(tables, name, crowded).unionByName(fresh.where(F.col(schemas.SEASON).isin(crowded)).select(*key, schemas.SEASON))
        others = filters.where(~F.col(schemas.SEASON).isin(crowded))
        tables.replace(others.unionByName(built(keys, key)), "keys", name)
    rest = fresh.where(~F.col(schemas.SEASON).isin(crowded)) if crowded else fresh
    sizes = {s: now[s][0] if s in now else block_count(n) for s, n in new.items() if s not in crowded}
    if sizes:
        tables.append(filter_rows(rest, key, sizes), "keys", name)


def rebuild_filters(tables: Tables, usable: dict[str, DataFrame], swap: Callable[[], None]) -> None:
    """Run ``swap``, which replaces the fact tables by ``usable``; at any moment the filters know all live keys."""
    fresh = {}
    for name in schemas.FACTS:
        fresh[name] = cut_lineage(built(usable[name].select(*schemas.KEYS[name], schemas.SEASON), schemas.KEYS[name]))
        if tables.exists("keys", name):
            tables.append(fresh[name], "keys", name)
    swap()
    tables.replace_all(fresh, "keys")
