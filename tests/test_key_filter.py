"""Key filters: never miss a key, rarely open a season for nothing, survive growth and replays."""

import pytest
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.operators import key_filter
from courtlake.plans import daily_load, refresh
from courtlake.plans.daily_load import load_documents
from courtlake.sources.files import read_daily_documents
from courtlake.sources.tables import Tables
from tests.test_ingest import NOW, counts, document, history, put  # noqa: F401


def keys(spark, first, n, season):
    return spark.range(first, first + n).select(F.col("id").alias("game_id"), (F.col("id") % 7).alias("person_id"), F.lit(season).alias(schemas.SEASON))


ON = ["game_id", "person_id"]


def test_no_season_that_holds_a_key_is_missed(spark):
    stored = keys(spark, 0, 3000, 2001).unionByName(keys(spark, 5000, 40, 2002)).unionByName(keys(spark, 0, 10, 2003))
    filters = key_filter.built(stored, ON)
    assert dict(filters.dtypes) == key_filter.FILTER
    for k in (0, 7, 2999, 5000, 5039):
        probe = stored.filter(F.col("game_id") == k)
        want = {r[schemas.SEASON] for r in probe.collect()}
        assert want <= set(key_filter.possible_seasons(probe, filters, ON))
    assert key_filter.possible_seasons(stored.limit(0), filters, ON) == []
    assert key_filter.possible_seasons(stored, filters.limit(0), ON) == []


def test_foreign_keys_rarely_pass(spark):
    filters = key_filter.built(keys(spark, 0, 20_000, 2001), ON)
    foreign = keys(spark, 10**9, 2000, 0)
    passed = sum(key_filter.possible_seasons(foreign.filter(F.col("game_id") % 20 == i), filters, ON) != [] for i in range(20))
    assert passed <= 1


def test_a_large_batch_is_not_broadcast(spark, monkeypatch):
    """Many probes share a block, so few blocks do not make a small batch."""
    stored = keys(spark, 0, 150_000, 2001).unionByName(keys(spark, 150_000, 60_000, 2002))
    filters, sent, broadcast = key_filter.built(stored, ON), [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (sent.append(df.count()), broadcast(df))[1])
    assert key_filter.possible_seasons(stored, filters, ON) == [2001, 2002] and sent == []
    assert key_filter.possible_seasons(stored.filter("game_id < 50"), filters, ON) == [2001] and len(sent) == 2 and max(sent) <= 100


def test_pieces_are_combined(spark):
    whole = keys(spark, 0, 500, 2001)
    sizes = {2001: 64}
    pieces = [key_filter.filter_rows(whole.filter(F.col("game_id") % 3 == i), ON, sizes) for i in range(3)]
    together = pieces[0].unionByName(pieces[1]).unionByName(pieces[2])
    assert key_filter.filter_sizes(together) == {2001: (64, 500)}
    assert all(key_filter.possible_seasons(whole.filter(F.col("game_id") == k), together, ON) == [2001] for k in (0, 1, 2, 499))


def day(game, year):
    doc = document(game=game)
    for row in doc["recent_games"]:
        row["GAME_DATE_EST"] = f"{year}-01-05T00:00:00"
    return doc


@pytest.fixture
def opened(monkeypatch):
    """The seasons that loads ask for, per table."""
    seen, read = [], Tables.read

    def spy(self, layer, name, *args, seasons=None, **kwargs):
        if seasons is not None:
            seen.append((name, seasons))
        return read(self, layer, name, *args, seasons=seasons, **kwargs)

    monkeypatch.setattr(Tables, "read", spy)
    return seen


def test_a_day_opens_only_the_seasons_hit(spark, tmp_path, opened):
    tables = Tables(spark, str(tmp_path / "lake"))
    for n, year in enumerate(range(2015, 2019)):
        load_documents(read_daily_documents(spark, put(tmp_path, f"d{n}", day(f"{n:010d}", year))), tables, NOW)
    assert opened and all(seasons == [] for _, seasons in opened)  # all new: no stored file was opened
    opened.clear()
    load_documents(read_daily_documents(spark, put(tmp_path, "again", day("0000000003", 2018))), tables, NOW)
    assert opened == [(name, [2018]) for name in schemas.FACTS]
    opened.clear()
    load_documents(read_daily_documents(spark, put(tmp_path, "moved", day("0000000003", 2023))), tables, NOW)  # another date, same keys
    assert opened == [(name, [2018]) for name in schemas.FACTS]
    assert counts(tables) == [4, 8, 8]
    plan = tables.read("public", "games", seasons=[2018])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "= 2018)" in plan


def test_a_crowded_filter_is_rebuilt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_filter, "LEAST_BLOCKS", 1)
    for module in (key_filter, daily_load):
        monkeypatch.setattr(module, "KEYS_PER_BLOCK", 1)
    tables = Tables(spark, str(tmp_path / "lake"))
    for n in range(3):
        load_documents(read_daily_documents(spark, put(tmp_path, f"d{n}", day(f"{n:010d}", 2020))), tables, NOW)
    sizes = key_filter.filter_sizes(tables.read("keys", "games", key_filter.FILTER))
    assert sizes[2020][0] > 1 and sizes[2020][1] == 3
    load_documents(read_daily_documents(spark, put(tmp_path, "x", day("0000000002", 2021))), tables, NOW)
    assert counts(tables) == [3, 6, 6]


def test_backfill_replaces_the_filters(spark, tmp_path, history, opened):  # noqa: F811
    tables = Tables(spark, str(tmp_path / "lake"))
    load_documents(read_daily_documents(spark, put(tmp_path, "d", day("0000000777", 2019))), tables, NOW)
    refresh.backfill(spark, history, tables, current_year=2025)
    assert set(key_filter.filter_sizes(tables.read("keys", "games", key_filter.FILTER))) == {2024}
    opened.clear()
    load_documents(read_daily_documents(spark, put(tmp_path, "e", day("0000000100", 2024))), tables, NOW)
    assert opened[0] == ("games", [2024]) and tables.read("public", "games").filter("game_id = 100").count() == 1


def test_tables_without_filters_get_them(spark, tmp_path, history):  # noqa: F811
    tables = Tables(spark, str(tmp_path / "lake"))
    refresh.backfill(spark, history, tables, current_year=2025)
    tables._fs().delete(tables._path(tables.path("keys", "games")), True)
    load_documents(read_daily_documents(spark, put(tmp_path, "e", day("0000000100", 2011))), tables, NOW)
    assert tables.read("public", "games").filter("game_id = 100").count() == 1
    assert tables.exists("keys", "games")
