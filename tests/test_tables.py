"""Table layout and database options."""

import pytest

from courtlake.sources import jdbc
from courtlake.sources.tables import Tables


def test_replace_may_read_the_table_itself(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    tables.replace(spark.range(5), "marts", "t")
    tables.replace(tables.read("marts", "t").filter("id > 2"), "marts", "t")
    assert sorted(r["id"] for r in tables.read("marts", "t").collect()) == [3, 4]
    assert [p.name for p in (tmp_path / "marts").iterdir()] == ["t"]


def test_failed_replace_keeps_the_old_rows(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    tables.replace(spark.range(5), "marts", "t")
    with pytest.raises(Exception, match="(?i)zero"):
        tables.replace(spark.range(3).selectExpr("1 / (id - 1) AS id"), "marts", "t")
    assert tables.read("marts", "t").count() == 5


def test_a_reader_sees_one_whole_version(spark, tmp_path, monkeypatch):
    """Started before, during and after a swap."""
    tables, seen = Tables(spark, str(tmp_path)), {}
    tables.replace(spark.range(5), "marts", "t")
    first = tables.read("marts", "t")
    point = Tables._point

    def during(self, folder, version):
        seen["before"] = tables.read("marts", "t")
        point(self, folder, version)
        seen["after"] = tables.read("marts", "t")

    monkeypatch.setattr(Tables, "_point", during)
    tables.replace(spark.range(9), "marts", "t")
    monkeypatch.undo()
    tables.append(spark.range(2), "marts", "t")
    assert [first.count(), seen["before"].count(), seen["after"].count(), tables.read("marts", "t").count()] == [5, 5, 9, 11]


def test_old_versions_go_by_age(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    versions = lambda: sorted(p.name for p in (tmp_path / "marts" / "t").glob("version-*"))
    for n in range(3):
        tables.replace(spark.range(n + 1), "marts", "t")
    assert len(versions()) == 3
    tables.remove_old("marts", "t", keep_seconds=0)
    assert len(versions()) == 1 and tables.read("marts", "t").count() == 3
    now = Tables(spark, str(tmp_path), keep_seconds=0)
    now.replace(spark.range(7), "marts", "t")
    assert len(versions()) == 1 and now.read("marts", "t").count() == 7


def test_a_folder_without_a_pointer_is_a_version(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "marts" / "t"))
    tables = Tables(spark, str(tmp_path))
    tables.append(spark.range(1), "marts", "t")
    assert tables.read("marts", "t").count() == 5
    tables.replace(tables.read("marts", "t").filter("id > 1"), "marts", "t")
    assert tables.read("marts", "t").count() == 2


def test_append_and_empty_read(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    assert tables.read("public", "t", {"id": "bigint"}).isEmpty()
    for _ in range(2):
        tables.append(spark.range(3), "public", "t")
    assert tables.read("public", "t", {"id": "bigint"}).count() == 6


def test_season_partitions_are_pruned(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    tables.replace(spark.range(10).selectExpr("id", "2000 + id % 3 AS season_year"), "marts", "t", ["season_year"])
    plan = tables.read("marts", "t").filter("season_year = 2001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season_year" in plan


def test_unknown_layer(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown layer"):
        Tables(spark, str(tmp_path)).path("attic", "t")


class Recorder:
    """Stands in for Spark's reader or writer and keeps the options. No database is opened."""

    def __init__(self):
        self.seen = {}

    def format(self, name):
        return self.option("format", name)

    def mode(self, name):
        return self.option("mode", name)

    def option(self, key, value):
        self.seen[key] = value
        return self

    def options(self, **values):
        self.seen.update(values)
        return self


class Carrier:
    def __init__(self):
        self.read = self.write = Recorder()


def test_jdbc_options():
    properties = {"user": "u", "driver": "d"}
    plain = jdbc.table_reader(Carrier(), "jdbc:x", "s.t", properties, None).seen
    assert plain == {"format": "jdbc", "url": "jdbc:x", "dbtable": "s.t", "user": "u", "driver": "d"}
    split = jdbc.table_reader(Carrier(), "jdbc:x", "s.t", properties, jdbc.Split("id", "0", "99", 8)).seen
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("id", "0", "99", 8)
    written = jdbc.table_writer(Carrier(), "jdbc:x", "s.t", properties, 4).seen
    assert (written["mode"], written["numPartitions"], written["dbtable"]) == ("overwrite", 4, "s.t")


def test_partitioned_write_makes_few_files(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    rows = spark.range(0, 4000, 1, 16).selectExpr("id", "2000 + id % 4 AS season_year")
    tables.replace(rows, "marts", "t", ["season_year"])
    assert len(list((tmp_path / "marts" / "t").glob("version-*/season_year=*/*.parquet"))) <= 8
    assert tables.read("marts", "t").count() == 4000
