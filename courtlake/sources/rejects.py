"""Text lines to typed rows, with a channel for the lines that cannot be used and the reason why."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake import schemas
from courtlake.sources.backfill import PLAYER_STATISTICS, CsvTable, surrogate

MALFORMED = "malformed line"


def parsed_lines(lines: DataFrame, table: CsvTable, line: str = "line") -> DataFrame:
    """Columns of ``table`` typed from CSV lines without a header, the line itself, and ``malformed``.

    A line with too few or too many fields is malformed, a blank one too; what it has is typed all the same. Unreadable
    values become what the table's typing says: 0 for counts, NULL for ids and dates.
    """
    ddl = ", ".join(f"`{h}` STRING" for h in table.columns) + ", `_damaged` STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged", "escape": '"'}
    raw = lines.select(F.col(line).alias("line"), F.from_csv(F.col(line), ddl, options).alias("row"))
    typed = table.typed(raw.select("line", "row.*"), keep=("line", "_damaged"))
    blank = F.trim(F.coalesce("line", F.lit(""))) == ""
    return typed.withColumn("malformed", F.col("_damaged").isNotNull() | blank).drop("_damaged")


def with_reasons(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Add ``reasons``: the names of the conditions that hold for a row, in the order given."""
    named: Iterable[Column] = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons.items()]
    return rows.withColumn("reasons", F.array_compact(F.array(*named)))


def split_by_reasons(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The usable rows, and (line, reasons) of all others. Every row is in exactly one of them."""
    bad = F.size("reasons") > 0
    return rows.where(~bad).drop("reasons"), rows.where(bad).select("line", "reasons")


def reason_counts(rejected: DataFrame) -> DataFrame:
    """(reason, n): how many lines each reason holds for; a line may have several."""
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def player_rows(lines: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Player statistics from lines of the historical file, and the rejected lines with their reasons.

    ``lookup`` maps team_city and team_name to team_id, one row per pair. Unlike ``backfill.resolve_teams``
    rows of unknown teams are not dropped: they are rejected under their own reason.
    """
    rows = parsed_lines(lines, PLAYER_STATISTICS)
    for side, name in (("player_team", "team_id"), ("opponent_team", "opponent_team_id")):
        ids = lookup.select(F.col("team_city").alias(f"{side}_city"), F.col("team_name").alias(f"{side}_name"), F.col("team_id").alias(name))
        rows = rows.join(ids, [f"{side}_city", f"{side}_name"], "left")
    missing = {f"no {c}": F.col(c).isNull() & ~F.col("malformed") for c in schemas.REQUIRED["player_statistics"] if c != "team_id"}
    unknown = (F.col("team_id").isNull() | F.col("opponent_team_id").isNull()) & ~F.col("malformed")
    usable, rejected = split_by_reasons(with_reasons(rows, {MALFORMED: F.col("malformed")} | missing | {"unknown team": unknown}))
    return schemas.conform(surrogate(usable, "game_id", "person_id"), schemas.PLAYER_STATISTICS), rejected
