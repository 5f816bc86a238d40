"""Rolling and positional window operators over one timeline per key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from courtlake.functions.calendar import whole_days_between
from courtlake.operators.skew import HOT_ROWS, HotKeys, place_in_blocks


@dataclass(frozen=True)
class Timeline:
    """What a window builder may use: frames, and the place of a row on its key's timeline."""

    spec: WindowSpec
    reach: int
    position: Column
    total: Column
    whole: bool = True  # no timeline is cut into blocks

    def last(self, rows: int) -> WindowSpec:
        """The current row and the ones before it, ``rows`` in all."""
        return self._frame(rows - 1, 0)

    def prior(self, rows: int) -> WindowSpec:
        """The ``rows`` rows before the current one, without it."""
        return self._frame(rows, -1)

    def _frame(self, back: int, end: int) -> WindowSpec:
        if back > self.reach:
            raise ValueError(f"a frame of {back} rows back needs reach >= {back}, have {self.reach}")
        return self.spec.rowsBetween(-back, end)

    @property
    def recency(self) -> Column:
        """1 for the latest row of the key, by counting from the end."""
        return self.total - self.position + 1


def over_timeline(
    df: DataFrame,
    on: list[str],
    at: str,
    order: list[str],
    reach: int,
    build: Callable[[Timeline], list[Column]],
    floor_rows: int = HOT_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Add window columns that look back at most ``reach`` rows.

    One shuffle and one sort serve all columns that ``build`` returns. ``order`` must be total
    and start with ``at``. Timelines of crowded keys are cut into blocks, wherever their rows lie. ``probe`` may name a cheaper frame holding the key for at least all
    rows of ``df``; it is counted to find crowded keys.
    """
    hot = HotKeys.find(df if probe is None else probe, on, floor_rows)
    if hot is None:
        spec = Window.partitionBy(*on).orderBy(*order)
        total = F.count(F.lit(1)).over(Window.partitionBy(*on))
        return df.select("*", *build(Timeline(spec, reach, F.row_number().over(spec).cast("bigint"), total)))
    placed = place_in_blocks(df, on, order, reach, hot)
    spec = Window.partitionBy(*on, "_block").orderBy(*order)
    counted = F.count(F.lit(1)).over(Window.partitionBy(*on, "_block"))
    position = F.col("_offset") + F.row_number().over(spec)
    line = Timeline(spec, reach, position, F.coalesce(F.col("_total"), counted), whole=False)
    built = placed.select(*df.columns, "_halo", *build(line))
    return built.filter(~F.col("_halo")).drop("_halo")


def rolling_means(frame: WindowSpec, columns: list[str], suffix: str) -> list[Column]:
    return [F.avg(c).over(frame).alias(c + suffix) for c in columns]


def history(line: Timeline, columns: list[str], back: int) -> list[Column]:
    """The values of the ``back`` previous rows, as columns ``_ago_<rows>_<column>``.

    ``slope_of`` turns them into a trend with plain arithmetic. That is several times cheaper than
    a regression aggregate, which starts anew on every frame.
    """
    if back > line.reach:
        raise ValueError(f"looking {back} rows back needs reach >= {back}, have {line.reach}")
    return [F.lag(c, n).over(line.spec).alias(_ago(c, n)) for n in range(1, back + 1) for c in columns]


def history_columns(columns: list[str], back: int) -> list[str]:
    return [_ago(c, n) for n in range(1, back + 1) for c in columns]


def _ago(column: str, rows: int) -> str:
    return f"_ago_{rows}_{column}" if rows else column


def _values(column: str, first: int, last: int) -> list[str]:
    """SQL names of a column ``first`` to ``last`` rows ago; 0 is the row itself."""
    return [f"`{_ago(column, n)}`" for n in range(first, last + 1)]


def _total(values: list[str], factors: list[int] | None = None) -> str:
    weighted = factors or [1] * len(values)
    return " + ".join(f"{f}D * coalesce({v}, 0D)" for v, f in zip(values, weighted, strict=True))


def _known(values: list[str], factors: list[int] | None = None) -> str:
    weighted = factors or [1] * len(values)
    return " + ".join(f"if({v} IS NULL, 0D, {f}D)" for v, f in zip(values, weighted, strict=True))


def slope_of(column: str, first: int, last: int) -> Column:
    """Least-squares slope per row over the known values; NULL below two of them."""
    values = _values(column, first, last)
    steps = [last - first - n for n in range(len(values))]  # the oldest value is at 0
    count, x, y = _known(values), _known(values, steps), _total(values)
    xx, xy = _known(values, [s * s for s in steps]), _total(values, steps)
    return F.expr(f"(({count}) * ({xy}) - ({x}) * ({y})) / nullif(({count}) * ({xx}) - ({x}) * ({x}), 0D)")


def mean_of_earlier_days(on: list[str], at: str, values: dict[str, Column]) -> list[Column]:
    """Mean of each value over the key's rows of earlier days; rows without a date come before all others.

    For whole timelines; shares the shuffle of the other windows on the key.
    """
    day = F.coalesce(F.unix_date(F.to_date(at)).cast("bigint"), F.lit(-(10**12)))
    before = Window.partitionBy(*on).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    return [(F.sum(v).over(before) / F.nullif(F.count(v).over(before), F.lit(0))).alias(name) for name, v in values.items()]


def rest_days(line: Timeline, at: str, first: int = 2) -> Column:
    """Full days since the previous row of the key; ``first`` where there is none."""
    previous = F.lag(at).over(line.spec)
    return F.coalesce(whole_days_between(F.col(at), previous), F.lit(first))


def top_per_key(df: DataFrame, on: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key.

    Spark limits each key before the shuffle, so a crowded key sends at most ``n`` rows per task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*on).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)
