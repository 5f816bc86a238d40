"""Group statistics brought back to rows without a window over the group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlake.functions.numbers import standard_score
from courtlake.operators.skew import measured


def zscores(df: DataFrame, group: list[str], columns: list[str], suffix: str = "_z") -> DataFrame:
    """Standard score of each column within its group, by sample deviation. A NULL group is a group.

    Mean and deviation come from a map-side combined aggregate, so a group may hold any share
    of the rows; their table is measured before it is broadcast. ``df`` is read twice: pass a
    materialised frame.
    """
    stats = [F.avg(c).alias(f"_mean_{c}") for c in columns] + [F.stddev_samp(c).alias(f"_dev_{c}") for c in columns]
    per_group = measured(df.groupBy(*[F.col(g).alias(f"_of_{g}") for g in group]).agg(*stats))
    joined = df.join(per_group, reduce(and_, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]))
    scores = [
        standard_score(F.col(c), F.col(f"_mean_{c}"), F.col(f"_dev_{c}")).alias(c + suffix) for c in columns
    ]
    return joined.select(*df.columns, *scores)
