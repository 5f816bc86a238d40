"""Mixing sources to target weights, by hash-random order and prefix sums over ranges of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlake.llm.common import stored

RANGE_ROWS = 256  # documents aimed at per range of a source's order; results do not depend on it
FAN = 256  # ranges per group of ranges
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the five control blanks; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order_key(key: str, text: str, seed: str) -> Column:
    """Hash-random: md5 of seed, id and text, so that reruns and recomputed tasks agree."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col(text)), F.lit(""))))


def _range_of(order: Column, ranges: Column) -> Column:
    """Which of a source's equal ranges of the hash an order key lies in; grows with the key."""
    unit = F.conv(F.substring(order, 1, 13), 16, 10).cast("double") / float(16**13)
    return F.floor(unit * ranges).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size, ...).

    Sources by code point, null last, take ``weights`` in turn and share the whole size by weight. A
    target stops at ``cap`` times its source's size; the excess goes to the others by weight until none
    is above. Sources in the order of cap to weight reach their caps first, so one running sum finds
    the level at which the rest share. One row per source, so these windows stay small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(weights)), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    top = (F.col("source_size") * cap).cast("double")
    ordered = Window.orderBy((F.col("top") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    return (
        sources.withColumn("weight", weight)
        .withColumn("top", top)
        .withColumn("level", level)
        # the level of the first source that stays below its cap holds for all later ones
        .withColumn("shared", F.min(F.when(F.col("top") > F.col("level") * F.col("weight"), F.struct(F.col("top") / F.col("weight"), "level"))).over(whole))
        .withColumn("target", F.least(F.col("top"), F.coalesce(F.col("shared.level") * F.col("weight"), F.col("top"))))
        .drop("weight", "top", "level", "shared")
    )


def mixing_plan(sized: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row per source: size, target, whole epochs, and where the last epoch is cut.

    Equal ranges of the hash order hold ``RANGE_ROWS`` documents or so. Their token sums, and those of
    groups of ranges, give prefix sums level by level; row by row, only the range in which the cut
    falls is sorted, since every other lies wholly on one side. ``sized`` has (source, ord, size).
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = source_targets(sources, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.select("source", "source_size", "target", F.ceil(F.col("n") / RANGE_ROWS).alias("ranges"), epochs.alias("epochs"))
    sources = stored(sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-sources")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ranged = sized.join(sources, same(sized, sources)).select(sized["source"], "ord", "size", "rest", _range_of(F.col("ord"), F.col("ranges")).alias("range"))
    sums = stored(ranged.groupBy("source", "range").agg(F.sum("size").alias("size"), F.first("rest").alias("rest")), "mix-ranges")

    # largest group of ranges, then largest range in it, that starts at or below the cut
    def reach(df: DataFrame, unit: str) -> DataFrame:
        order = Window.partitionBy("source").orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
        starts = df.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
        at = starts.where(F.col("start") <= F.col("rest")).groupBy("source").agg(F.max(F.struct(unit, "start")).alias("at"))
        return at.select(F.col("source").alias("at_source"), F.col(f"at.{unit}").alias(f"at_{unit}"), F.col("at.start").alias("at_start"))

    group = F.floor(F.col("range") / FAN).alias("group")
    groups = sums.groupBy("source", group).agg(F.sum("size").alias("size"), F.first("rest").alias("rest")).withColumn("base", F.lit(0))
    at_group = reach(groups, "group")
    inside = sums.select("*", group).join(at_group, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("group") == F.col("at_group")))
    at_range = stored(reach(inside.select("source", "range", "size", "rest", F.col("at_start").alias("base")), "range"), "mix-cuts")

    rows = ranged.join(at_range, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("range") == F.col("at_range")))
    rows = rows.groupBy("source", "range", "ord").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("at_start").alias("base"))
    order = Window.partitionBy("source").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    taken = rows.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0))).where(F.col("start") + F.col("size") / 2 <= F.col("rest"))
    last = taken.groupBy("source").agg(F.max("ord").alias("cut")).withColumnRenamed("source", "c_source")
    cuts = at_range.join(last, F.col("at_source").eqNullSafe(F.col("c_source")), "left").select("at_source", "at_range", F.coalesce("cut", F.lit("")).alias("cut"))
    plan = sources.join(cuts, F.col("source").eqNullSafe(F.col("at_source")), "left")
    return stored(plan.select(F.col("source").alias("p_source"), "source_size", "target", "ranges", "epochs", "at_range", "cut"), "mix-plan")


def _mixed(documents: DataFrame, keep: list[str], key: str, source: str, text: str, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """(kept, size, source_size, target, epochs_taken), one row per document."""
    size, order = word_count(F.col(text)), _order_key(key, text, seed)
    sized = stored(documents.select(F.col(source).alias("source"), order.alias("ord"), size.alias("size")), "mix-sizes")
    plan = mixing_plan(sized, weights, cap)
    rows = documents.select(F.struct(*keep).alias("kept"), F.col(source).alias("source"), order.alias("ord"), size.alias("size"))
    at = _range_of(F.col("ord"), F.col("ranges"))
    inside = (at < F.col("at_range")) | ((at == F.col("at_range")) & (F.col("ord") <= F.col("cut")))
    times = F.col("epochs") + F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select(
        "kept", "size", "source_size", "target", F.least(times, F.lit(cap)).cast("long").alias("epochs_taken")
    )


def mix(
    documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix",
) -> DataFrame:
    """One row per row of ``documents``: ``key``, size, source_size, target, epochs_taken, taken.

    Each source's documents stand in hash-random order, and the mix runs over them again and again until
    the source's target is used up: ``epochs_taken`` is how often a document comes (0 to ``cap``), and
    ``taken`` its words times that. The document on which the target falls is taken if at least half of
    it lies before the target, so a source misses its target by half a document at most. No document is
    shortened.

    Null texts have size 0. A null source is a source of its own, the last one. Rows alike in id, text
    and source are taken or left together. With no words at all, all targets are 0. Only ``key``,
    ``source`` and ``text`` are read; other columns, of whatever name, do not matter.
    """
    rows = _mixed(documents, [key], key, source, text, weights, cap, seed)
    return rows.select(F.col(f"kept.{key}").alias(key), "size", "source_size", "target", "epochs_taken", (F.col("size") * F.col("epochs_taken")).alias("taken"))


def mixed_documents(
    documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix",
) -> DataFrame:
    """The rows of ``documents``, all columns, each as often as the mix takes it (see ``mix``)."""
    rows = _mixed(documents, documents.columns, key, source, text, weights, cap, seed)
    return rows.select("kept", F.explode(F.array_repeat(F.lit(1), F.col("epochs_taken").cast("int")))).select("kept.*")
