"""URL rules: host suffixes and path prefixes, matched by hashed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8  # hex digits of the hash prefix that the join uses
STEP = 1 << 24  # packs (labels of a host, length of a path) into one number

RULES_SCHEMA = "host string, path string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host up to ``/``, ``?``, ``#`` or the end, A-Z lowered; the path up to ``?``, ``#`` or the end.

    A null URL, or one without ``://``, has an empty host and path.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def url_verdicts(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: ``key``, host, path, rule, verdict.

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains where the URL's path
    starts with the rule's. The longest rule (host and path together) wins; at equal length the longer
    host, then ``block`` before ``allow``. A URL that no rule fits has a null rule and the verdict
    ``default``. Null URLs and URLs without ``://`` have an empty host and path and fit no rule; rules
    with a null part are void, a null path counts as ``/``; repeated rows are judged alike. Without pages
    there are no rows, without rules all URLs get ``default``. URLs of any length are read whole; columns
    other than ``key`` and ``url`` do not matter, whatever their names.

    Every distinct URL is expanded into the expressions that some rule could equal: the host suffixes
    and path prefixes of the lengths that occur among the rules. They meet the rules on a short hash
    prefix, and the full digests then confirm. Distinct URLs bound the work for crowded hosts; only
    fitting expressions reach the grouping. Spark broadcasts the rules if its size check allows it.
    """
    spark = pages.sparkSession
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("/")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.dropna().withColumn("digest", _digest(F.col("r_host"), F.col("r_path")))
    rules = rules.select("*", F.substring("digest", 1, SHORT).alias("short"))
    shapes = rules.select((F.size(_labels(F.col("r_host"))) * STEP + F.length("r_path")).alias("shape")).distinct()
    # bounded by the lengths of rules, not by their number or the pages
    known = sorted(row.shape for row in shapes.toLocalIterator())

    host, path = host_and_path(F.col("u"))
    urls = pages.select(F.col(url).alias("u")).where(F.col("u").isNotNull()).distinct().select("u", host.alias("h"), path.alias("p"))
    shape = F.lit(known) if known else F.array().cast("array<bigint>")
    labels = _labels(F.col("h"))
    n, length = F.floor(F.col("shape") / STEP).cast("int"), (F.col("shape") % STEP).cast("int")
    expressions = (
        urls.withColumn("l", labels)
        .select("u", "l", "p", F.explode(shape).alias("shape"))
        .where((n <= F.size("l")) & (length <= F.length("p")))
        .select("u", _digest(F.array_join(F.slice("l", -n, n), "."), F.substr("p", F.lit(1), length)).alias("e_digest"))
        .withColumn("e_short", F.substring("e_digest", 1, SHORT))
    )
    fits = expressions.join(rules, F.col("e_short") == F.col("short")).where(F.col("e_digest") == F.col("digest"))
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("total"), F.length("r_host").alias("host_length"),
        (F.col("r_verdict") == "block").alias("blocks"), "r_host", "r_path", "r_verdict",
    )
    best = fits.groupBy("u").agg(F.max(rank).alias("best")).select(F.col("u").alias("b_u"), "best")
    host, path = host_and_path(F.col("u"))
    return (
        pages.select(F.col(key).alias("k"), F.col(url).alias("u"))
        .join(best, F.col("u") == F.col("b_u"), "left")
        .select(
            F.col("k").alias(key), host.alias("host"), path.alias("path"),
            F.concat("best.r_host", "best.r_path").alias("rule"),
            F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"),
        )
    )


def rules_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES_SCHEMA)
