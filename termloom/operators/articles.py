"""From pages to article text: filters, sampling, caps and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import strip_markup

# The main namespace, the title mark of disambiguation pages, the sampling seed.
MAIN_NAMESPACE = 0
DISAMBIGUATION = "(disambiguation)"
SAMPLE_SEED = 13


def is_article() -> Column:
    """Main namespace, no redirect, no disambiguation page, with text. A NULL title fails."""
    return (
        (F.col("ns") == MAIN_NAMESPACE)
        & F.col("redirect").isNull()
        & ~F.lower("title").contains(DISAMBIGUATION)
        & F.col("raw_text").isNotNull()
    )


def articles(pages: DataFrame) -> DataFrame:
    """Article rows without the columns only the filter needed."""
    return pages.filter(is_article()).drop("ns", "redirect")


def article_text(article_rows: DataFrame, clean=strip_markup) -> DataFrame:
    """Replace raw_text by its cleaned text and drop rows left empty.

    The text passes through a one-element array, so that the filter on its length does not
    compute the cleaning a second time below the projection.
    """
    kept = F.filter(F.array(clean(F.col("raw_text"))), lambda text: F.length(text) > 0)
    others = [c for c in article_rows.columns if c != "raw_text"]
    return article_rows.select(*others, F.explode_outer(kept).alias("text")).filter(F.col("text").isNotNull())


def sample_rows(df: DataFrame, fraction: float, seed: int = SAMPLE_SEED) -> DataFrame:
    """Bernoulli sample without replacement; outside (0, 1) every row stays."""
    return df.sample(False, fraction, seed) if 0 < fraction < 1 else df


def sample_by_key(df: DataFrame, key: str, fraction: float, seed: int = SAMPLE_SEED) -> DataFrame:
    """Sample that depends on the key and seed only, so re-runs and re-partitioning agree."""
    if not 0 < fraction < 1:
        return df
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return df.filter(bucket < int(fraction * 2**32))


def cap_rows(df: DataFrame, limit: int, key: str | None = None) -> DataFrame:
    """At most `limit` rows; 0 is no cap.

    With a unique key the cap is stable: only keys travel to find the limit-th smallest, and
    the rows below it stay in place in their partitions.
    """
    if limit <= 0:
        return df
    if key is None:
        return df.limit(limit)
    last = df.select(key).orderBy(key).limit(limit).agg(F.max(key))
    return df.filter(F.col(key) <= last.scalar())


def splits(scan: DataFrame) -> int:
    """Partitions of a plain scan; planning only, no job runs."""
    return scan.rdd.getNumPartitions()


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Deal the rows out evenly over `partitions`."""
    return df.repartition(partitions) if partitions > 0 else df


def spread_scan(scan: DataFrame, at_least: int | None = None) -> DataFrame:
    """Deal out a scan that has fewer splits than tasks could run; leave a larger one alone.

    A table of many files is never shuffled by this. One file of one row group, whatever its
    rows cost to process, would otherwise keep a single core busy.
    """
    wanted = at_least or scan.sparkSession.sparkContext.defaultParallelism
    return spread(scan, wanted) if splits(scan) < wanted else scan
