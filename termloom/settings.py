"""Size bounds for what may reach the driver or be broadcast, and the shared scratch folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest table, in bytes of doubles, that is collected and broadcast to the executors.
BROADCAST_BYTES = 256 * 1024 * 1024
# Bytes of doubles per block when both sides of a product are too large to broadcast. Every row
# is shuffled once per block of the other side, so blocks are as large as a task can hold.
BLOCK_BYTES = 64 * 1024 * 1024
# Most clusters one labeling may have where sums are kept per cluster.
MAX_CLUSTERS = 10_000
# Largest term lexicon looked up from a broadcast map; a larger one is joined.
LEXICON_ROWS = 500_000
# Largest stop-word table that becomes a literal set in the plan; a larger one is joined.
STOPWORD_ROWS = 10_000

_fallback_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only for local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="termloom-")
    return _fallback_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the scratch folder that no earlier write has used."""
    return f"{scratch_root(spark)}/termloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def block_count(rows: int, width: int, at_least: int, block_rows: int | None = None) -> int:
    """Blocks for `rows` vectors of `width` doubles: small enough to hold, and at least as many
    as the cluster needs to be busy (but no more than there are rows)."""
    fitting = block_rows or max(1, BLOCK_BYTES // (8 * max(width, 1)))
    blocks = math.ceil(rows / fitting)
    return max(1, blocks if block_rows else min(rows, max(blocks, at_least)))


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` once to the scratch folder and read it back; `compression` as the parquet writer knows it.

    Used where several later passes read the same result: it is computed once, its
    lineage ends at the files, and a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
