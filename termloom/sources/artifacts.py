"""Result tables as JSON lines or parquet, and other small sources."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.settings import stored

# Names of the result folders and the columns of their rows.
TOPICS, TERMS, DOCS, NEIGHBORS = "topics", "term_embeddings", "doc_embeddings", "term_neighbors_samples"
SCHEMAS = {
    TOPICS: T.StructType([
        T.StructField("topic", T.IntegerType(), False),
        T.StructField("singular_value", T.DoubleType(), False),
        T.StructField("terms", T.ArrayType(T.StringType()), False),
        T.StructField("weights", T.ArrayType(T.DoubleType()), False),
    ]),
    TERMS: T.StructType([
        T.StructField("term", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.DoubleType()), False),
    ]),
    DOCS: T.StructType([
        T.StructField("title", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.DoubleType()), False),
    ]),
    NEIGHBORS: T.StructType([
        T.StructField("term", T.StringType(), False),
        T.StructField("neighbors", T.ArrayType(T.StructType([
            T.StructField("_1", T.StringType(), False),
            T.StructField("_2", T.DoubleType(), False),
        ]))),
    ]),
}
# Keys our own tables carry next to the columns above.
KEYS = {TERMS: T.StructField("term_id", T.IntegerType()), DOCS: T.StructField("doc_id", T.LongType())}

# Largest table, in rows, that may be gathered into one file.
SINGLE_FILE_ROWS = 100_000


def artifact_path(out: str, kind: str) -> str:
    return f"{out.rstrip('/')}/{kind}"


def write_artifact(df: DataFrame, out: str, kind: str, fmt: str = "json") -> str:
    """Overwrite `<out>/<kind>`; JSON lines by default, parquet for later Spark passes."""
    path = artifact_path(out, kind)
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def write_topics(df: DataFrame, out: str, fmt: str = "json") -> str:
    return write_artifact(df, out, TOPICS, fmt)


def write_doc_embeddings(df: DataFrame, out: str, fmt: str = "json") -> str:
    return write_artifact(df, out, DOCS, fmt)


def write_term_embeddings(df: DataFrame, out: str, fmt: str = "json") -> str:
    return write_artifact(df, out, TERMS, fmt)


def write_neighbors(df: DataFrame, out: str, fmt: str = "json") -> str | None:
    """Write the neighbour samples; nothing at all when no seed was a known term.

    The rows are stored first, so that the test and the write do not each run the search.
    """
    found = stored(df, "neighbors")
    if found.isEmpty():
        return None
    return write_artifact(found, out, NEIGHBORS, fmt)


def read_artifact(spark: SparkSession, out: str, kind: str, fmt: str = "json") -> DataFrame:
    """All part files of `<out>/<kind>` under the fixed schema plus its key, NULL when absent."""
    schema = SCHEMAS[kind]
    if kind in KEYS:
        schema = T.StructType([KEYS[kind], *schema.fields])
    return spark.read.format(fmt).schema(schema).load(artifact_path(out, kind))


def in_file_order(records: DataFrame, name: str) -> DataFrame:
    """Add a number that grows with the file's path, the place of the split in it, and the row's place there.

    Spark deals large splits first, so row numbers alone do not follow the part files. One narrow pass lists the
    splits that hold rows; their ranks are joined, and the row number counts within a split.
    """
    split = records.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    # Rows of one task are numbered without gaps, and a split is read by one task.
    placed = stored(split.withColumn("_place", F.monotonically_increasing_id()), "file_order")
    splits = placed.groupBy("_path", "_start").agg(F.min("_place").alias("_low"), F.count("*").alias("_rows"))
    order = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    # One row per split of the files.
    ranked = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(order), F.lit(0)))
    numbered = placed.join(ranked.drop("_rows"), ["_path", "_start"])
    return numbered.withColumn(name, F.col("_before") + F.col("_place") - F.col("_low")).drop(
        "_path", "_start", "_place", "_low", "_before"
    )


def embedding_matrix(records: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Records as (label, embedding, vector); a record without its label or embedding is dropped."""
    return records.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).withColumn(
        "vector", array_to_vector(vector)
    )


def write_single_file(df: DataFrame, path: str, max_rows: int = SINGLE_FILE_ROWS) -> None:
    """JSON lines in one part file, for small tables handed to other tools.

    Readers here take the whole folder, so larger tables are refused, not gathered in one task.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows: read the folder of part files instead")
    df.coalesce(1).write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table from a few local rows."""
    return spark.createDataFrame(rows, schema)


def index_range(spark: SparkSession, count: int, partitions: int = 32) -> DataFrame:
    """Ids 0..count-1, made on the executors in at least 32 slices."""
    return spark.range(0, count, 1, max(32, partitions))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )
