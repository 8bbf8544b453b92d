"""Page dumps in XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.sources.xml_records import records

ROW_TAG = "page"
# The page schema is the input format.
# `redirect` only has to tell null from not null; the attribute also keeps its target.
PAGE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("ns", T.IntegerType()),
    T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
    T.StructField("revision", T.StructType([
        T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())])),
    ])),
])


def project_pages(pages: DataFrame) -> DataFrame:
    """Nested page rows to (title, ns, redirect, raw_text)."""
    return pages.select(
        "title",
        F.col("ns").try_cast("int").alias("ns"),
        "redirect",
        F.col("revision.text._VALUE").alias("raw_text"),
    )


def read_pages(spark: SparkSession, path: str, row_tag: str = ROW_TAG, by_record: bool = True) -> DataFrame:
    """Scan pages with the fixed schema, so no inference pass reads the dump first.

    Large files are split between tasks, see `xml_records`; one pass runs at once to find out about comments, CDATA
    sections and the like. With `by_record=False` the XML reader gives every file to a single task. Both give the same rows
    for well-formed files; after a fault in the markup the XML reader stops, the split scan goes on with the next record.
    """
    return (read_pages_by_record if by_record else read_pages_by_file)(spark, path, row_tag)


def read_pages_by_file(spark: SparkSession, path: str, row_tag: str = ROW_TAG) -> DataFrame:
    """One task per file."""
    return project_pages(spark.read.format("xml").options(**_options(row_tag)).schema(PAGE_SCHEMA).load(path))


def read_pages_by_record(spark: SparkSession, path: str, row_tag: str = ROW_TAG) -> DataFrame:
    """The same rows with large files split between tasks."""
    return project_pages(_parsed(records(spark, path, row_tag), row_tag, PAGE_SCHEMA))


def _options(row_tag: str) -> dict[str, str]:
    return {"rowTag": row_tag, "ignoreSurroundingSpaces": "false"}


def _parsed(rows: DataFrame, row_tag: str, schema: T.StructType) -> DataFrame:
    return rows.select(F.from_xml("value", schema.simpleString(), _options(row_tag)).alias("page")).select("page.*")


def read_pages_inferred(
    spark: SparkSession, path: str, row_tag: str = ROW_TAG, sampling_ratio: float = 1.0, by_record: bool = True
) -> DataFrame:
    """Scan pages with an inferred schema; parts that no page carries come back as NULL. Inference and scan read records
    of split files; with `by_record=False` the XML reader gives every file to a single task for both."""
    reader = spark.read.options(samplingRatio=sampling_ratio, **_options(row_tag))
    if by_record:
        rows = records(spark, path, row_tag)
        # Spark infers schemas from files or from strings; the strings pass through Python.
        pages = _parsed(rows, row_tag, reader.xml(rows.rdd.map(lambda r: r.value)).schema)
    else:
        pages = reader.format("xml").load(path)
    revision = _field(pages.schema, "revision")
    text = _field(revision, "text")
    if isinstance(text, T.StructType):
        raw_text = F.col("revision.text._VALUE") if "_VALUE" in text.names else F.lit(None)
    else:
        # Inference drops the struct when no <text> element carries attributes.
        raw_text = F.col("revision.text") if text is not None else F.lit(None)
    redirect = _field(pages.schema, "redirect")
    return pages.select(
        (F.col("title").cast("string") if "title" in pages.columns else F.lit(None).cast("string")).alias("title"),
        (F.col("ns").try_cast("int") if "ns" in pages.columns else F.lit(None).cast("int")).alias("ns"),
        _redirect_column(redirect).alias("redirect"),
        raw_text.cast("string").alias("raw_text"),
    )


def _field(schema, name):
    if isinstance(schema, T.StructType) and name in schema.names:
        return schema[name].dataType
    return None


def _redirect_column(redirect) -> Column:
    struct_type = PAGE_SCHEMA["redirect"].dataType
    if redirect is None:
        return F.lit(None).cast(struct_type)
    has_target = isinstance(redirect, T.StructType) and "_title" in redirect.names
    target = F.col("redirect._title").cast("string") if has_target else F.lit(None).cast("string")
    return F.when(F.col("redirect").isNotNull(), F.struct(target.alias("_title")))


def write_pages(pages: DataFrame, path: str, row_tag: str = ROW_TAG) -> None:
    """Write (title, ns, redirect, raw_text) rows as a page dump, one XML file per partition."""
    nested = pages.select(
        "title",
        "ns",
        "redirect",
        F.struct(
            F.struct(F.lit("preserve").alias("_space"), F.col("raw_text").alias("_VALUE")).alias("text")
        ).alias("revision"),
    )
    nested.write.mode("overwrite").format("xml").option("rootTag", "pages").option("rowTag", row_tag).save(path)
