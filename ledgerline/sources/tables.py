"""Reading tables and filing catalogs, and writing results partitioned or merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of a filing catalog; bodies are optional, so that a catalog can be picked from without reading them.
CATALOG = T.StructType(
    [
        T.StructField("accession", T.LongType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("form_type", T.StringType()),
        T.StructField("filing_date", T.DateType()),
        T.StructField("html", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("markdown", T.StringType()),
    ]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_catalog(spark: SparkSession, path: str, file_format: str = "parquet", schema: T.StructType = CATALOG) -> DataFrame:
    """A filing catalog from Parquet, JSON lines, ORC or CSV (with a header); missing fields are null."""
    reader = spark.read.schema(schema)
    if file_format == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    return reader.format(file_format).load(path)


def write_filings(filings: DataFrame, path: str, date_col: str = "filing_date", compression: str = "zstd") -> None:
    """Filings partitioned by form and filing year, so that a read for either prunes folders. Bodies are long texts, which pay for a closer compression.

    Rows are rebalanced by these columns: Spark splits a large folder over as many writers as its size asks for, and joins small ones.
    """
    by_year = filings.withColumn("filing_year", F.year(date_col))
    by_year.hint("rebalance", "form_type", "filing_year").write.mode("overwrite").partitionBy("form_type", "filing_year").parquet(path, compression=compression)


def latest_by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; partial aggregation, so a key with many rows sends one a task."""
    rest = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return rows.groupBy(*key).agg(last).select(*key, "last.*")


def upsert(current: DataFrame | None, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """current with changes written over it by key: the last write wins."""
    both = changes if current is None else current.unionByName(changes)
    return latest_by_key(both, key, order)
