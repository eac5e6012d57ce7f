"""Stored results, string requests, repositories and a paged source of repositories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leakwise.functions import paths
from leakwise.functions.text import decoded
from leakwise.operators.overlap import canonical_order
from leakwise.schema import FINDING


def read_results(spark: SparkSession, path: str, schema: str = FINDING) -> DataFrame:
    """Findings stored as lines of JSON or as one JSON array, in canonical order; a truncated last line is dropped.
    Lines are read in parallel; an array is one record, so one task reads it whole."""
    lines = spark.read.text(path)
    first = lines.where("trim(value) <> ''").limit(1).collect()
    if not first:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    if first[0][0].lstrip().startswith("["):
        reader = reader.option("multiLine", "true")
    return reader.json(path).orderBy(*canonical_order())


def string_requests(rows: DataFrame) -> DataFrame:
    """(source, source_type, base64) rows as files; the type is the extension that chooses the finders."""
    return rows.select(
        F.lit(0).alias("repo_index"),
        F.coalesce("source_type", F.lit("")).alias("path"),
        decoded(F.col("source"), F.col("base64")).alias("text"),
    )


def repositories(rows: DataFrame, base: str) -> DataFrame:
    """(address) rows with https address and checkout folder, repeats dropped, indexed in the order of ``position``."""
    from pyspark.sql import Window

    https = paths.git_to_https(F.col("address"))
    unique = rows.withColumn("https", https).groupBy("https").agg(F.min("position").alias("position"))
    # the registry is a configuration list, so one task may number it
    numbered = unique.withColumn("repo_index", F.row_number().over(Window.orderBy("position")) - 1)
    return numbered.withColumn("checkout", paths.checkout_location(F.lit(base), F.col("https")))


class PagedSource(DataSource):
    """A cursor-paged service as a table. ``fetch(cursor)`` returns (rows, next cursor or None); it is given with
    :func:`paged_source`, so tests need no network."""

    fetch: Callable[[str | None], tuple[list[tuple], str | None]]
    shape = "name string, address string"

    @classmethod
    def name(cls) -> str:
        return "paged_repositories"

    def schema(self) -> str:
        return self.shape

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(type(self).fetch)


class _PagedReader(DataSourceReader):
    def __init__(self, fetch) -> None:
        self.fetch = fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a cursor can't be split

    def read(self, partition) -> Iterator[tuple]:
        cursor = None
        while True:
            rows, cursor = self.fetch(cursor)
            yield from rows
            if cursor is None:
                return


def paged_source(spark: SparkSession, fetch, shape: str = "name string, address string") -> DataFrame:
    source = type("PagedRepositories", (PagedSource,), {"fetch": staticmethod(fetch), "shape": shape})
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()
