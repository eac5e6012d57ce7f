"""Files below roots as rows, and texts of tables as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakwise.functions.paths import under_pruned_folder
from leakwise.rules import extensions as ext


def _below(files: DataFrame, index: int, root: str, prune: tuple[str, ...], *more: str) -> DataFrame:
    path = F.regexp_replace("path", "^file:/+", "/")
    base = root.rstrip("/") + "/"
    out = files.select(F.lit(index).alias("repo_index"), path.alias("path"), F.col("length").alias("size"), F.col("path").alias("uri"), *more)
    inside = F.when(F.col("path").startswith(base), F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))).otherwise(F.col("path"))
    return out.where(~under_pruned_folder(inside, list(prune))) if prune else out


def _of_roots(spark: SparkSession, roots: list[str], prune: tuple[str, ...], *more: str) -> DataFrame:
    frames = []
    for index, root in enumerate(dict.fromkeys(roots)):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        frames.append(_below(files, index, root, prune, *more))
    return reduce(DataFrame.unionByName, frames)


def list_roots(spark: SparkSession, roots: list[str], prune: tuple[str, ...] = ()) -> DataFrame:
    """(repo_index, path, size, uri) of all files below the roots; a root's index is its place in the list, and a repeated
    root counts once. No file is opened, so the splits of the scan, of which small files make one each, are put together."""
    return _of_roots(spark, roots, prune).coalesce(4 * spark.sparkContext.defaultParallelism)


def read_roots(spark: SparkSession, roots: list[str], prune: tuple[str, ...] = (), size_limit: int | None = None) -> DataFrame:
    """The same with the content, through Spark's own reader: for stores that only Spark reaches. Every file within
    ``size_limit`` is read whole, whatever is done with it."""
    files = _of_roots(spark, roots, prune, "content").drop("uri")
    return files if size_limit is None else files.where(F.col("size") <= size_limit)


def stream_roots(spark: SparkSession, root: str, index: int = 0, prune: tuple[str, ...] = (), per_trigger: int = 1000) -> DataFrame:
    """The same rows as a stream of files that arrive below a root."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(shape).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    return _below(files, index, root, prune, "content").drop("uri")


def with_text(files: DataFrame) -> DataFrame:
    """``text`` from ``content``; bytes that aren't UTF-8 are replaced."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))


#: Tables up to this size may be dealt over all cores.
SPREAD_BYTES = 256 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores if they are small by the optimizer's estimate and come in fewer splits than there are
    cores (a small file in one row group); larger tables stay as they are, however many cores there are."""
    plan = rows._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if size <= SPREAD_BYTES and plan.toRdd().getNumPartitions() < cores else rows


def documents_as_files(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a documents table as files: the path is made of source, folder, id and extension."""
    kinds = [".java", ".cpp", ".xml", ".yaml", ".rb", ".erb", ".conf", ""]
    extension = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % len(kinds) + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 10 == 0, "tests").otherwise("src")
    return documents.select(
        F.lit(0).alias("repo_index"),
        F.concat(F.lit("/"), "source", F.lit("/"), folder, F.lit("/doc"), F.col("doc_id").cast("string"), extension).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        "text",
        "doc_id",
        *keep,
    )


def listed(files: DataFrame) -> DataFrame:
    """Files in the order of repository and path (the list of a walk)."""
    return files.orderBy("repo_index", "path")


DEFAULT_PRUNED = tuple(ext.PRUNED_FOLDERS)
