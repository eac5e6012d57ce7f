"""A training corpus from the documents table: five stages, each over all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``. An empty table gives
an empty result at every stage; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakwise.llm.common import forget, remainder, scope, written
from leakwise.llm.exact_dedup import exact_dedup, normalised
from leakwise.llm.mixing import mixing_plan, taken, word_count
from leakwise.llm.packing import pack
from leakwise.llm.quality import learn_quality, quality_score
from leakwise.llm.queries import TARGETS, labels, tokenizer_path, tree_columns
from leakwise.llm.simhash_dedup import components, fingerprints

#: As op8_mixing: as many tokens as there are, a document up to three times.
MIX = TARGETS
CUT_SCORE = 0.3


def _staying(docs: DataFrame, digest: Column, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and digest stay by ``rows`` (doc_id, digest, stays; one per row of ``docs``); of
    those that repeat both, the first by all columns. The joins are told to sort, so that no list of rows passes through
    the driver."""
    rows = written(rows, "staying")
    own, place = "leakwise_digest", "leakwise_place"  # no column of the documents
    pair = [F.col("doc_id").alias("leakwise_id"), F.col("digest").alias("leakwise_of")]
    same = F.col("doc_id").eqNullSafe(F.col("leakwise_id")) & (F.col(own) == F.col("leakwise_of"))
    gone = rows.where("not stays").select(*pair).distinct().hint("merge")
    left = docs.withColumn(own, digest).join(gone, same, "left_anti")
    again = rows.where("stays").groupBy(*pair).count().where("count > 1").select("leakwise_id", "leakwise_of")
    if again.isEmpty():
        return left.select(docs.columns)
    again = again.hint("merge")
    first = Window.partitionBy("doc_id", own).orderBy(*docs.columns)
    one = left.join(again, same, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return left.join(again, same, "left_anti").select(docs.columns).unionByName(one.select(docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; null text counts as empty, null ids are judged like others."""
    model = learn_quality(docs, labels(spark, sf_dir), remainder("doc_id", 5) != 0)
    return docs.where(quality_score(model, "text") >= CUT_SCORE)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row: that with the smallest id; of rows that repeat it, the first by all columns. Null texts equal
    empty ones; a null id stays only if no row of the group has one."""
    rows = exact_dedup(docs).select("doc_id", F.col("text_sha256").alias("digest"), F.col("kept").alias("stays"))
    return _staying(docs, F.sha2(normalised("text"), 256), rows)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row: that with the smallest id, and of its texts the smallest digest. Null ids and
    texts as in ``dedup_exact``; texts without words are one group."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = written(components(fingerprints(docs, digest=digest)), "near")
    smallest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    chosen = rows.where(smallest).groupBy("root").agg(F.min("digest").alias("least")).hint("merge")
    stays = smallest & (F.col("digest") == F.col("least"))
    return _staying(docs, digest, rows.join(chosen, "root").select("doc_id", "digest", stays.alias("stays")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budgets of their domain, language and source, once for each epoch that takes them. Null languages
    and sources are names of their own; rows that repeat an id go together; texts without words weigh nothing and take part
    with their leaf's passes and prefix."""
    plan, _ = mixing_plan(docs, tree_columns(), word_count("text"), MIX)
    leaf = {f"leaf_{k}": F.coalesce(c.cast("string"), F.lit("")) for k, c in tree_columns().items()}
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("mix_id"), *[c.alias(k.removeprefix("leaf_")) for k, c in leaf.items()])
    epochs = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken(whole, plan, MIX, "mix_id").where("copies > 0").select("row", epochs.alias("epoch")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 1024 tokens; null text is one piece that holds the end only."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("dedup_exact", dedup_exact),
    ("dedup_near", dedup_near),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: The classifier and the fingerprints can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves behind goes as soon as its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope() as kept:
            after = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(after)
        forget(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
