"""A corpus pipeline of five operators: each stage works on all that the stage before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of ``documents``; the last adds
``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

Defined cases: null and empty texts are neither toxic, nor copies of each other, nor contaminated, and have no secrets; they
stay.  Rows alike are one group in the join, of which one row stays; ids may be null or repeat, for rows are numbered or told
apart by their content.  Of equal ids in a group any one row stays, the same in each run over the same files.  Long texts are
read whole.  An empty table passes through as an empty one.  ``docs`` has the columns of ``documents``; names that a stage
uses inside are never among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphset.llm.common import save, small_batches, table
from graphset.llm.decontaminate import decontaminate
from graphset.llm.jaccard_join import jaccard_classes
from graphset.llm.mix_sources import mix_sources
from graphset.llm.secret_findings import labelled_findings
from graphset.llm.secret_scan import fit_forest, redact_secrets
from graphset.llm.toxicity import fit, held_out, keep_civil


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine calls toxic go."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return keep_civil(docs, fit(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join the row of the smallest id stays (null ids last)."""
    small_batches(spark)
    # written once, so that a row keeps its number whatever becomes of executors
    numbered = save(docs.withColumn("row_number_in_docs", F.monotonically_increasing_id()))
    classes = jaccard_classes(numbered, id_col="row_number_in_docs")
    ids = numbered.select("row_number_in_docs", "doc_id")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_number_in_docs")
    keep = classes.join(ids, "row_number_in_docs").groupBy("component_id").agg(F.min(place).alias("first")).select(F.col("first.row_number_in_docs").alias("row_number_in_docs"))
    return numbered.join(save(keep), "row_number_in_docs", "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are masked, and n_chars follows the text."""
    small_batches(spark)
    masked = redact_secrets(docs, fit_forest(labelled_findings(spark)))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the copies of each."""
    small_batches(spark)
    numbered = save(docs.withColumn("row_number_in_docs", F.monotonically_increasing_id()))
    plan = mix_sources(numbered, id_col="row_number_in_docs").select("row_number_in_docs", "size", "source_size", "target", "copies", "taken")
    return numbered.join(save(plan.filter("copies > 0")), "row_number_in_docs").drop("row_number_in_docs")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix),
]

#: Trained models, tiles and joins over all n-grams cannot be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
