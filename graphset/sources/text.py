"""Readers and writers of graph text, blocks, molecules, corpora, features and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphset.storage import save


def read_graph_text(spark: SparkSession, path: str, gid: str = "ordinal", directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Graphs from ``t # id`` / ``v id label`` / ``e from to label`` lines; a file ends at ``t # -1``.

    Edges are read as arcs if ``directed``, else with the smaller end first.  The graph's id is the ordinal of its ``t`` line, or with ``gid='label'`` the number on it.  One record is one graph, cut
    at line starts, so that files are split and graphs never are gathered in one task; several files follow in their order
    by name, in whatever order Spark reads them.
    """
    raw = spark.read.option("lineSep", "\nt").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # inside a block of a file, records come in their order
    raw = raw.withColumn("at", F.monotonically_increasing_id())
    head = F.trim(F.regexp_replace(F.split("value", "\n")[0], "^t", ""))
    graph = save(raw.select("file", "block", "at", "value", F.regexp_extract(head, r"#\s*(-?\d+)", 1).alias("label")).filter("label <> ''"))
    ends = graph.filter("label = '-1'").groupBy("file").agg(F.min(F.struct("block", "at")).alias("end"))
    graph = graph.join(ends, "file", "left").filter(F.col("end").isNull() | (F.struct("block", "at") < F.col("end"))).drop("end")
    if gid == "label":
        graph = graph.withColumn("gid", F.col("label").cast("long"))
    else:
        # one row for each block of a file
        sizes = graph.groupBy("file", "block").agg(F.count("*").alias("k"))
        before = sizes.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
        own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
        graph = graph.withColumn("own", own).join(before, ["file", "block"]).withColumn("gid", F.col("own") + F.col("before"))
    line = graph.select("gid", F.posexplode(F.split("value", "\n")).alias("pos", "line")).select("gid", "pos", F.split(F.trim("line"), " ").alias("f"))
    v = line.filter(F.col("f")[0] == "v").select("gid", F.col("f")[1].cast("int").alias("vid"), F.col("f")[2].alias("vlb"))
    e = line.filter(F.col("f")[0] == "e").select("gid", "pos", F.col("f")[1].cast("int").alias("src"), F.col("f")[2].cast("int").alias("dst"), F.col("f")[3].alias("elb"))
    e = e.withColumn("eid", F.row_number().over(Window.partitionBy("gid").orderBy("pos")) - 1)
    e = e.select("gid", "eid", "src", "dst", "elb")
    return v, e if directed else e.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def graph_text(v: DataFrame, e: DataFrame) -> DataFrame:
    """gid, value: each graph as text, vertices by id, then edges; each field is followed by a space."""
    vs = v.groupBy("gid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vid", "vlb"))), lambda x: F.concat(F.lit("v "), x["vid"], F.lit(" "), x["vlb"], F.lit(" "))), "\n").alias("vs"))
    es = e.groupBy("gid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("eid", "src", "dst", "elb"))), lambda x: F.concat(F.lit("e "), x["src"], F.lit(" "), x["dst"], F.lit(" "), x["elb"], F.lit(" "))), "\n").alias("es"))
    return vs.join(es, "gid", "left").select("gid", F.concat_ws("\n", F.concat(F.lit("t # "), F.col("gid").cast("string"), F.lit(" ")), "vs", "es").alias("value"))


def write_graph_text(v: DataFrame, e: DataFrame, path: str) -> None:
    """Graph text by ascending gid, range-partitioned over files, with one closing ``t # -1`` in the last."""
    end = v.sparkSession.createDataFrame([(1, 0, "t # -1")], "last int, gid long, value string")
    rows = graph_text(v, e).select(F.lit(0).alias("last"), F.col("gid").cast("long").alias("gid"), "value").unionByName(end)
    rows.orderBy("last", "gid").select("value").write.text(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Building blocks from CSV with an index column and a header."""
    return spark.read.option("header", True).schema("id long, block string").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_smi(spark: SparkSession, path: str) -> DataFrame:
    """smiles, id from tab-separated .smi or .ism files, also gzipped."""
    if not path.removesuffix(".gz").endswith((".smi", ".ism")):
        raise ValueError(f"neither .smi nor .ism: {path}")
    return spark.read.option("sep", "\t").schema("smiles string, id string").csv(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """tokens: a line is a sentence."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("tokens"))


def read_fscores(df: DataFrame) -> DataFrame:
    """fid, score from (pos, row) with rows [score, id, id, …]; the last score of an id wins."""
    at = df.select("pos", F.col("row")[0].cast("double").alias("score"), F.explode(F.slice("row", 2, F.greatest(F.size("row") - 1, F.lit(0)))).alias("fid"))
    return at.groupBy("fid").agg(F.max_by("score", "pos").alias("score"))


def write_patterns(patterns: DataFrame, occ: DataFrame, path: str) -> None:
    patterns.write.option("header", True).csv(f"{path}/patterns")
    occ.write.option("header", True).csv(f"{path}/occurrences")


def write_vocab(dictionary: DataFrame, path: str) -> None:
    dictionary.orderBy("label_id").write.option("header", True).csv(path)


def write_corpus(tokens: DataFrame, path: str, kind: str = "alt") -> None:
    """One sentence a line: 'alt' and 'all' in one folder, 'individual' in one folder for each radius r."""
    line = F.array_join("tokens", " ").alias("value")
    if kind == "individual":
        tokens.select("r", line).write.partitionBy("r").text(path)
    else:
        tokens.select(line).write.text(path)


def feature_columns(df: DataFrame, column: str = "vector", prefix: str = "feature-") -> DataFrame:
    """The vector spread over columns ``prefix`` 000, 001, … behind the others."""
    first = df.select(F.size(column)).filter(F.col(column).isNotNull()).first()
    keep = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*keep, *(F.col(column)[i].alias(f"{prefix}{i:03d}") for i in range(first[0] if first else 0)))


def write_features(df: DataFrame, path: str, column: str = "vector", prefix: str = "feature-") -> None:
    """Input columns and ``feature_columns`` as CSV."""
    feature_columns(df, column, prefix).write.option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    df.orderBy(F.desc("score")).write.option("header", True).csv(path)


def save_mining(patterns: DataFrame, occ: DataFrame, path: str) -> None:
    patterns.write.parquet(f"{path}/patterns")
    occ.write.parquet(f"{path}/occurrences")


def load_mining(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/patterns"), spark.read.parquet(f"{path}/occurrences")
