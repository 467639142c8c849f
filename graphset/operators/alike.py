"""Work done once for all graphs that are alike.

Small graphs with few labels repeat: what follows from a graph alone is worked out for one graph of each class, the one of the
smallest id, and its rows are then given to every graph of the class.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphset.storage import HOT_SHARE, SALTS, is_small, save

#: Graphs with more vertices or edges than this are never brought into one row; each is a class of its own.
ROWS_IN_ROW = 1_000


@dataclass(frozen=True)
class Alike:
    """``v`` and ``e`` hold one graph of each class; ``members`` (gid, first), ``sizes`` (gid, weight) and ``hot`` (first) say
    which graphs it stands for, how many, and which classes are so large that their graphs are dealt over many tasks."""

    v: DataFrame
    e: DataFrame
    members: DataFrame
    sizes: DataFrame
    hot: DataFrame

    def spread(self, rows: DataFrame) -> DataFrame:
        """The rows (gid, …) of the first graphs, for each graph that they stand for."""
        salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64("gid"), F.lit(SALTS))).otherwise(0)
        salts = F.when(F.col("is_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
        hot = F.broadcast(self.hot.withColumn("is_hot", F.lit(True)))
        to = self.members.join(hot, "first", "left").withColumn("salt_of_class", salt).drop("is_hot")
        given = rows.withColumnRenamed("gid", "first").join(hot, "first", "left").withColumn("salt_of_class", F.explode(salts)).drop("is_hot")
        return to.join(given.hint("merge"), ["first", "salt_of_class"]).select(*rows.columns)


def alike(v: DataFrame, e: DataFrame, written: bool = False) -> Alike:
    """Graphs are alike if their vertices and edges agree in all columns but gid; tables that are written are not written again."""
    if not written:
        v, e = save(v), save(e)
    large = v.groupBy("gid").count().unionByName(e.groupBy("gid").count()).filter(F.col("count") > ROWS_IN_ROW)
    large = save(large.select("gid").distinct())
    # vertices and edges of a graph come together by one shuffle
    vs, es = (F.struct(*(c for c in df.columns if c != "gid")) for df in (v, e))
    kinds = [f"{name} struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in df.schema.fields if f.name != 'gid')}>" for df, name in ((v, "vs"), (e, "es"))]
    none = [F.lit(None).cast(kind.split(" ", 1)[1]) for kind in kinds]
    rows = v.select("gid", vs.alias("vs"), none[1].alias("es")).union(e.select("gid", none[0].alias("vs"), es.alias("es")))
    packed = rows.join(large, "gid", "left_anti").groupBy("gid").agg(*(F.array_sort(F.collect_list(c)).alias(c) for c in ("vs", "es")))
    # the digest of all that a graph has stands for it
    keyed = packed.select("gid", F.unhex(F.sha2(F.to_json(F.struct("vs", "es")), 256)).alias("key"))
    keyed = save(keyed.unionByName(large.select("gid", F.concat(F.lit("large "), F.col("gid").cast("string")).cast("binary").alias("key"))))
    classes = save(keyed.groupBy("key").agg(F.min("gid").alias("first"), F.count("*").alias("weight")))
    total = classes.agg(F.sum("weight")).first()[0] or 0
    # fewer than the inverse of the share
    hot = save(classes.filter(F.col("weight") > total * HOT_SHARE).select("key", "first"))
    plain = keyed.join(F.broadcast(hot.select("key", "first")), "key", "left")
    met = plain.filter("first IS NOT NULL").select("gid", "first")
    rest = plain.filter("first IS NULL").select("gid", "key").join(classes.select("key", "first").hint("merge"), "key").select("gid", "first")
    sizes = classes.select(F.col("first").alias("gid"), "weight")
    firsts = F.broadcast(sizes.select("gid")) if is_small(classes) else sizes.select("gid")
    return Alike(save(v.join(firsts, "gid", "left_semi")), save(e.join(firsts, "gid", "left_semi")), save(met.unionByName(rest)), sizes, hot.select("first"))


def once(v: DataFrame, e: DataFrame, work: Callable[[DataFrame, DataFrame], DataFrame], written: bool = False) -> DataFrame:
    """``work(v, e)``, a table with gid whose rows follow from each graph alone, done once for all graphs that are alike."""
    some = alike(v, e, written)
    return some.spread(save(work(some.v, some.e)))
