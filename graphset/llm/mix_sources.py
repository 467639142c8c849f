"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

Each source has a target of words.  Among all document rates between 0 and ``most`` that meet the targets, entropy balancing
takes those closest to 1 in the sense of relative entropy.  Its convex dual has one multiplier for each source's word
constraint, and the rate of a document is tilted by its own share in that constraint: min(most, exp(multiplier * size / mean
size of the source)).  Newton's iteration finds all multipliers at once: each step sums mass and slope of the dual over all
documents of each source (over the counts of documents by source and size, which is the same sum), and a bracket that
shrinks with each step keeps it from running off.  Long documents are thus thinned out, or repeated, before short ones are.

Rates become copies: every document gets the whole part, and along each source's documents by (size, hash of the id) one more
wherever the running sum of the fractions passes a half.  Neighbours in that order are of nearly equal size, so that the words
taken differ from the target by half the longest document at most.  Fractions are counted in steps of 2**-24, so sums are
exact in any order.  The running sum is taken inside ranges of equal numbers of documents and then over the ranges, so no
source is one task's work.

Defined cases: a null or empty text has size 0 and one copy; null sources are one source, the last; the rank of a source is
its place by code point; where all sizes are 0, so are targets and words taken.  Long texts count whole.  Every input row
gives one output row, an empty table none; rows alike in all that is read are interchangeable; null ids come first in the
order of hashes.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphset.llm.common import numbered, save

#: Weights of the sources by rank, repeating; share of all words that the mix takes; the most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Newton steps at most (fewer than 10 are usual), and the relative error of a source's mass at which they end.
STEPS, ERROR = 80, 1e-12
#: Steps in which a copy's fraction is counted: 2**24.
DIGITS = 24
UNIT = 1 << DIGITS


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): shares by weight, capped at ``most`` times the size, the
    excess shared again by weight until no target is above its cap."""
    ws = F.array(*(F.lit(float(w)) for w in weights))
    ranked = numbered(sources.withColumn("last", F.col("source").isNull()), "last", "source", name="rank")
    table = ranked.withColumn("weight", F.element_at(ws, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    table = save(table.select("source", "source_size", "weight", "cap"))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        used, rest, n = table.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        if n == capped or rest == 0:
            break
        level, capped = (total - used) / rest, n
    return table.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def source_key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def tilt(size: Column, most: int) -> Column:
    """The rate of a document of that size, from its source's mean size and multiplier."""
    return F.least(F.exp(F.col("multiplier") * size / F.col("mean")), F.lit(float(most)))


def multipliers(groups: DataFrame, goals: DataFrame, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """s, source_size, target, mean, multiplier of each source: the dual's solution by distributed Newton steps.

    ``groups``: s, size, n (documents of that source and size); ``goals``: s, source_size, target.
    """
    sized = groups.filter("size > 0")
    facts = sized.groupBy("s").agg(F.sum("n").alias("docs"), F.min("size").alias("least"))
    wanted = F.col("target") / F.col("source_size")
    # the least document's rate alone bounds the multiplier: at its bracket's ends the mass lies beyond the target
    edge = F.when(wanted >= 1, F.log(F.lit(float(most)))).otherwise(F.log(wanted)) * F.col("mean") / F.col("least")
    state = goals.join(facts, "s").withColumn("mean", F.col("source_size") / F.col("docs"))
    full = F.col("target") >= F.col("source_size") * float(most)
    state = state.select("s", "source_size", "target", "mean", F.least(edge, F.lit(0.0)).alias("low"), F.greatest(edge, F.lit(0.0)).alias("high"), F.when(full, edge).otherwise(0.0).alias("multiplier"), full.alias("done"))
    state = save(state)
    for turn in range(steps):
        if turn % 2 == 0 and state.filter("NOT done").isEmpty():
            break
        rate = tilt(F.col("size"), most)
        words = F.col("n") * F.col("size")
        sums = sized.join(state.filter("NOT done").select("s", "mean", "multiplier"), "s").groupBy("s").agg(
            F.sum(words * rate).alias("mass"), F.sum(F.when(rate < most, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope")
        )
        at = state.join(sums, "s", "left")
        over = F.col("mass") - F.col("target")
        low, high = F.when(over < 0, F.col("multiplier")).otherwise(F.col("low")), F.when(over > 0, F.col("multiplier")).otherwise(F.col("high"))
        # on the logarithm of the mass, which is nearly straight in the multiplier
        newton = F.col("multiplier") - F.log(F.col("mass") / F.col("target")) * F.col("mass") / F.nullif(F.col("slope"), F.lit(0.0))
        middle = (low + high) / 2
        step = F.when((newton > low) & (newton < high), newton).otherwise(middle)
        close = (F.abs(over) <= F.col("target") * ERROR) | (step == F.col("multiplier"))
        state = save(
            at.select(
                "s", "source_size", "target", "mean",
                F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
                F.when(F.col("done") | close, F.col("multiplier")).otherwise(step).alias("multiplier"),
                (F.col("done") | close).alias("done"),
            )
        )
    return state.select("s", "source_size", "target", "mean", "multiplier")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, **options) -> DataFrame:
    """id, source, size, source_size, target, rate, copies, taken for each row of ``docs``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit(""))
    source = F.col(source_col).cast("string")
    sized = docs.select(F.col(id_col).alias("id"), source.alias("source"), source_key(source).alias("s"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("tie"))
    # written once: numbers of rows alike, and the ranges below, are what they are from here on
    sized = save(sized)
    order = ["s", "size", "key", "tie"]
    dealt = save(sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    groups = save(dealt.groupBy("s", "size").agg(F.count("*").alias("n")))
    sources = groups.groupBy("s").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")).withColumn("source", F.when(F.col("s") != "", F.expr("substring(s, 2)")))
    goals = save(targets(sources.select("source", "source_size"), most=most, **options).withColumn("s", source_key(F.col("source"))))
    solved = multipliers(groups, goals.select("s", "source_size", "target"), most)
    plan = goals.select("s", "source_size", "target").join(solved.select("s", "mean", "multiplier"), "s", "left")
    # a source has a row for each range that it reaches into, so no join is on a hot source
    here = save(dealt.select("part", "s").distinct().join(plan, "s"))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("target") >= F.col("source_size") * float(most), F.lit(float(most))).otherwise(F.coalesce(tilt(F.col("size"), most), F.lit(0.0)))
    rated = dealt.join(here, ["part", "s"]).withColumn("rate", rate)
    rated = rated.withColumns({"whole": F.floor("rate"), "fraction": F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long")})
    sums = rated.groupBy("s", "part").agg(F.sum("fraction").alias("sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    inside = F.sum("fraction").over(Window.partitionBy("part", "s").orderBy("size", "key", "tie").rowsBetween(Window.unboundedPreceding, 0))
    out = rated.withColumn("inside", inside).join(save(before), ["part", "s"]).withColumn("run", F.col("before") + F.col("inside"))

    def passed(run: Column) -> Column:
        return F.shiftright(run + UNIT // 2, DIGITS)

    more = passed(F.col("run")) - passed(F.col("run") - F.col("fraction"))
    out = out.withColumn("copies", (F.col("whole") + more).cast("int"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
