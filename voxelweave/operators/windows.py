"""Rankings, runs of levels, neighbours and moving sums within a study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.session import cut


def first_by(df: DataFrame, group: list[str], *order: Column, top: int = 1) -> DataFrame:
    """The first rows of each group in an order. Ties must be broken by the order itself."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= top).drop("_r")


def midpoint_slabs(levels: DataFrame, group: list[str], ordinal: str, center: str) -> DataFrame:
    """Slabs split half-way between the centres of neighbour levels; the outer ends mirror the half gap.

    A level without neighbours has no slab (nulls). Levels follow each other by ordinal.
    """
    w = W.partitionBy(*group).orderBy(ordinal)
    before, after = F.lag(center).over(w), F.lead(center).over(w)
    half = lambda o: (F.col(center) - o) / 2
    low = F.when(before.isNotNull(), F.col(center) - half(before)).when(after.isNotNull(), F.col(center) + half(after))
    high = F.when(after.isNotNull(), F.col(center) - half(after)).when(before.isNotNull(), F.col(center) + half(before))
    return levels.withColumns({"low": F.least(low, high), "high": F.greatest(low, high)})


def longest_block(levels: DataFrame, group: list[str], ordinal: str) -> DataFrame:
    """The longest run of consecutive ordinals, the first of equals: its first ordinal and length."""
    one = levels.select(*group, ordinal).distinct()
    island = one.withColumn("_i", F.col(ordinal) - F.row_number().over(W.partitionBy(*group).orderBy(ordinal)))
    blocks = island.groupBy(*group, "_i").agg(F.min(ordinal).alias("first"), F.count("*").alias("length")).drop("_i")
    return first_by(blocks, group, F.col("length").desc(), F.col("first"))


def adjacent_reference(levels: DataFrame, group: list[str], ordinal: str, height: str, valid: Column) -> DataFrame:
    """Each level with the mean height of its nearest valid levels on both sides, and its loss against it."""
    v = F.when(valid, F.col(height))
    w = W.partitionBy(*group).orderBy(ordinal)
    below = F.last(v, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    above = F.first(v, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    out = levels.withColumns({"_b": below, "_a": above})
    ref = F.when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), (F.col("_b") + F.col("_a")) / 2).otherwise(F.coalesce("_b", "_a"))
    return out.withColumn("reference", ref).withColumn("loss", 1 - F.try_divide(F.col(height), F.col("reference"))).drop("_b", "_a")


def moving_average(df: DataFrame, group: list[str], order: str, value: str, width: int = 3) -> DataFrame:
    """Centred mean over a window whose missing ends count as zero."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return df.withColumn("smooth", F.sum(value).over(w) / width)


def window_median(df: DataFrame, group: list[str], order: str, value: str, width: int = 5) -> DataFrame:
    """Median of a centred window, clipped at the ends."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return df.withColumn("median", F.percentile(value, 0.5).over(w))


def interpolate(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Missing values on the line between their known neighbours; ends keep the nearest known value."""
    w = W.partitionBy(*group).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("o"), F.col(value).cast("double").alias("v")))
    out = df.withColumn("_p", F.last(known, ignorenulls=True).over(w)).withColumn("_n", F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    part = F.try_divide(F.col(order) - F.col("_p.o"), F.col("_n.o") - F.col("_p.o"))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * part
    return out.withColumn("filled", F.coalesce(F.col(value).cast("double"), line, F.col("_p.v"), F.col("_n.v"))).drop("_p", "_n")


def fracture_rollup(grades: DataFrame, group: list[str], complete: Column | None = None) -> DataFrame:
    """Highest grade and worst severity of the complete levels, whether any is suspected, and how many were analysed and left out.

    A level without a grade is indeterminate, which ranks below none; so is a group without complete levels.
    """
    complete = F.lit(True) if complete is None else complete
    grade = F.when(complete, F.col("grade"))
    worst = F.max(F.when(complete, F.coalesce("grade", F.lit(-1))))
    severity = F.coalesce(F.get(F.array(*[F.lit(x) for x in ("none", "mild", "moderate", "severe")]), F.greatest(worst, F.lit(0)).cast("int")), F.lit("indeterminate"))
    severity = F.when(F.coalesce(worst, F.lit(-1)) < 0, "indeterminate").otherwise(severity)
    return grades.groupBy(*group).agg(
        F.max(grade).alias("max_grade"), F.coalesce(F.bool_or(grade > 0), F.lit(False)).alias("suspicion"), severity.alias("severity"),
        F.count_if(F.coalesce(complete, F.lit(False))).alias("n_analyzed"), F.count_if(~F.coalesce(complete, F.lit(False))).alias("n_incomplete"),
    )


def effusion_qc(sides: DataFrame, group: list[str], volume: str, least: float) -> DataFrame:
    """Volume of the sides that reach `least`, and how many don't."""
    keep = F.col(volume) >= least
    return sides.groupBy(*group).agg(F.sum(F.when(keep, F.col(volume)).otherwise(0)).alias("kept"), F.count_if(~keep).alias("dropped"))


def version(df: DataFrame, study: str, identity: list[str], at: str) -> DataFrame:
    """Version numbers per study: each new identity, in order of first appearance, is one more; a repeat keeps its number."""
    first = df.groupBy(study, *identity).agg(F.min(at).alias("_at"))
    w = W.partitionBy(study).orderBy("_at", *identity)
    return first.withColumn("version", F.row_number().over(w)).drop("_at")


def artifact_order(df: DataFrame, group: list[str], position: str, original: str) -> DataFrame:
    """Place of each artifact in its group: by position where it has one, else after those by original order."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(F.col(position).asc_nulls_last(), original)))


def purge_plan(
    cases: DataFrame, order: list[str], size: str, total_bytes: float, most_percent: float = 0.0, least_free: float = 0.0, most_cases: int = 0, expired: Column | None = None, protected: DataFrame | None = None, key: str = "case_id"
) -> DataFrame:
    """The oldest unprotected cases to delete until every rule that is on holds, with freed_before, place and used_percent_after.

    A case goes while, with all older ones gone, the disk is used to `most_percent` of `total_bytes` or more, less than
    `least_free` bytes are free, or more than `most_cases` cases (protected ones too) are left; or if it is `expired`
    itself, which must be monotone in the order. A limit of 0 is off. What is used is the sum of all sizes.

    Running sums are built in two steps, so that no task holds the whole table: sums of ranges of the order, whose
    number is that of the shuffle partitions, and sums within a range.
    """
    n = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    used, resident = cases.agg(F.coalesce(F.sum(size), F.lit(0)).cast("double"), F.count("*")).first()
    free = cases if protected is None else cases.join(protected.select(key).distinct().hint("merge"), key, "left_anti")
    dealt = cut(free.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum(size).alias("_sum"), F.count("*").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_freed"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_gone"))
    mine = W.partitionBy("_part").orderBy(*order)
    within = F.coalesce(F.sum(size).over(mine.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    both = dealt.withColumns({"_within": within, "_row": F.row_number().over(mine)}).join(F.broadcast(before), "_part")  # one row a partition
    both = both.withColumns({"freed_before": F.col("_freed") + F.col("_within"), "place": F.col("_gone") + F.col("_row")})
    left = F.lit(used) - F.col("freed_before")
    rules = [expired] if expired is not None else []
    if most_percent > 0:
        rules.append(left / total_bytes * 100 >= most_percent)
    if least_free > 0:
        rules.append(total_bytes - left < least_free)
    if most_cases > 0:
        rules.append(F.lit(resident) - F.col("place") + 1 > most_cases)
    fires = F.lit(False)
    for rule in rules:
        fires = fires | F.coalesce(rule, F.lit(False))
    return both.where(fires).withColumn("used_percent_after", (left - F.col(size)) / total_bytes * 100).drop("_part", "_within", "_row", "_freed", "_gone")
